"""Queries over the engine's operators, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import BY_FIELD, EXTREMES, FEATURE_COLUMNS, FIELDS, MINUTE_FEATURES, NEWS2_BANDS
from pulsegrid.operators import access, dashboards, ingest, quality, ranking, scd, simulate, star, stats
from pulsegrid.operators import features as feats
from pulsegrid.plans.domain import CONFIG, SQL_STAMP, STAMP, Domain, sql
from pulsegrid.plans.registry import register
from pulsegrid.session import keep
from pulsegrid.streaming import state

_TIMES = {"effective_datetime", "received_at", "encounter_start_at", "encounter_end_at", "feature_cutoff_at", "outcome_cutoff_at", "scored_at_ts", "admitted_at", "discharged_at", "hour_start", "time", "latest_measured", "latest_received"}
_DATES = {"full_date", "valid_from", "valid_to", "birth_date"}


def show(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Columns in plain types: times and dates as text, fractions rounded, whole numbers as long."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        kind = kinds[c]
        x = F.col(c)
        if kind.startswith("timestamp"):
            x = F.date_format(x, STAMP)
        elif kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            x = F.round(x.cast("double"), digits)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            x = x.cast("long")
        out.append(x.alias(c))
    return df.select(*out)


def shown(columns: list[str], times: set[str] | None = None, dates: set[str] | None = None, doubles: set[str] | None = None, longs: set[str] | None = None, digits: int = 6) -> str:
    """The same in SQL; the kinds are named."""
    out = []
    for c in columns:
        if c in (times or _TIMES):
            out.append(f"strftime({c}, '{SQL_STAMP}') AS {c}")
        elif c in (dates or _DATES):
            out.append(f"strftime({c}, '%Y-%m-%d') AS {c}")
        elif doubles and c in doubles:
            out.append(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}")
        elif longs and c in longs:
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def simple(name: str, relation: str, columns: list[str], build, doubles: set[str] = frozenset(), longs: set[str] = frozenset(), where: str = "") -> None:
    """Registers a query that shows columns of a relation."""
    text = sql(f"SELECT {shown(columns, doubles=doubles, longs=longs)} FROM {relation} {where}", relation)
    register(name, text)(lambda spark, sf: show(build(Domain(spark, sf)), columns))


# ---- ingest ----

CANDIDATE = ["observation_id", "patient_id", "encounter_id", "observation_type", "loinc_code", "value", "unit", "effective_datetime", "received_at", "source"]
simple("prj1_unpivot_measurements", "candidates", CANDIDATE, lambda d: d.candidates, {"value"})
simple("flt2_quality_classifier", "classified", ["observation_id", "loinc_code", "value", "rejection_reason"], lambda d: ingest.classify(d.candidates), {"value"})
simple("win1_latest_records", "processed", [*CANDIDATE, "year", "month", "day"], lambda d: d.processed, {"value"}, {"year", "month", "day"})
simple("flt3_quarantine", "classified", ["observation_id", "loinc_code", "value", "rejection_reason"], lambda d: ingest.split(d.candidates)[1], {"value"}, where="WHERE rejection_reason IS NOT NULL")


@register("flt4_local_rules", sql("SELECT observation_id, loinc_code, CASE WHEN rejection_reason IN ('missing_observation_id', 'missing_patient_id', 'physiological_range_violation') THEN rejection_reason WHEN rejection_reason = 'missing_effective_datetime' AND NOT ok THEN 'physiological_range_violation' END AS rejection_reason FROM (SELECT *, value BETWEEN " + "CASE loinc_code " + " ".join(f"WHEN '{v.loinc}' THEN {v.analytical[0]}" for v in BY_FIELD.values()) + " END AND CASE loinc_code " + " ".join(f"WHEN '{v.loinc}' THEN {v.analytical[1]}" for v in BY_FIELD.values()) + " END AS ok FROM classified)", "classified"))
def local_rules(spark, sf):
    return ingest.classify(Domain(spark, sf).candidates, local=True).select("observation_id", "loinc_code", "rejection_reason")


@register("snk5_run_metrics", sql("SELECT 'run' AS run_started_at, count(*) AS candidate_count, count(*) FILTER (rejection_reason IS NULL) AS valid_count, count(rejection_reason) AS rejected_count FROM classified", "classified"))
def run_metrics(spark, sf):
    return ingest.run_metrics(Domain(spark, sf).candidates, "run")


_HALVES = {
    "old": "SELECT observation_id, loinc_code, encounter_id, value, received_at FROM processed WHERE length(observation_id) % 2 = 0 OR CAST(strftime(effective_datetime, '%d') AS INTEGER) < 15",
    "fresh": "SELECT observation_id, loinc_code, encounter_id, value + 1 AS value, CASE WHEN day % 3 = 0 THEN received_at ELSE received_at + INTERVAL 1 HOUR END AS received_at FROM processed WHERE day >= 10",
}


def _merge_sql(test: str, delete: bool) -> str:
    gone = "WHERE NOT (f.observation_id IS NULL AND coalesce(o.encounter_id IN (SELECT encounter_id FROM fresh WHERE encounter_id IS NOT NULL), false))" if delete else ""
    body = (
        f"SELECT coalesce(o.observation_id, f.observation_id) AS observation_id, coalesce(o.loinc_code, f.loinc_code) AS loinc_code, "
        f"round(CASE WHEN o.observation_id IS NULL OR f.received_at {test} o.received_at THEN f.value ELSE o.value END, 6) AS value "
        f"FROM old o FULL OUTER JOIN fresh f ON o.observation_id = f.observation_id AND o.loinc_code = f.loinc_code {gone}"
    )
    return sql("", "processed").rstrip() + f", old AS ({_HALVES['old']}), fresh AS ({_HALVES['fresh']}) {body}"


def _merge(tie: str, delete: bool):
    def build(spark, sf):
        p = Domain(spark, sf).processed
        cols = ["observation_id", "loinc_code", "encounter_id"]
        old = p.where((F.length("observation_id") % 2 == 0) | (F.dayofmonth("effective_datetime") < 15)).select(*cols, "value", "received_at")
        later = F.when(F.col("day") % 3 == 0, F.col("received_at")).otherwise(C.add_hours(F.col("received_at"), 1))
        fresh = p.where("day >= 10").select(*cols, (F.col("value") + 1).alias("value"), later.alias("received_at"))
        return show(ingest.merge(old, fresh, tie, delete), ["observation_id", "loinc_code", "value"])

    return build


register("snk3_merge_strict", _merge_sql(">", False))(_merge("strict", False))
register("snk6_merge_incoming_delete_missing", _merge_sql(">=", True))(_merge("incoming", True))


def _event_error_sql() -> str:
    checks = ["WHEN trim(coalesce(observation_id, '')) = '' THEN 'observation_id must be a non-empty string'", "WHEN trim(coalesce(patient_id, '')) = '' THEN 'patient_id must be a non-empty string'"]
    checks += ["WHEN encounter_id IS NULL THEN 'encounter_id is required for schema_version 1.2'", "WHEN source IS NULL THEN 'source must be a non-empty string'", "WHEN try_cast(event_timestamp AS TIMESTAMP) IS NULL THEN 'event_timestamp is not valid ISO-8601'"]
    for f in FIELDS:
        v = BY_FIELD[f]
        if v.ordinal:
            checks.append(f"WHEN {f} <> floor({f}) THEN '{f} must be a whole-number ordinal'")
        checks.append(f"WHEN {f} NOT BETWEEN {v.realtime[0]} AND {v.realtime[1]} THEN '{f} must be between {v.realtime[0]:g} and {v.realtime[1]:g}'")
    return "CASE " + " ".join(checks) + " END"


@register("flt6_event_validator", sql(f"SELECT event_id, {_event_error_sql()} AS error FROM wide", "wide"))
def event_validator(spark, sf):
    rows = Domain(spark, sf).wide.withColumn("schema_version", F.lit("1.2"))
    return rows.select("event_id", ingest.event_error(rows).alias("error"))


@register("str5_legacy_ids", sql("SELECT observation_id, count(*) AS n FROM candidates WHERE observation_id LIKE 'legacy%' GROUP BY 1", "candidates"))
def legacy_ids(spark, sf):
    return Domain(spark, sf).candidates.where("observation_id like 'legacy%'").groupBy("observation_id").agg(F.count(F.lit(1)).alias("n"))


# ---- star schema ----

simple("gm1_staged_observations", "staged", CANDIDATE, lambda d: d.staged, {"value"})
simple("gm8_dim_provider", "providers", ["provider_version_key", "provider_key", "provider_npi", "provider_name", "taxonomy_code", "taxonomy_description", "provider_state", "valid_from", "valid_to", "is_current", "data_source"], lambda d: d.providers)
simple("gm3_dim_encounter", "encounters", ["encounter_key", "encounter_id", "encounter_reference", "patient_key", "patient_id", "provider_key", "provider_version_key", "encounter_start_at", "encounter_end_at", "is_synthetic_provider_assignment"], lambda d: d.encounters)
simple("gm4_dim_facility", "facilities", ["facility_key", "facility_id", "facility_name", "city", "state"], lambda d: d.facilities)
simple("gm9_dim_unit", "units", ["unit_key", "facility_key", "facility_id", "facility_name", "unit_name", "care_level", "care_level_rank"], lambda d: d.units, longs={"care_level_rank"})
simple("gm7_dim_patient_version", "versions", ["patient_version_key", "patient_key", "patient_id", "birth_date", "gender", "race", "ethnicity", "marital_status", "state", "payer_name", "valid_from", "valid_to", "is_current"], lambda d: d.versions)
simple("gm10_fact_observations", "facts", ["fact_observation_key", "patient_key", "encounter_key", "provider_key", "provider_version_key", "observation_type_key", "date_key", "observation_id", "loinc_code", "value", "effective_datetime"], lambda d: d.facts, {"value"}, {"date_key"})
ADMISSION = ["admission_key", "encounter_key", "patient_key", "patient_version_key", "provider_key", "provider_version_key", "facility_key", "unit_key", "admit_date_key", "encounter_id", "run_id", "scenario", "admitted_at", "discharged_at", "length_of_stay_hours", "unit", "diagnosis_code", "diagnosis_display", "diagnosis_source", "attending_npi", "attending_taxonomy_code", "attending_specialty", "birth_date", "age_at_admission_years"]
simple("gm11_fact_admissions", "fact_admissions", ADMISSION, lambda d: d.fact_admissions, longs={"admit_date_key", "length_of_stay_hours", "age_at_admission_years"})
simple("agg21_payer_periods", "payer_history", ["patient_id", "payer_name", "valid_from", "valid_to"], lambda d: d.payer_history)

CALENDAR = ["date_key", "full_date", "calendar_year", "calendar_quarter", "month_number", "month_name", "day_of_month", "iso_day_of_week", "day_name", "iso_week_of_year"]


@register("gm2_dim_date", sql("SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, strftime(d, '%Y-%m-%d') AS full_date, year(d) AS calendar_year, quarter(d) AS calendar_quarter, month(d) AS month_number, monthname(d) AS month_name, day(d) AS day_of_month, isodow(d) AS iso_day_of_week, dayname(d) AS day_name, week(d) AS iso_week_of_year FROM (SELECT DISTINCT CAST(effective_datetime AS DATE) AS d FROM staged)", "staged"))
def dim_date(spark, sf):
    return show(star.dim_date(Domain(spark, sf).staged), CALENDAR)


@register("gm5_dim_observation_type", sql("SELECT DISTINCT md5(loinc_code) AS observation_type_key, observation_type, loinc_code, unit, 'http://loinc.org' AS code_system FROM staged", "staged"))
def dim_observation_type(spark, sf):
    return star.dim_observation_type(Domain(spark, sf).staged)


@register("gm6_dim_patient", sql("SELECT DISTINCT md5(patient_id) AS patient_key, patient_id, 'Patient/' || patient_id AS patient_reference, 'HAPI FHIR R4' AS source_system, 'synthetic' AS data_classification FROM staged", "staged"))
def dim_patient(spark, sf):
    return star.dim_patient(Domain(spark, sf).staged)


@register("join17_star_join", sql("SELECT f.fact_observation_key, p.patient_reference, e.encounter_reference, t.code_system, d.month_name, v.provider_name FROM facts f LEFT JOIN (SELECT DISTINCT md5(patient_id) AS patient_key, 'Patient/' || patient_id AS patient_reference FROM staged) p ON f.patient_key = p.patient_key LEFT JOIN encounters e ON f.encounter_key = e.encounter_key LEFT JOIN (SELECT DISTINCT md5(loinc_code) AS k, 'http://loinc.org' AS code_system FROM staged) t ON f.observation_type_key = t.k LEFT JOIN (SELECT DISTINCT CAST(strftime(effective_datetime, '%Y%m%d') AS INTEGER) AS date_key, monthname(effective_datetime) AS month_name FROM staged) d ON f.date_key = d.date_key LEFT JOIN providers v ON f.provider_version_key = v.provider_version_key", "facts", "encounters", "providers", "staged"))
def star_join(spark, sf):
    d = Domain(spark, sf)
    dims = {"patient_key": star.dim_patient(d.staged), "encounter_key": d.encounters, "observation_type_key": star.dim_observation_type(d.staged), "date_key": star.dim_date(d.staged), "provider_version_key": d.providers}
    derived = ("patient_key", "observation_type_key", "date_key")  # tables of their own, read for their size and for the join
    joined = star.star_join(d.facts, {key: keep(dim) if key in derived else dim for key, dim in dims.items()}, CONFIG)
    return joined.select("fact_observation_key", "patient_reference", "encounter_reference", "code_system", "month_name", "provider_name")


@register("join14_overlapping_versions", sql("SELECT a.provider_version_key AS earlier_key, b.provider_version_key AS later_key FROM shifted a JOIN shifted b ON a.provider_npi = b.provider_npi AND a.provider_version_key < b.provider_version_key WHERE a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')", "providers").replace(" SELECT a.provider_version_key AS earlier_key", ", shifted AS (SELECT provider_npi, provider_version_key, CASE WHEN is_current AND provider_npi LIKE '%2' THEN DATE '1995-06-01' ELSE valid_from END AS valid_from, valid_to FROM providers) SELECT a.provider_version_key AS earlier_key"))
def overlapping(spark, sf):
    p = Domain(spark, sf).providers.withColumn("valid_from", F.when(F.col("is_current") & F.col("provider_npi").endswith("2"), F.lit("1995-06-01").cast("date")).otherwise(F.col("valid_from")))
    return scd.overlapping_versions(p, "provider_npi", "provider_version_key")


# ---- features ----

ENCOUNTER = ["encounter_key", "patient_key", "encounter_start_at", "feature_cutoff_at", "outcome_cutoff_at", "feature_observation_count", "outcome_observation_count"]
COUNTS = [f"outcome_{v}_extreme_count" for v in EXTREMES]
simple("gm12_encounter_vital_features", "features", [*ENCOUNTER, *FEATURE_COLUMNS, *COUNTS, "deterioration_proxy_label", "label_definition_version", "is_scoring_eligible", "is_training_eligible"], lambda d: d.features, set(FEATURE_COLUMNS), {"deterioration_proxy_label"})
simple("gm13_minute_features", "minutes", ["encounter_minute_key", "encounter_key", "minute_index", "observation_count", *(m[0] for m in MINUTE_FEATURES)], lambda d: d.minutes, {m[0] for m in MINUTE_FEATURES}, {"minute_index"})
simple("gm15_encounter_news2", "news2", ["encounter_key", "patient_key", *NEWS2_BANDS, "news2_total"], lambda d: d.news2, set(NEWS2_BANDS), {"news2_total"})
simple("gm17_training_dataset", "training", ["encounter_key", "patient_key", *FEATURE_COLUMNS, "deterioration_proxy_label", "feature_schema_version", "split_bucket", "data_split"], lambda d: d.training, set(FEATURE_COLUMNS), {"deterioration_proxy_label", "split_bucket"})
simple("gm18_scoring_dataset", "features", ["encounter_key", "patient_key", *FEATURE_COLUMNS, "label_definition_version"], lambda d: feats.scoring_dataset(d.features), set(FEATURE_COLUMNS), where="WHERE is_scoring_eligible")
CENSUS = ["unit_key", "facility_key", "unit", "hour_start", "census", "admissions", "discharges", "mean_admission_news2", "patients_news2_5_or_more", "patients_news2_7_or_more"]
simple("gm16_unit_hourly_census", "census", CENSUS, lambda d: d.census, {"mean_admission_news2"})


@register("gm14_trend_features", sql("SELECT encounter_key, patient_key, " + ", ".join(f"round(regr_slope({v}_mean, CAST(minute_index AS DOUBLE)), 8) AS {v}_slope" for v in feats.SLOPES) + " FROM minutes GROUP BY 1, 2", "minutes"))
def trend_features(spark, sf):
    return show(feats.trend_features(Domain(spark, sf).minutes), ["encounter_key", "patient_key", *(f"{v}_slope" for v in feats.SLOPES)], 8)


PREDICTION = ["model_version", "encounter_key", "patient_key", "actual_label", "deterioration_probability", "predicted_label", "scored_at"]
simple("gm19_predictions_serving", "predictions", PREDICTION, lambda d: feats.predictions_serving(d.predictions), {"deterioration_probability"}, {"actual_label", "predicted_label"})


@register("gm20_predictions_latest", sql("SELECT model_version, encounter_key, round(deterioration_probability, 6) AS deterioration_probability, 'synthetic_portfolio_only' AS prediction_scope, false AS is_clinically_validated, CASE WHEN predicted_label = 1 THEN 'elevated_proxy' ELSE 'baseline_proxy' END AS proxy_risk_band FROM predictions WHERE model_version = 'm1'", "predictions"))
def predictions_latest(spark, sf):
    return show(feats.predictions_latest(Domain(spark, sf).predictions, "m1"), ["model_version", "encounter_key", "deterioration_probability", "prediction_scope", "is_clinically_validated", "proxy_risk_band"])


@register("win5_latest_prediction_per_patient", sql("SELECT patient_key, encounter_key, round(deterioration_probability, 6) AS deterioration_probability FROM (SELECT *, row_number() OVER (PARTITION BY patient_key ORDER BY scored_at DESC, encounter_key DESC) AS rn FROM predictions) WHERE rn = 1", "predictions"))
def latest_prediction(spark, sf):
    return show(ranking.latest_by(Domain(spark, sf).predictions, ["patient_key"], ["scored_at", "encounter_key"]), ["patient_key", "encounter_key", "deterioration_probability"])


# ---- dashboards ----


def report(name: str, final: str, relations: list[str], build, columns: list[str]) -> None:
    register(name, sql(final, *relations))(lambda spark, sf: show(build(Domain(spark, sf)), columns))


_HOUR = f"strftime(hour_start, '{SQL_STAMP}') AS time"
report("agg16_census_by_unit", f"SELECT {_HOUR}, unit AS metric, CAST(sum(census) AS BIGINT) AS census FROM census GROUP BY 1, 2", ["census"], lambda d: dashboards.census_by_unit(d.census), ["time", "metric", "census"])
report("agg16_census_by_care_level", f"SELECT {_HOUR}, care_level AS metric, CAST(sum(census) AS BIGINT) AS census FROM census JOIN units USING (unit_key) GROUP BY 1, 2", ["census", "units"], lambda d: dashboards.census_by_care_level(d.census, d.units), ["time", "metric", "census"])
report("agg16_flow_per_hour", f"SELECT {_HOUR}, CAST(sum(admissions) AS BIGINT) AS admissions, CAST(sum(discharges) AS BIGINT) AS discharges FROM census GROUP BY 1", ["census"], lambda d: dashboards.flow_per_hour(d.census), ["time", "admissions", "discharges"])
report("agg16_acute_patients", f"SELECT {_HOUR}, unit AS metric, CAST(sum(patients_news2_5_or_more) AS BIGINT) AS patients FROM census GROUP BY 1, 2", ["census"], lambda d: dashboards.acute_patients(d.census), ["time", "metric", "patients"])
report("agg16_census_summary", "SELECT unit, max(census) AS peak_census, round(avg(1.0 * census), 6) AS mean_census FROM census GROUP BY 1", ["census"], lambda d: dashboards.census_summary(d.census), ["unit", "peak_census", "mean_census"])
report("agg16_observations_per_hour", f"SELECT strftime(date_trunc('hour', effective_datetime), '{SQL_STAMP}') AS time, observation_type AS metric, count(*) AS observations FROM facts GROUP BY 1, 2", ["facts"], lambda d: dashboards.observations_per_hour(d.facts), ["time", "metric", "observations"])
report("agg16_latest_observation", f"SELECT strftime(max(effective_datetime), '{SQL_STAMP}') AS latest_measured, strftime(max(received_at), '{SQL_STAMP}') AS latest_received FROM facts", ["facts"], lambda d: dashboards.latest_observation(d.facts), ["latest_measured", "latest_received"])
report("agg16_observations_by_vital", "SELECT observation_type, count(*) AS observations FROM facts GROUP BY 1", ["facts"], lambda d: dashboards.observations_by_vital(d.facts), ["observation_type", "observations"])
report("agg16_news2_completeness", "SELECT count(news2_total) AS complete, count(*) AS encounters FROM news2", ["news2"], lambda d: dashboards.news2_completeness(d.news2), ["complete", "encounters"])
report("agg16_rejections_by_reason", "SELECT rejection_reason, count(*) AS records FROM classified WHERE rejection_reason IS NOT NULL GROUP BY 1", ["classified"], lambda d: dashboards.rejections_by_reason(ingest.split(d.candidates)[1]), ["rejection_reason", "records"])
report("agg16_risk_bands_by_unit", "SELECT unit, CASE WHEN news2_total >= 7 THEN 'High (7+)' WHEN news2_total >= 5 THEN 'Medium (5-6)' ELSE 'Low (0-4)' END AS risk_band, count(*) AS admissions FROM fact_admissions JOIN admission_news2 USING (encounter_key) WHERE news2_total IS NOT NULL GROUP BY 1, 2", ["fact_admissions", "admission_news2"], lambda d: dashboards.risk_bands_by_unit(d.fact_admissions, d.admission_news2), ["unit", "risk_band", "admissions"])
report("agg16_mean_news2_by_day", f"SELECT strftime(date_trunc('day', admitted_at), '{SQL_STAMP}') AS time, unit AS metric, round(avg(news2_total), 6) AS mean_news2 FROM fact_admissions JOIN admission_news2 USING (encounter_key) GROUP BY 1, 2", ["fact_admissions", "admission_news2"], lambda d: dashboards.mean_news2_by_day(d.fact_admissions, d.admission_news2), ["time", "metric", "mean_news2"])


def _labels(d: Domain) -> DataFrame:
    return d.fact_admissions.select("encounter_key", (F.col("length_of_stay_hours") % 2).cast("int").alias("deterioration_proxy_label"))


for _by in ("unit", "attending_specialty"):
    report(f"agg16_deterioration_rate_by_{_by}", f"SELECT {_by}, count(*) AS admissions, round(avg(1.0 * (length_of_stay_hours % 2)), 6) AS deterioration_rate FROM fact_admissions GROUP BY 1", ["fact_admissions"], lambda d, by=_by: dashboards.deterioration_rate(d.fact_admissions, _labels(d), by), [_by, "admissions", "deterioration_rate"])
report("agg16_admissions_by_diagnosis_source", "SELECT diagnosis_source, count(*) AS admissions FROM fact_admissions GROUP BY 1", ["fact_admissions"], lambda d: dashboards.admissions_by_diagnosis_source(d.fact_admissions), ["diagnosis_source", "admissions"])


@register("agg23_health_gate", "SELECT CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS invocations FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 30 MINUTE AND ts <= TIMESTAMP '2024-01-10 12:00:00'")
def health_gate(spark, sf):
    e = Domain(spark, sf).table("events")
    rows = e.select(F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").cast("long").alias("errors"), F.lit(1).cast("long").alias("invocations"))
    return dashboards.recent_sums(rows, "2024-01-10 12:00:00")


# ---- windows, ranks, statistics ----


@register("win6_forward_fill", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN round(value, 6) END AS v FROM events)")
def forward_fill(spark, sf):
    e = Domain(spark, sf).table("events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.round("value", 6)).alias("v"))
    return ranking.forward_fill(e, "user_id", "event_id", ["v"]).select("event_id", "v")


@register("win7_midranks", "SELECT doc_id, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS midrank FROM documents")
def midranks(spark, sf):
    return ranking.midranks(Domain(spark, sf).table("documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "n_chars", "midrank")


@register("win8_deltas", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS value_delta FROM events")
def deltas(spark, sf):
    return show(ranking.deltas(Domain(spark, sf).table("events").select("event_id", "user_id", "value"), "user_id", "event_id", ["value"]), ["event_id", "value_delta"])


@register("win9_recent_history", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC) AS n FROM (SELECT event_id, user_id, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) WHERE n <= 10")
def recent_history(spark, sf):
    e = Domain(spark, sf).table("events").select("event_id", "user_id", F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("h"))
    return ranking.recent_history(e, "user_id", "h", "event_id", 10).select("event_id", "user_id")


@register("agg19_latency_summary", "SELECT event_type, observed, round(mean_ms, 2) AS mean_ms, round(l[CAST(floor((observed - 1) * 0.5) AS BIGINT) + 1], 2) AS p50_ms, round(l[CAST(floor((observed - 1) * 0.95) AS BIGINT) + 1], 2) AS p95_ms, round(l[CAST(floor((observed - 1) * 0.99) AS BIGINT) + 1], 2) AS p99_ms, round(l[observed], 2) AS max_ms FROM (SELECT event_type, count(*) AS observed, avg(value) AS mean_ms, list_sort(list(value)) AS l FROM events GROUP BY 1)")
def latency_summary(spark, sf):
    return ranking.latency_summary(Domain(spark, sf).table("events"), "value", ["event_type"])


@register("ml6_auc", sql("SELECT model_version, m AS positives, n AS negatives, round((t - m * (m + 1) / 2.0) / (m * n), 9) AS auc FROM (SELECT model_version, count(*) FILTER (quality = 1) AS m, count(*) FILTER (quality = 0) AS n, sum(r) FILTER (quality = 1) AS t FROM (SELECT *, rank() OVER (PARTITION BY model_version ORDER BY deterioration_probability) + (count(*) OVER (PARTITION BY model_version, deterioration_probability) - 1) / 2.0 AS r FROM predictions) GROUP BY 1)", "predictions"))
def auc(spark, sf):
    return show(stats.auc_frame(Domain(spark, sf).predictions, "quality", "deterioration_probability", ["model_version"]), ["model_version", "positives", "negatives", "auc"], 9)


@register("ml4_operating_point", sql("SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy FROM (SELECT count(*) FILTER (deterioration_probability >= 0.4 AND quality = 1) AS tp, count(*) FILTER (deterioration_probability >= 0.4 AND quality = 0) AS fp, count(*) FILTER (deterioration_probability < 0.4 AND quality = 1) AS fn, count(*) FILTER (deterioration_probability < 0.4 AND quality = 0) AS tn FROM predictions)", "predictions"))
def operating_point(spark, sf):
    out = stats.operating_point(Domain(spark, sf).predictions, "quality", "deterioration_probability", 0.4)
    return show(out, out.columns, 9)


@register("ml5_youden_threshold", sql("SELECT threshold, round(j, 9) AS j FROM (SELECT t AS threshold, sum(p) OVER (ORDER BY t DESC) / sum(p) OVER () - sum(q) OVER (ORDER BY t DESC) / sum(q) OVER () AS j FROM (SELECT deterioration_probability AS t, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM predictions GROUP BY 1)) ORDER BY round(j, 12) DESC, abs(threshold - 0.5), threshold LIMIT 1", "predictions"))
def youden(spark, sf):
    return show(stats.youden(Domain(spark, sf).predictions, "quality", "deterioration_probability"), ["threshold", "j"], 9)


@register("st5_holm", "SELECT item_id, round(least(1.0, max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 9) AS holm_p_value FROM (SELECT item_id, p, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS s FROM (SELECT item_id, (item_id + 1) / 10000.0 AS p FROM benchmark))")
def holm(spark, sf):
    rows = Domain(spark, sf).table("benchmark").select("item_id", ((F.col("item_id") + 1) / 10000.0).alias("p_value"))
    return show(stats.holm_frame(rows), ["item_id", "holm_p_value"], 9)


@register("st9_heart_rate_rise", sql("SELECT encounter_key, round(max(CASE WHEN minute_index = 1440 * 6 + k THEN 1 END) * 0 + late - early, 6) AS rise FROM (SELECT encounter_key, 0 AS k, 0 AS minute_index, avg(heart_rate_mean) FILTER (minute_index >= 5000) AS late, avg(heart_rate_mean) FILTER (minute_index < 5000) AS early FROM minutes GROUP BY 1) GROUP BY 1, late, early", "minutes").replace("max(CASE WHEN minute_index = 1440 * 6 + k THEN 1 END) * 0 + late - early", "late - early"))
def heart_rate_rise(spark, sf):
    m = Domain(spark, sf).minutes.select("encounter_key", F.col("heart_rate_mean").alias("v"), F.col("minute_index"))
    late, early = F.avg(F.when(F.col("minute_index") >= 5000, F.col("v"))), F.avg(F.when(F.col("minute_index") < 5000, F.col("v")))
    return show(m.groupBy("encounter_key").agg((late - early).alias("rise")), ["encounter_key", "rise"])


# ---- column functions ----


@register("str_key_functions", "SELECT c_custkey, md5(c_name) AS stable_key, md5(c_name || '|' || c_mktsegment) AS composite_key, CAST('0x' || substr(md5(c_name), 1, 7) AS BIGINT) AS hex_prefix, string_split(c_name, '#')[-1] AS tail, sha256(c_name) AS sha FROM customer")
def key_functions(spark, sf):
    return Domain(spark, sf).table("customer").select("c_custkey", C.stable_key(F.col("c_name")).alias("stable_key"), C.composite_key(F.col("c_name"), F.col("c_mktsegment")).alias("composite_key"), C.hex_prefix_number(C.stable_key(F.col("c_name")), 7).alias("hex_prefix"), F.substring_index("c_name", "#", -1).alias("tail"), F.sha2("c_name", 256).alias("sha"))


@register("dt_time_functions", f"SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date_key, strftime(ts + INTERVAL 90 MINUTE, '{SQL_STAMP}') AS plus_minutes, strftime(date_trunc('hour', ts), '{SQL_STAMP}') AS hour_start, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS seconds_since, epoch_us(ts) // 1000 AS epoch_millis, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 60 AS minute_index FROM events")
def time_functions(spark, sf):
    t = F.col("t")
    e = Domain(spark, sf).table("events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    since = C.seconds_between(F.lit("2024-01-01").cast("timestamp"), F.date_trunc("SECOND", t))
    return e.select("event_id", C.date_key(t).cast("long").alias("date_key"), F.date_format(C.add_minutes(t, 90), STAMP).alias("plus_minutes"), F.date_format(F.date_trunc("HOUR", t), STAMP).alias("hour_start"), since.alias("seconds_since"), C.epoch_ms(t).alias("epoch_millis"), C.whole_div(since, 60).alias("minute_index"))


def _warning_sql(f: str) -> str:
    rules = {
        "heart_rate": "WHEN heart_rate <= 40 OR heart_rate >= 131 THEN 3 WHEN heart_rate BETWEEN 111 AND 130 THEN 2 WHEN heart_rate BETWEEN 41 AND 50 OR heart_rate BETWEEN 91 AND 110 THEN 1",
        "spo2": "WHEN spo2 <= 91 THEN 3 WHEN spo2 <= 93 THEN 2 WHEN spo2 <= 95 THEN 1",
        "respiratory_rate": "WHEN respiratory_rate <= 8 OR respiratory_rate >= 25 THEN 3 WHEN respiratory_rate BETWEEN 21 AND 24 THEN 2 WHEN respiratory_rate BETWEEN 9 AND 11 THEN 1",
        "systolic_bp": "WHEN systolic_bp <= 90 OR systolic_bp >= 220 THEN 3 WHEN systolic_bp <= 100 THEN 2 WHEN systolic_bp <= 110 THEN 1",
    }
    return f"CASE WHEN {f} IS NULL THEN NULL {rules[f]} ELSE 0 END"


WARNED = ("heart_rate", "spo2", "respiratory_rate", "systolic_bp")


@register("math13_warning_scores", sql("SELECT event_id, " + ", ".join(f"CAST({_warning_sql(f)} AS BIGINT) AS {f}_score" for f in WARNED) + " FROM wide", "wide"))
def warning_scores(spark, sf):
    w = Domain(spark, sf).wide
    return w.select("event_id", *(C.warning_score(f, F.col(f)).cast("long").alias(f"{f}_score") for f in WARNED))


@register("math12_status_bands", sql("SELECT event_id, CASE WHEN heart_rate IS NULL THEN 'Unknown' WHEN heart_rate < 60 THEN 'Low' WHEN heart_rate > 100 THEN 'High' ELSE 'Normal' END AS heart_rate_status, CASE WHEN spo2 IS NULL THEN 'Unknown' WHEN spo2 < 90 THEN 'Critical' WHEN spo2 < 95 THEN 'Low' ELSE 'Normal' END AS spo2_status, CASE WHEN temperature IS NULL THEN 'Unknown' WHEN temperature <= 35.0 THEN 'Low' WHEN temperature >= 38.1 THEN 'Fever' ELSE 'Normal' END AS temperature_status, CASE WHEN inhaled_oxygen_concentration IS NULL THEN 'Unknown' WHEN inhaled_oxygen_concentration <= 21 THEN 'Room air' ELSE 'Supplemental' END AS oxygen_status FROM wide", "wide"))
def status_bands(spark, sf):
    return Domain(spark, sf).wide.select("event_id", C.heart_rate_status(F.col("heart_rate")).alias("heart_rate_status"), C.spo2_status(F.col("spo2")).alias("spo2_status"), C.temperature_status(F.col("temperature")).alias("temperature_status"), C.oxygen_status(F.col("inhaled_oxygen_concentration")).alias("oxygen_status"))


@register("math6_logistic_scores", sql("SELECT encounter_key, round(1 / (1 + exp(-(0.25 + 0.5 * (coalesce(heart_rate_mean, 80) - 80) / 12 - 0.75 * (coalesce(spo2_min, 95) - 95) / 3))), 9) AS probability FROM features", "features"))
def logistic_scores(spark, sf):
    p = C.logistic([F.col("heart_rate_mean"), F.col("spo2_min")], [80, 95], [80, 95], [12, 3], [0.5, -0.75], 0.25)
    return show(Domain(spark, sf).features.select("encounter_key", p.alias("probability")), ["encounter_key", "probability"], 9)


@register("math7_reflect", sql("SELECT event_id, round(CASE WHEN heart_rate IS NULL THEN NULL WHEN heart_rate NOT BETWEEN 20 AND 250 THEN heart_rate WHEN fmod(fmod(heart_rate - 50, 100) + 100, 100) <= 50 THEN round(50 + fmod(fmod(heart_rate - 50, 100) + 100, 100), 1) ELSE round(150 - fmod(fmod(heart_rate - 50, 100) + 100, 100), 1) END, 4) AS folded FROM wide", "wide"))
def reflect(spark, sf):
    return show(Domain(spark, sf).wide.select("event_id", C.reflect(F.col("heart_rate"), 50, 100, (20, 250)).alias("folded")), ["event_id", "folded"], 4)


# ---- joins and checks ----


@register("join16_delete_missing_keys", sql("SELECT observation_id, loinc_code FROM processed p WHERE encounter_id IN (SELECT encounter_id FROM processed WHERE day < 10 AND encounter_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM processed q WHERE q.day < 10 AND q.observation_id = p.observation_id AND q.loinc_code = p.loinc_code)", "processed"))
def delete_missing_keys(spark, sf):
    p = Domain(spark, sf).processed
    load = p.where("day < 10")
    return p.join(load.select("encounter_id").where("encounter_id is not null"), "encounter_id", "left_semi").join(load.select("observation_id", "loinc_code"), ["observation_id", "loinc_code"], "left_anti").select("observation_id", "loinc_code")


@register("join19_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def orphans(spark, sf):
    d = Domain(spark, sf)
    return quality.orphans(d.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", d.table("supplier").where("s_nationkey < 20"), "s_suppkey").select("l_orderkey", "l_linenumber")


@register("agg12_duplicate_grain", sql("SELECT observation_id, loinc_code, count(*) AS duplicate_count FROM candidates GROUP BY 1, 2 HAVING count(*) > 1", "candidates"))
def duplicate_grain(spark, sf):
    return quality.duplicates(Domain(spark, sf).candidates, "observation_id", "loinc_code")


@register("agg17_group_fingerprints", "SELECT user_id, count(*) AS rows, md5(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT user_id, md5(CAST(event_id AS VARCHAR) || '|' || event_type) AS h FROM events) GROUP BY 1")
def group_fingerprints(spark, sf):
    e = Domain(spark, sf).table("events").select("user_id", "event_id", "event_type")
    return quality.ordered_fingerprint(e, ["user_id"]).select("user_id", "rows", "fingerprint")


@register("dq1_expectations", sql("SELECT rule, failures FROM (SELECT 'not_null:observation_id' AS rule, count(*) FILTER (observation_id IS NULL) AS failures FROM candidates UNION ALL SELECT 'in_range:value', count(*) FILTER (NOT value BETWEEN 0 AND 300) FROM candidates UNION ALL SELECT 'in_set:source', count(*) FILTER (source NOT IN ('feed', 'fhir_webhook')) FROM candidates UNION ALL SELECT 'unique:observation_id,loinc_code', (SELECT count(*) FROM (SELECT 1 FROM candidates GROUP BY observation_id, loinc_code HAVING count(*) > 1)) UNION ALL SELECT 'row_count', 0)", "candidates"))
def expectations(spark, sf):
    rules = [quality.not_null("observation_id"), quality.in_range("value", 0, 300), quality.in_set("source", ["feed", "fhir_webhook"])]
    return quality.check(Domain(spark, sf).candidates, quality.Contract(rules, 1, [("observation_id", "loinc_code")])).select("rule", "failures")


@register("dq5_freshness", "SELECT date_diff('second', CAST(max(ts) AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') AS age_seconds, date_diff('second', CAST(max(ts) AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') <= 26 * 3600 AS passed FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def freshness(spark, sf):
    e = Domain(spark, sf).table("events").select(F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("ts"))
    return quality.freshness(e, "ts", "2024-02-01 00:00:00", 26).select("age_seconds", "passed")


@register("dq4_split_leakage", sql("SELECT split_key FROM (SELECT CAST(split_bucket AS VARCHAR) AS split_key, CASE WHEN length(encounter_key) + split_bucket > 36 THEN data_split ELSE substr(encounter_key, 1, 1) END AS s FROM training) GROUP BY 1 HAVING count(DISTINCT s) > 1", "training"))
def split_leakage(spark, sf):
    t = Domain(spark, sf).training.select(F.col("split_bucket").cast("string").alias("split_key"), F.when(F.length("encounter_key") + F.col("split_bucket") > 36, F.col("data_split")).otherwise(F.substring("encounter_key", 1, 1)).alias("data_split"))
    return quality.split_leakage(t, "split_key")


@register("dq4_inconsistent_versions", sql("SELECT model_version FROM predictions GROUP BY 1 HAVING count(DISTINCT scored_at) <> 1 OR count(DISTINCT decision_threshold) <> 1", "predictions"))
def inconsistent_versions(spark, sf):
    return quality.inconsistent_versions(Domain(spark, sf).predictions)


@register("set2_compare_keys", "SELECT c_custkey, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' ELSE 'mismatched' END AS difference FROM (SELECT coalesce(x.c_custkey, y.c_custkey) AS c_custkey, x.c_name AS a, y.c_name AS b FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0) x FULL OUTER JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 9 <> 0) y ON x.c_custkey = y.c_custkey) WHERE a IS DISTINCT FROM b")
def compare_keys(spark, sf):
    c = Domain(spark, sf).table("customer").select("c_custkey", "c_name")
    changed = c.withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.col("c_name")))
    return quality.compare_keys(c.where("c_custkey % 10 <> 0"), changed.where("c_custkey % 9 <> 0"), ["c_custkey"], ["c_name"])


@register("scd1_merge_snapshot", sql("SELECT provider_npi, taxonomy_code, valid_from, valid_to, is_current FROM (SELECT provider_npi, taxonomy_code, valid_from, CASE WHEN ch THEN '2024-05-01' ELSE valid_to END AS valid_to, CASE WHEN ch THEN 'false' ELSE is_current END AS is_current FROM (SELECT *, is_current = 'true' AND CAST(substr(provider_npi, 2) AS INTEGER) % 3 = 0 AS ch FROM provider_history) UNION ALL SELECT provider_npi, 'new', '2024-05-01', '', 'true' FROM provider_history WHERE is_current = 'true' AND CAST(substr(provider_npi, 2) AS INTEGER) % 3 = 0 UNION ALL SELECT 'z1', 'new', '2024-05-01', '', 'true')", "provider_history"))
def merge_snapshot(spark, sf):
    h = Domain(spark, sf).provider_history
    third = F.substring("provider_npi", 2, 9).cast("int") % 3 == 0
    snap = h.where("is_current = 'true'").withColumn("taxonomy_code", F.when(third, "new").otherwise(F.col("taxonomy_code"))).select(*scd.SNAPSHOT_FIELDS)
    added = spark.createDataFrame([("z1", "Zed", "new", "d", "WA")], ", ".join(f"{f} string" for f in scd.SNAPSHOT_FIELDS))
    return scd.merge_snapshot(h, snap.unionByName(added), "2024-05-01").select("provider_npi", "taxonomy_code", "valid_from", "valid_to", "is_current")


@register("flt10_patient_access", "SELECT event_id FROM events WHERE (event_type = 'view' AND CAST(user_id AS VARCHAR) LIKE '1%') OR (event_type = 'click' AND CAST(user_id AS VARCHAR) LIKE '_2')")
def patient_access(spark, sf):
    e = Domain(spark, sf).table("events").select("event_id", F.col("event_type").alias("principal"), F.col("user_id").cast("string").alias("patient_id"))
    policy = spark.createDataFrame([("vie*", "1*"), ("click", "?2")], "principal_pattern string, patient_pattern string")
    return access.authorized(e, policy).select("event_id")


# ---- live state ----


def _events(d: Domain) -> DataFrame:
    w = d.wide.where("patient_id <> ' ' and event_timestamp <> 'bad'")
    return w.withColumns({"arrival": F.pmod(F.col("event_id") * 7919, F.lit(1_000_003)), "event_timestamp": C.parse_iso(F.col("event_timestamp"))})


_EVENTS = "SELECT *, (event_id * 7919) % 1000003 AS arrival, CAST(event_timestamp AS TIMESTAMP) AS t FROM wide WHERE patient_id <> ' ' AND event_timestamp <> 'bad'"


@register("stm3_merged_vitals", sql(f"SELECT patient_id, " + ", ".join(f"round(arg_max({f}, (t, arrival)) FILTER ({f} IS NOT NULL), 6) AS {f}" for f in FIELDS) + f", strftime(max(t), '{SQL_STAMP}') AS event_timestamp FROM ({_EVENTS}) GROUP BY 1", "wide"))
def merged_vitals(spark, sf):
    return show(state.merged_vitals(_events(Domain(spark, sf))), ["patient_id", *FIELDS, "event_timestamp"])


@register("stm1_deduplicated", sql(f"SELECT observation_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY arrival) AS r FROM ({_EVENTS}) WHERE observation_id IS NOT NULL) WHERE r = 1", "wide"))
def deduplicated(spark, sf):
    return state.deduplicated(_events(Domain(spark, sf)).where("observation_id is not null")).select("observation_id", "event_id")


@register("stm4_window_readings", sql(f"SELECT encounter_id, reading, event_id FROM (SELECT *, strftime(t, '%Y-%m-%dT%H:%M:%S.000000Z') || '#' || observation_id AS reading, row_number() OVER (PARTITION BY encounter_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || '#' || observation_id ORDER BY arrival DESC) AS r FROM ({_EVENTS}) WHERE encounter_id IS NOT NULL AND coalesce(source, '') <> 'load_test' AND observation_id IS NOT NULL) WHERE r = 1", "wide"))
def window_readings(spark, sf):
    return state.window_readings(_events(Domain(spark, sf)).where("observation_id is not null")).select("encounter_id", "reading", "event_id")


@register("stm11_route_metrics", sql(f"SELECT CASE WHEN source = 'load_test' AND error IS NULL THEN 'LoadTest' ELSE 'Live' END AS namespace, count(*) FILTER (error IS NULL) AS records_processed, count(error) AS permanent_records_rejected, 0 AS duplicates_skipped, 0 AS stale_records_skipped FROM (SELECT *, {_event_error_sql()} AS error FROM wide) GROUP BY 1", "wide"))
def route_metrics(spark, sf):
    rows = Domain(spark, sf).wide.withColumn("schema_version", F.lit("1.2"))
    return state.route_metrics(state.route(rows, ingest.event_error(rows)))


@register("stm14_compacted", sql(f"SELECT patient_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY t DESC, arrival DESC) AS r FROM ({_EVENTS}) WHERE coalesce(source, '') <> 'load_test') WHERE r = 1", "wide"))
def compacted(spark, sf):
    return state.compacted(_events(Domain(spark, sf))).select("patient_id", "event_id")


# ---- generation ----


@register("sim9_batch_cycles", "SELECT patient_id, run, elapsed FROM (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS patient_id FROM customer), range(0, 2) AS r(run), (SELECT range AS elapsed FROM range(0, 1800, 300))")
def batch_cycles(spark, sf):
    return simulate.batch_cycles(spark, Domain(spark, sf).patients, "s", "2024-01-01", runs=2, step=300).select("patient_id", F.col("run").cast("long").alias("run"), F.col("elapsed").cast("long").alias("elapsed"))


@register("prj13_split_groups", "SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS patient_id, 'bidmc' || lpad(CAST(c_custkey % 53 + 1 AS VARCHAR), 2, '0') AS split_group, c_custkey // 53 AS epoch FROM customer")
def split_groups(spark, sf):
    from pulsegrid.operators import cohort

    rows = Domain(spark, sf).table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("patient_id"), (F.col("c_custkey") + 1).alias("position"))
    return cohort.split_groups(rows)





# ---- text and number functions over the tables ----


@register("str10_npi_check_digit", "SELECT c_custkey, CASE WHEN t % 10 = 0 THEN 0 ELSE 10 - t % 10 END AS digit FROM (SELECT c_custkey, (SELECT CAST(sum(CASE WHEN i % 2 = 0 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) AS BIGINT) FROM (SELECT i, CAST(substr(reverse('80840' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')), i + 1, 1) AS INTEGER) AS d FROM range(0, 14) AS r(i))) AS t FROM customer)")
def npi_check_digit(spark, sf):
    nine = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return Domain(spark, sf).table("customer").select("c_custkey", C.npi_check_digit(nine).cast("long").alias("digit"))


@register("str9_truthy_and_trim", "SELECT event_id, lower(trim(CASE WHEN event_id % 4 = 0 THEN ' Yes ' WHEN event_id % 4 = 1 THEN '1' ELSE event_type END)) IN ('1', 'true', 'yes') AS truthy, nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE event_type END), '') AS trimmed FROM events")
def truthy(spark, sf):
    k, kind = F.col("event_id"), F.col("event_type")
    text = F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, "1").otherwise(kind)
    return Domain(spark, sf).table("events").select("event_id", C.truthy(text).alias("truthy"), C.blank_to_null(F.when(k % 3 == 0, "  ").otherwise(kind)).alias("trimmed"))


@register("math9_ramp", "SELECT event_id, round(CASE WHEN event_id % 1200 < 300 OR event_id % 1200 >= 900 THEN 0 ELSE least(1.0, (event_id % 1200 - 300) / 300.0) END, 6) AS share FROM events")
def ramp(spark, sf):
    return show(Domain(spark, sf).table("events").select("event_id", C.ramp(F.col("event_id") % 1200, 300, 600, 900).alias("share")), ["event_id", "share"])


@register("dt12_age_at_least", "SELECT patient_id, date_part('year', DATE '2024-06-15') - date_part('year', birth_date) - CASE WHEN (date_part('month', birth_date), date_part('day', birth_date)) > (6, 15) THEN 1 ELSE 0 END >= 65 AS older FROM (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS patient_id, CAST(DATE '1940-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS DATE) AS birth_date FROM customer)")
def age_at_least(spark, sf):
    return Domain(spark, sf).patients.select("patient_id", C.age_at_least(F.col("birth_date"), F.lit("2024-06-15").cast("date"), 65).alias("older"))


@register("map1_code_names", sql("SELECT loinc_code, observation_type, count(*) AS n FROM candidates GROUP BY 1, 2", "candidates"))
def code_names(spark, sf):
    return Domain(spark, sf).candidates.groupBy("loinc_code", "observation_type").agg(F.count(F.lit(1)).alias("n"))


@register("json1_parsed_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parsed_props(spark, sf):
    return Domain(spark, sf).table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("src3_decoded_records", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS patient_id, event_id % 10 = 0 AS failed FROM events")
def decoded_records(spark, sf):
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("patient_id"), F.col("value").cast("string").alias("heart_rate")))
    data = F.when(F.col("event_id") % 10 == 0, "***").otherwise(F.base64(F.encode(body, "UTF-8")))
    out = ingest.decode_records(Domain(spark, sf).table("events").select("event_id", data.alias("data")))
    return out.select("event_id", F.col("event.patient_id").alias("patient_id"), F.col("error").isNotNull().alias("failed"))


@register("prj10_quarantine_replay", sql("SELECT observation_id, patient_id, 'quarantine_replay' AS source, strftime(effective_datetime, '%Y-%m-%d %H:%M:%S') AS event_timestamp, round(CASE WHEN loinc_code = '8867-4' THEN value END, 6) AS heart_rate, trim(patient_id) = '' OR effective_datetime IS NULL AS refused FROM (SELECT * FROM classified WHERE rejection_reason IS NOT NULL)", "classified").replace("trim(patient_id) = '' OR effective_datetime IS NULL", "effective_datetime IS NULL"))
def quarantine_replay(spark, sf):
    rejected = ingest.split(Domain(spark, sf).candidates)[1].withColumn("effective_datetime", F.date_format("effective_datetime", STAMP))
    out = ingest.replay_events(rejected).withColumn("refused", F.col("error").isNotNull())
    return show(out, ["observation_id", "patient_id", "source", "event_timestamp", "heart_rate", "refused"])


@register("prj11_observations", sql("SELECT loinc_code, count(*) AS n, round(sum(value), 3) AS total FROM (" + " UNION ALL ".join(f"SELECT '{BY_FIELD[f].loinc}' AS loinc_code, " + ("CAST(NULL AS DOUBLE)" if BY_FIELD[f].ordinal else f"round({f}, 1)") + f" AS value FROM wide WHERE {f} IS NOT NULL" for f in FIELDS if not f.endswith("_bp")) + " UNION ALL SELECT '85354-9', round(systolic_bp, 1) FROM wide WHERE systolic_bp IS NOT NULL AND diastolic_bp IS NOT NULL) GROUP BY 1", "wide"))
def observations(spark, sf):
    out = ingest.observations_of(Domain(spark, sf).wide.select("event_id", *FIELDS))
    return show(out.groupBy("loinc_code").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), ["loinc_code", "n", "total"], 3)


@register("stm5_window_scores", sql(f"SELECT encounter_id, count(*) AS readings, round(avg(heart_rate), 6) AS heart_rate_mean, round(stddev_samp(heart_rate), 6) AS heart_rate_stddev, CASE WHEN TIMESTAMP '2024-01-09 00:00:00' < any_value(cutoff) + INTERVAL 60 SECOND THEN 'window_open' ELSE 'scored' END AS status FROM (SELECT *, min(t) OVER (PARTITION BY encounter_id) + INTERVAL 10080 MINUTE AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id, t, observation_id ORDER BY arrival DESC) AS r FROM ({_EVENTS}) WHERE encounter_id IS NOT NULL AND coalesce(source, '') <> 'load_test' AND observation_id IS NOT NULL) WHERE r = 1) WHERE t < cutoff GROUP BY 1", "wide"))
def window_scores(spark, sf):
    from pulsegrid.functions.catalog import FEATURES

    readings = state.window_readings(_events(Domain(spark, sf)).where("observation_id is not null"))
    out = state.window_scores(readings, F.lit("2024-01-09 00:00:00").cast("timestamp"), 10080, F.col("heart_rate_mean") / 250, "m1", FEATURES)
    return show(out, ["encounter_id", "readings", "heart_rate_mean", "heart_rate_stddev", "status"])


@register("stm12_measured_at", sql(f"SELECT patient_id, strftime(max(t), '{SQL_STAMP}') AS event_timestamp FROM ({_EVENTS}) GROUP BY 1", "wide"))
def measured_at(spark, sf):
    return show(access.with_measured_at(state.merged_vitals(_events(Domain(spark, sf)))), ["patient_id", "event_timestamp"])


@register("stm13_interval_gate", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY s, event_id) AS r FROM (SELECT event_id, user_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) * 1000 + event_id % 1000 AS s FROM events)) WHERE r = 1".replace("s // 86400", "s // 86400000"))
def interval_gate(spark, sf):
    since = C.seconds_between(F.lit("2024-01-01").cast("timestamp"), F.date_trunc("SECOND", F.col("ts").cast("timestamp")))
    e = Domain(spark, sf).table("events").select("event_id", "user_id", (since * 1000 + F.col("event_id") % 1000).alias("s"))
    return ranking.gate_interval(e.withColumn("s", F.col("s") + F.col("event_id") / 1e9), "user_id", "s", 86_400_000).select("event_id", "user_id")


@register("stm15_connections", "SELECT event_id, k AS connection_id FROM events JOIN (SELECT c_custkey AS u, 'conn' || CAST(c_custkey % 17 AS VARCHAR) AS k FROM customer) s ON s.u = user_id")
def connections(spark, sf):
    d = Domain(spark, sf)
    subscriptions = d.table("customer").select(F.col("c_custkey").alias("patient_id"), F.concat(F.lit("conn"), F.col("c_custkey") % 17).alias("connection_id"))
    events = d.table("events").select("event_id", F.col("user_id").alias("patient_id"))
    return access.connections_for(events, subscriptions).select("event_id", "connection_id")


@register("stm9_replay_split", "SELECT event_id, event_id % 3 >= 1 AS is_terminal FROM events")
def replay_split(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, '{"observation_id":"a"}').when(F.col("event_id") % 3 == 1, '{"observation_id":"a","_replay_attempt":1}').otherwise("broken")
    return state.replay(Domain(spark, sf).table("events").select("event_id", raw.alias("raw"))).select("event_id", "is_terminal")


@register("agg1_encounter_spans", sql(f"SELECT trim(encounter_id) AS encounter_id, strftime(min(effective_datetime), '{SQL_STAMP}') AS first_at, strftime(max(effective_datetime), '{SQL_STAMP}') AS last_at FROM staged GROUP BY 1", "staged"))
def encounter_spans(spark, sf):
    s = Domain(spark, sf).staged
    return show(s.groupBy(F.trim("encounter_id").alias("encounter_id")).agg(F.min("effective_datetime").alias("first_at"), F.max("effective_datetime").alias("last_at")), ["encounter_id", "first_at", "last_at"])


@register("agg19_nearest_rank_whole_table", "SELECT f AS fraction, l[CAST(floor((len(l) - 1) * f) AS BIGINT) + 1] AS value FROM (SELECT list_sort(list(value)) AS l FROM events), (VALUES (0.5), (0.95), (0.99)) AS q(f)")
def nearest_rank(spark, sf):
    return ranking.distributed_nearest_rank(Domain(spark, sf).table("events").select("value"), "value", [0.5, 0.95, 0.99])


@register("agg20_value_sums", sql("SELECT loinc_code, round(sum(CAST(value AS DECIMAL(18, 4))), 4) AS total FROM processed GROUP BY 1", "processed"))
def value_sums(spark, sf):
    return show(Domain(spark, sf).processed.groupBy("loinc_code").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("total")), ["loinc_code", "total"], 4)
