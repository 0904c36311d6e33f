"""Queries over column functions, checks, live state and generated data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions import exact
from pulsegrid.functions.catalog import BY_FIELD, FIELDS, NEWS2_BANDS, VITALS
from pulsegrid.lineage import file_emitter, run
from pulsegrid.operators import access, features, ingest, quality, ranking, scd, simulate, star, study
from pulsegrid.plans.domain import CONFIG, RELATIONS, SQL_STAMP, Domain, _score, sql
from pulsegrid.plans.registry import register
from pulsegrid.plans.vitals import _EVENTS, _events, show
from pulsegrid.streaming import state

# ---- column functions ----


@register("prj2_missing_columns", sql("SELECT event_id, CAST(NULL AS VARCHAR) AS ward, CAST(NULL AS DOUBLE) AS weight FROM wide", "wide"))
def missing_columns(spark, sf):
    w = Domain(spark, sf).wide.select("event_id", "patient_id")
    return ingest.with_columns(ingest.with_columns(w, ("patient_id", "ward")), ("weight",), "double").drop("patient_id")


@register("prj6_reference_ids", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'p' || user_id END AS patient_id FROM events")
def reference_ids(spark, sf):
    k = F.col("event_id") % 5
    text = F.when(k.isin(0, 1), F.concat(F.lit("Patient/p"), "user_id")).when(k == 2, F.concat(F.lit("Group/p"), "user_id")).when(k == 3, "Patient/")
    return Domain(spark, sf).table("events").select("event_id", C.reference_id(text, "Patient").alias("patient_id"))


@register("prj7_public_columns", "SELECT c_custkey, c_name FROM customer")
def public_columns(spark, sf):
    c = Domain(spark, sf).table("customer")
    return access.public_columns(c.select("c_custkey", "c_name", F.lit(1).alias("_secret"), F.col("c_name").alias("__copy")))


@register("str7_id_tails", "SELECT c_custkey, 'c' || c_custkey AS tail, c_name AS same FROM customer")
def id_tails(spark, sf):
    return Domain(spark, sf).table("customer").select("c_custkey", C.id_tail(F.concat(F.lit("http://host/Patient/c"), "c_custkey")).alias("tail"), C.id_tail(F.col("c_name")).alias("same"))


@register("str8_valid_names", "SELECT event_id, event_id % 4 <> 0 AND event_id % 4 <> 3 AS identifier, event_id % 4 <> 3 AS model_version FROM events")
def valid_names(spark, sf):
    k = F.col("event_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("1"), "event_type")).when(k % 4 == 1, F.concat(F.col("event_type"), F.lit("_"), k)).when(k % 4 == 2, F.upper("event_type")).otherwise(F.concat("event_type", F.lit("; drop")))
    return Domain(spark, sf).table("events").select("event_id", C.valid_identifier(name).alias("identifier"), C.valid_model_version(name).alias("model_version"))


@register("str11_probability_labels", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '--' WHEN event_id % 10 = 1 THEN '<0.1%' ELSE printf('%.1f%%', (event_id % 1000) / 10.0) END AS label FROM events")
def probability_labels(spark, sf):
    k = F.col("event_id")
    p = F.when(k % 10 == 0, F.lit(None).cast("double")).when(k % 10 == 1, F.lit(0.0005)).otherwise((k % 1000) / 1000.0)
    return Domain(spark, sf).table("events").select("event_id", C.probability_label(p).alias("label"))


_UUID = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@register("str12_uuid5", f"SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM (SELECT c_custkey, sha1(unhex('{_UUID.replace('-', '')}') || encode('enc' || c_custkey || '|' || c_name)) AS h FROM customer)")
def uuid5(spark, sf):
    return Domain(spark, sf).table("customer").select("c_custkey", C.uuid5(_UUID, F.concat(F.lit("enc"), "c_custkey", F.lit("|"), "c_name")).alias("id"))


@register("str13_verified_blobs", "SELECT CAST(c_custkey AS VARCHAR) AS name, sha256(c_name) AS sha256, c_custkey % 10 <> 0 AS verified FROM customer")
def verified_blobs(spark, sf):
    k, content = F.col("c_custkey"), F.encode("c_name", "UTF-8")
    published = F.when(k % 20 == 0, F.lit(None).cast("string")).when(k % 10 == 0, F.sha2("c_mktsegment", 256)).otherwise(F.sha2("c_name", 256))
    return quality.verify_blobs(Domain(spark, sf).table("customer").select(k.cast("string").alias("name"), content.alias("content"), published.alias("expected")))


@register("dt10_latency", "SELECT event_id, greatest((epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(ts)) / 1000.0, 0.0) AS latency_ms FROM events")
def latency(spark, sf):
    return Domain(spark, sf).table("events").select("event_id", C.latency_ms(F.col("ts").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")).alias("latency_ms"))


@register("math5_news2_bands", sql("SELECT encounter_key, CASE WHEN news2_total IS NULL THEN NULL WHEN news2_total >= 7 THEN 'high' WHEN news2_total >= 5 THEN 'medium' WHEN greatest(" + ", ".join(_score(p) for p in NEWS2_BANDS) + ") = 3 THEN 'low-medium' ELSE 'low' END AS band FROM news2", "news2"))
def news2_bands(spark, sf):
    n = Domain(spark, sf).news2
    scores = [C.news2_score(p, F.col(p)) for p in NEWS2_BANDS]
    return n.select("encounter_key", C.news2_band(F.col("news2_total"), scores).alias("band"))


@register("math5_reading_bands", "SELECT event_id, total, CASE WHEN total >= 7 THEN 'high' WHEN total >= 5 THEN 'medium' WHEN most = 3 THEN 'low-medium' ELSE 'low' END AS band FROM (SELECT event_id, " + " + ".join(f"({_score(p)})" for p in NEWS2_BANDS) + " AS total, greatest(" + ", ".join(_score(p) for p in NEWS2_BANDS) + ") AS most FROM (SELECT event_id, " + ", ".join(f"CAST({v.analytical[0]} + event_id * {7 + 2 * i} % {int(v.analytical[1] - v.analytical[0]) + 1} AS DOUBLE) AS {v.field}" for i, v in enumerate(VITALS)) + " FROM events))")
def reading_bands(spark, sf):
    """Readings with all seven parameters, so that every band occurs."""
    values = {v.field: (F.lit(float(v.analytical[0])) + (F.col("event_id") * (7 + 2 * i)) % int(v.analytical[1] - v.analytical[0] + 1)).cast("double") for i, v in enumerate(VITALS)}
    scores = [C.news2_score(p, values[p]) for p in NEWS2_BANDS]
    total = C.news2_total(values)
    return Domain(spark, sf).table("events").select("event_id", total.alias("total"), C.news2_band(total, scores).alias("band"))


@register("math8_shift_clamped", sql("SELECT event_id, round(CASE WHEN heart_rate IS NULL OR event_id % 3 = 0 OR heart_rate NOT BETWEEN 20 AND 250 THEN heart_rate ELSE least(greatest(heart_rate + (event_id % 3) * 40 - 60, 20), 250) END, 6) AS moved FROM wide", "wide"))
def shift_clamped(spark, sf):
    offset = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(((F.col("event_id") % 3) * 40 - 60).cast("double"))
    return show(Domain(spark, sf).wide.select("event_id", C.shift_clamped(F.col("heart_rate"), offset, (20, 250)).alias("moved")), ["event_id", "moved"])


@register("math13_patient_priority", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -1 WHEN urgent THEN t WHEN t > 0 THEN t ELSE 0 END AS score, CASE WHEN event_id % 17 = 0 THEN 'No data' WHEN urgent THEN 'Urgent' WHEN t > 0 THEN 'Review' ELSE 'Stable' END AS status FROM (SELECT event_id, h + s + r + b AS t, h + s + r + b >= 7 OR greatest(h, s, r, b) = 3 AS urgent FROM (SELECT event_id, CASE WHEN hr <= 40 OR hr >= 131 THEN 3 WHEN hr BETWEEN 111 AND 130 THEN 2 WHEN hr BETWEEN 41 AND 50 OR hr BETWEEN 91 AND 110 THEN 1 ELSE 0 END AS h, CASE WHEN sp <= 91 THEN 3 WHEN sp <= 93 THEN 2 WHEN sp <= 95 THEN 1 ELSE 0 END AS s, CASE WHEN rr <= 8 OR rr >= 25 THEN 3 WHEN rr BETWEEN 21 AND 24 THEN 2 WHEN rr BETWEEN 9 AND 11 THEN 1 ELSE 0 END AS r, CASE WHEN bp <= 90 OR bp >= 220 THEN 3 WHEN bp <= 100 THEN 2 WHEN bp <= 110 THEN 1 ELSE 0 END AS b FROM (SELECT event_id, 50 + event_id % 70 AS hr, 92 + event_id % 9 AS sp, 10 + event_id % 14 AS rr, 95 + event_id % 60 AS bp FROM events)))")
def patient_priority(spark, sf):
    k = F.col("event_id")
    there = lambda x: F.when(k % 17 != 0, x.cast("double"))
    score, status = C.patient_priority({"heart_rate": there(50 + k % 70), "spo2": there(92 + k % 9), "respiratory_rate": there(10 + k % 14), "systolic_bp": there(95 + k % 60)})
    return Domain(spark, sf).table("events").select("event_id", score.cast("int").alias("score"), status.alias("status"))


@register("math14_freshness_status", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'No data' WHEN event_id % 500 <= 10 THEN 'Current' WHEN event_id % 500 <= 310 THEN 'Delayed' ELSE 'Stale' END AS status FROM events")
def freshness_status(spark, sf):
    k = F.col("event_id")
    return Domain(spark, sf).table("events").select("event_id", C.freshness_status(F.when(k % 11 != 0, k % 500), 10, 310).alias("status"))


@register("math15_finite", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN round(value, 6) END AS finite, CASE WHEN event_id % 4 = 3 THEN CAST(event_id AS DOUBLE) END AS parsed FROM events")
def finite(spark, sf):
    k = F.col("event_id") % 4
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.round("value", 6))
    text = F.when(k == 3, F.col("event_id").cast("string")).when(k == 0, " ")
    return Domain(spark, sf).table("events").select("event_id", C.finite(x).alias("finite"), C.finite(C.to_number(text)).alias("parsed"))


_CODES = [*(c for codes in study.DIAGNOSES.values() for c in codes), "000"]
_TAXONOMY = [c for codes in study.SPECIALTIES.values() for c in codes]


def _grouped_sql(groups: dict, code: str) -> str:
    return "CASE " + " ".join(f"WHEN {code} IN ({', '.join(repr(c) for c in codes)}) THEN '{g}'" for g, codes in groups.items()) + " ELSE 'Other' END"


@register("map3_code_groups", f"SELECT event_id, {_grouped_sql(study.DIAGNOSES, 'd')} AS diagnosis_group, {_grouped_sql(study.SPECIALTIES, 't')} AS specialty_group FROM (SELECT event_id, ({_CODES!r})[event_id % {len(_CODES)} + 1] AS d, ({_TAXONOMY!r})[event_id % {len(_TAXONOMY)} + 1] AS t FROM events)")
def code_groups(spark, sf):
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % len(values) + 1).cast("int"))
    return Domain(spark, sf).table("events").select("event_id", study.diagnosis_group(pick(_CODES), _CODES).alias("diagnosis_group"), study.specialty_group(pick(_TAXONOMY)).alias("specialty_group"))


# ---- filters, joins, aggregates and checks ----

_LISTED = [f" p{i} " if i % 2 else f"p{i}" for i in range(1, 61)]


@register("flt1_active_list", sql(f"SELECT observation_id, loinc_code, patient_id FROM processed WHERE trim(coalesce(encounter_id, '')) <> '' AND patient_id IN ({', '.join(repr(p.strip()) for p in _LISTED)})", "processed"))
def active_list(spark, sf):
    """A configured list of patients, which is what this filter is for."""
    return star.staged_observations(Domain(spark, sf).processed, _LISTED).select("observation_id", "loinc_code", "patient_id")


_AGES = {"heart_rate": 2 * 86400.0, "spo2": 5 * 86400.0, "systolic_bp": 86400.0}


@register("flt9_fresh_values", sql("SELECT patient_id, " + ", ".join(f"CASE WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(t) FILTER ({f} IS NOT NULL)) <= {int(a * 1e6)} THEN round(arg_max({f}, (t, arrival)) FILTER ({f} IS NOT NULL), 6) END AS {f}" for f, a in _AGES.items()) + f" FROM ({_EVENTS}) GROUP BY 1", "wide"))
def fresh_values(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return show(state.live_values(state.merged_vitals(_events(Domain(spark, sf))), now, _AGES), ["patient_id", *_AGES])


_ATTENDED = RELATIONS["encounters"].replace("p.provider_key", "p.provider_key").replace(
    "JOIN providers p ON p.provider_npi = r.provider_npi", "LEFT JOIN (SELECT 'enc' || c_custkey AS e_id, 's' || (c_custkey % 12 + 1) AS npi FROM customer WHERE c_custkey % 2 = 0) a ON a.e_id = e.encounter_id JOIN providers p ON p.provider_npi = coalesce(a.npi, r.provider_npi)"
).replace("true AS is_synthetic_provider_assignment", "a.npi IS NULL AS is_synthetic_provider_assignment")


@register("join7_attending_override", sql(f"SELECT encounter_key, provider_key, provider_version_key, is_synthetic_provider_assignment FROM ({_ATTENDED})", "staged", "providers"))
def attending_override(spark, sf):
    d = Domain(spark, sf)
    k = F.col("c_custkey")
    admissions = d.table("customer").where(k % 2 == 0).select(F.concat(F.lit("enc"), k).alias("encounter_id"), F.concat(F.lit("s"), k % 12 + 1).alias("attending_npi"))
    return star.dim_encounter(d.staged, d.providers, admissions, CONFIG).select("encounter_key", "provider_key", "provider_version_key", "is_synthetic_provider_assignment")


def _waveform_groups(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    return d.table("customer").where(k % 3 != 0).select(F.concat(F.lit("p"), k).alias("patient_id"), F.concat(F.lit("g"), k % 7).alias("split_group"))


_GROUPS = "(SELECT 'p' || c_custkey AS patient_id, 'g' || (c_custkey % 7) AS split_group FROM customer WHERE c_custkey % 3 <> 0)"
_BUCKET = "CAST('0x' || substr(coalesce(md5(g.split_group), f.patient_key), 1, 7) AS BIGINT) % 10"


@register("join8_split_groups", sql(f"SELECT encounter_key, {_BUCKET} AS split_bucket, CASE WHEN {_BUCKET} < 8 THEN 'train' ELSE 'test' END AS data_split FROM features f LEFT JOIN {_GROUPS} g ON md5(g.patient_id) = f.patient_key WHERE is_training_eligible", "features"))
def split_groups(spark, sf):
    d = Domain(spark, sf)
    return features.training_dataset(d.features, _waveform_groups(d), CONFIG).select("encounter_key", "split_bucket", "data_split")


@register("agg8_order_fixed_statistics", sql("SELECT encounter_key, loinc_code, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(regr_slope(value, CAST(day AS DOUBLE)), 6) AS slope FROM facts GROUP BY 1, 2", "facts"))
def order_fixed_statistics(spark, sf):
    v = F.col("value")
    found = Domain(spark, sf).facts.groupBy("encounter_key", "loinc_code").agg(exact.exact_avg(v).alias("mean"), exact.exact_stddev(v).alias("deviation"), exact.exact_slope(v, F.col("day")).alias("slope"))
    return show(found, ["encounter_key", "loinc_code", "mean", "deviation", "slope"])


@register("agg10_distinct_patients", sql("SELECT DISTINCT patient_id, loinc_code, unit FROM staged", "staged"))
def distinct_patients(spark, sf):
    return Domain(spark, sf).staged.groupBy("patient_id", "loinc_code", "unit").agg(F.count(F.lit(1)).alias("n")).drop("n")


@register("agg14_invalid_count", sql("SELECT (SELECT count(*) FROM candidates WHERE observation_id IS NULL OR patient_id IS NULL OR patient_id = '' OR loinc_code IS NULL OR value IS NULL OR effective_datetime IS NULL) + (SELECT count(*) FROM (SELECT 1 FROM candidates WHERE observation_id IS NOT NULL AND loinc_code IS NOT NULL GROUP BY observation_id, loinc_code HAVING count(*) > 1)) AS invalid_row_count", "candidates"))
def invalid_count(spark, sf):
    return quality.invalid_count(Domain(spark, sf).candidates)


@register("agg15_missing_split", sql("SELECT 'missing_train_or_test_split' AS failure WHERE (SELECT count(DISTINCT data_split) FROM training WHERE data_split = 'train') <> 2", "training"))
def missing_split(spark, sf):
    t = Domain(spark, sf).training
    return quality.missing_split(t.where("data_split = 'train'")).unionByName(quality.missing_split(t.unionByName(t.withColumn("data_split", F.lit("test")))).where("failure is null"))


@register("agg22_not_one_current", sql("SELECT provider_npi FROM (SELECT provider_npi, CASE WHEN provider_npi LIKE '%7' THEN false ELSE is_current OR provider_npi LIKE '%4' END AS c FROM providers) GROUP BY 1 HAVING sum(CASE WHEN c THEN 1 ELSE 0 END) <> 1", "providers"))
def not_one_current(spark, sf):
    npi = F.col("provider_npi")
    p = Domain(spark, sf).providers.withColumn("is_current", F.when(npi.endswith("7"), F.lit(False)).otherwise(F.col("is_current") | npi.endswith("4")))
    return scd.not_one_current(p, "provider_npi")


@register("scd2_roster_versions", "SELECT user_id, event_type, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to, valid_to IS NULL AS is_current FROM (SELECT user_id, event_type, t AS valid_from, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS valid_to FROM (SELECT user_id, date_trunc('hour', ts) AS t, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2))")
def roster_versions(spark, sf):
    t = F.date_trunc("HOUR", F.col("ts").cast("timestamp"))
    changes = Domain(spark, sf).table("events").groupBy("user_id", t.alias("at")).agg(F.max_by("event_type", "event_id").alias("event_type"))
    return show(scd.versions_from_changes(changes, "user_id", "at"), ["user_id", "event_type", "valid_from", "valid_to", "is_current"])


@register("srt4_empty_frame", "SELECT 9 AS columns, 0 AS rows")
def empty_frame(spark, sf):
    none = ingest.measurement_candidates(Domain(spark, sf).wide.select("event_id", "heart_rate"))
    return none.agg(F.lit(len(none.columns)).alias("columns"), F.count(F.lit(1)).alias("rows"))


@register("srt7_first_readings", sql(f"SELECT encounter_id, arg_min(event_id, (strftime(t, '%Y-%m-%dT%H:%M:%S.000000Z') || '#' || observation_id)) AS event_id FROM ({_EVENTS}) WHERE encounter_id IS NOT NULL AND coalesce(source, '') <> 'load_test' AND observation_id IS NOT NULL AND event_id % 71 <> 0 GROUP BY 1", "wide"))
def first_readings(spark, sf):
    rows = state.window_readings(_events(Domain(spark, sf)).where("observation_id is not null and event_id % 71 <> 0"))
    return rows.groupBy("encounter_id").agg(F.min_by("event_id", "reading").alias("event_id"))


@register("dq2_contract", sql("SELECT rule, failures, passed FROM (SELECT 'row_count' AS rule, greatest(2 - count(*), 0) AS failures, count(*) >= 2 AS passed FROM predictions UNION ALL SELECT 'not_null:encounter_key', count(*) FILTER (encounter_key IS NULL), true FROM predictions UNION ALL SELECT 'in_set:predicted_label', count(*) FILTER (predicted_label NOT IN (0, 1)), true FROM predictions UNION ALL SELECT 'in_range:deterioration_probability', count(*) FILTER (deterioration_probability > 0.9), count(*) FILTER (deterioration_probability > 0.9) = 0 FROM predictions UNION ALL SELECT 'not_in_set:model_version', count(*) FILTER (model_version IN ('m1')), false FROM predictions UNION ALL SELECT 'unique:model_version,patient_key', (SELECT count(*) FROM (SELECT 1 FROM predictions GROUP BY model_version, patient_key HAVING count(*) > 1)), false)", "predictions"))
def contract(spark, sf):
    rules = [quality.not_null("encounter_key"), quality.in_set("predicted_label", [0, 1]), quality.in_range("deterioration_probability", 0, 0.9), quality.not_in_set("model_version", ["m1"])]
    return quality.check(Domain(spark, sf).predictions, quality.Contract(rules, 2, [("model_version", "patient_key")])).select("rule", "failures", "passed")


@register("dq4_unique_grain", sql("SELECT observation_id, loinc_code, count(*) AS duplicate_count FROM (SELECT * FROM facts UNION ALL SELECT * FROM facts WHERE day = 3) GROUP BY 1, 2 HAVING count(*) > 1", "facts"))
def unique_grain(spark, sf):
    f = Domain(spark, sf).facts.select("observation_id", "loinc_code", "day")
    return quality.duplicates(f.unionByName(f.where("day = 3")), "observation_id", "loinc_code")


@register("dq4_unique_predictions", sql("SELECT model_version, patient_key, count(*) AS duplicate_count FROM predictions GROUP BY 1, 2 HAVING count(*) > 1", "predictions"))
def unique_predictions(spark, sf):
    return quality.duplicates(Domain(spark, sf).predictions, "model_version", "patient_key")


@register("dq4_values_in_range", sql("SELECT model_version, encounter_key FROM predictions WHERE deterioration_probability * 1.2 - 0.1 < 0 OR deterioration_probability * 1.2 - 0.1 > 1", "predictions"))
def values_in_range(spark, sf):
    p = Domain(spark, sf).predictions.withColumn("deterioration_probability", F.col("deterioration_probability") * 1.2 - 0.1)
    return quality.out_of_unit_range(p)


@register("dq4_one_class_splits", sql("SELECT data_split, count(DISTINCT y) AS class_count FROM (SELECT data_split, CASE WHEN data_split = 'test' THEN 0 ELSE ascii(encounter_key) % 2 END AS y FROM training) GROUP BY 1 HAVING count(DISTINCT y) <> 2", "training"))
def one_class_splits(spark, sf):
    y = F.when(F.col("data_split") == "test", 0).otherwise(F.ascii("encounter_key") % 2)
    return quality.one_class_splits(Domain(spark, sf).training.withColumn("deterioration_proxy_label", y))


@register("dq4_split_group_leakage", sql(f"SELECT split_group FROM training t JOIN {_GROUPS} g ON md5(g.patient_id) = t.patient_key GROUP BY 1 HAVING count(DISTINCT data_split) > 1", "training"))
def split_group_leakage(spark, sf):
    d = Domain(spark, sf)
    return quality.split_group_leakage(d.training, _waveform_groups(d))


@register("dq6_frozen_files", "SELECT 'same' AS file, true AS passed UNION ALL SELECT 'changed', false")
def frozen_files(spark, sf):
    """The gate reads a plan's file before any data; the file is this module's own."""
    digest = quality.hashlib.sha256(quality.Path(__file__).read_bytes()).hexdigest()
    found = []
    for name, frozen in (("same", digest), ("changed", "0" * 64)):
        try:
            found.append((name, quality.file_gate(__file__, frozen) == digest))
        except ValueError:
            found.append((name, False))
    return Domain(spark, sf).spark.createDataFrame(found, "file string, passed boolean")


@register("lin1_run_events", "SELECT * FROM (VALUES ('load', 'START', 0), ('load', 'COMPLETE', 0), ('train', 'START', 1), ('train', 'FAIL', 1), ('silent', 'ran', 2)) AS t(job, event, number)")
def run_events(spark, sf):
    """A job that completes, one that fails, and one whose events cannot be emitted and that runs all the same."""
    events: list[tuple[str, str, int]] = []

    def emit(event: dict) -> None:
        events.append((event["job"]["name"], event["eventType"], 0 if event["job"]["name"] == "load" else 1))

    with run(emit, "load", ["raw"], ["processed"]):
        pass
    try:
        with run(emit, "train", ["training"], ["model"]):
            raise RuntimeError("the job fails")
    except RuntimeError:
        pass
    with run(file_emitter("/no such folder/lineage.jsonl"), "silent", [], []):
        events.append(("silent", "ran", 2))
    return Domain(spark, sf).spark.createDataFrame(events, "job string, event string, number int")


# ---- live state ----

_NOW = "TIMESTAMP '2024-01-10 00:00:00'"


@register("stm1_claims", f"SELECT observation_id, outcome, CASE WHEN outcome = 'claimed' THEN strftime({_NOW} + INTERVAL 60 SECOND, '{SQL_STAMP}') ELSE strftime(lease, '{SQL_STAMP}') END AS lease_until FROM (SELECT 'o' || e AS observation_id, CASE WHEN e % 5 = 0 OR (e % 5 = 1 AND e % 3 = 0) OR (e % 5 <> 0 AND e % 7 = 0) THEN 'claimed' WHEN e % 5 = 1 THEN 'in_progress' ELSE 'duplicate' END AS outcome, {_NOW} + CASE WHEN e % 3 = 0 THEN -INTERVAL 30 SECOND ELSE INTERVAL 30 SECOND END AS lease FROM (SELECT event_id AS e FROM events))")
def claims(spark, sf):
    k, now = F.col("event_id"), F.lit("2024-01-10 00:00:00").cast("timestamp")
    after = lambda seconds: now + F.make_dt_interval(secs=seconds)
    e = Domain(spark, sf).table("events")
    ids = F.concat(F.lit("o"), k).alias("observation_id")
    held = e.where(k % 5 != 0).select(ids, F.when(k % 5 == 1, "processing").otherwise("completed").alias("state"), after(F.when(k % 3 == 0, -30).otherwise(30)).alias("lease_until"), after(F.when(k % 7 == 0, -1).otherwise(1000)).alias("expires_at"))
    asked = state.claim(held, e.select(ids).unionByName(e.select(ids)), now)
    left = state.claims_after(held, asked, now)
    return show(asked.join(left, "observation_id"), ["observation_id", "outcome", "lease_until"])


_FOLD_FIELDS = ", ".join(f"CASE WHEN old THEN s.{f} ELSE coalesce(e.{f}, s.{f}) END AS {f}, CASE WHEN old OR e.{f} IS NULL THEN s.{f}_at ELSE e.t END AS {f}_at" for f in FIELDS)
_STALE = " OR ".join(f"(e.{f} IS NOT NULL AND coalesce(s.{f}_at > e.t, false))" for f in FIELDS)
_STM2 = (
    f"ev AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY arrival, t) AS n, count(*) OVER (PARTITION BY patient_id) AS most FROM ({_EVENTS})), "
    "folded AS (SELECT DISTINCT patient_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS stale, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {f}, CAST(NULL AS TIMESTAMP) AS {f}_at" for f in FIELDS) + " FROM ev "
    f"UNION ALL SELECT patient_id, n, CASE WHEN old THEN accepted ELSE accepted + 1 END, CASE WHEN old THEN stale + 1 ELSE stale END, {', '.join(f'{f}, {f}_at' for f in FIELDS)} FROM "
    f"(SELECT s.patient_id, e.n, accepted, stale, old, {_FOLD_FIELDS} FROM folded s JOIN ev e ON s.patient_id = e.patient_id AND e.n = s.n + 1, LATERAL (SELECT {_STALE} AS old) AS o(old)))"
)


def _stm2_sql() -> str:
    text = sql("SELECT 1", "wide")
    return text.replace("WITH ", "WITH RECURSIVE ", 1).rsplit(" SELECT 1", 1)[0] + f", {_STM2} SELECT f.patient_id, accepted, stale, " + ", ".join(f"round(f.{x}, 6) AS {x}" for x in FIELDS) + " FROM folded f JOIN (SELECT patient_id, max(n) AS n FROM ev GROUP BY 1) l ON f.patient_id = l.patient_id AND f.n = l.n"


@register("stm2_latest_vitals", _stm2_sql())
def latest_vitals(spark, sf):
    return show(state.latest_vitals(_events(Domain(spark, sf))), ["patient_id", "accepted", "stale", *FIELDS])


@register("stm6_score_requests", sql(f"SELECT q.encounter_id, CASE WHEN coalesce(trim(q.encounter_id), '') = '' THEN 'no_encounter' WHEN q.stored IS NOT NULL THEN 'scored' WHEN w.first IS NULL THEN 'no_readings' WHEN TIMESTAMP '2024-01-09 00:00:00' < w.first + INTERVAL 7 DAY + INTERVAL 60 SECOND THEN 'window_open' ELSE 'model_unavailable' END AS status, q.stored AS probability FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 9 <> 1 THEN 'enc' || c_custkey END AS encounter_id, CASE WHEN c_custkey % 9 > 1 AND c_custkey % 4 = 0 THEN 0.25 END AS stored FROM customer) q LEFT JOIN (SELECT encounter_id, min(t) AS first FROM ({_EVENTS}) WHERE encounter_id IS NOT NULL AND coalesce(source, '') <> 'load_test' AND observation_id IS NOT NULL GROUP BY 1) w ON w.encounter_id = q.encounter_id", "wide"))
def score_requests(spark, sf):
    from pulsegrid.functions.catalog import FEATURES

    d, k = Domain(spark, sf), F.col("c_custkey")
    asked = d.table("customer").select(F.when(k % 9 == 0, " ").when(k % 9 != 1, F.concat(F.lit("enc"), k)).alias("encounter_id"))
    stored = d.table("customer").where((k % 9 > 1) & (k % 4 == 0)).select(F.concat(F.lit("enc"), k).alias("encounter_id"), F.lit("m1").alias("model_version"), F.lit(0.25).alias("probability"))
    other = stored.withColumns({"model_version": F.lit("m0"), "probability": F.lit(0.9)})
    readings = state.window_readings(_events(d).where("observation_id is not null"))
    return state.score_requests(asked, readings, stored.unionByName(other), F.lit("2024-01-09 00:00:00").cast("timestamp"), 10080, None, "m1", FEATURES)


@register("stm7_route_outcomes", "SELECT 'Live' AS namespace, count(*) FILTER (event_id % 4 <> 0) AS records_processed, count(*) FILTER (event_id % 4 = 0) AS permanent_records_rejected, count(*) FILTER (event_id % 5 = 1) AS duplicates_skipped, count(*) FILTER (event_id % 5 = 2) AS stale_records_skipped FROM events")
def route_outcomes(spark, sf):
    k = F.col("event_id")
    e = Domain(spark, sf).table("events").select("event_id", F.lit("feed").alias("source"), F.when(k % 5 == 1, "duplicate").when(k % 5 == 2, "stale").alias("outcome"))
    return state.route_metrics(state.route(e, F.when(k % 4 == 0, "bad")))


@register("stm8_handled_records", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'done' WHEN event_id % 8 = 0 THEN 'dead_letter' ELSE 'retry' END AS handling FROM events")
def handled_records(spark, sf):
    k = F.col("event_id")
    return state.handled(Domain(spark, sf).table("events").select("event_id", F.when(k % 4 == 0, "bad").alias("error"), (k % 8 == 0).alias("permanent"))).select("event_id", "handling")


@register("stm10_load_tests", sql(f"SELECT observation_id, event_id, CAST(epoch(TIMESTAMP '2024-01-10 00:00:00') + 86400 AS BIGINT) AS expires_at FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY arrival) AS r FROM ({_EVENTS}) WHERE source = 'load_test' AND observation_id IS NOT NULL) WHERE r = 1", "wide"))
def load_tests(spark, sf):
    routed = state.route(_events(Domain(spark, sf)).where("observation_id is not null"), F.lit(None).cast("string"))
    return state.load_test_results(routed, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("observation_id", "event_id", "expires_at")


_CYCLES = "(SELECT user_id % 9 AS run_id, event_id AS cycle, event_id % 7 AS retryable, 6 AS attempts FROM events)"


@register("stm16_degraded_runs", f"SELECT run_id, min(cycle) AS first_cycle, count(*) AS length FROM (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY cycle) AS g FROM (SELECT *, retryable >= 3 AS bad FROM {_CYCLES})) WHERE bad GROUP BY run_id, g")
def degraded_runs(spark, sf):
    e = Domain(spark, sf).table("events").select((F.col("user_id") % 9).alias("run_id"), F.col("event_id").alias("cycle"), (F.col("event_id") % 7).alias("retryable"), F.lit(6).alias("attempts"))
    return state.degraded_runs(e, 0.5)


@register("stm16_until_disabled", "SELECT patient_id, cycle FROM (SELECT user_id AS patient_id, event_id AS cycle, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS f FROM events) WHERE f IS NULL OR cycle <= f")
def until_disabled(spark, sf):
    e = Domain(spark, sf).table("events").select(F.col("user_id").alias("patient_id"), F.col("event_id").alias("cycle"), F.when(F.col("event_type") == "error", "permanent").otherwise("ok").alias("outcome"))
    return state.until_disabled(e).select("patient_id", "cycle")


# ---- generated data ----


def _number(key: str) -> str:
    return f"CAST('0x' || substr(sha256({key}), 1, 16) AS UBIGINT)"


def _unit(key: str) -> str:
    return f"(CAST({_number(key)} AS DOUBLE) / 18446744073709551616.0)"


@register("math10_seeded_draws", f"SELECT c_custkey, round({_unit(_K := repr('seed:') + ' || c_custkey')}, 12) AS u, CAST({_number(_K)} % 2 AS INTEGER) AS choice FROM customer")
def seeded_draws(spark, sf):
    key = F.concat(F.lit("seed:"), F.col("c_custkey"))
    return Domain(spark, sf).table("customer").select("c_custkey", F.round(C.unit_interval(key), 12).alias("u"), C.seeded_index(key, 2).alias("choice"))


@register("sim1_choose_scenarios", f"SELECT 'c' || c_custkey AS patient_id, CASE WHEN coalesce(n, 0) < coalesce(d, 0) THEN 'normal' WHEN coalesce(n, 0) > coalesce(d, 0) THEN 'deterioration' WHEN {_number(repr('seed:c') + ' || c_custkey')} % 2 = 0 THEN 'normal' ELSE 'deterioration' END AS scenario FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS n, count(*) FILTER (o_orderkey % 2 <> 0) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def choose_scenarios(spark, sf):
    d = Domain(spark, sf)
    return simulate.choose_scenarios(d.patients, "seed", d.admissions.select("patient_id", "scenario"))


@register("sim2_balanced_runs", "SELECT p AS patient_id, CAST(r AS INTEGER) AS run, CASE WHEN row_number() OVER (PARTITION BY p ORDER BY sha256('s:' || p || ':' || r)) <= 3 THEN 'normal' ELSE 'deterioration' END AS scenario FROM (SELECT 'c' || c_custkey AS p, r FROM customer, range(0, 6) AS runs(r))")
def balanced_runs(spark, sf):
    return simulate.balanced_runs(Domain(spark, sf).patients, "s")


@register("sim3_waveform_rows", "SELECT 'c' || c_custkey AS patient_id, CAST(c_custkey % 53 + 1 AS INTEGER) AS record, CAST(((o - CASE WHEN c_custkey >= 53 THEN n // 2 ELSE 0 END) % n + n) % n AS INTEGER) AS offset_seconds, CAST(o AS DOUBLE) AS heart_rate FROM customer, (SELECT r, 5 + r % 4 AS n, o FROM range(1, 54) AS records(r), range(0, 9) AS offsets(o) WHERE o < 5 + r % 4) WHERE r = c_custkey % 53 + 1")
def waveform_rows(spark, sf):
    d = Domain(spark, sf)
    offsets = spark.range(1, 54).select(F.col("id").cast("int").alias("record"), F.explode(F.sequence(F.lit(0), (4 + F.col("id") % 4).cast("int"))).alias("offset_seconds"))
    cohort = d.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("patient_id"), (F.col("c_custkey") + 1).alias("position"))
    return simulate.waveform_rows(offsets.withColumn("heart_rate", F.col("offset_seconds").cast("double")), cohort).select("patient_id", "record", "offset_seconds", "heart_rate")


_KEY4 = "'precursor:s:p' || user_id || ':' || event_id"
_EFFECTS = {"heart_rate": (9.0, 3.0), "spo2": (-2.0, 0.5)}


def _normal_sql(f: str, mean: float, sd: float) -> str:
    key = f"{_KEY4} || ':{f}:"
    return f"({mean} + {sd} * sqrt(-2 * ln(1 - {_unit(key + chr(117) + chr(39))})) * cos(2 * pi() * {_unit(key + chr(118) + chr(39))}))"


@register("sim4_precursors", f"SELECT event_id, " + ", ".join(f"round(CASE WHEN event_id % 2 = 1 AND {_unit(_KEY4)} < 0.6 THEN {_normal_sql(f, m, s)}{' * CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 1.0 END' if f == 'heart_rate' else ''} ELSE 0 END, 6) AS effect_{f}" for f, (m, s) in _EFFECTS.items()) + " FROM events")
def precursors(spark, sf):
    e = Domain(spark, sf).table("events").select("event_id", F.concat(F.lit("p"), "user_id").alias("patient_id"), F.col("event_id").cast("string").alias("run_id"), F.when(F.col("event_id") % 2 == 1, "deterioration").otherwise("normal").alias("scenario"), (F.col("user_id") % 3 == 0).alias("age_65_plus"))
    return show(simulate.precursors(e, "s", 0.6, _EFFECTS, 1.5), ["event_id", *(f"effect_{f}" for f in _EFFECTS)])


_ELAPSED = "(event_id * 37) % 2000"
_START = {"heart_rate": "40 + event_id % 180", "respiratory_rate": "6 + event_id % 40", "spo2": "70 + event_id % 31", "systolic_bp": "80 + event_id % 120", "temperature": "35 + event_id % 6"}


def _scenario_sql(f: str) -> str:
    low, high, noise, digits = simulate.DETERIORATION[f]
    key = "'deterioration:s:p' || user_id || ':r' || (event_id % 6)"
    target = f"round({low} + {high - low} * {_unit(f'{key} || {chr(39)}:{f}{chr(39)}')}, {digits})"
    shift = f"{noise} * (2 * {_unit(f'{key} || {chr(39)}:{f}:{chr(39)} || printf({chr(39)}%.3f{chr(39)}, CAST({_ELAPSED} AS DOUBLE))')} - 1)"
    worse = f"least(greatest(round({target} + {shift}, {digits}), {low}), {high})"
    x = f"CAST({_START[f]} AS DOUBLE)"
    calm = x
    if f in simulate.NORMAL:
        a, b = simulate.NORMAL[f]
        accepted = BY_FIELD[f].realtime
        span = b - a
        offset = f"fmod(fmod({x} - {a}, {2 * span}) + {2 * span}, {2 * span})"
        calm = f"CASE WHEN {x} NOT BETWEEN {accepted[0]} AND {accepted[1]} THEN {x} WHEN {offset} <= {span} THEN round({a} + {offset}, 1) ELSE round({a} + {2 * span} - {offset}, 1) END"
    return f"round(CASE WHEN {_ELAPSED} >= 900 AND {_ELAPSED} < 1800 AND event_id % 2 = 1 THEN {worse} WHEN {_ELAPSED} >= 900 AND {_ELAPSED} < 1800 THEN {calm} ELSE {x} END, 4) AS {f}"


def _readings(d: Domain) -> DataFrame:
    return d.table("events").select(
        "event_id", F.concat(F.lit("p"), "user_id").alias("patient_id"), F.concat(F.lit("r"), F.col("event_id") % 6).alias("run_id"), F.when(F.col("event_id") % 2 == 1, "deterioration").otherwise("normal").alias("scenario"), F.expr(_ELAPSED).alias("elapsed"),
        *(F.expr(x).cast("double").alias(f) for f, x in _START.items()),
    )


@register("sim5_scenario_readings", "SELECT event_id, " + ", ".join(_scenario_sql(f) for f in _START) + " FROM events")
def scenario_readings(spark, sf):
    return show(simulate.apply_scenario(_readings(Domain(spark, sf)), "s"), ["event_id", *_START], 4)


@register("sim4_applied_precursor", "SELECT event_id, round(CASE WHEN share = 0 THEN hr ELSE least(greatest(hr + 30.0 * share, 20), 250) END, 6) AS heart_rate FROM (SELECT event_id, CAST(40 + event_id % 180 AS DOUBLE) AS hr, CASE WHEN e < 300 OR e >= 900 THEN 0 ELSE least(1.0, (e - 300) / 400.0) END AS share FROM (SELECT event_id, (event_id * 37) % 2000 AS e FROM events))")
def applied_precursor(spark, sf):
    rows = _readings(Domain(spark, sf)).withColumn("effect_heart_rate", F.lit(30.0))
    return show(simulate.apply_precursor(rows, 300, 700), ["event_id", "heart_rate"])


_KEY7 = "'admission:s:c' || o_custkey || ':r' || o_orderkey"


def _pick_sql(values: str, part: str) -> str:
    return f"list_extract({values}, CAST(floor({_unit(f'{_KEY7} || {chr(39)}:{part}{chr(39)}')} * len({values})) AS BIGINT) + 1)"


@register("sim7_planned_admissions", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'synthea-fallback-facility' ELSE {_pick_sql(chr(91) + repr('f1') + ', ' + repr('f2') + ', ' + repr('f3') + chr(93), 'facility')} END AS facility, CASE WHEN {_unit(_KEY7 + ' || ' + repr(':unit'))} < 0.2 THEN 'Medical intensive care unit' WHEN {_unit(_KEY7 + ' || ' + repr(':unit'))} < 0.5 THEN 'Step-down unit' ELSE 'Medical-surgical ward' END AS unit, CASE WHEN o_orderkey % 3 = 0 THEN {_pick_sql(chr(91) + repr('x') + ', ' + repr('y') + chr(93), 'diagnosis')} ELSE {_pick_sql(chr(91) + repr('a') + ', ' + repr('b') + ', ' + repr('c') + chr(93), 'diagnosis')} END AS diagnosis, CASE WHEN o_orderkey % 3 = 0 THEN 'simulator_fallback' ELSE 'synthea_history' END AS diagnosis_source, CAST(24 + floor({_unit(_KEY7 + ' || ' + repr(':stay'))} * 121) AS INTEGER) AS length_of_stay_hours, CAST(floor({_unit(_KEY7 + ' || ' + repr(':hour'))} * 24) AS INTEGER) AS admit_hour FROM orders")
def planned_admissions(spark, sf):
    texts = lambda *v: F.array(*(F.lit(x) for x in v))
    o = F.col("o_orderkey")
    rows = Domain(spark, sf).table("orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("patient_id"), F.concat(F.lit("r"), o).alias("run_id"), F.when(o % 5 != 0, texts("f1", "f2", "f3")).alias("facilities"), F.when(o % 3 != 0, texts("a", "b", "c")).otherwise(F.array().cast("array<string>")).alias("diagnoses"), texts("x", "y").alias("fallback_diagnoses"))
    return simulate.plan_admissions(rows, "s").select("o_orderkey", "facility", "unit", "diagnosis", "diagnosis_source", "length_of_stay_hours", "admit_hour")


@register("sim8_chosen_attendings", sql(f"SELECT encounter_id, provider_npi AS attending_npi FROM (SELECT 'o' || o_orderkey AS encounter_id, p.provider_npi, row_number() OVER (PARTITION BY o_orderkey ORDER BY p.provider_npi) - 1 AS k, count(*) OVER (PARTITION BY o_orderkey) AS n, {_number(repr('attending:s:c') + ' || o_custkey || ' + repr(':r') + ' || o_orderkey')} AS h FROM orders JOIN providers p ON p.provider_state = 'WA' AND p.taxonomy_code IN ('t' || (o_orderkey % 3), 't' || (o_orderkey % 3 + 3)) AND CAST(o_orderdate AS DATE) >= p.valid_from AND CAST(o_orderdate AS DATE) < coalesce(p.valid_to, DATE '9999-12-31')) WHERE k = CAST(h % CAST(n AS UBIGINT) AS BIGINT)", "providers"))
def chosen_attendings(spark, sf):
    d, o = Domain(spark, sf), F.col("o_orderkey")
    rows = d.table("orders").select(F.concat(F.lit("o"), o).alias("encounter_id"), F.concat(F.lit("c"), "o_custkey").alias("patient_id"), F.concat(F.lit("r"), o).alias("run_id"), F.concat(F.lit("u"), o % 3).alias("unit"), F.to_date("o_orderdate").alias("admitted_on"))
    specialties = spark.createDataFrame([(f"u{i}", f"t{i + j}") for i in range(3) for j in (0, 3)], "unit string, taxonomy_code string")
    return simulate.choose_attendings(rows, d.providers, specialties, "s").select("encounter_id", "attending_npi")


@register("sim9_batch_vitals", "SELECT p AS patient_id, CAST(run AS BIGINT) AS run, CAST(e AS BIGINT) AS elapsed, CAST(60 + (e + k) % 40 AS DOUBLE) AS heart_rate, CASE WHEN e % 300 = 0 THEN CAST(100 + k % 40 AS DOUBLE) END AS systolic_bp FROM (SELECT 'c' || c_custkey AS p, c_custkey AS k, run, e FROM customer, range(0, 2) AS runs(run), (SELECT range AS e FROM range(0, 900, 150)))")
def batch_vitals(spark, sf):
    """The feature window of a batch, which no scenario changes; sim5_scenario_readings covers the rest."""
    d, k = Domain(spark, sf), F.col("c_custkey")
    patient = F.concat(F.lit("c"), k).alias("patient_id")
    waveforms = d.table("customer").select(patient, k, F.explode(F.sequence(F.lit(0), F.lit(899))).alias("offset_seconds")).select("patient_id", "offset_seconds", (60 + (F.col("offset_seconds") + F.col("c_custkey")) % 40).cast("double").alias("heart_rate"))
    bedside = d.table("customer").select(patient, (100 + k % 40).cast("double").alias("systolic_bp"))
    cycles = simulate.batch_cycles(spark, d.patients, "s", "2024-01-01", runs=2, seconds=900, step=150)
    return show(simulate.batch_vitals(cycles, waveforms, bedside, "s"), ["patient_id", "run", "elapsed", "heart_rate", "systolic_bp"])


@register("prj11_observation_rows", sql("SELECT event_id, '8867-4' AS loinc_code, round(heart_rate, 1) AS value, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS DOUBLE) AS second_value FROM wide WHERE heart_rate IS NOT NULL UNION ALL SELECT event_id, '85354-9', round(systolic_bp, 1), NULL, round(diastolic_bp, 1) FROM wide WHERE systolic_bp IS NOT NULL AND diastolic_bp IS NOT NULL UNION ALL SELECT event_id, '67775-7', NULL, CASE consciousness_level WHEN 0 THEN 'LA9340-6' WHEN 1 THEN 'LA6560-2' WHEN 2 THEN 'LA17108-4' WHEN 3 THEN 'LA17107-6' WHEN 4 THEN 'LA9343-0' END, NULL FROM wide WHERE consciousness_level IS NOT NULL", "wide"))
def observation_rows(spark, sf):
    out = ingest.observations_of(Domain(spark, sf).wide.select("event_id", *FIELDS)).where(F.col("loinc_code").isin("8867-4", "85354-9", "67775-7"))
    return out.select("event_id", "loinc_code", "value", "answer", "second_value")


@register("win9_hourly_history", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC) AS n FROM (SELECT user_id, date_trunc('hour', ts) AS h, max(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE n <= 60 GROUP BY 1")
def hourly_history(spark, sf):
    e = Domain(spark, sf).table("events").select("event_id", "user_id", F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("h"))
    return ranking.recent_history(e, "user_id", "h", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))

