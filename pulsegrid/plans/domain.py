"""The engine's input relations, derived from the driver tables; once as DataFrames and once as DuckDB SQL.

Events become wide vital records (with deliberate faults), orders become admissions and claims, suppliers become
provider versions, customers become patients. The expressions are shared text where both engines read them alike.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import EngineConfig
from pulsegrid.functions.catalog import EXTREMES, FEATURES, FIELDS, LABEL_VERSION, LOINC, MINUTE_FEATURES, NEWS2_BANDS, VITALS
from pulsegrid.operators import features as feats
from pulsegrid.operators import ingest, scd, star
from pulsegrid.session import importable, keep, table

CONFIG = EngineConfig(feature_minutes=7 * 1440, outcome_minutes=7 * 1440, as_of="2024-01-15 12:00:00")
STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "%Y-%m-%d %H:%M:%S"
UNITS = ("Medical intensive care unit", "Step-down unit", "Medical-surgical ward")
CARE = (("critical", 3), ("intermediate", 2), ("acute", 1))


def _vital(i: int) -> str:
    v = VITALS[i]
    low, high = (int(x) for x in v.analytical)
    step = "1" if v.ordinal else "10"
    span = high - low + 1 if v.ordinal else (high - low) * 10 + 1
    when = "event_id % 8 IN (3, 4)" if v.field == "diastolic_bp" else f"event_id % 8 = {i}"
    return f"CASE WHEN {when} THEN ({low} + CAST((event_id * 7919) % {span} AS DOUBLE) / {step}) * (CASE WHEN event_id % 79 = 0 THEN 10 ELSE 1 END) END"


#: name: expression over events; {t}: the event's time as ISO text, {later}: a day later.
WIDE = {
    "observation_id": "CASE WHEN event_id % 89 = 0 THEN CAST(NULL AS VARCHAR(40)) WHEN event_id % 71 = 0 THEN concat('o', CAST(event_id - 8 AS VARCHAR(40))) ELSE concat('o', CAST(event_id AS VARCHAR(40))) END",
    "patient_id": "CASE WHEN event_id % 97 = 0 THEN ' ' ELSE concat('p', CAST(user_id AS VARCHAR(40))) END",
    "encounter_id": "CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS VARCHAR(40)) ELSE concat('enc', CAST(user_id AS VARCHAR(40))) END",
    "event_timestamp": "CASE WHEN event_id % 83 = 0 THEN 'bad' ELSE {t} END",
    "received_at": "CASE WHEN event_id % 71 = 0 THEN {later} ELSE {t} END",
    "source": "CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS VARCHAR(40)) WHEN event_id % 7 = 0 THEN 'load_test' ELSE 'feed' END",
    **{f: _vital(i) for i, f in enumerate(FIELDS)},
}
ADMISSIONS = {
    "encounter_id": "concat('o', CAST(o_orderkey AS VARCHAR(40)))",
    "patient_id": "concat('c', CAST(o_custkey AS VARCHAR(40)))",
    "run_id": "concat('run', CAST(o_orderkey % 6 AS VARCHAR(40)))",
    "scenario": "CASE WHEN o_orderkey % 2 = 0 THEN 'normal' ELSE 'deterioration' END",
    "facility_id": "concat('n', CAST(o_custkey % 25 AS VARCHAR(40)))",
    "unit": f"CASE o_orderkey % 3 WHEN 0 THEN '{UNITS[0]}' WHEN 1 THEN '{UNITS[1]}' ELSE '{UNITS[2]}' END",
    "diagnosis_code": "substr(o_orderpriority, 1, 1)",
    "diagnosis_display": "o_orderpriority",
    "diagnosis_source": "CASE WHEN o_orderkey % 4 = 0 THEN 'simulator_fallback' ELSE 'synthea_history' END",
    "attending_npi": "concat('s', CAST(o_orderkey % 12 AS VARCHAR(40)))",
}
PROVIDERS = {
    "provider_npi": "concat('s', CAST(s_suppkey AS VARCHAR(40)))",
    "provider_name": "s_name",
    "taxonomy_code": "concat('t', CAST((s_nationkey + v) % 7 AS VARCHAR(40)))",
    "taxonomy_description": "concat('specialty ', CAST((s_nationkey + v) % 7 AS VARCHAR(40)))",
    "provider_state": "CASE WHEN s_suppkey % 3 = 0 THEN ' OR ' ELSE 'WA' END",
    "valid_from": "CASE WHEN v = 0 THEN '1990-01-01' ELSE '1995-06-17' END",
    "valid_to": "CASE WHEN v = 0 AND s_suppkey % 2 = 0 THEN '1995-06-17' ELSE ' ' END",
    "is_current": "CASE WHEN v = 0 AND s_suppkey % 2 = 0 THEN 'false' ELSE 'true' END",
    "data_source": "'roster'",
}


class Domain:
    """The relations for one set of driver tables; each is built once, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = importable(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def wide(self) -> DataFrame:
        iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
        t, later = iso.format("ts"), iso.format("ts + interval 1 day")
        cols = {n: F.expr(e.format(t=t, later=later) if "{t}" in e else e) for n, e in WIDE.items()}
        return self.table("events").select("event_id", *(c.alias(n) for n, c in cols.items()))

    @cached_property
    def candidates(self) -> DataFrame:
        return ingest.with_metadata(ingest.measurement_candidates(self.wide))

    @cached_property
    def valid(self) -> DataFrame:
        return ingest.split(self.candidates)[0]

    @cached_property
    def processed(self) -> DataFrame:
        return keep(ingest.latest_per_key(self.valid))  # a table in the lakehouse, which the models below read many times

    @cached_property
    def active(self) -> DataFrame:
        """The active patients: all users of the events table with a purchase, as many as the table has."""
        return self.table("events").where("event_type = 'purchase'").select(F.concat(F.lit("p"), "user_id").alias("patient_id")).distinct()

    @cached_property
    def staged(self) -> DataFrame:
        return star.staged_observations(self.processed, self.active)

    @cached_property
    def provider_history(self) -> DataFrame:
        versions = self.table("supplier").withColumn("v", F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        return versions.select(*(F.expr(e).alias(n) for n, e in PROVIDERS.items()))

    @cached_property
    def providers(self) -> DataFrame:
        return star.dim_provider(self.provider_history)

    @cached_property
    def encounters(self) -> DataFrame:
        return keep(star.dim_encounter(self.staged, self.providers, config=CONFIG))

    @cached_property
    def facts(self) -> DataFrame:
        return star.fact_observations(self.staged, self.encounters)

    @cached_property
    def features(self) -> DataFrame:
        return feats.encounter_vital_features(self.encounters, self.facts, CONFIG)

    @cached_property
    def minutes(self) -> DataFrame:
        return feats.minute_features(self.features, self.facts)

    @cached_property
    def news2(self) -> DataFrame:
        return feats.encounter_news2(self.features, self.facts)

    @cached_property
    def admissions(self) -> DataFrame:
        o = self.table("orders")
        start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
        end = start + F.make_dt_interval(hours=(2 + F.col("o_orderkey") % 25).cast("int"), mins=((F.col("o_orderkey") % 7) * 10).cast("int"))
        return o.select(*(F.expr(e).alias(n) for n, e in ADMISSIONS.items()), start.alias("admitted_at"), end.alias("discharged_at"))

    @cached_property
    def admission_news2(self) -> DataFrame:
        key, n = F.md5(F.concat(F.lit("o"), "o_orderkey")), F.col("o_orderkey")
        return self.table("orders").select(key.alias("encounter_key"), F.when(n % 5 != 0, (n % 12).cast("int")).alias("news2_total"))

    @cached_property
    def payer_history(self) -> DataFrame:
        claims = self.table("orders").select(F.concat(F.lit("c"), "o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("payer_name"), F.to_date("o_orderdate").alias("start"))
        return scd.periods(claims, "patient_id", "payer_name", "start")

    @cached_property
    def patients(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("c"), k).alias("patient_id"),
            F.date_add(F.lit("1940-01-01").cast("date"), (k % 18000).cast("int")).alias("birth_date"),
            F.when(k % 2 == 0, "female").otherwise("male").alias("gender"),
            *(F.lit(v).alias(n) for n, v in (("race", "r"), ("ethnicity", "e"), ("marital_status", "m"))),
            F.col("c_mktsegment").alias("state"),
        )

    @cached_property
    def versions(self) -> DataFrame:
        return star.dim_patient_version(self.payer_history, self.patients)

    @cached_property
    def fact_admissions(self) -> DataFrame:
        return star.fact_admissions(self.admissions, self.versions, self.providers)

    @cached_property
    def facilities(self) -> DataFrame:
        n = self.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("facility_id"), F.col("n_name").alias("facility_name"), F.lit("c").alias("city"), F.lit("s").alias("state"))
        return star.dim_facility(n)

    @cached_property
    def units(self) -> DataFrame:
        rows = [(u, c, r) for u, (c, r) in zip(UNITS, CARE, strict=True)]
        return star.dim_unit(self.facilities, self.spark.createDataFrame(rows, "unit_name string, care_level string, care_level_rank int"))

    @cached_property
    def census(self) -> DataFrame:
        return feats.unit_hourly_census(self.fact_admissions, self.admission_news2, CONFIG)

    @cached_property
    def training(self) -> DataFrame:
        return feats.training_dataset(self.features, config=CONFIG)

    @cached_property
    def predictions(self) -> DataFrame:
        d, y = self.table("documents"), self.table("labels")
        rows = y.join(d.select("doc_id", "n_chars"), "doc_id")
        p = F.round((F.col("n_chars") % 1000) / 1000.0, 3)
        version = F.when(F.col("doc_id") % 3 == 0, "m1").otherwise("m2")
        return rows.select(
            version.alias("model_version"), F.md5(F.col("doc_id").cast("string")).alias("encounter_key"), F.md5((F.col("doc_id") % 50).cast("string")).alias("patient_key"), F.lit("test").alias("data_split"),
            F.col("toxic").alias("actual_label"), p.alias("deterioration_probability"), (p >= 0.5).cast("int").alias("predicted_label"), F.lit(0.5).alias("decision_threshold"),
            F.lit("f1").alias("feature_schema_version"), F.lit("l1").alias("label_definition_version"), F.lit("x").alias("dataset_fingerprint"), F.concat(F.lit("2024-01-0"), F.col("doc_id") % 9 + 1).alias("scored_at"), "quality", "doc_id",
        )


# ---- the same as DuckDB SQL: named relations, each a common table expression ----

_T = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_LATER = "strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S')"


def _select(cols: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('{t}', _T).replace('{later}', _LATER)} AS {n}" for n, e in cols.items())


def _case(field: str, inner: str = "value") -> str:
    return f"CASE WHEN loinc_code = '{LOINC[field]}' THEN {inner} END"


def _score(parameter: str) -> str:
    bands, above = NEWS2_BANDS[parameter]
    test = "=" if parameter == "consciousness_level" else "<="
    return "CASE WHEN " + f"{parameter} IS NULL THEN NULL " + " ".join(f"WHEN {parameter} {test} {b} THEN {s}" for b, s in bands) + f" ELSE {above} END"


_SQL_STAT = {"mean": "avg", "min": "min", "max": "max", "stddev": "stddev_samp"}
_HEX = "|| '|' ||"
_legacy = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("patient_id", "event_timestamp", "source", *FIELDS))
_ids = f"CASE WHEN observation_id IS NOT NULL AND trim(observation_id) <> '' THEN observation_id ELSE 'legacy_flattened_' || sha256({_legacy}) END"
_low = "CASE loinc_code " + " ".join(f"WHEN '{v.loinc}' THEN {v.analytical[0]}" for v in VITALS) + " END"
_high = "CASE loinc_code " + " ".join(f"WHEN '{v.loinc}' THEN {v.analytical[1]}" for v in VITALS) + " END"
_extreme = {f: (f"value <= {lo}" if hi is None else f"(value <= {lo} OR value >= {hi})") for f, (lo, hi) in EXTREMES.items()}

RELATIONS = {
    "wide": f"SELECT event_id, {_select(WIDE)} FROM events",
    "candidates": " UNION ALL ".join(
        f"SELECT {_ids} AS observation_id, patient_id, encounter_id, '{v.name}' AS observation_type, '{v.loinc}' AS loinc_code, {v.field} AS value, '{v.unit}' AS unit, "
        f"try_cast(event_timestamp AS TIMESTAMP) AS effective_datetime, try_cast(received_at AS TIMESTAMP) AS received_at, coalesce(source, 'fhir_webhook') AS source FROM wide WHERE {v.field} IS NOT NULL"
        for v in VITALS
    ),
    "classified": (
        "SELECT *, CASE WHEN observation_id IS NULL OR trim(observation_id) = '' THEN 'missing_observation_id' WHEN patient_id IS NULL OR trim(patient_id) = '' THEN 'missing_patient_id' "
        "WHEN value IS NULL THEN 'missing_value' WHEN effective_datetime IS NULL THEN 'missing_effective_datetime' "
        f"WHEN NOT (value BETWEEN {_low} AND {_high}) THEN 'physiological_range_violation' END AS rejection_reason FROM candidates"
    ),
    "processed": (
        "SELECT * EXCLUDE (rejection_reason, rn), year(effective_datetime) AS year, month(effective_datetime) AS month, day(effective_datetime) AS day FROM (SELECT *, row_number() OVER (PARTITION BY observation_id, loinc_code ORDER BY "
        + ", ".join(f"{c} DESC NULLS LAST" for c in ingest.RECENCY)
        + ") AS rn FROM classified WHERE rejection_reason IS NULL) WHERE rn = 1"
    ),
    "active": "SELECT DISTINCT concat('p', CAST(user_id AS VARCHAR)) AS patient_id FROM events WHERE event_type = 'purchase'",
    "staged": "SELECT * FROM processed WHERE encounter_id IS NOT NULL AND trim(encounter_id) <> '' AND patient_id IN (SELECT patient_id FROM active)",
    "provider_history": f"SELECT {_select(PROVIDERS)} FROM (SELECT s.*, v FROM supplier s, (VALUES (0), (1)) AS versions(v) WHERE v = 0 OR s_suppkey % 2 = 0)",
    "providers": (
        "SELECT md5(provider_npi || '|' || CAST(valid_from AS VARCHAR)) AS provider_version_key, md5(provider_npi) AS provider_key, * FROM (SELECT trim(provider_npi) AS provider_npi, trim(provider_name) AS provider_name, trim(taxonomy_code) AS taxonomy_code, "
        "trim(taxonomy_description) AS taxonomy_description, trim(provider_state) AS provider_state, CAST(valid_from AS DATE) AS valid_from, CAST(nullif(trim(valid_to), '') AS DATE) AS valid_to, CAST(is_current AS BOOLEAN) AS is_current, data_source FROM provider_history)"
    ),
    "encounters": (
        "SELECT md5(e.encounter_id) AS encounter_key, e.encounter_id, 'Encounter/' || e.encounter_id AS encounter_reference, md5(e.patient_id) AS patient_key, e.patient_id, p.provider_key, p.provider_version_key, encounter_start_at, encounter_end_at, true AS is_synthetic_provider_assignment "
        "FROM (SELECT *, row_number() OVER (ORDER BY encounter_id, patient_id) AS n FROM (SELECT trim(encounter_id) AS encounter_id, patient_id, min(effective_datetime) AS encounter_start_at, max(effective_datetime) AS encounter_end_at FROM staged WHERE patient_id IS NOT NULL GROUP BY 1, 2)) e "
        "JOIN (SELECT provider_npi, row_number() OVER (ORDER BY provider_npi) AS k, count(*) OVER () AS c FROM providers WHERE is_current) r ON r.k = (e.n - 1) % r.c + 1 "
        "JOIN providers p ON p.provider_npi = r.provider_npi AND CAST(encounter_start_at AS DATE) >= p.valid_from AND CAST(encounter_start_at AS DATE) < coalesce(p.valid_to, DATE '9999-12-31')"
    ),
    "facts": (
        "SELECT md5(observation_id || '|' || loinc_code) AS fact_observation_key, md5(o.patient_id) AS patient_key, e.encounter_key, provider_key, provider_version_key, md5(loinc_code) AS observation_type_key, CAST(strftime(effective_datetime, '%Y%m%d') AS INTEGER) AS date_key, o.* "
        "FROM staged o JOIN encounters e ON md5(trim(o.encounter_id)) = e.encounter_key"
    ),
    "windowed": (
        f"SELECT e.*, f.loinc_code, f.value, f.effective_datetime, f.fact_observation_key, encounter_start_at + INTERVAL {CONFIG.feature_minutes} MINUTE AS feature_cutoff_at, encounter_start_at + INTERVAL {CONFIG.feature_minutes + CONFIG.outcome_minutes} MINUTE AS outcome_cutoff_at, "
        f"f.effective_datetime < encounter_start_at + INTERVAL {CONFIG.feature_minutes} MINUTE AS is_f, "
        f"f.effective_datetime >= encounter_start_at + INTERVAL {CONFIG.feature_minutes} MINUTE AND f.effective_datetime < encounter_start_at + INTERVAL {CONFIG.feature_minutes + CONFIG.outcome_minutes} MINUTE AS is_o "
        "FROM encounters e JOIN facts f ON e.encounter_key = f.encounter_key"
    ),
    "counted": (
        "SELECT encounter_key, patient_key, provider_key, provider_version_key, encounter_start_at, encounter_end_at, feature_cutoff_at, outcome_cutoff_at, count(*) FILTER (is_f) AS feature_observation_count, count(*) FILTER (is_o) AS outcome_observation_count, "
        + ", ".join(f"{_SQL_STAT[s]}(CASE WHEN is_f AND loinc_code = '{LOINC[v]}' THEN value END) AS {n}" for n, v, s in FEATURES)
        + ", "
        + ", ".join(f"count(*) FILTER (is_o AND loinc_code = '{LOINC[f]}' AND {e}) AS outcome_{f}_extreme_count" for f, e in _extreme.items())
        + " FROM windowed GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"
    ),
    "features": (
        f"SELECT *, CASE WHEN greatest({', '.join(f'outcome_{f}_extreme_count' for f in EXTREMES)}) >= {CONFIG.min_repeated_extremes} THEN 1 ELSE 0 END AS deterioration_proxy_label, '{LABEL_VERSION}' AS label_definition_version, "
        f"TIMESTAMP '{CONFIG.as_of}' >= feature_cutoff_at AND feature_observation_count > 0 AS is_scoring_eligible, TIMESTAMP '{CONFIG.as_of}' >= outcome_cutoff_at AND feature_observation_count > 0 AND outcome_observation_count > 0 AS is_training_eligible FROM counted"
    ),
    "minutes": (
        "SELECT md5(encounter_key || '|' || CAST(minute_index AS VARCHAR)) AS encounter_minute_key, encounter_key, patient_key, minute_index, deterioration_proxy_label, count(*) AS observation_count, "
        + ", ".join(f"{_SQL_STAT[s]}({_case(v)}) AS {n}" for n, v, s in MINUTE_FEATURES)
        + " FROM (SELECT e.encounter_key, e.patient_key, e.deterioration_proxy_label, f.loinc_code, f.value, CAST(date_diff('second', e.encounter_start_at, f.effective_datetime) // 60 AS INTEGER) AS minute_index "
        "FROM features e JOIN facts f ON e.encounter_key = f.encounter_key WHERE e.is_training_eligible AND f.effective_datetime < e.feature_cutoff_at) GROUP BY 2, 3, 4, 5"
    ),
    "last_values": (
        "SELECT encounter_key, patient_key, feature_cutoff_at, "
        + ", ".join(f"max({_case(p)}) AS {p}" for p in NEWS2_BANDS)
        + " FROM (SELECT e.encounter_key, e.patient_key, e.feature_cutoff_at, f.loinc_code, f.value, row_number() OVER (PARTITION BY e.encounter_key, f.loinc_code ORDER BY f.effective_datetime DESC, f.fact_observation_key DESC) AS rn "
        "FROM features e JOIN facts f ON e.encounter_key = f.encounter_key WHERE f.effective_datetime < e.feature_cutoff_at) WHERE rn = 1 GROUP BY 1, 2, 3"
    ),
    "news2": "SELECT *, " + " + ".join(f"({_score(p)})" for p in NEWS2_BANDS) + " AS news2_total FROM last_values",
    "admissions": (
        f"SELECT {_select(ADMISSIONS)}, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS admitted_at, "
        "CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_hours(2 + o_orderkey % 25) + to_minutes((o_orderkey % 7) * 10) AS discharged_at FROM orders"
    ),
    "admission_news2": "SELECT md5(concat('o', CAST(o_orderkey AS VARCHAR))) AS encounter_key, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 12 AS INTEGER) END AS news2_total FROM orders",
    "payer_history": (
        "SELECT patient_id, payer_name, valid_from, lead(valid_from) OVER (PARTITION BY patient_id ORDER BY valid_from, payer_name) AS valid_to FROM (SELECT *, lag(payer_name) OVER (PARTITION BY patient_id ORDER BY valid_from, payer_name) AS before "
        "FROM (SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS patient_id, o_orderpriority AS payer_name, CAST(o_orderdate AS DATE) AS valid_from FROM orders)) WHERE before IS NULL OR before <> payer_name"
    ),
    "patients": "SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS patient_id, CAST(DATE '1940-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS DATE) AS birth_date, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, 'r' AS race, 'e' AS ethnicity, 'm' AS marital_status, c_mktsegment AS state FROM customer",
    "versions": "SELECT md5(h.patient_id || '|' || CAST(valid_from AS VARCHAR)) AS patient_version_key, md5(h.patient_id) AS patient_key, h.patient_id, birth_date, gender, race, ethnicity, marital_status, state, payer_name, valid_from, valid_to, valid_to IS NULL AS is_current FROM payer_history h JOIN patients p ON h.patient_id = p.patient_id",
    "fact_admissions": (
        "SELECT md5(a.encounter_id) AS admission_key, md5(a.encounter_id) AS encounter_key, md5(a.patient_id) AS patient_key, v.patient_version_key, md5(a.attending_npi) AS provider_key, p.provider_version_key, md5(a.facility_id) AS facility_key, md5(a.facility_id || '|' || a.unit) AS unit_key, "
        "CAST(strftime(admitted_at, '%Y%m%d') AS INTEGER) AS admit_date_key, a.encounter_id, a.run_id, a.scenario, admitted_at, discharged_at, date_diff('second', admitted_at, discharged_at) // 3600 AS length_of_stay_hours, a.unit, a.diagnosis_code, a.diagnosis_display, a.diagnosis_source, a.attending_npi, "
        "p.taxonomy_code AS attending_taxonomy_code, p.taxonomy_description AS attending_specialty, v.birth_date, date_diff('second', CAST(v.birth_date AS TIMESTAMP), admitted_at) // 31557600 AS age_at_admission_years FROM admissions a "
        "LEFT JOIN versions v ON a.patient_id = v.patient_id AND CAST(admitted_at AS DATE) >= v.valid_from AND (v.valid_to IS NULL OR CAST(admitted_at AS DATE) < v.valid_to) "
        "LEFT JOIN providers p ON a.attending_npi = p.provider_npi AND CAST(admitted_at AS DATE) >= p.valid_from AND (p.valid_to IS NULL OR CAST(admitted_at AS DATE) < p.valid_to)"
    ),
    "facilities": "SELECT md5('n' || CAST(n_nationkey AS VARCHAR)) AS facility_key, 'n' || CAST(n_nationkey AS VARCHAR) AS facility_id, n_name AS facility_name, 'c' AS city, 's' AS state FROM nation",
    "units": "SELECT md5(facility_id || '|' || unit_name) AS unit_key, facility_key, facility_id, facility_name, unit_name, care_level, CAST(care_level_rank AS INTEGER) AS care_level_rank FROM facilities, (VALUES "
    + ", ".join(f"('{u}', '{c}', {r})" for u, (c, r) in zip(UNITS, CARE, strict=True))
    + ") AS u(unit_name, care_level, care_level_rank)",
    "present": (
        "SELECT a.*, n.news2_total, date_trunc('hour', admitted_at) + to_hours(k) AS hour_start FROM fact_admissions a LEFT JOIN admission_news2 n ON a.encounter_key = n.encounter_key, "
        "range(0, 1000) AS hours(k) WHERE date_trunc('hour', admitted_at) + to_hours(k) < discharged_at"
    ),
    "census": (
        "SELECT unit_key, facility_key, unit, hour_start, count(*) AS census, count(*) FILTER (admitted_at >= hour_start AND admitted_at < hour_start + INTERVAL 1 HOUR) AS admissions, count(*) FILTER (discharged_at >= hour_start AND discharged_at < hour_start + INTERVAL 1 HOUR) AS discharges, "
        "avg(news2_total) AS mean_admission_news2, count(*) FILTER (news2_total >= 5) AS patients_news2_5_or_more, count(*) FILTER (news2_total >= 7) AS patients_news2_7_or_more FROM present GROUP BY 1, 2, 3, 4"
    ),
    "training": (
        "SELECT *, 'vital-features-v3' AS feature_schema_version, CAST(CAST('0x' || substr(patient_key, 1, 7) AS BIGINT) % 10 AS BIGINT) AS split_bucket, CASE WHEN CAST('0x' || substr(patient_key, 1, 7) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'test' END AS data_split FROM features WHERE is_training_eligible"
    ),
    "predictions": (
        "SELECT CASE WHEN doc_id % 3 = 0 THEN 'm1' ELSE 'm2' END AS model_version, md5(CAST(doc_id AS VARCHAR)) AS encounter_key, md5(CAST(doc_id % 50 AS VARCHAR)) AS patient_key, 'test' AS data_split, toxic AS actual_label, round((n_chars % 1000) / 1000.0, 3) AS deterioration_probability, "
        "CASE WHEN round((n_chars % 1000) / 1000.0, 3) >= 0.5 THEN 1 ELSE 0 END AS predicted_label, 0.5 AS decision_threshold, 'f1' AS feature_schema_version, 'l1' AS label_definition_version, 'x' AS dataset_fingerprint, '2024-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR) AS scored_at, quality, doc_id FROM labels JOIN documents USING (doc_id)"
    ),
}
#: What each relation reads.
_USES = {n: [m for m in RELATIONS if m != n and f" {m} " in f" {sql.replace('(', ' ').replace(')', ' ').replace(',', ' ')} "] for n, sql in RELATIONS.items()}


def sql(final: str, *relations: str) -> str:
    """A statement over named relations and what these read."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _USES[name]:
            add(other)
        if name not in order:
            order.append(name)

    for r in relations:
        add(r)
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in order) + " " + final if order else final
