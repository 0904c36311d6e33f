"""Queries over sources and sinks: what is written comes back as it was, and each reader gives its rows."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import ACVPU, BP_PANEL, FIELDS, VITALS
from pulsegrid.operators import access, cohort, ingest
from pulsegrid.operators.ingest import EVENT_SCHEMA
from pulsegrid.plans.domain import Domain, sql
from pulsegrid.plans.registry import register
from pulsegrid.plans.vitals import _merge_sql, show, shown
from pulsegrid.session import new_folder
from pulsegrid.sources import readers, sinks

FLAT = ["observation_id", "patient_id", "encounter_id", "event_timestamp", "source", *FIELDS]
REASONED = ["observation_id", "loinc_code", "value", "rejection_reason"]


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(data))
    out.close()


def _rename(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Renames the files of a folder that end in old so that they end in new."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(folder)):
        name = status.getPath().toString()
        if name.endswith(old):
            fs.rename(path(name), path(name[: -len(old)] + new))


# ---- sources ----


@register("src1_raw_json_events", sql(f"SELECT {shown(FLAT, doubles=set(FIELDS))} FROM wide", "wide"))
def raw_json_events(spark, sf):
    w, path = Domain(spark, sf).wide, new_folder(spark, "raw_events")
    w.where("event_id % 2 = 0").select(*FLAT).write.json(f"{path}/day=1/hour=2")
    w.where("event_id % 2 = 1").select(*FLAT).write.json(f"{path}/late")
    return show(readers.resolve_types(readers.raw_events(spark, path), [(f, "double") for f in FIELDS]), FLAT)


@register("src1_incremental_events", sql("SELECT observation_id, patient_id, event_timestamp FROM wide", "wide"))
def incremental_events(spark, sf):
    w, path = Domain(spark, sf).wide, new_folder(spark, "incremental")
    for part in (0, 1):  # a second run reads only the files that came after the first
        w.where(F.col("event_id") % 2 == part).select(*FLAT).write.json(f"{path}/in/part{part}")
        stream = readers.incremental_events(spark, f"{path}/in").select("observation_id", "patient_id", "event_timestamp")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@register("src2_resolved_types", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS DOUBLE) / 4 END AS number, CASE WHEN event_id % 5 <> 0 AND event_id % 4 = 0 THEN event_id // 4 END AS whole FROM events")
def resolved_types(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "n/a").otherwise((k / 4).cast("string"))
    whole = F.when(k % 5 == 0, "x1").when(k % 4 == 0, (k / 4).cast("long").cast("string")).otherwise("1.2.3")
    rows = Domain(spark, sf).table("events").select("event_id", text.alias("number"), whole.alias("whole"))
    return readers.resolve_types(rows, [("number", "double"), ("whole", "long"), ("absent", "int")])


def _observation_text() -> F.Column:
    """An observation as JSON text for each event, with faults at some event numbers."""
    k, i = F.col("event_id"), F.col("event_id") % 8
    none = F.lit(None)
    value = (k % 100) + 0.5
    codes = F.array(*(F.lit(BP_PANEL if v.field.endswith("_bp") else v.loinc) for v in VITALS))
    coding = lambda code: F.struct(F.array(F.struct(F.lit("http://other").alias("system"), F.lit("zz").alias("code")), F.struct(F.lit("http://loinc.org").alias("system"), code.alias("code"))).alias("coding"))
    part = lambda loinc, x: F.struct(coding(F.lit(loinc)).alias("code"), F.struct(x.alias("value"), F.lit("mmHg").alias("unit")).alias("valueQuantity"))
    answer = F.element_at(F.array(*(F.lit(c) for c in ACVPU)), (k % 5 + 1).cast("int"))
    return F.to_json(
        F.struct(
            F.when(k % 67 == 0, "Patient").otherwise("Observation").alias("resourceType"),
            F.when(k % 89 == 0, "").otherwise(F.concat(F.lit("o"), k)).alias("id"),
            coding(F.when(k % 83 == 0, "1-1").otherwise(F.element_at(codes, (i + 1).cast("int")))).alias("code"),
            F.struct(F.concat(F.when(k % 97 == 0, "Group/p").otherwise("Patient/p"), "user_id").alias("reference")).alias("subject"),
            F.when(k % 101 != 0, F.struct(F.concat(F.lit("Encounter/enc"), "user_id").alias("reference"))).alias("encounter"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("effectiveDateTime"),
            F.when(i.isin(0, 1, 2, 5, 6), F.struct(value.alias("value"), F.lit("u").alias("unit"))).otherwise(none).alias("valueQuantity"),
            F.when(i == 7, coding(answer)).otherwise(none).alias("valueCodeableConcept"),
            F.when(i.isin(3, 4), F.array_compact(F.array(part("8480-6", value), F.when(k % 13 != 0, part("8462-4", value + 10))))).otherwise(none).alias("component"),
        )
    )


_OK = "event_id % 83 <> 0 AND event_id % 8"
_V = "CAST(event_id % 100 AS DOUBLE) + 0.5"
_SINGLE = {"heart_rate": 0, "respiratory_rate": 1, "spo2": 2, "temperature": 5, "inhaled_oxygen_concentration": 6}
_FHIR = {
    **{f: f"CASE WHEN {_OK} = {i} THEN {_V} END" for f, i in _SINGLE.items()},
    "systolic_bp": f"CASE WHEN {_OK} IN (3, 4) THEN {_V} END",
    "diastolic_bp": f"CASE WHEN {_OK} IN (3, 4) AND event_id % 13 <> 0 THEN {_V} + 10 END",
    "consciousness_level": f"CASE WHEN {_OK} = 7 THEN CAST(([{', '.join(map(str, ACVPU.values()))}])[event_id % 5 + 1] AS DOUBLE) END",
}


@register(
    "prj5_fhir_events",
    "SELECT CASE WHEN event_id % 89 = 0 THEN '' ELSE 'o' || event_id END AS observation_id, CASE WHEN event_id % 97 <> 0 THEN 'p' || user_id END AS patient_id, CASE WHEN event_id % 101 <> 0 THEN 'enc' || user_id END AS encounter_id, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_timestamp, " + ", ".join(f"{_FHIR[f]} AS {f}" for f in FIELDS) + ", CASE WHEN event_id % 89 = 0 THEN 'observation identifier is required' WHEN event_id % 97 = 0 THEN 'subject must reference a Patient' "
    "WHEN event_id % 101 = 0 THEN 'encounter must reference an Encounter' WHEN event_id % 83 = 0 THEN 'unsupported LOINC code' END AS error FROM events",
)
def fhir_events(spark, sf):
    texts = Domain(spark, sf).table("events").select(_observation_text().alias("value"))
    return ingest.fhir_events(readers.observations(texts)).select("observation_id", "patient_id", "encounter_id", "event_timestamp", *FIELDS, "error")


@register("src4_pushed_observations", "SELECT event_id, CASE WHEN event_id % 61 = 0 OR event_id % 67 = 0 THEN 'resource must be an Observation' WHEN event_id % 50 = 0 OR event_id % 89 = 0 THEN 'path id does not match the resource id' END AS request_error FROM events")
def pushed_observations(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 61 == 0, "no json").otherwise(_observation_text())
    rows = Domain(spark, sf).table("events").select("event_id", F.when(k % 50 == 0, "another").otherwise(F.concat(F.lit("o"), k)).alias("path_id"), text.alias("value"))
    return readers.observations(rows).select("event_id", "request_error")


@register("src5_ndjson_folder", sql("SELECT observation_id, event_timestamp FROM wide", "wide"))
def ndjson_folder(spark, sf):
    folder = new_folder(spark, "ndjson")
    Domain(spark, sf).wide.select(*FLAT).write.json(folder)
    _rename(spark, folder, ".json", ".ndjson")
    _write_bytes(spark, f"{folder}/notes.txt", b"no event")
    return readers.ndjson_folder(spark, folder).select("observation_id", "event_timestamp")


@register("src6_seed_csv", sql("SELECT provider_npi, provider_name, taxonomy_code, provider_state, valid_from, valid_to, is_current = 'true' AS is_current FROM provider_history", "provider_history"))
def seed_csv(spark, sf):
    path = new_folder(spark, "seed")
    Domain(spark, sf).provider_history.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return readers.seed_csv(spark, path, readers.PROVIDER_SEED).select("provider_npi", "provider_name", "taxonomy_code", "provider_state", "valid_from", "valid_to", "is_current")


@register("src7_table_scan", sql("SELECT observation_id, loinc_code, round(value, 6) AS value FROM processed", "processed"))
def table_scan(spark, sf):
    path = new_folder(spark, "table")
    sinks.replace_table(Domain(spark, sf).processed, path)
    readers.read_table(spark, path).createOrReplaceTempView("src7_processed")
    return show(readers.read_table(spark, "src7_processed"), ["observation_id", "loinc_code", "value"])


@register("src8_ordered_records", sql("SELECT encounter_key, feature_observation_count, true AS in_order FROM features", "features"))
def ordered_records(spark, sf):
    """The rows with whether each comes after the one before it."""
    rows = readers.ordered_records(Domain(spark, sf).features, ["encounter_key", "feature_observation_count"])
    placed = rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    earlier = F.lag("encounter_key").over(Window.partitionBy("part").orderBy("at"))
    return placed.select("encounter_key", "feature_observation_count", F.coalesce(earlier <= F.col("encounter_key"), F.lit(True)).alias("in_order"))


@register("src9_training_csv", sql("SELECT encounter_key, round(heart_rate_mean, 6) AS heart_rate_mean, deterioration_proxy_label, data_split FROM training", "training"))
def training_csv(spark, sf):
    path = new_folder(spark, "training")
    rows = Domain(spark, sf).training
    rows.write.option("header", "true").csv(path)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return show(readers.seed_csv(spark, path, schema), ["encounter_key", "heart_rate_mean", "deterioration_proxy_label", "data_split"])


@register("src10_result_pages", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def result_pages(spark, sf):
    c = Domain(spark, sf).table("customer")
    cell = lambda x: F.struct(x.cast("string").alias("VarCharValue"))
    k = F.col("c_custkey")
    short = F.when(k % 7 == 0, F.array(cell(k), cell(F.when(k % 5 != 0, F.col("c_name"))))).otherwise(F.array(cell(k), cell(F.when(k % 5 != 0, F.col("c_name"))), cell(F.col("c_mktsegment"))))
    head = F.struct(F.lit(-1).cast("long").alias("at"), F.array(*(cell(F.lit(n)) for n in ("c_custkey", "c_name", "c_mktsegment"))).alias("Data"))
    pages = c.select(F.floor(k / 100).alias("page"), F.struct(k.cast("long").alias("at"), short.alias("Data")).alias("r")).groupBy("page").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    rows = F.transform(F.when(F.col("page") % 3 == 0, F.concat(F.array(head), "rows")).otherwise(F.col("rows")), lambda r: F.struct(r["Data"].alias("Data")))
    texts = pages.select("page", F.to_json(F.struct(F.struct(rows.alias("Rows")).alias("ResultSet"))).alias("value"))
    return readers.result_pages(texts, ["c_custkey", "c_name", "c_mktsegment"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


def _served(url: str) -> str:
    """A page of a made-up search: two entries, and a link to the next page up to the patient's last."""
    patient, page = (int(x.split("=")[1]) for x in url.split("?")[1].split("&"))
    links = [{"relation": "self", "url": url}] + ([{"relation": "next", "url": f"search?patient={patient}&page={page + 1}"}] if page < patient % 3 else [])
    return json.dumps({"resourceType": "Bundle", "link": links, "entry": [{"resource": {"id": f"{patient}-{page}-{i}"}} for i in range(2)]})


@register("src13_paged_search", "SELECT 'search?patient=' || c_custkey || '&page=0' AS url, CAST(p AS INTEGER) AS page, CAST(i AS INTEGER) AS position, '{\"id\":\"' || c_custkey || '-' || p || '-' || i || '\"}' AS resource FROM customer, range(0, 3) AS pages(p), range(0, 2) AS items(i) WHERE p <= c_custkey % 3")
def paged_search(spark, sf):
    starts = Domain(spark, sf).table("customer").select(F.concat(F.lit("search?patient="), "c_custkey", F.lit("&page=0")).alias("url"))
    return readers.paged_search(starts, _served)


@register("src14_waveform_records", "SELECT 'bidmc' || lpad(CAST(r AS VARCHAR), 2, '0') || 'n' AS record, CAST(i AS INTEGER) AS offset_seconds, CASE WHEN i % 7 <> 3 THEN round(60 + r + i / 10.0, 6) END AS heart_rate, round(12 + i / 50.0, 6) AS respiratory_rate, round(CAST(90 + r AS DOUBLE), 6) AS spo2 FROM range(1, 9) AS records(r), range(0, 40) AS samples(i)")
def waveform_records(spark, sf):
    Domain(spark, sf)
    folder = new_folder(spark, "waveforms")
    for r in range(1, 9):
        name, i = f"bidmc{r:02d}n", np.arange(40)
        hr = np.where(i % 7 == 3, -32768, (60 + r) * 10 + i)
        data = np.stack([(90 + r) * 100 + 5 + 0 * i, hr, 12 * 50 + i], axis=1).astype("<i2")
        stray = "0 " if r == 3 else ""
        header = f"{name} 3 1 40\n{name}.dat 16 100(5)/% 16 0 0 0 0 SpO2,\n{name}.dat 16 10(0)/bpm 16 0 0 0 0 {stray}HR,\n{name}.dat 16 50(0)/pm 16 0 0 0 0 RESP,\n# a note\n"
        _write_bytes(spark, f"{folder}/{name}.hea", header.encode())
        _write_bytes(spark, f"{folder}/{name}.dat", data.tobytes())
    return show(readers.waveform_records(spark, folder), ["record", "offset_seconds", "heart_rate", "respiratory_rate", "spo2"])


@register("src15_quarantine_by_reason", sql(f"SELECT {shown(REASONED, doubles={'value'})} FROM classified WHERE rejection_reason = 'physiological_range_violation'", "classified"))
def quarantine_by_reason(spark, sf):
    path = new_folder(spark, "quarantine")
    sinks.write_quarantine(ingest.split(Domain(spark, sf).candidates)[1], path)
    return show(readers.quarantine(spark, path, "observation_id string, loinc_code string, value double, rejection_reason string", "physiological_range_violation"), REASONED)


@register("src16_inline_values", "SELECT a.d * 100 + b.d * 10 + c.d AS n FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS a(d), (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS b(d), (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS c(d)")
def inline_values(spark, sf):
    digits = readers.values(Domain(spark, sf).spark, [(i,) for i in range(10)], "d int")
    empty = readers.values(spark, [], "d int")
    a, b, c = (F.broadcast(digits.unionByName(empty).select(F.col("d").alias(n))) for n in "abc")  # ten rows each, by definition
    return a.crossJoin(b).crossJoin(c).select((F.col("a") * 100 + F.col("b") * 10 + F.col("c")).alias("n"))


# ---- bundles of health records ----

_IDENTIFIER, _SCENARIO = "urn:simulator:encounter", "urn:simulator:scenario"


def _bundles(d: Domain) -> DataFrame:
    """(patient_id, path, value): a bundle of JSON text for each customer, with an encounter, condition, claim and pressure for each order."""
    s = lambda **f: F.struct(*(v.alias(n) for n, v in f.items()))
    one = lambda **f: F.array(s(**f))
    lit = F.lit
    k = F.col("c_custkey")
    said = lambda url, text: s(url=lit(url), extension=one(url=lit("text"), valueString=text))
    patient = F.to_json(
        s(
            resourceType=lit("Patient"), id=F.concat(lit("c"), k), birthDate=F.date_format(F.date_add(lit("1940-01-01").cast("date"), (k % 18000).cast("int")), "yyyy-MM-dd"), gender=F.when(k % 2 == 0, "female").otherwise("male"),
            maritalStatus=s(text=lit("M")), address=one(city=lit("x"), state=F.col("c_mktsegment")), extension=F.array(said(cohort.RACE, F.concat(lit("r"), k % 3)), said(cohort.ETHNICITY, lit("e"))),
        )
    )
    o = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(o % 24).cast("int"))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    visit = F.concat(lit("o"), o)
    encounter = F.to_json(
        F.struct(
            lit("Encounter").alias("resourceType"), visit.alias("id"), s(code=F.when(o % 3 == 0, "IMP").otherwise("AMB")).alias("class"), s(reference=F.concat(lit("Patient/c"), "o_custkey")).alias("subject"),
            s(start=iso(start), end=F.when(o % 7 != 0, iso(start + F.expr("interval 30 hours")))).alias("period"),
            one(coding=one(system=lit(cohort.SNOMED), code=F.concat(lit("d"), o % 5), display=F.concat(lit("diagnosis "), o % 5)), text=lit("synthea_history")).alias("reasonCode"),
            s(reference=F.concat(lit("Organization?identifier=x|f"), o % 4), display=F.concat(lit("Hospital "), o % 4), identifier=s(system=lit("y"), value=F.concat(lit("f"), o % 4))).alias("serviceProvider"),
            F.when(o % 11 != 0, one(location=s(display=F.concat(lit("unit "), o % 3)))).alias("location"),
            one(system=lit(_IDENTIFIER), value=F.concat(lit("run"), o % 6, lit(":x"))).alias("identifier"), s(tag=one(system=lit(_SCENARIO), code=F.when(o % 2 == 0, "normal").otherwise("deterioration"))).alias("meta"),
            one(type=one(coding=one(code=F.when(o % 13 != 0, "ATND").otherwise("PART"))), individual=s(identifier=s(system=lit(cohort.NPI), value=F.concat(lit("s"), o % 12)))).alias("participant"),
        )
    )
    kind = F.when(o % 2 == 0, "(disorder)").otherwise("(finding)")
    condition = F.to_json(s(resourceType=lit("Condition"), code=s(coding=one(system=lit(cohort.SNOMED), code=F.concat(lit("k"), o % 6), display=F.concat(lit("thing "), o % 6, lit(" "), kind))), encounter=s(reference=F.concat(lit("urn:uuid:o"), o))))
    claim = F.to_json(s(resourceType=lit("ExplanationOfBenefit"), billablePeriod=s(start=iso(F.col("o_orderdate").cast("timestamp"))), insurer=s(display=F.when(o % 9 != 0, F.col("o_orderpriority")))))
    part = lambda code, x: s(code=s(coding=one(system=lit("http://loinc.org"), code=lit(code))), valueQuantity=s(value=x.cast("double")))
    pressure = F.to_json(s(resourceType=lit("Observation"), id=F.concat(lit("b"), o), code=s(coding=one(system=lit("http://loinc.org"), code=lit(BP_PANEL))), component=F.array_compact(F.array(part("8480-6", 100 + o % 50), F.when(o % 3 != 0, part("8462-4", 60 + o % 30))))))
    rows = d.table("customer").select(k.alias("k"), F.array(s(o=lit(-1).cast("long"), n=lit(0), text=patient)).alias("r"))
    orders = d.table("orders").select(F.col("o_custkey").alias("k"), F.array(*(s(o=o.cast("long"), n=lit(n), text=t) for n, t in enumerate((encounter, condition, claim, pressure)))).alias("r"))
    every = F.sort_array(F.flatten(F.collect_list("r")))
    entries = F.array_join(F.transform(every, lambda r: F.concat(lit('{"resource":'), r["text"], lit("}"))), ",")
    found = rows.unionByName(orders).groupBy("k").agg(F.concat(lit('{"resourceType":"Bundle","entry":['), entries, lit("]}")).alias("value"))
    known = found.join(d.table("customer").select(k.alias("k")), "k", "left_semi")
    return known.select(F.concat(lit("c"), "k").alias("patient_id"), F.concat(lit("bundle_"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("path"), "value")


def _resources(d: Domain, kind: str, schema: str) -> DataFrame:
    return readers.bundle_resources(_bundles(d).drop("path"), kind, schema)


@register("src11_bundle_patients", "SELECT 'c' || c_custkey AS patient_id, strftime(DATE '1940-01-01' + CAST(c_custkey % 18000 AS INTEGER), '%Y-%m-%d') AS birth_date, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, 'r' || (c_custkey % 3) AS race, 'e' AS ethnicity, 'M' AS marital_status, c_mktsegment AS state FROM customer")
def bundle_patients(spark, sf):
    return cohort.patients(_resources(Domain(spark, sf), "Patient", cohort.PATIENT))


_VISITS = "(SELECT o.* FROM orders o JOIN customer ON c_custkey = o_custkey)"


@register("src12_blood_pressures", f"SELECT 'c' || o_custkey AS patient_id, 'b' || o_orderkey AS source_observation_id, CAST(100 + o_orderkey % 50 AS DOUBLE) AS systolic, CAST(60 + o_orderkey % 30 AS DOUBLE) AS diastolic FROM {_VISITS} WHERE o_orderkey % 3 <> 0")
def blood_pressures(spark, sf):
    return cohort.blood_pressures(_resources(Domain(spark, sf), "Observation", cohort.OBSERVATION))


@register("agg21_payer_history_of_claims", f"SELECT patient_id, payer_name, valid_from, lead(valid_from) OVER (PARTITION BY patient_id ORDER BY valid_from, payer_name) AS valid_to FROM (SELECT *, lag(payer_name) OVER (PARTITION BY patient_id ORDER BY valid_from, payer_name) AS earlier FROM (SELECT 'c' || o_custkey AS patient_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority ELSE 'No insurance' END AS payer_name, strftime(o_orderdate, '%Y-%m-%d') AS valid_from FROM {_VISITS})) WHERE earlier IS NULL OR earlier <> payer_name UNION ALL SELECT 'c' || c_custkey, 'No insurance', '1900-01-01', NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def payer_history_of_claims(spark, sf):
    d = Domain(spark, sf)
    return cohort.payer_history(_resources(d, "ExplanationOfBenefit", cohort.CLAIM), _bundles(d).select("patient_id"))


@register("prj8_admission_rows", f"SELECT 'o' || o_orderkey AS encounter_id, 'c' || o_custkey AS patient_id, 'run' || (o_orderkey % 6) AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'normal' ELSE 'deterioration' END AS scenario, strftime(CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24), '%Y-%m-%dT%H:%M:%S') AS admitted_at, strftime(CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24 + 30), '%Y-%m-%dT%H:%M:%S') AS discharged_at, 'f' || (o_orderkey % 4) AS facility_id, 'Hospital ' || (o_orderkey % 4) AS facility_name, 'unit ' || (o_orderkey % 3) AS unit, 'd' || (o_orderkey % 5) AS diagnosis_code, 'diagnosis ' || (o_orderkey % 5) AS diagnosis_display, 'synthea_history' AS diagnosis_source, 's' || (o_orderkey % 12) AS attending_npi FROM {_VISITS} WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")
def admission_rows(spark, sf):
    return cohort.admission_rows(_resources(Domain(spark, sf), "Encounter", cohort.ENCOUNTER), _IDENTIFIER, _SCENARIO)


def _first_seen(value: str, where: str) -> str:
    return f"(SELECT o_custkey, string_agg(v, ',' ORDER BY f) AS l FROM (SELECT o_custkey, {value} AS v, min(o_orderkey) AS f FROM {_VISITS} WHERE {where} GROUP BY 1, 2) GROUP BY 1)"


@register("prj9_admission_profile", f"SELECT 'c' || a.o_custkey AS patient_id, coalesce(h.l, a.l) AS facilities, coalesce(d.l, '') AS diagnoses, coalesce(e.l, '') AS hospital_diagnoses FROM {_first_seen("'f' || (o_orderkey % 4)", 'true')} a LEFT JOIN {_first_seen("'f' || (o_orderkey % 4)", 'o_orderkey % 3 = 0')} h USING (o_custkey) LEFT JOIN {_first_seen("'k' || (o_orderkey % 6)", 'o_orderkey % 2 = 0')} d USING (o_custkey) LEFT JOIN {_first_seen("'k' || (o_orderkey % 6)", 'o_orderkey % 2 = 0 AND o_orderkey % 3 = 0')} e USING (o_custkey)")
def admission_profile(spark, sf):
    d = Domain(spark, sf)
    out = cohort.admission_profile(_resources(d, "Encounter", cohort.ENCOUNTER), _resources(d, "Condition", cohort.CONDITION))
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ","), F.lit("")).alias(c)
    return out.select("patient_id", joined("facilities", "id"), joined("diagnoses", "code"), joined("hospital_diagnoses", "code"))


@register("prj12_facilities", "SELECT 'n' || n_nationkey AS facility_id, n_name AS facility_name, 'x' AS city, 'y' AS state FROM nation WHERE n_nationkey IN (SELECT o_custkey % 30 FROM orders) UNION ALL SELECT 'synthea-fallback-facility', 'Regional General Hospital', NULL, NULL")
def facilities(spark, sf):
    d = Domain(spark, sf)
    organizations = d.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("facility_id"), F.col("n_name").alias("facility_name"), F.lit("x").alias("city"), F.lit("y").alias("state"))
    used = d.table("orders").select(F.when(F.col("o_orderkey") % 50 == 0, cohort.FALLBACK_FACILITY[0]).otherwise(F.concat(F.lit("n"), F.col("o_custkey") % 30)).alias("facility_id"))
    whole = used.unionByName(d.table("orders").select(F.concat(F.lit("n"), F.col("o_custkey") % 30).alias("facility_id")))
    return cohort.facilities(organizations, whole.unionByName(readers.values(spark, [(cohort.FALLBACK_FACILITY[0],)], "facility_id string")))


@register("prj14_recent_encounters", f"SELECT 'c' || o_custkey AS patient_id, arg_max('o' || o_orderkey, (CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24), 'o' || o_orderkey)) AS id, false AS has_provider FROM {_VISITS} GROUP BY o_custkey")
def recent_encounters(spark, sf):
    recent = cohort.recent_encounters(_resources(Domain(spark, sf), "Encounter", cohort.ENCOUNTER))
    clean = cohort.sanitised(recent, ("serviceProvider", "participant", "location"))
    return clean.select("patient_id", "id", F.lit("serviceProvider" in clean.columns).alias("has_provider"))


@register("prj15_cohort", "SELECT 'c' || c_custkey AS patient_id FROM customer ORDER BY c_custkey LIMIT 50")
def first_bundles(spark, sf):
    return cohort.cohort(_bundles(Domain(spark, sf)), 50).select("patient_id")


# ---- sinks ----


@register("snk1_quarantine_round_trip", sql(f"SELECT {shown(REASONED, doubles={'value'})}, true AS stamped FROM classified WHERE rejection_reason IS NOT NULL", "classified"))
def quarantine_round_trip(spark, sf):
    path = new_folder(spark, "quarantine")
    sinks.write_quarantine(ingest.split(Domain(spark, sf).candidates)[1], path)
    out = readers.quarantine(spark, path, "observation_id string, loinc_code string, value double, rejection_reason string, quarantined_at timestamp")
    return show(out.withColumn("stamped", F.col("quarantined_at").isNotNull()), [*REASONED, "stamped"])


@register("srt3_existence_probe", "SELECT * FROM (VALUES ('some', true), ('none', false)) AS t(load, written)")
def existence_probe(spark, sf):
    rejected = ingest.split(Domain(spark, sf).candidates)[1]
    some, none = (sinks.write_quarantine(r, new_folder(spark, "probe")) for r in (rejected, rejected.where("rejection_reason = 'no such reason'")))
    return readers.values(spark, [("some", some), ("none", none)], "load string, written boolean")


@register("snk2_partitioned_by_day", sql("SELECT observation_id, loinc_code, round(value, 6) AS value, strftime(effective_datetime, '%Y-%m-%d') AS effective_date FROM processed", "processed"))
def partitioned_by_day(spark, sf):
    path = new_folder(spark, "by_day")
    sinks.write_by_day(Domain(spark, sf).processed, path)
    return show(spark.read.parquet(path), ["observation_id", "loinc_code", "value", "effective_date"])


@register("snk6_upserted_table", _merge_sql(">=", True))
def upserted_table(spark, sf):
    p, path = Domain(spark, sf).processed, new_folder(spark, "upserts")
    later = F.when(F.col("day") % 3 == 0, F.col("received_at")).otherwise(C.add_hours(F.col("received_at"), 1))
    sinks.upsert(spark, path, p.where((F.length("observation_id") % 2 == 0) | (F.dayofmonth("effective_datetime") < 15)))
    sinks.upsert(spark, path, p.where("day >= 10").withColumns({"value": F.col("value") + 1, "received_at": later}), "incoming", True)
    return show(sinks.current(spark, path), ["observation_id", "loinc_code", "value"])


@register("snk4_added_columns", sql("SELECT observation_id, loinc_code, CASE WHEN day >= 10 THEN unit END AS unit FROM processed", "processed"))
def added_columns(spark, sf):
    p = Domain(spark, sf).processed
    old, new = p.where("day < 10").drop("unit"), p.where("day >= 10")
    return sinks.add_missing_columns(old, new).unionByName(new).select("observation_id", "loinc_code", "unit")


@register("snk5_appended_metrics", sql("SELECT 'a' AS run_started_at, count(*) AS candidate_count, count(rejection_reason) AS rejected_count, true AS stamped FROM classified UNION ALL SELECT 'b', count(*), count(rejection_reason), true FROM classified", "classified"))
def appended_metrics(spark, sf):
    d, path = Domain(spark, sf), new_folder(spark, "metrics")
    for run in ("a", "b"):
        sinks.append_metrics(ingest.run_metrics(d.candidates, run), path)
    out = spark.read.schema("run_started_at string, candidate_count long, rejected_count long, processed_at timestamp").json(path)
    return out.select("run_started_at", "candidate_count", "rejected_count", F.col("processed_at").isNotNull().alias("stamped"))


@register("snk7_replaced_table", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def replaced_table(spark, sf):
    c, path = Domain(spark, sf).table("customer").select("c_custkey", "c_name"), new_folder(spark, "replaced")
    sinks.replace_table(c, path)
    sinks.replace_table(c.where("c_custkey % 2 = 0"), path)
    return spark.read.parquet(path)


@register("snk8_prediction_lines", sql("SELECT model_version, encounter_key, round(deterioration_probability, 6) AS deterioration_probability, false AS in_line FROM predictions", "predictions"))
def prediction_lines(spark, sf):
    path = new_folder(spark, "predictions")
    sinks.write_predictions(Domain(spark, sf).predictions, path)
    out = spark.read.json(path)
    lines = spark.read.text(f"{path}/model_version=m1").unionByName(spark.read.text(f"{path}/model_version=m2"))
    held = lines.where(F.col("value").contains("model_version")).isEmpty()
    return show(out.withColumn("in_line", F.lit(not held)), ["model_version", "encounter_key", "deterioration_probability", "in_line"])


@register("snk9_registered_partitions", sql("SELECT model_version, count(*) AS n FROM predictions WHERE model_version = 'm1' GROUP BY 1", "predictions"))
def registered_partitions(spark, sf):
    path = new_folder(spark, "partitions")
    sinks.write_predictions(Domain(spark, sf).predictions, path)
    name = path.rsplit("/", 1)[1]
    spark.sql(f"CREATE TABLE {name} (encounter_key STRING, deterioration_probability DOUBLE, model_version STRING) USING json PARTITIONED BY (model_version) LOCATION '{path}_table'")
    for _ in range(2):  # the second time it is there already
        sinks.register_partition(spark, name, "model_version", "m1", f"{path}/model_version=m1")
    return spark.table(name).groupBy("model_version").agg(F.count("encounter_key").alias("n"))


@register("snk10_raw_landing", sql("SELECT year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour, count(*) AS n FROM (SELECT CAST(received_at AS TIMESTAMP) AS t FROM wide) GROUP BY 1, 2, 3, 4", "wide"))
def raw_landing(spark, sf):
    path = new_folder(spark, "landing")
    Domain(spark, sf).wide.select(*FLAT, "received_at").write.json(f"{path}/in")
    stream = readers.incremental_events(spark, f"{path}/in").withColumn("arrived_at", C.parse_iso(F.col("received_at")))
    sinks.land_raw(stream, f"{path}/out", f"{path}/state", once=True).awaitTermination()
    landed = spark.read.schema(EVENT_SCHEMA + ", year int, month int, day int, hour int").json(f"{path}/out")
    return landed.groupBy(*(F.col(c).cast("long").alias(c) for c in ("year", "month", "day", "hour"))).agg(F.count(F.lit(1)).alias("n"))


@register("snk11_reference_lines", "SELECT CAST(to_json({'nation': n_nationkey, 'region': n_regionkey, 'title': CASE WHEN n_nationkey % 4 <> 0 THEN n_name END}) AS VARCHAR) AS line FROM nation")
def reference_lines(spark, sf):
    path = new_folder(spark, "reference")
    n = Domain(spark, sf).table("nation").select(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("title"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    sinks.write_reference(n, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("snk12_materialised", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def materialised(spark, sf):
    d = Domain(spark, sf)
    sinks.materialise(d.table("nation"), "snk12_nation")
    sinks.materialise(d.table("region"), "region", new_folder(spark, "region")).createOrReplaceTempView("snk12_region")
    return spark.sql("SELECT n_name, r_name FROM snk12_nation JOIN snk12_region ON n_regionkey = r_regionkey")


@register("snk13_published_batches", sql("SELECT patient_id, count(*) AS n, true AS one_partition, true AS small_batches FROM wide WHERE event_timestamp <> 'bad' GROUP BY 1", "wide"))
def published_batches(spark, sf):
    path = new_folder(spark, "published")
    sinks.publish(Domain(spark, sf).wide.where("event_timestamp <> 'bad'").select(*FLAT), path, batch=100)
    read = readers.raw_events(spark, path).withColumn("file", F.input_file_name())
    task = F.regexp_extract("file", r"part-(\d+)-", 1)
    largest = read.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    found = read.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(task) == 1).alias("one_partition"))
    return found.crossJoin(F.broadcast(largest)).select("patient_id", "n", "one_partition", (F.col("most") <= 100).alias("small_batches"))  # a single row


@register("snk14_fan_out", "SELECT c_custkey AS patient_id, 'conn' || (c_custkey % 17) AS connection_id, d.deliveries, d.gone FROM customer, (SELECT count(*) FILTER (c_custkey % 17 <> 5) AS deliveries, count(*) FILTER (c_custkey % 17 = 5) AS gone FROM events JOIN customer ON c_custkey = user_id) d WHERE c_custkey % 17 <> 5")
def fan_out(spark, sf):
    """A stream's events go to the patients' connections; one that is gone loses its subscriptions."""
    d, path = Domain(spark, sf), new_folder(spark, "fan_out")
    subscriptions = d.table("customer").select(F.col("c_custkey").alias("patient_id"), F.concat(F.lit("conn"), F.col("c_custkey") % 17).alias("connection_id"))
    d.table("events").select("event_id", F.col("user_id").alias("patient_id")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("event_id long, patient_id long").parquet(f"{path}/in")
    status = F.when(F.col("connection_id") == "conn5", 410).otherwise(200)
    sinks.fan_out(stream, lambda: subscriptions, lambda sent: sent.select("connection_id", status.alias("status")).write.mode("append").parquet(f"{path}/attempts"), f"{path}/state").awaitTermination()
    attempts = spark.read.parquet(f"{path}/attempts")
    left = sinks.after_delivery(subscriptions, attempts)
    return left.crossJoin(F.broadcast(sinks.delivery_metrics(attempts).select("deliveries", "gone")))  # a single row


@register("stm15_subscriptions_after", "SELECT connection_id, patient_id FROM (SELECT 'conn' || (event_id % 40) AS connection_id, arg_max(user_id, event_id) AS patient_id, arg_max(event_id % 3 <> 0, event_id) AS open FROM events GROUP BY 1) WHERE open")
def subscriptions_after(spark, sf):
    e = Domain(spark, sf).table("events").select(F.concat(F.lit("conn"), F.col("event_id") % 40).alias("connection_id"), F.col("user_id").alias("patient_id"), F.when(F.col("event_id") % 3 == 0, "disconnect").otherwise("connect").alias("action"), F.col("event_id").alias("at"))
    return access.subscriptions_after(e)


