"""From raw events to merged measurements."""

from __future__ import annotations

import base64
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.catalog import FIELDS
from pulsegrid.operators import ingest, star
from pulsegrid.sources import readers, sinks

BASE = {"observation_id": "o1", "patient_id": "p1", "encounter_id": "e1", "event_timestamp": "2024-01-01T08:00:00", "received_at": "2024-01-01T08:00:01", "source": "feed"}


def events(spark, *changes):
    names = [*BASE, *FIELDS]
    rows = [tuple((BASE | c).get(n) for n in names) for c in changes]
    kinds = ", ".join(f"{n} {'double' if n in FIELDS else 'string'}" for n in names)
    return spark.createDataFrame(rows, kinds)


def test_one_event_with_both_pressures_gives_two_rows(spark):
    got = ingest.measurement_candidates(events(spark, {"systolic_bp": 120.0, "diastolic_bp": 80.0})).collect()
    assert sorted((r.observation_id, r.loinc_code, r.value) for r in got) == [("o1", "8462-4", 80.0), ("o1", "8480-6", 120.0)]


def test_first_rule_wins(spark):
    frame = events(
        spark, {"heart_rate": 300.0}, {"patient_id": " ", "heart_rate": 80.0}, {"observation_id": "o3", "event_timestamp": "nope", "heart_rate": 80.0}, {"observation_id": "o4", "diastolic_bp": 25.0}, {"observation_id": "o5", "systolic_bp": 280.0},
        {"observation_id": "o6", "patient_id": "", "heart_rate": 999.0}, {"observation_id": "o7", "heart_rate": 20.0},
    )
    reasons = [r.rejection_reason for r in ingest.classify(ingest.measurement_candidates(frame)).collect()]
    assert reasons == ["physiological_range_violation", "missing_patient_id", "missing_effective_datetime", "physiological_range_violation", "physiological_range_violation", "missing_patient_id", None]
    blank = spark.createDataFrame([(" ", "p", "8867-4", 300.0), ("o", "p", "x", 1.0), ("o", "p", "", 1.0), ("o", "p", "8867-4", None)], "observation_id string, patient_id string, loinc_code string, value double").withColumn("effective_datetime", F.current_timestamp())
    assert [r.rejection_reason for r in ingest.classify(blank).collect()] == ["missing_observation_id", "unsupported_loinc_code", "missing_loinc_code", "missing_value"]


def test_legacy_id_and_missing_columns(spark):
    frame = spark.createDataFrame([("p1", "2024-01-01T00:00:00", 80.0)], "patient_id string, event_timestamp string, heart_rate double")
    r = ingest.measurement_candidates(frame).first()
    want = hashlib.sha256(("p1|2024-01-01T00:00:00||80.0" + "|" * 7).encode()).hexdigest()
    assert r.observation_id == f"legacy_flattened_{want}" and r.source == "fhir_webhook" and r.received_at == r.effective_datetime and r.encounter_id is None
    assert ingest.measurement_candidates(frame.drop("patient_id")).count() == 0


def row(i, value, received, encounter="e1"):
    t = None if received is None else datetime.fromisoformat(received)
    return (i, "p1", encounter, "heart_rate", "8867-4", float(value), "beats/minute", datetime(2024, 1, 1), t, "feed", 2024, 1, 1)


KINDS = "observation_id string, patient_id string, encounter_id string, observation_type string, loinc_code string, value double, unit string, effective_datetime timestamp, received_at timestamp, source string, year int, month int, day int"


def test_latest_record_of_a_key(spark):
    rows = [row("a", 1, "2024-01-02"), row("a", 2, "2024-01-01"), row("b", 1, None), row("b", 9, "2024-01-01"), row("c", 5, "2024-01-01"), row("c", 6, "2024-01-01")]
    got = ingest.latest_per_key(spark.createDataFrame(rows, KINDS))
    assert got.columns == [c.split()[0] for c in KINDS.split(", ")] and sorted((r.observation_id, r.value) for r in got.collect()) == [("a", 1.0), ("b", 9.0), ("c", 6.0)]


def test_merge_modes(spark):
    old = spark.createDataFrame([row("same", 1, "2024-01-01"), row("newer", 1, "2024-01-01"), row("older", 1, "2024-01-03"), row("null", 1, None), row("gone", 1, "2024-01-01"), row("other", 1, "2024-01-01", "e2"), row("loose", 1, "2024-01-01", None)], KINDS)
    new = spark.createDataFrame([row("same", 2, "2024-01-01"), row("newer", 2, "2024-01-02"), row("older", 2, "2024-01-02"), row("null", 2, "2024-01-01"), row("added", 2, None)], KINDS)
    values = lambda df: {r.observation_id: r.value for r in df.collect()}
    strict = {"same": 1, "newer": 2, "older": 1, "null": 2, "gone": 1, "other": 1, "loose": 1, "added": 2}
    assert values(ingest.merge(old, new)) == strict
    assert values(ingest.merge(old, new, "incoming")) == strict | {"same": 2}
    assert values(ingest.merge(old, new, "incoming", delete_missing=True)) == {k: v for k, v in (strict | {"same": 2}).items() if k != "gone"}
    assert values(ingest.merge(old.drop("encounter_id"), new)) == strict


def test_upsert_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.current(spark, path) is None
    sinks.upsert(spark, path, spark.createDataFrame([row("a", 1, "2024-01-01"), row("a", 3, "2024-01-02")], KINDS))
    sinks.upsert(spark, path, spark.createDataFrame([row("a", 9, "2024-01-01"), row("b", 2, "2024-01-01")], KINDS))
    assert {r.observation_id: r.value for r in sinks.current(spark, path).collect()} == {"a": 3.0, "b": 2.0}


def test_quarantine_round_trip(spark, tmp_path):
    path = str(tmp_path / "q")
    bad = ingest.split(ingest.with_metadata(ingest.measurement_candidates(events(spark, {"heart_rate": 300.0}, {"observation_id": "o2", "heart_rate": 80.0}))))[1]
    assert sinks.write_quarantine(bad, path) and not sinks.write_quarantine(bad.limit(0), path)
    schema = "observation_id string, patient_id string, loinc_code string, value double, effective_datetime string, rejection_reason string, quarantined_at string"
    back = readers.quarantine(spark, path, schema, "physiological_range_violation")
    r = ingest.replay_events(back).first()
    assert (r.schema_version, r.observation_id, r.source, r.heart_rate, r.error) == ("1.0", "o1", "quarantine_replay", 300.0, None)
    broken = spark.createDataFrame([("o", None, "8867-4", 1.0, "t"), ("o", "p", "zz", 1.0, "t")], "observation_id string, patient_id string, loinc_code string, value double, effective_datetime string")
    assert [r.error for r in ingest.replay_events(broken).collect()] == ["missing required fields: patient_id", "unsupported code: zz"]


def test_event_validation(spark):
    good = {"schema_version": "1.2", "observation_id": "o", "patient_id": "p", "encounter_id": "e", "source": "s", "event_timestamp": "2024-01-01T00:00:00Z", "heart_rate": "80"}
    cases = [
        ({}, None), ({"schema_version": "9"}, "schema_version must be one of: 1.0, 1.1, 1.2"), ({"observation_id": " "}, "observation_id must be a non-empty string"), ({"encounter_id": None}, "encounter_id is required for schema_version 1.2"),
        ({"schema_version": "1.0", "encounter_id": None}, None), ({"event_timestamp": "x"}, "event_timestamp is not valid ISO-8601"), ({"heart_rate": "abc"}, "heart_rate must be numeric"), ({"heart_rate": "251"}, "heart_rate must be between 20 and 250"),
        ({"systolic_bp": "280"}, None), ({"consciousness_level": "1.5"}, "consciousness_level must be a whole-number ordinal"), ({"heart_rate": None}, "at least one supported vital measurement is required"), ({"_replay_attempt": "-1"}, "_replay_attempt must be a non-negative integer"),
    ]
    names = [c.split(" ")[0] for c in ingest.EVENT_SCHEMA.split(", ")]
    rows = spark.createDataFrame([tuple((good | c).get(n) for n in names) for c, _ in cases], ingest.EVENT_SCHEMA)
    assert [r.e for r in rows.select(ingest.event_error(rows).alias("e")).collect()] == [e for _, e in cases]


def coding(code):
    return {"coding": [{"system": "http://other", "code": "zzz"}, {"system": "http://loinc.org", "code": code}]}


def test_observations_become_events_and_back(spark):
    def obs(i, code, **more):
        return json.dumps({"resourceType": "Observation", "id": i, "code": coding(code), "subject": {"reference": "Patient/p1"}, "encounter": {"reference": "Encounter/e1"}, "effectiveDateTime": "2024-01-01T00:00:00Z"} | more)

    part = lambda code, v: {"code": coding(code), "valueQuantity": {"value": v}}
    texts = [
        obs("1", "8867-4", valueQuantity={"value": 72}), obs("2", "67775-7", valueCodeableConcept=coding("LA17108-4")), obs("3", "85354-9", component=[part("8480-6", 120), part("8462-4", 80)]),
        obs("4", "85354-9", component=[]), obs("5", "1-1", valueQuantity={"value": 1}), obs("6", "8867-4", valueQuantity={"value": 1}, subject={"reference": "Group/x"}), "not json", json.dumps({"resourceType": "Patient"}),
    ]
    parsed = readers.observations(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [r.request_error is None for r in parsed.collect()] == [True] * 6 + [False] * 2
    got = {r.observation_id: r for r in ingest.fhir_events(parsed.where("request_error is null")).collect()}
    assert got["1"].heart_rate == 72 and got["2"].consciousness_level == 2 and (got["3"].systolic_bp, got["3"].diastolic_bp) == (120, 80)
    assert [got[i].error for i in "123456"] == [None, None, None, "no supported value", "unsupported LOINC code", "subject must reference a Patient"]
    back = ingest.observations_of(spark.createDataFrame([("r1", 71.26, 120.0, None, 2.0)], "id string, heart_rate double, systolic_bp double, diastolic_bp double, consciousness_level double")).collect()
    assert sorted((r.loinc_code, r.value, r.answer) for r in back) == [("67775-7", None, "LA17108-4"), ("8867-4", 71.3, None)]


def test_stream_records_decode(spark):
    good = base64.b64encode(json.dumps({"observation_id": "o1", "heart_rate": 80}).encode()).decode()
    rows = [(good,), ("***",), (base64.b64encode(b"\xff\xfe").decode(),), (base64.b64encode(b"[1]").decode(),), (base64.b64encode(b"nope").decode(),), (None,)]
    got = ingest.decode_records(spark.createDataFrame(rows, "data string")).collect()
    assert got[0].event.observation_id == "o1" and got[0].event.heart_rate == "80" and [r.error is None for r in got] == [True, False, False, False, False, False]


def test_half_open_versions_and_lost_encounters(spark):
    staged = spark.createDataFrame([("e1", "p1", datetime(2024, 1, 10, 5)), (" e1 ", "p1", datetime(2024, 1, 10, 4)), ("e2", "p1", datetime(1980, 1, 1))], "encounter_id string, patient_id string, effective_datetime timestamp")
    history = spark.createDataFrame([("n1", "A", "t", "d", "WA", "2020-01-01", "2024-01-10", "false", "s"), ("n1", "B", "t", "d", "WA", "2024-01-10", " ", "true", "s")], "provider_npi string, provider_name string, taxonomy_code string, taxonomy_description string, provider_state string, valid_from string, valid_to string, is_current string, data_source string")
    providers = star.dim_provider(history)
    got = star.dim_encounter(staged, providers).collect()
    assert len(got) == 1 and got[0].encounter_id == "e1" and got[0].encounter_start_at == datetime(2024, 1, 10, 4)
    assert got[0].provider_version_key == hashlib.md5(b"n1|2024-01-10").hexdigest()
    attended = star.dim_encounter(staged, providers, spark.createDataFrame([("e1", "n1")], "encounter_id string, attending_npi string")).first()
    assert not attended.is_synthetic_provider_assignment


def test_two_loads_of_one_version_conflict_and_old_versions_go(spark, tmp_path, monkeypatch):
    import os

    path = str(tmp_path / "table")
    load = lambda n, hour: spark.createDataFrame([(f"o{n}", "c", "e", float(n), f"2024-01-01 {hour:02d}:00:00", "2024-01-01 00:00:00")], "observation_id string, loinc_code string, encounter_id string, value double, received_at string, effective_datetime string").selectExpr("observation_id", "loinc_code", "encounter_id", "value", "CAST(received_at AS timestamp) received_at", "CAST(effective_datetime AS timestamp) effective_datetime")
    assert sinks.current(spark, path) is None
    for n in range(4):
        sinks.upsert(spark, path, load(n, n))
    assert sinks.current(spark, path).count() == 4 and len([f for f in os.listdir(path) if f.startswith("v_")]) == 2
    write = sinks.write_by_day

    def slow(df, version, **more):
        write(df, version, **more)
        monkeypatch.setattr(sinks, "write_by_day", write)
        sinks.upsert(spark, path, load(8, 8))  # another load overtakes this one

    monkeypatch.setattr(sinks, "write_by_day", slow)
    with pytest.raises(sinks.Conflict):
        sinks.upsert(spark, path, load(9, 9))
    assert sorted(r.observation_id for r in sinks.current(spark, path).collect()) == ["o0", "o1", "o2", "o3", "o8"]
