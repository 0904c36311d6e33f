"""Structured Streaming against the batch folds, on file sources."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.catalog import FEATURES, FIELDS
from pulsegrid.operators import access
from pulsegrid.sources import readers, sinks
from pulsegrid.streaming import state

T0 = datetime(2024, 1, 1, 8)
KINDS = "observation_id string, patient_id string, encounter_id string, source string, event_timestamp timestamp, arrival long, " + ", ".join(f"{f} double" for f in FIELDS)


def event(i, patient, seconds, arrival=None, encounter="e1", source="feed", **vitals):
    return (i, patient, encounter, source, T0 + timedelta(seconds=seconds), arrival if arrival is not None else int(i[1:]), *(vitals.get(f) for f in FIELDS))


EVENTS = [
    event("o1", "p1", 0, heart_rate=70.0), event("o2", "p1", 10, heart_rate=75.0, spo2=97.0), event("o3", "p1", 5, heart_rate=60.0, respiratory_rate=15.0), event("o4", "p1", 10, heart_rate=76.0),
    event("o5", "p2", 0, spo2=95.0), event("o6", "p2", -5, temperature=37.0), event("o7", "p1", 3, respiratory_rate=14.0),
]


def test_all_or_nothing_and_per_field_folds(spark):
    frame = spark.createDataFrame(EVENTS, KINDS).repartition(3)
    got = {r.patient_id: r for r in state.latest_vitals(frame).collect()}
    p1 = got["p1"]
    assert (p1.heart_rate, p1.spo2, p1.respiratory_rate, p1.accepted, p1.stale) == (76.0, 97.0, 14.0, 4, 1)
    assert (got["p2"].spo2, got["p2"].temperature) == (95.0, 37.0)
    merged = {r.patient_id: r for r in state.merged_vitals(frame).collect()}
    assert (merged["p1"].heart_rate, merged["p1"].respiratory_rate) == (76.0, 15.0) and merged["p1"].event_timestamp == T0 + timedelta(seconds=10)


def write_json(folder, name, rows):
    names = [c.split(" ")[0] for c in KINDS.split(", ")]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in zip(names, r, strict=True)}) + "\n" for r in rows))


def drain(stream, spark, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_streaming_state_equals_the_batch_fold(spark, tmp_path):
    folder = tmp_path / "in"
    write_json(folder, "a.json", EVENTS[:4])
    write_json(folder, "b.json", EVENTS[4:])
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).json(str(folder))
    out = drain(state.latest_vitals_stream(stream), spark, "latest_vitals_out", tmp_path, "update")
    last = {}
    for r in out.collect():
        if r.patient_id not in last or r.accepted + r.stale > last[r.patient_id].accepted + last[r.patient_id].stale:
            last[r.patient_id] = r
    want = {r.patient_id: r for r in state.latest_vitals(spark.createDataFrame(EVENTS, KINDS)).collect()}
    assert set(last) == set(want)
    for p, r in want.items():
        assert [last[p][f] for f in FIELDS] == [r[f] for f in FIELDS] and (last[p].accepted, last[p].stale) == (r.accepted, r.stale)


def test_stream_keeps_one_event_of_an_id_and_window_readings(spark, tmp_path):
    rows = [*EVENTS, EVENTS[0], event("o8", "p1", 1, source="load_test", heart_rate=1.0), event("o9", "p1", 2, encounter=None, heart_rate=1.0)]
    write_json(tmp_path / "in", "a.json", rows)
    stream = spark.readStream.schema(KINDS).json(str(tmp_path / "in"))
    once = drain(state.deduplicated(stream), spark, "once_out", tmp_path)
    assert sorted(r.observation_id for r in once.collect()) == [f"o{i}" for i in range(1, 10)]
    readings = drain(state.window_readings(stream), spark, "readings_out", tmp_path)
    batch = state.window_readings(spark.createDataFrame(rows, KINDS))
    assert sorted(r.reading for r in readings.collect()) == sorted(r.reading for r in batch.collect()) and batch.count() == 7


def test_landing_and_fan_out(spark, tmp_path):
    write_json(tmp_path / "in", "a.json", EVENTS)
    stream = spark.readStream.schema(KINDS).json(str(tmp_path / "in"))
    out = str(tmp_path / "raw")
    assert sinks.land_raw(stream, out, str(tmp_path / "c1"), time="event_timestamp", once=True).awaitTermination(120)
    landed = spark.read.json(out)
    assert landed.count() == len(EVENTS) and {"year", "month", "day", "hour"} <= set(landed.columns)
    got = []
    subscriptions = spark.createDataFrame([("p1", "c1"), ("p1", "c2")], "patient_id string, connection_id string")
    query = sinks.fan_out(stream, lambda: subscriptions, lambda df: got.extend(r.connection_id for r in df.collect()), str(tmp_path / "c2"))
    assert query.awaitTermination(120) and sorted(got) == ["c1"] * 5 + ["c2"] * 5
    assert access.connections_for(spark.createDataFrame(EVENTS, KINDS), subscriptions).count() == 10
    changes = spark.createDataFrame([("c1", "p1", "connect", 1), ("c1", "p1", "disconnect", 2), ("c2", "p2", "connect", 1)], "connection_id string, patient_id string, action string, at int")
    assert [tuple(r) for r in access.subscriptions_after(changes).collect()] == [("c2", "p2")]


def test_window_scores(spark):
    rows = [event("o1", "p1", 0, heart_rate=70.0), event("o2", "p1", 60, heart_rate=80.0), event("o3", "p1", 900, heart_rate=200.0)]
    readings = state.window_readings(spark.createDataFrame(rows, KINDS))
    at = lambda s: F.lit((T0 + timedelta(seconds=s)).isoformat()).cast("timestamp")
    score = F.col("heart_rate_mean") / 100
    r = state.window_scores(readings, at(960), 15, score, "m1", FEATURES).first()
    assert (r.readings, r.heart_rate_mean, r.status, r.probability) == (2, 75.0, "scored", 0.75) and r.heart_rate_stddev == pytest.approx(50**0.5)
    assert r.respiratory_rate_mean is None
    assert state.window_scores(readings, at(959), 15, score, "m1", FEATURES).first().status == "window_open"
    assert state.window_scores(readings, at(960), 15, None, "m1", FEATURES).first().status == "model_unavailable"
    assert state.window_scores(readings, at(960), 15, score, None, FEATURES).first().status == "no_approved_model"
    scored = state.window_scores(readings, at(960), 15, score, "m1", FEATURES).select("encounter_id", "model_version", "status", "probability")
    stored = spark.createDataFrame([("e1", "m1", "scored", 0.1)], "encounter_id string, model_version string, status string, probability double")
    assert state.first_scores(stored, scored).collect() == stored.collect() and state.first_scores(stored.limit(0), scored).count() == 1


def test_replay_limit(spark):
    rows = [('{"observation_id":"a"}',), ('{"observation_id":"b","_replay_attempt":1}',), ("broken",)]
    got = state.replay(spark.createDataFrame(rows, "raw string")).collect()
    assert json.loads(got[0].replay_raw)["_replay_attempt"] == "1" and [r.is_terminal for r in got] == [False, True, True]
    assert got[2].data_base64 == "YnJva2Vu" and got[0].data_base64 is None


def test_queue_and_age_and_runs(spark):
    frame = spark.createDataFrame([*EVENTS, event("o9", "p1", 99, source="load_test", heart_rate=1.0)], KINDS)
    assert {r.patient_id: r.observation_id for r in state.compacted(frame).collect()} == {"p1": "o4", "p2": "o5"}
    live = state.live_values(state.latest_vitals(frame), F.lit((T0 + timedelta(seconds=14)).isoformat()).cast("timestamp"), {"heart_rate": 10, "spo2": 3, "respiratory_rate": 10})
    p1 = {r.patient_id: r for r in live.collect()}["p1"]
    cycles = spark.createDataFrame([("r", i, 10, n) for i, n in enumerate((0, 6, 7, 0, 9))], "run_id string, cycle int, attempts int, retryable int")
    assert p1.spo2 is None and sorted((r.first_cycle, r.length) for r in state.degraded_runs(cycles, 0.5).collect()) == [(1, 2), (4, 1)]


def test_measured_at_hides_internal_fields(spark):
    rows = access.with_measured_at(state.latest_vitals(spark.createDataFrame(EVENTS, KINDS)).withColumn("_x", F.lit(1)))
    assert "_x" not in rows.columns and {r.patient_id: r.event_timestamp for r in rows.collect()}["p1"] == T0 + timedelta(seconds=10)


def test_sources(spark, tmp_path):
    (tmp_path / "raw" / "deep").mkdir(parents=True)
    (tmp_path / "raw" / "deep" / "x.ndjson").write_text('{"observation_id": 5, "heart_rate": "71", "extra": 1}\n{"observation_id": "b", "heart_rate": {"x": 1}}\n')
    rows = readers.resolve_types(readers.raw_events(spark, str(tmp_path / "raw")), [("heart_rate", "double"), ("nope", "int")]).orderBy("observation_id").collect()
    assert [(r.observation_id, r.heart_rate) for r in rows] == [("5", 71.0), ("b", None)]
    assert readers.ndjson_folder(spark, str(tmp_path / "raw" / "deep")).count() == 2
    (tmp_path / "seed.csv").write_text("unit_name,care_level,care_level_rank\nWard,acute,1\n")
    assert readers.seed_csv(spark, str(tmp_path / "seed.csv"), readers.UNIT_SEED).first().care_level_rank == 1
    stream = readers.incremental_events(spark, str(tmp_path / "raw"))
    assert drain(stream.select("observation_id"), spark, "inc_out", tmp_path).count() == 2
    assert [r[0] for r in spark.createDataFrame([(" hr, ",), ("SpO2,",)], "c string").select(readers.channel_name(F.col("c"))).collect()] == ["HR", "SPO2"]
    with pytest.raises(ValueError):
        readers.checked("a;b")
    assert readers.ordered_records(spark.createDataFrame([("b", 1), ("a", 2)], "encounter_key string, x int"), ["encounter_key", "x"]).first().x == 2
    sinks.write_reference(spark.createDataFrame([("b", None)], "z string, a string"), str(tmp_path / "ref"))
    assert spark.read.text(str(tmp_path / "ref")).first()[0] == '{"a":null,"z":"b"}'
    sinks.write_predictions(spark.createDataFrame([("m1", 1)], "model_version string, x int"), str(tmp_path / "pred"))
    assert spark.read.text(str(tmp_path / "pred")).first()[0] == '{"x":1}'
