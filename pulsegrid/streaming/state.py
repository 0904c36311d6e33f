"""Keyed live state over event streams, and batch folds with the same meaning.

Events carry observation_id, patient_id, encounter_id, source, event_timestamp (a timestamp), arrival (their order)
and the vital fields. The batch folds are the definition; the streaming queries apply the same rules by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import FIELDS, LOINC
from pulsegrid.operators.features import STATISTICS
from pulsegrid.operators.ranking import latest_by

CLAIM_DAYS = 7
WINDOW_TTL_DAYS = 2
GRACE_SECONDS = 60
LEASE_SECONDS = 60
LOAD_TEST_SECONDS = 24 * 3600
MAX_REPLAYS = 1


# ---- claims and routing ----


def deduplicated(stream: DataFrame, time: str = "event_timestamp", days: int = CLAIM_DAYS) -> DataFrame:
    """The first event of each observation_id within the claim period; works on streams and tables.

    A stream keeps ids for the period in its state, exactly once, so the lease that guards a retried event is
    not needed. A table keeps, of each id, the event that arrived first.
    """
    if stream.isStreaming:
        return stream.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark(["observation_id"])
    return stream.groupBy("observation_id").agg(F.min_by(F.struct(*stream.columns), "arrival").alias("r")).select("r.*")


CLAIMS = "observation_id string, state string, lease_until timestamp, expires_at timestamp"


def claim(claims: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """(observation_id, outcome) of requests for claims, one a request id: claimed, duplicate or in_progress.

    An id is claimed where it has no claim, its claim has expired, or its processing has outlasted its lease; a
    completed one is a duplicate, and one that is still processed must be retried later.
    """
    held = claims.select("observation_id", F.col("state").alias("_s"), F.col("lease_until").alias("_l"), F.col("expires_at").alias("_e"))
    rows = requests.select("observation_id").distinct().join(held, "observation_id", "left")
    free = F.col("_s").isNull() | (F.col("_e") <= now) | ((F.col("_s") == "processing") & (F.col("_l") < now))
    return rows.select("observation_id", F.when(free, "claimed").when(F.col("_s") == "completed", "duplicate").otherwise("in_progress").alias("outcome"))


def claims_after(claims: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The claims once the claimed ones hold a new lease; expired claims of others go."""
    taken = outcomes.where("outcome = 'claimed'").select("observation_id")
    kept = claims.where(F.col("expires_at") > now).join(taken, "observation_id", "left_anti").select("observation_id", "state", "lease_until", "expires_at")
    lease, expiry = now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS)), now + F.make_dt_interval(days=F.lit(CLAIM_DAYS))
    return kept.unionByName(taken.select("observation_id", F.lit("processing").alias("state"), lease.alias("lease_until"), expiry.alias("expires_at")))


def handled(records: DataFrame, error: str = "error", permanent: str = "permanent") -> DataFrame:
    """Adds handling: done, dead_letter for permanent failures, and retry for others, which a batch reports one by one."""
    return records.withColumn("handling", F.when(F.col(error).isNull(), "done").when(F.col(permanent), "dead_letter").otherwise("retry"))


def load_test_results(routed: DataFrame, now: Column) -> DataFrame:
    """Load-test events for their own sink, each id once, with the second at which they expire a day later."""
    rows = deduplicated(routed.where("route = 'load_test'"))
    return rows.withColumn("expires_at", F.unix_seconds(now) + LOAD_TEST_SECONDS)


def route(events: DataFrame, error: Column) -> DataFrame:
    """Adds route: rejected, load_test or live."""
    return events.withColumn("route", F.when(error.isNotNull(), "rejected").when(F.col("source") == "load_test", "load_test").otherwise("live"))


def route_metrics(routed: DataFrame) -> DataFrame:
    """Counts by namespace, in one aggregation; a row's outcome column, where there is one, counts stale and duplicate events."""
    namespace = F.when(F.col("route") == "load_test", "LoadTest").otherwise("Live")
    outcome = F.col("outcome") if "outcome" in routed.columns else F.lit(None).cast("string")
    return routed.groupBy(namespace.alias("namespace")).agg(
        F.count_if(F.col("route") != "rejected").alias("records_processed"),
        F.count_if(F.col("route") == "rejected").alias("permanent_records_rejected"),
        F.count_if(outcome == "duplicate").alias("duplicates_skipped"),
        F.count_if(outcome == "stale").alias("stale_records_skipped"),
    )


def replay(failed: DataFrame, limit: int = MAX_REPLAYS) -> DataFrame:
    """Failed raw records (raw JSON text) with their next attempt; those at the limit are terminal and keep their bytes."""
    attempt = F.coalesce(F.get_json_object("raw", "$._replay_attempt").try_cast("int"), F.lit(0))
    out = failed.withColumn("attempt", attempt)
    readable = F.try_parse_json("raw").isNotNull()
    next_raw = F.when(F.col("attempt") < limit, F.to_json(F.map_concat(F.map_filter(F.from_json("raw", "map<string,string>"), lambda k, _: k != "_replay_attempt"), F.create_map(F.lit("_replay_attempt"), (F.col("attempt") + 1).cast("string")))))
    terminal = ~F.coalesce(readable, F.lit(False)) | (F.col("attempt") >= limit)
    return out.select("*", F.when(~terminal, next_raw).alias("replay_raw"), terminal.alias("is_terminal"), F.when(terminal, F.base64(F.encode("raw", "UTF-8"))).alias("data_base64"))


# ---- latest vitals of each patient ----

LATEST_SCHEMA = "patient_id string, accepted long, stale long, " + ", ".join(f"{f} double, {f}_event_timestamp timestamp" for f in FIELDS)


def fold_latest(state: dict[str, Any], event: dict[str, Any]) -> bool:
    """Applies an event to a patient's latest vitals: all of its vitals, or none where one is older than the stored.

    An equal time is accepted; vitals that the event lacks stay. Gives whether it was accepted.
    """
    present = [f for f in FIELDS if event.get(f) is not None]
    at = event["event_timestamp"]
    if any(state.get(f"{f}_event_timestamp") is not None and state[f"{f}_event_timestamp"] > at for f in present):
        return False
    for f in present:
        state[f], state[f"{f}_event_timestamp"] = float(event[f]), at
    return True


def latest_vitals(events: DataFrame) -> DataFrame:
    """The batch fold: each patient's events in order of arrival, in one pass over a sorted array.

    The fold depends on order, so a patient's events meet in one group; patients bound its size.
    """
    item = F.struct("arrival", "event_timestamp", *(F.col(f).cast("double").alias(f) for f in FIELDS))
    start = F.struct(F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("stale"), *(x for f in FIELDS for x in (F.lit(None).cast("double").alias(f), F.lit(None).cast("timestamp").alias(f"{f}_event_timestamp"))))

    def step(s: Column, e: Column) -> Column:
        old = F.lit(False)
        for f in FIELDS:
            old = old | (e[f].isNotNull() & F.coalesce(s[f"{f}_event_timestamp"] > e["event_timestamp"], F.lit(False)))
        fields = [x for f in FIELDS for x in (F.when(old | e[f].isNull(), s[f]).otherwise(e[f]).alias(f), F.when(old | e[f].isNull(), s[f"{f}_event_timestamp"]).otherwise(e["event_timestamp"]).alias(f"{f}_event_timestamp"))]
        return F.struct((s["accepted"] + F.when(old, 0).otherwise(1)).cast("long").alias("accepted"), (s["stale"] + F.when(old, 1).otherwise(0)).cast("long").alias("stale"), *fields)

    return events.groupBy("patient_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("s")).select("patient_id", "s.*")


def latest_vitals_stream(events: DataFrame) -> DataFrame:
    """The streaming fold with state by patient; emits each touched patient's latest vitals in update mode."""
    names = [c.split(" ")[0] for c in LATEST_SCHEMA.split(", ")][1:]

    def update(key: tuple, batches: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        state = dict(zip(names, group.get, strict=True)) if group.exists else dict.fromkeys(names)
        state = {k: None if v is None or v is pd.NaT or v != v else v for k, v in state.items()}
        state["accepted"], state["stale"] = int(state["accepted"] or 0), int(state["stale"] or 0)
        for event in pd.concat(list(batches)).sort_values("arrival").to_dict("records"):
            event = {k: None if v is pd.NaT or v != v else v for k, v in event.items()}
            state["accepted" if fold_latest(state, event) else "stale"] += 1
        group.update(tuple(state[n] for n in names))
        yield pd.DataFrame([{"patient_id": key[0], **state}])[["patient_id", *names]]

    state_schema = ", ".join(LATEST_SCHEMA.split(", ")[1:])
    return events.groupBy("patient_id").applyInPandasWithState(update, LATEST_SCHEMA, state_schema, "update", "NoTimeout")


def merged_vitals(events: DataFrame) -> DataFrame:
    """Each field's freshest value on its own: the last by time, then arrival. Independent of order, so it aggregates early."""
    by = F.struct("event_timestamp", "arrival")
    aggs = [x for f in FIELDS for x in (F.max_by(f, F.when(F.col(f).isNotNull(), by)).alias(f), F.max(F.when(F.col(f).isNotNull(), F.col("event_timestamp"))).alias(f"{f}_event_timestamp"))]
    found = events.groupBy("patient_id").agg(*aggs)
    return found.withColumn("event_timestamp", F.greatest(*(F.col(f"{f}_event_timestamp") for f in FIELDS)))


def compacted(payloads: DataFrame) -> DataFrame:
    """Of queued payloads, without load tests, the last of each patient."""
    return latest_by(payloads.where(F.coalesce(F.col("source") != "load_test", F.lit(True))), ["patient_id"], ["event_timestamp", "arrival"])


def live_values(state: DataFrame, now: Column, max_age: dict[str, float]) -> DataFrame:
    """State whose fields older than their limit in seconds are null."""
    age = lambda f: (F.unix_micros(now) - F.unix_micros(F.col(f"{f}_event_timestamp"))) / 1e6
    return state.withColumns({f: F.when(age(f) <= limit, F.col(f)) for f, limit in max_age.items()})


# ---- feature windows and scores ----


def window_readings(events: DataFrame) -> DataFrame:
    """Readings kept for the feature window: every event of an encounter but load tests, one for each time and id.

    Stale events are kept too. On a stream, state older than the time to live is dropped.
    """
    rows = events.where(F.col("encounter_id").isNotNull() & F.coalesce(F.col("source") != "load_test", F.lit(True)))
    rows = rows.withColumn("reading", C.reading_key(F.col("event_timestamp"), F.col("observation_id")))
    if events.isStreaming:
        return rows.withWatermark("event_timestamp", f"{WINDOW_TTL_DAYS} days").dropDuplicatesWithinWatermark(["encounter_id", "reading"])
    return latest_by(rows, ["encounter_id", "reading"], ["arrival"])


def window_scores(readings: DataFrame, now: Column, minutes: int, score: Column | None, model_version: str | None, features) -> DataFrame:
    """Each encounter's window features, status and score at a time.

    The window starts with the first reading; its end belongs to the outcome. status: no_approved_model,
    window_open until the end and a grace, model_unavailable without a score column, else scored.
    """
    start = readings.groupBy("encounter_id").agg(F.min("event_timestamp").alias("window_start"))
    rows = readings.join(start, "encounter_id").withColumn("window_cutoff", C.add_minutes(F.col("window_start"), minutes)).where("event_timestamp < window_cutoff")
    found = rows.groupBy("encounter_id", "window_start", "window_cutoff").agg(F.count(F.lit(1)).alias("readings"), *(STATISTICS[s](F.col(v).cast("double")).alias(n) for n, v, s in features))
    status = F.lit("no_approved_model") if model_version is None else F.when(now < F.col("window_cutoff") + F.make_dt_interval(secs=F.lit(GRACE_SECONDS)), "window_open").otherwise("scored" if score is not None else "model_unavailable")
    out = found.withColumns({"model_version": F.lit(model_version).cast("string"), "status": status})
    return out.withColumn("probability", F.when(F.col("status") == "scored", score) if score is not None else F.lit(None).cast("double"))


def score_requests(requests: DataFrame, readings: DataFrame, stored: DataFrame, now: Column, minutes: int, score: Column | None, model_version: str | None, features) -> DataFrame:
    """Requests (encounter_id) with status and probability: a stored score of the model first, else the window's state.

    status: no_encounter, no_approved_model, no_readings, or what ``window_scores`` says.
    """
    found = window_scores(readings, now, minutes, score, model_version, features).select("encounter_id", F.col("status").alias("_s"), F.col("probability").alias("_p"))
    old = stored.where(F.col("model_version") == F.lit(model_version)).groupBy("encounter_id").agg(F.max("probability").alias("_old"))
    rows = requests.join(old, "encounter_id", "left").join(found, "encounter_id", "left")
    status = F.when(C.is_blank(F.col("encounter_id")), "no_encounter").when(F.lit(model_version is None), "no_approved_model")
    status = status.when(F.col("_old").isNotNull(), "scored").when(F.col("_s").isNull(), "no_readings").otherwise(F.col("_s"))
    return rows.select(*requests.columns, status.alias("status"), F.coalesce("_old", "_p").alias("probability"))


def first_scores(stored: DataFrame, scored: DataFrame) -> DataFrame:
    """Stored scores with new ones added; the first of an encounter and model version stays."""
    fresh = scored.where("status = 'scored'").join(stored.select("encounter_id", "model_version"), ["encounter_id", "model_version"], "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def degraded_runs(cycles: DataFrame, threshold: float) -> DataFrame:
    """Each run of consecutive cycles (run_id, cycle, attempts, retryable) whose retryable share reaches a threshold."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("cycle")
    rows = cycles.withColumn("bad", F.coalesce(F.try_divide(F.col("retryable"), F.col("attempts")) >= threshold, F.lit(False)))
    rows = rows.withColumn("_g", F.sum((~F.col("bad")).cast("int")).over(w))
    return rows.where("bad").groupBy("run_id", "_g").agg(F.min("cycle").alias("first_cycle"), F.count(F.lit(1)).alias("length")).drop("_g")


def until_disabled(cycles: DataFrame) -> DataFrame:
    """Cycles (patient_id, cycle, outcome) up to each patient's first permanent failure, which disables the patient."""
    first = cycles.groupBy("patient_id").agg(F.min(F.when(F.col("outcome") == "permanent", F.col("cycle"))).alias("_f"))
    return cycles.join(first, "patient_id").where("_f is null or cycle <= _f").select(*cycles.columns)


def long_to_wide(measurements: DataFrame) -> DataFrame:
    """Events with vital fields from measurement rows of one observation."""
    keys = [c for c in ("observation_id", "patient_id", "encounter_id", "source", "event_timestamp", "arrival") if c in measurements.columns]
    return measurements.groupBy(*keys).agg(*(F.max(F.when(F.col("loinc_code") == LOINC[f], F.col("value"))).alias(f) for f in FIELDS))
