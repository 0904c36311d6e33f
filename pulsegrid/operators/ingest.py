"""Raw events to processed measurements: transform, validate, unpivot, classify, deduplicate and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import ACVPU, BP_PANEL, BY_LOINC, FIELDS, SCHEMA_VERSIONS, VITALS

PROCESSED = ("observation_id", "patient_id", "encounter_id", "observation_type", "loinc_code", "value", "unit", "effective_datetime", "received_at", "source", "year", "month", "day")
KEY = ("observation_id", "loinc_code")
#: The newest record of a key comes first by these, nulls last.
RECENCY = ("received_at", "effective_datetime", "source", "value", "patient_id", "encounter_id", "unit", "observation_type")

_CODING = "array<struct<system: string, code: string, display: string>>"
_CONCEPT = f"struct<coding: {_CODING}, text: string>"
_QUANTITY = "struct<value: double, unit: string>"
OBSERVATION_SCHEMA = (
    f"resourceType string, id string, code {_CONCEPT}, subject struct<reference: string>, encounter struct<reference: string>, effectiveDateTime string, "
    f"valueQuantity {_QUANTITY}, valueCodeableConcept {_CONCEPT}, component array<struct<code: {_CONCEPT}, valueQuantity: {_QUANTITY}>>"
)
EVENT_SCHEMA = (
    "schema_version string, observation_id string, patient_id string, encounter_id string, event_timestamp string, source string, received_at string, _replay_attempt string, "
    + ", ".join(f"{f} string" for f in FIELDS)
)


def with_columns(df: DataFrame, names: tuple[str, ...], kind: str = "string") -> DataFrame:
    """df with typed null columns for the names it lacks."""
    missing = {n: F.lit(None).cast(kind) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def fhir_events(observations: DataFrame) -> DataFrame:
    """Flat vital events from parsed observations (OBSERVATION_SCHEMA), with an error column.

    A quantity, a coded answer or a blood-pressure panel fills its fields; error says why a row is no event
    and is null otherwise. received_at stands in for a missing effective time where the column exists.
    """
    o = with_columns(observations, ("received_at",))
    code = C.loinc_code(F.col("code"))
    answer = C.lookup(ACVPU, C.loinc_code(F.col("valueCodeableConcept")))
    quantity = F.col("valueQuantity.value")

    def component(loinc: str) -> Column:
        found = F.filter("component", lambda c: (C.loinc_code(c["code"]) == loinc) & c["valueQuantity"]["value"].isNotNull())
        return F.try_element_at(found, F.lit(-1))["valueQuantity"]["value"]

    out = o.select("*", code.alias("_code"), C.reference_id(F.col("subject.reference"), "Patient").alias("patient_id"), C.reference_id(F.col("encounter.reference"), "Encounter").alias("encounter_id"))
    values = {}
    for v in VITALS:
        direct = F.when(F.col("_code") == v.loinc, answer.cast("double") if v.ordinal else quantity)
        values[v.field] = direct
    for field, loinc in (("systolic_bp", "8480-6"), ("diastolic_bp", "8462-4")):
        values[field] = F.when(F.col("_code") == BP_PANEL, component(loinc)).otherwise(values[field])
    out = out.withColumns(values)
    single = F.col("_code").isin(*(v.loinc for v in VITALS))
    error = (
        F.when(C.is_blank(F.col("id")), "observation identifier is required")
        .when(F.col("patient_id").isNull(), "subject must reference a Patient")
        .when(F.col("encounter_id").isNull(), "encounter must reference an Encounter")
        .when(~F.coalesce(single | (F.col("_code") == BP_PANEL), F.lit(False)), "unsupported LOINC code")
        .when(F.coalesce(*(F.col(f) for f in FIELDS)).isNull(), "no supported value")
    )
    time = F.coalesce(F.col("effectiveDateTime"), F.col("received_at").cast("string"))
    return out.select(
        F.lit("1.2").alias("schema_version"), F.col("id").alias("observation_id"), "patient_id", "encounter_id", time.alias("event_timestamp"), F.lit("fhir_webhook").alias("source"), *FIELDS, error.alias("error")
    )


def event_error(df: DataFrame) -> Column:
    """Why a flat event of text fields is rejected on arrival; null where it is accepted.

    Checks come in order: version, ids, source, time, each present vital (numeric, whole where ordinal, in the
    realtime range), at least one vital, and the replay counter.
    """
    have = set(df.columns)

    def col(n: str) -> Column:
        return F.col(n) if n in have else F.lit(None).cast("string")

    versions = ", ".join(SCHEMA_VERSIONS)
    found = F.when(~F.coalesce(col("schema_version").isin(*SCHEMA_VERSIONS), F.lit(False)), f"schema_version must be one of: {versions}")
    for n in ("observation_id", "patient_id"):
        found = found.when(C.is_blank(col(n)), f"{n} must be a non-empty string")
    found = found.when((col("schema_version") != "1.0") & col("encounter_id").isNull(), F.concat(F.lit("encounter_id is required for schema_version "), col("schema_version")))
    found = found.when(col("encounter_id").isNotNull() & C.is_blank(col("encounter_id")), "encounter_id must be a non-empty string")
    found = found.when(C.is_blank(col("source")), "source must be a non-empty string")
    found = found.when(C.is_blank(col("event_timestamp")), "event_timestamp must be a non-empty ISO-8601 string")
    found = found.when(C.parse_iso(col("event_timestamp")).isNull(), "event_timestamp is not valid ISO-8601")
    for v in VITALS:
        if v.field not in have:
            continue
        number = F.col(v.field).try_cast("double")
        found = found.when(F.col(v.field).isNotNull() & number.isNull(), f"{v.field} must be numeric")
        if v.ordinal:
            found = found.when(number != F.floor(number), f"{v.field} must be a whole-number ordinal")
        found = found.when(~number.between(*v.realtime), f"{v.field} must be between {v.realtime[0]:g} and {v.realtime[1]:g}")
    found = found.when(F.coalesce(*(col(f).cast("string") for f in FIELDS)).isNull(), "at least one supported vital measurement is required")
    attempt = col("_replay_attempt")
    return found.when(attempt.isNotNull() & ~F.coalesce(attempt.cast("string").rlike("^[0-9]+$"), F.lit(False)), "_replay_attempt must be a non-negative integer")


def legacy_observation_id(df: DataFrame) -> Column:
    """The id of a flat record without one: a hash of who, when, source and all vitals, nulls as empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("patient_id", "event_timestamp", "source", *FIELDS)]
    return F.concat(F.lit("legacy_flattened_"), F.sha2(F.concat_ws("|", *parts), 256))


def measurement_candidates(df: DataFrame) -> DataFrame:
    """One row for each present vital of each wide record: a single scan and an unpivot.

    Missing columns count as null. Without patient or time columns there are no candidates.
    """
    if not {"patient_id", "event_timestamp"} <= set(df.columns):
        df = with_columns(df, ("patient_id", "event_timestamp")).limit(0)
    source = F.col("source").cast("string") if "source" in df.columns else F.lit("fhir_webhook")
    received = F.col("received_at") if "received_at" in df.columns else F.col("event_timestamp")
    given = F.col("observation_id").cast("string") if "observation_id" in df.columns else F.lit(None).cast("string")
    encounter = F.col("encounter_id").cast("string") if "encounter_id" in df.columns else F.lit(None).cast("string")
    ids = F.when(~C.is_blank(given), given).otherwise(legacy_observation_id(df))
    wide = with_columns(df, FIELDS, "double")
    base = wide.select(
        ids.alias("observation_id"),
        F.col("patient_id").cast("string").alias("patient_id"),
        encounter.alias("encounter_id"),
        C.parse_iso(F.col("event_timestamp").cast("string")).alias("effective_datetime"),
        C.parse_iso(received.cast("string")).alias("received_at"),
        source.alias("source"),
        *(F.struct(F.lit(v.loinc).alias("loinc_code"), F.lit(v.unit).alias("unit"), F.col(v.field).try_cast("double").alias("value"), F.col(v.field).isNotNull().alias("present")).alias(f"m_{v.field}") for v in VITALS),
    )
    keys = [c for c in base.columns if not c.startswith("m_")]
    long = base.select(*keys, F.inline(F.filter(F.array(*(F.col(f"m_{f}") for f in FIELDS)), lambda m: m["present"])))
    return long.select("observation_id", "patient_id", "encounter_id", "loinc_code", "value", "unit", "effective_datetime", "received_at", "source")


def with_metadata(df: DataFrame) -> DataFrame:
    """Adds the measurement's name, a default source and the day's parts."""
    return df.withColumns(
        {
            "observation_type": C.lookup({k: v.name for k, v in BY_LOINC.items()}, F.col("loinc_code")),
            "source": F.coalesce(F.col("source"), F.lit("fhir_webhook")),
            "year": F.year("effective_datetime"),
            "month": F.month("effective_datetime"),
            "day": F.dayofmonth("effective_datetime"),
        }
    )


def in_analytical_range() -> Column:
    """Whether value lies in its code's analytical range, ends included; null without a known code."""
    low = C.lookup({v.loinc: float(v.analytical[0]) for v in VITALS}, F.col("loinc_code"))
    high = C.lookup({v.loinc: float(v.analytical[1]) for v in VITALS}, F.col("loinc_code"))
    return F.col("value").between(low, high)


def rejection_reason(local: bool = False) -> Column:
    """The first quality rule that a measurement breaks; null for a valid one. local: only the three rules of the local loader."""
    reason = F.when(C.is_blank(F.col("observation_id")), "missing_observation_id").when(C.is_blank(F.col("patient_id")), "missing_patient_id")
    if not local:
        reason = (
            reason.when(C.is_blank(F.col("loinc_code")), "missing_loinc_code")
            .when(~F.col("loinc_code").isin(*BY_LOINC), "unsupported_loinc_code")
            .when(F.col("value").isNull(), "missing_value")
            .when(F.col("effective_datetime").isNull(), "missing_effective_datetime")
        )
    return reason.when(~in_analytical_range(), "physiological_range_violation")


def classify(df: DataFrame, local: bool = False) -> DataFrame:
    return df.withColumn("rejection_reason", rejection_reason(local))


def split(df: DataFrame, local: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows in processed columns, rejected rows with their reason)."""
    marked = classify(df, local)
    return marked.where("rejection_reason is null").select(*PROCESSED), marked.where("rejection_reason is not null")


def latest_per_key(df: DataFrame, keys: tuple[str, ...] = KEY, recency: tuple[str, ...] = RECENCY) -> DataFrame:
    """One row for each key: the first by recency, descending with nulls last.

    max of a struct compares its fields in order and puts nulls first, so descending order has them last.
    It aggregates before the shuffle, so a key with many records costs one row from each task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in recency if c in rest]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def merge(target: DataFrame, incoming: DataFrame, tie: str = "strict", delete_missing: bool = False) -> DataFrame:
    """target after the incoming records are merged in by key.

    A matching record replaces one without received_at or with an earlier one; with tie="incoming" an equally
    old one too. With delete_missing, target rows of the incoming encounters that the load lacks go.
    incoming has one row for each key (latest_per_key). Columns that target lacks are added as null.
    """
    if tie not in ("strict", "incoming"):
        raise ValueError(f"tie must be strict or incoming, not {tie!r}")
    for c in incoming.columns:
        if c not in target.columns:
            target = target.withColumn(c, F.lit(None).cast(incoming.schema[c].dataType))
    old = target.select(F.struct(*target.columns).alias("t"), *(F.col(k).alias(f"_t{k}") for k in KEY))
    new = incoming.select(F.struct(*(F.col(c) if c in incoming.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns)).alias("s"), *(F.col(k).alias(f"_s{k}") for k in KEY))
    joined = old.join(new, [F.col(f"_t{k}") == F.col(f"_s{k}") for k in KEY], "full_outer")
    newer = F.col("s.received_at") > F.col("t.received_at") if tie == "strict" else F.col("s.received_at") >= F.col("t.received_at")
    take = F.col("t").isNull() | (F.col("s").isNotNull() & (F.col("t.received_at").isNull() | F.coalesce(newer, F.lit(False))))
    if delete_missing:
        loaded = incoming.select(F.col("encounter_id").alias("_e")).where("_e is not null").distinct()
        marked = joined.join(loaded, F.col("t.encounter_id") == F.col("_e"), "left")
        joined = marked.where(F.col("s").isNotNull() | F.col("_e").isNull())
    return joined.select(F.when(take, F.col("s")).otherwise(F.col("t")).alias("r")).select("r.*")


def run_metrics(candidates: DataFrame, run_started_at: str) -> DataFrame:
    """One row of counts from a single pass over the classified candidates."""
    marked = candidates if "rejection_reason" in candidates.columns else classify(candidates)
    rejected = F.count_if(F.col("rejection_reason").isNotNull())
    return marked.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("rejection_reason").isNull()).alias("valid_count"), rejected.alias("rejected_count")).select(
        F.lit(run_started_at).alias("run_started_at"), "*"
    )


def replay_events(quarantine: DataFrame) -> DataFrame:
    """Quarantined measurements as version 1.0 events; error says why one cannot be replayed. The encounter is lost."""
    required = ("observation_id", "patient_id", "loinc_code", "value", "effective_datetime")
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required))
    known = F.col("loinc_code").isin(*BY_LOINC)
    error = F.when(missing != "", F.concat(F.lit("missing required fields: "), missing)).when(~known, F.concat(F.lit("unsupported code: "), F.col("loinc_code")))
    fields = [F.when(F.col("loinc_code") == v.loinc, F.col("value").cast("double")).alias(v.field) for v in VITALS]
    return quarantine.select(
        F.lit("1.0").alias("schema_version"),
        F.col("observation_id").cast("string").alias("observation_id"),
        F.col("patient_id").cast("string").alias("patient_id"),
        F.lit("quarantine_replay").alias("source"),
        F.col("effective_datetime").cast("string").alias("event_timestamp"),
        *fields,
        error.alias("error"),
    )


def observations_of(readings: DataFrame) -> DataFrame:
    """Observations from wide readings: one for each present vital, both pressures as one panel.

    Values are rounded to one decimal; pressures need both; consciousness becomes its answer code.
    """
    codes = {float(n): c for c, n in ACVPU.items()}
    readings = with_columns(readings, FIELDS, "double")

    def one(v) -> Column:
        x = F.col(v.field).cast("double")
        return F.when(x.isNotNull(), F.struct(F.lit(v.loinc).alias("loinc_code"), (F.lit(None).cast("double") if v.ordinal else F.round(x, 1)).alias("value"), (C.lookup(codes, x) if v.ordinal else F.lit(None).cast("string")).alias("answer"), F.lit(None).cast("double").alias("second_value")))

    pressure = F.when(
        F.col("systolic_bp").isNotNull() & F.col("diastolic_bp").isNotNull(),
        F.struct(F.lit(BP_PANEL).alias("loinc_code"), F.round(F.col("systolic_bp").cast("double"), 1).alias("value"), F.lit(None).cast("string").alias("answer"), F.round(F.col("diastolic_bp").cast("double"), 1).alias("second_value")),
    )
    items = [one(v) for v in VITALS if not v.field.endswith("_bp")] + [pressure]
    keep = [c for c in readings.columns if c not in FIELDS]
    return readings.select(*keep, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("o")).select(*keep, "o.*")


def decode_records(records: DataFrame, data_col: str = "data") -> DataFrame:
    """Stream records of base64 JSON objects: the event's text fields, the raw text, and error for what cannot be read."""
    decoded = records.withColumn("_bytes", F.try_to_binary(F.col(data_col), F.lit("base64")))
    valid = F.when(F.is_valid_utf8(F.col("_bytes").cast("string")), F.col("_bytes").cast("string"))
    decoded = decoded.withColumn("raw", valid).drop("_bytes")
    kind = F.try_variant_get(F.try_parse_json("raw"), "$", "map<string, variant>")
    parsed = decoded.withColumn("event", F.from_json("raw", T.StructType.fromDDL(EVENT_SCHEMA)))
    error = F.when(F.col("raw").isNull(), "record data must be base64-encoded UTF-8").when(kind.isNull(), "record data must contain a JSON object")
    return parsed.withColumn("error", error)
