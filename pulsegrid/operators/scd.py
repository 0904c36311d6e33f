"""Slowly changing dimensions: snapshot merges, change lists and periods from repeated facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT_FIELDS = ("provider_npi", "provider_name", "taxonomy_code", "taxonomy_description", "provider_state")


class DuplicateKeys(ValueError):
    """A snapshot names a key more than once."""


def merge_snapshot(history: DataFrame, snapshot: DataFrame, effective: str, key: str = "provider_npi", fields: tuple[str, ...] = SNAPSHOT_FIELDS, source: str = "nppes_snapshot") -> DataFrame:
    """history after a snapshot: changed current versions are closed, changed and new keys get a new one.

    Versions of keys that the snapshot lacks stay as they are. Blank valid_to is open. Raises DuplicateKeys.
    """
    if not snapshot.groupBy(key).count().where("count > 1").isEmpty():
        raise DuplicateKeys(f"the snapshot holds duplicate {key} values")
    snap = snapshot.select(F.col(key).alias("_key"), F.struct(*fields).alias("_new"))
    is_current = F.lower(F.col("is_current").cast("string")) == "true"
    joined = history.join(snap, (F.col(key) == F.col("_key")) & is_current, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.struct(*fields))
    kind = history.schema["is_current"].dataType
    kept = joined.withColumns(
        {"valid_to": F.when(changed, F.lit(effective).cast(history.schema["valid_to"].dataType)).otherwise(F.col("valid_to")), "is_current": F.when(changed, F.lit("false").cast(kind)).otherwise(F.col("is_current"))}
    ).select(*history.columns)
    current = history.where(is_current).select(F.col(key).alias("_key"), F.struct(*fields).alias("_old"))
    fresh = snap.join(current, "_key", "left").where(F.col("_old").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")))
    open_end = F.lit("") if history.schema["valid_to"].dataType.simpleString() == "string" else F.lit(None)
    added = fresh.select("_new.*").select(
        *fields,
        F.lit(effective).cast(history.schema["valid_from"].dataType).alias("valid_from"),
        open_end.cast(history.schema["valid_to"].dataType).alias("valid_to"),
        F.lit("true").cast(kind).alias("is_current"),
        F.lit(source).alias("data_source"),
    )
    return kept.unionByName(added, allowMissingColumns=True)


def versions_from_changes(changes: DataFrame, key: str, start: str) -> DataFrame:
    """Versions from rows that each start a state: valid_to is the next start, the last is current."""
    w = Window.partitionBy(key).orderBy(start)
    out = changes.withColumns({"valid_from": F.col(start), "valid_to": F.lead(start).over(w)})
    return out.withColumn("is_current", F.col("valid_to").isNull())


def periods(facts: DataFrame, key: str, value: str, start: str, default: str = "No insurance", keys: DataFrame | None = None) -> DataFrame:
    """Periods (key, value, valid_from, valid_to) from facts: one starts wherever the value changes.

    Facts are taken in order of start, then value; a null value counts as default; the last period is open.
    Keys of the table keys without any fact get one open period of the default from 1900-01-01.
    """
    w = Window.partitionBy(key).orderBy("valid_from", "_v")
    named = facts.select(key, F.coalesce(F.col(value), F.lit(default)).alias("_v"), F.col(start).alias("valid_from"))
    starts = named.withColumn("_before", F.lag("_v").over(w)).where("_before is null or _before <> _v")
    out = starts.withColumn("valid_to", F.lead("valid_from").over(w)).select(key, F.col("_v").alias(value), "valid_from", "valid_to")
    if keys is not None:
        kind = out.schema["valid_from"].dataType
        bare = keys.select(key).distinct().join(out.select(key).distinct(), key, "left_anti")
        out = out.unionByName(bare.select(key, F.lit(default).alias(value), F.lit("1900-01-01").cast(kind).alias("valid_from"), F.lit(None).cast(kind).alias("valid_to")))
    return out


def overlapping_versions(versions: DataFrame, key: str, version_key: str, far: str = "9999-12-31") -> DataFrame:
    """Pairs of a key's versions whose half-open periods overlap, each pair once.

    The self join is on the key, so its size is that of the versions of one key, which are few.
    """
    a = versions.select(key, F.col(version_key).alias("earlier_key"), F.col("valid_from").alias("a_from"), F.coalesce("valid_to", F.lit(far).cast("date")).alias("a_to"))
    b = versions.select(F.col(key).alias("_k"), F.col(version_key).alias("later_key"), F.col("valid_from").alias("b_from"), F.coalesce("valid_to", F.lit(far).cast("date")).alias("b_to"))
    hit = (F.col(key) == F.col("_k")) & (F.col("earlier_key") < F.col("later_key")) & (F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to"))
    return a.join(b, hit).select("earlier_key", "later_key")


def not_one_current(versions: DataFrame, key: str) -> DataFrame:
    """Keys that do not have exactly one current version."""
    return versions.groupBy(key).agg(F.count_if("is_current").alias("n")).where("n <> 1").select(key)
