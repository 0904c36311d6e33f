"""Declarative data-quality rules. All rules of a table are evaluated in one pass, bar those that need groups."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import stable_key


@dataclass(frozen=True)
class Rule:
    """A rule on rows: the condition that a good row meets. limit: bad rows that still pass; severity: error or warn."""

    name: str
    good: Column
    limit: int = 0
    severity: str = "error"


@dataclass(frozen=True)
class Contract:
    rules: list[Rule] = field(default_factory=list)
    min_rows: int = 0
    unique: list[tuple[str, ...]] = field(default_factory=list)


def not_null(column: str) -> Rule:
    return Rule(f"not_null:{column}", F.col(column).isNotNull())


def in_set(column: str, values: list) -> Rule:
    return Rule(f"in_set:{column}", F.col(column).isNull() | F.col(column).isin(values))


def not_in_set(column: str, values: list) -> Rule:
    return Rule(f"not_in_set:{column}", F.col(column).isNull() | ~F.col(column).isin(values))


def in_range(column: str, low, high) -> Rule:
    return Rule(f"in_range:{column}", F.col(column).isNull() | F.col(column).between(low, high))


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, severity, rows, failures, passed): one row for each rule.

    Row rules share one aggregation; each uniqueness rule adds one, on its own columns.
    """
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~F.coalesce(r.good, F.lit(False))).alias(f"r{i}") for i, r in enumerate(contract.rules)))
    items = [F.struct(F.lit("row_count").alias("rule"), F.lit("error").alias("severity"), F.greatest(F.lit(contract.min_rows) - F.col("n"), F.lit(0)).cast("long").alias("failures"), F.lit(0).cast("long").alias("allowed"))]
    items += [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r{i}").alias("failures"), F.lit(r.limit).cast("long").alias("allowed")) for i, r in enumerate(contract.rules)]
    out = counts.select("n", F.inline(F.array(*items))).select("rule", "severity", F.col("n").alias("rows"), "failures", (F.col("failures") <= F.col("allowed")).alias("passed"))
    for columns in contract.unique:
        found = duplicates(df, *columns).agg(F.count(F.lit(1)).alias("failures"))
        row = found.select(F.lit("unique:" + ",".join(columns)).alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("long").alias("rows"), "failures", (F.col("failures") == 0).alias("passed"))
        out = out.unionByName(row)
    return out


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Rows of child whose non-null key the parent lacks."""
    keys = parent.select(F.col(parent_column or column).alias("_parent")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, child[column] == keys["_parent"], "left_anti")


def freshness(df: DataFrame, column: str, as_of: str, hours: float) -> DataFrame:
    """One row: the newest time, its age in seconds at as_of and whether that is within the limit."""
    age = F.timestamp_diff("SECOND", F.col("newest"), F.lit(as_of).cast("timestamp"))
    return df.agg(F.max(column).alias("newest")).select("newest", age.alias("age_seconds"), F.coalesce(age <= int(hours * 3600), F.lit(False)).alias("passed"))


def split_leakage(training: DataFrame, group: str = "patient_key") -> DataFrame:
    """Groups that occur in more than one split."""
    return training.groupBy(group).agg(F.count_distinct("data_split").alias("n")).where("n > 1").select(group)


def missing_split(training: DataFrame) -> DataFrame:
    """One row where training lacks a split, none where it has both."""
    return training.agg(F.count_distinct("data_split").alias("n")).where("n <> 2").select(F.lit("missing_train_or_test_split").alias("failure"))


def one_class_splits(training: DataFrame, label: str = "deterioration_proxy_label") -> DataFrame:
    return training.groupBy("data_split").agg(F.count_distinct(label).alias("class_count")).where("class_count <> 2")


def inconsistent_versions(predictions: DataFrame) -> DataFrame:
    """Model versions whose metadata is not the same in all their rows."""
    columns = ("decision_threshold", "feature_schema_version", "label_definition_version", "dataset_fingerprint", "scored_at")
    bad = reduce(lambda a, b: a | b, (F.col(f"n_{c}") != 1 for c in columns))
    return predictions.groupBy("model_version").agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns)).where(bad).select("model_version")


def split_group_leakage(training: DataFrame, split_groups: DataFrame) -> DataFrame:
    """Waveform split groups (patient_id, split_group) whose patients occur in more than one split."""
    groups = split_groups.select(stable_key(F.col("patient_id")).alias("patient_key"), "split_group")
    return training.select("patient_key", "data_split").join(groups, "patient_key").groupBy("split_group").agg(F.count_distinct("data_split").alias("n")).where("n > 1").select("split_group")


def invalid_count(df: DataFrame) -> DataFrame:
    """One row: rows that lack a required value, plus keys (observation_id, loinc_code) that occur more than once."""
    lacking = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("observation_id", "patient_id", "loinc_code", "value", "effective_datetime"))) | (F.col("patient_id") == "")
    rows = df.agg(F.count_if(lacking).alias("n"))
    keys = duplicates(df.where("observation_id is not null and loinc_code is not null"), "observation_id", "loinc_code").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(keys).agg(F.sum("n").alias("invalid_row_count"))


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """(name, sha256, verified) of blobs (name, content, expected): whether a content has the checksum it was published with."""
    digest = F.sha2("content", 256)
    return blobs.select("name", digest.alias("sha256"), digest.eqNullSafe(F.col("expected")).alias("verified"))


def out_of_unit_range(predictions: DataFrame, columns: tuple[str, ...] = ("deterioration_probability", "decision_threshold")) -> DataFrame:
    bad = reduce(lambda a, b: a | b, (~F.col(c).between(0, 1) for c in columns))
    return predictions.where(bad).select("model_version", "encounter_key")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): the same for any order of rows.

    Row hashes are summed exactly, as decimals of four parts of 32 bits, so nothing is collected, sorted or overflows.
    """
    row = F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    part = lambda at: F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(at)).alias(f"s{at}") for at in (1, 9, 17, 25)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *sums).select("rows", F.md5(F.concat_ws(":", "rows", *(F.col(f"s{at}").cast("string") for at in (1, 9, 17, 25)))).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """MD5 of the sorted rows' MD5s: for tables or groups that fit into one task (dimensions, samples)."""
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in (group or []))))
    agg = [F.count(F.lit(1)).alias("rows"), F.md5(F.concat_ws("", F.sort_array(F.collect_list(row)))).alias("fingerprint")]
    return df.groupBy(*group).agg(*agg) if group else df.agg(*agg)


def compare_keys(expected: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that only one side has, or whose values differ, with the side or reason."""
    a = expected.select(*keys, F.struct(*values).alias("e"))
    b = stored.select(*keys, F.struct(*values).alias("s"))
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, F.when(F.col("s").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.col("e").eqNullSafe(F.col("s")), "mismatched").alias("difference")).where("difference is not null")


def file_gate(path: str | Path, sha256: str) -> str:
    """The file's SHA-256 where it equals the frozen one; else an error before any data is read."""
    digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    if digest != sha256:
        raise ValueError(f"{path} changed since it was frozen (SHA-256 {digest[:12]}, frozen {sha256[:12]})")
    return digest
