"""Window, ranking and top-k operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import keep


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by order; a max_by, which aggregates before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def forward_fill(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Carries each column forward within its key, never backward or across keys."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def before(df: DataFrame, keys: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """Adds <column>_before for each column: its sum over the rows of the same keys that come earlier by order.

    Each value of keys and order occurs once. Rows are dealt by ranges of both, so no key or table goes through one
    task: parts are summed by themselves, and the parts' sums, one row for each part and key, give what comes before.
    The ranges are kept as a checkpoint, since Spark samples bounds anew for each plan.
    """
    sign = [F.col(c).asc() for c in keys] + [F.col(order).desc() if descending else F.col(order).asc()]
    parts = keep(df.repartitionByRange(*sign).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(sign[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_same_part"), *(F.col(k).alias(f"_same_{k}") for k in keys), *(F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_first_{c}") for c in columns))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys), F.col("_part") == F.col("_same_part"))
    sums = parts.select(*parts.columns, *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in columns))
    return sums.join(offsets, same).select(*df.columns, *((F.col(f"_first_{c}") + F.col(f"_in_{c}")).alias(f"{c}_before") for c in columns))


def midranks(df: DataFrame, score: str, name: str = "midrank", group: list[str] | None = None) -> DataFrame:
    """Adds the average rank of equal scores, from 1 on, by running sums of the counts of distinct scores."""
    keys = list(group or [])
    counts = before(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c")), keys, score, ["_c"])
    ranks = counts.select(*keys, score, (F.col("_c_before") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, score])


def deltas(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's change against the key's row before; null where either value is missing."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns})


def recent_history(df: DataFrame, key: str, time: str, arrival: str, limit: int = 60) -> DataFrame:
    """The last rows of each key by time; of rows with one time the last to arrive."""
    once = latest_by(df, [key, time], [arrival])
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def distributed_nearest_rank(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """(fraction, value) by nearest floor rank over a table of any size, through counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    up_to = before(counts, [], value, ["c"]).withColumn("upto", F.col("c_before") + F.col("c"))
    total = counts.agg(F.sum("c").alias("n"))
    asked = F.explode(F.array(*(F.lit(float(f)) for f in fractions))).alias("fraction")
    ranks = total.select("n", asked).withColumn("rank", F.floor((F.col("n") - 1) * F.col("fraction")) + 1)
    hit = up_to.join(F.broadcast(ranks), (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    return hit.select("fraction", value)


def latency_summary(df: DataFrame, value: str, group: list[str] | None = None, fractions: tuple[float, ...] = (0.50, 0.95, 0.99)) -> DataFrame:
    """Count, mean, nearest-floor-rank percentiles and maximum of each group, rounded to two digits.

    Works on the counts of distinct values and their running sums, so a group of any size goes through no one task.
    """
    keys = list(group or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = before(counts, keys, value, ["_c"])
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), (F.sum(F.col("_c") * F.col(value)) / F.sum("_c")).alias("_mean"))
    totals = totals.select("_n", "_mean", *(F.col(k).alias(f"_total_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_total_{k}")) for k in keys), F.lit(True))
    rows = placed.join(totals, same) if keys else placed.crossJoin(F.broadcast(totals))  # a single row

    def at(fraction: float) -> Column:
        rank = F.floor((F.col("_n") - 1) * F.lit(fraction)) + 1
        return F.max(F.when((rank > F.col("_c_before")) & (rank <= F.col("_c_before") + F.col("_c")), F.col(value)))

    aggs = [F.max("_n").alias("observed"), F.round(F.max("_mean"), 2).alias("mean_ms"), *(F.round(at(p), 2).alias(f"p{int(p * 100)}_ms") for p in fractions), F.round(F.max(value), 2).alias("max_ms")]
    return rows.groupBy(*keys).agg(*aggs)


def gate_interval(df: DataFrame, key: str, elapsed: str, interval: float, suppress_first: bool = False) -> DataFrame:
    """The first row of each key and interval of elapsed time; with suppress_first none strictly between 0 and the first end."""
    rows = df.where((F.col(elapsed) <= 0) | (F.col(elapsed) >= interval)) if suppress_first else df
    rows = rows.withColumn("_i", F.floor(F.col(elapsed) / F.lit(float(interval))))
    best = rows.groupBy(key, "_i").agg(F.min_by(F.struct(*df.columns), F.col(elapsed)).alias("_r"))
    return best.select("_r.*")
