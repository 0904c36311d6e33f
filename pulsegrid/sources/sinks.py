"""Sinks: partitioned tables, append logs, key-based upserts and stream writers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.ingest import latest_per_key, merge
from pulsegrid.sources.readers import checked

#: Names of published models.
MODEL_VERSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def write_quarantine(rejected: DataFrame, path: str) -> bool:
    """Appends rejected rows with the time; writes nothing, and says so, where there are none."""
    if rejected.isEmpty():
        return False
    rejected.withColumn("quarantined_at", F.current_timestamp()).write.mode("append").json(path)
    return True


def write_by_day(df: DataFrame, path: str, time: str = "effective_datetime", mode: str = "overwrite") -> None:
    """Parquet partitioned by the day of a time; rows meet by day first, so a day is a few files, and AQE splits large days."""
    dated = df.withColumn("effective_date", F.to_date(time))
    dated.hint("rebalance", "effective_date").write.mode(mode).partitionBy("effective_date").parquet(path)


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("effective_date")


def add_missing_columns(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with the columns that only other has, as nulls."""
    return df.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in other.columns if c not in df.columns})


class Conflict(RuntimeError):
    """Another writer has moved the table on since this load read it."""


def _log(spark: SparkSession, path: str):
    """(file system, path class, log folder, sorted names of its entries) of a versioned table."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = of(f"{path.rstrip('/')}/_log")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    return fs, of, folder.toString(), [n for n in names if n.isdigit()]


def upsert(spark: SparkSession, path: str, incoming: DataFrame, tie: str = "strict", delete_missing: bool = False, versions: int = 2) -> str:
    """Merges records into the table at path: a new version beside the old, then a pointer moves to it.

    Readers go through ``current``. Versions are whole, so a failed load leaves the old one in place. Log entries are
    numbered, and an entry is created only where there is none, so of two loads that read one version the later
    raises Conflict, and loses nothing of the other's. The last versions stay for readers that still use them.
    """
    fs, of, folder, names = _log(spark, path)
    once = latest_per_key(incoming)
    old = current(spark, path)
    merged = once if old is None else merge(old, once, tie, delete_missing)
    version = f"{path.rstrip('/')}/v_{uuid.uuid4().hex}"
    write_by_day(merged, version)
    number = int(names[-1]) + 1 if names else 0
    try:
        out = fs.create(of(f"{folder}/{number:020d}"), False)
    except Py4JJavaError as error:
        fs.delete(of(version), True)
        raise Conflict(f"{path} has moved on; read it and load again") from error
    out.write(bytearray(version.encode()))
    out.close()
    for name in names[: len(names) + 1 - versions]:  # versions before the kept ones
        gone = _version(spark, f"{folder}/{name}")
        fs.delete(of(gone), True)
    return version


def _version(spark: SparkSession, entry: str) -> str:
    return spark.read.text(entry).first().value


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's newest version, or none."""
    _, _, folder, names = _log(spark, path)
    return read_by_day(spark, _version(spark, f"{folder}/{names[-1]}")) if names else None


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Appends a run's single metrics row as one file."""
    metrics.withColumn("processed_at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines in a folder for each model version, which is then no field of the lines."""
    predictions.write.mode("append").partitionBy("model_version").json(path)


def write_reference(df: DataFrame, path: str) -> None:
    """A small reference table as JSON lines with sorted keys in one file."""
    df.select(*sorted(df.columns)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """A model as a view, or as a table at path."""
    if path is None:
        df.createOrReplaceTempView(name)
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def land_raw(stream: DataFrame, path: str, checkpoint: str, time: str = "arrived_at", every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Lands a stream as gzip JSON in folders of year, month, day and hour."""
    t = F.col(time)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)}
    writer = stream.withColumns(parts).writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*parts)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()


def register_partition(spark: SparkSession, table: str, column: str, value: str, location: str) -> None:
    """Adds a partition to a catalog table unless it is there: later reads see its files without a scan of all folders."""
    for name in table.split("."):
        checked(name)
    checked(column)
    if not MODEL_VERSION.fullmatch(value):
        raise ValueError(f"unsafe partition value: {value!r}")
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({column} = '{value}') LOCATION '{location.replace(chr(39), '')}'")


def publish(df: DataFrame, path: str, key: str = "patient_id", partitions: int | None = None, batch: int = 500) -> None:
    """Republishes events, each key's in one partition, in order of time, in batches of at most so many events."""
    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    dealt.sortWithinPartitions(key, "event_timestamp").write.mode("append").option("maxRecordsPerFile", batch).json(path)


def fan_out(stream: DataFrame, subscriptions: Callable[[], DataFrame], deliver: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Joins each micro-batch with the subscriptions of the moment and hands the deliveries to a callback."""

    def batch(events: DataFrame, _: int) -> None:
        deliver(events.join(subscriptions(), "patient_id"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after_delivery(subscriptions: DataFrame, attempts: DataFrame) -> DataFrame:
    """The subscriptions that stay after attempts (connection_id, status): a connection that is gone (410) goes."""
    return subscriptions.join(attempts.where("status = 410").select("connection_id"), "connection_id", "left_anti").select(*subscriptions.columns)


def delivery_metrics(attempts: DataFrame) -> DataFrame:
    """Counts of deliveries, failures and gone connections from attempts (status)."""
    s = F.col("status")
    return attempts.agg(F.count_if(s == 200).alias("deliveries"), F.count_if(~s.isin(200, 410)).alias("failures"), F.count_if(s == 410).alias("gone"), F.count(F.lit(1)).alias("connections"))
