"""Helpers of the training-data operators: text batches, shared checkpoints, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that one step of a worker holds as Python strings.
STEP_ROWS = 256


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    A cluster whose machines do not share that folder gets the package with ``--py-files`` instead.
    """
    root = str(Path(__file__).resolve().parent.parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that all executors share.

    Never a local checkpoint: those die with an executor. Where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as ``build_session`` does, a checkpoint is removed once nothing refers to it.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. In local mode alone (tests) it may be unset: then under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def map_rows(
    df: DataFrame, columns: list[str], make: Callable[..., Callable[..., list[tuple]]], schema: str, args: tuple = ()
) -> DataFrame:
    """Applies a Python function to steps of rows, each giving any number of result rows.

    ``make(*args)`` runs once in a task and returns a function from the columns' value lists to a list of
    result tuples in the order of ``schema``. A worker holds at most STEP_ROWS input rows as Python values.
    """
    ship(df.sparkSession)
    picked = df.select(*columns)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make(*args)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                rows = step(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, type=f.type) for values, f in zip(zip(*rows, strict=True), arrow, strict=True)],
                        schema=arrow,
                    )

    return picked.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def unit(*parts: Any) -> F.Column:
    """A column of draws in [0, 1) that depends on its parts alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(1.0 / (1 << 53))
