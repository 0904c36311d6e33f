"""Session and table helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pulsegrid", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC with AQE; a cluster passes its own configuration instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it; a cluster gets it with ``--py-files``."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. In local mode alone (tests) it may be unset: then under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gives."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, for what several readers must see alike; removed once nothing refers to it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/_checkpoints")
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
