"""Sources: files, folders, streams and bundles as DataFrames with declared schemas."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ingest import EVENT_SCHEMA, OBSERVATION_SCHEMA

PROVIDER_SEED = "provider_npi string, provider_name string, taxonomy_code string, taxonomy_description string, provider_state string, valid_from string, valid_to string, is_current boolean, data_source string"
UNIT_SEED = "unit_name string, care_level string, care_level_rank int"
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked(*names: str) -> None:
    """Raises where a name is no plain SQL identifier."""
    for n in names:
        if not _IDENTIFIER.fullmatch(n):
            raise ValueError(f"unsafe SQL identifier: {n!r}")


def raw_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Flat events of all JSON files below a path. All fields are read as text, so mixed types cannot fail; casts follow."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def resolve_types(df: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """Casts columns that exist, to null where a value does not fit: (column, type) pairs."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in specs if c in df.columns})


def incremental_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """The same as a stream; with a checkpoint and an available-now trigger each file is read once."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def ordered_records(df: DataFrame, columns: list[str], key: str = "encounter_key") -> DataFrame:
    """Checked columns in order of the key, for a reproducible fetch."""
    checked(*columns, key)
    return df.select(*columns).orderBy(key)


def seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def ndjson_folder(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", "*.ndjson").json(folder)


def quarantine(spark: SparkSession, path: str, schema: str, reason: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows if reason is None else rows.where(F.col("rejection_reason") == reason)


def observations(json_text: DataFrame, column: str = "value") -> DataFrame:
    """Observation resources parsed from JSON text, with an error for what is none or does not fit its path id."""
    parsed = json_text.withColumn("o", F.from_json(column, T.StructType.fromDDL(OBSERVATION_SCHEMA)))
    wrong = F.coalesce(F.col("o.resourceType") != "Observation", F.lit(True))
    error = F.when(F.col("o").isNull() | wrong, "resource must be an Observation")
    if "path_id" in json_text.columns:
        error = error.when(~F.col("path_id").eqNullSafe(F.col("o.id")), "path id does not match the resource id")
    keep = [c for c in json_text.columns if c != column]
    return parsed.select(*keep, "o.*", error.alias("request_error"))


def bundle_resources(bundles: DataFrame, kind: str, schema: str, column: str = "value") -> DataFrame:
    """The resources of one kind in bundles of JSON text, parsed by a schema, with their place in the bundle."""
    entries = F.from_json(F.get_json_object(column, "$.entry"), "array<struct<resource: string>>")
    keep = [c for c in bundles.columns if c != column]
    rows = bundles.select(*keep, F.posexplode(entries).alias("position", "entry"))
    rows = rows.where(F.get_json_object("entry.resource", "$.resourceType") == kind)
    return rows.select(*keep, "position", F.from_json("entry.resource", T.StructType.fromDDL(schema)).alias("r")).select(*keep, "position", "r.*")


def result_pages(pages: DataFrame, columns: list[str], page: str = "page", body: str = "value") -> DataFrame:
    """Rows of a paged text result: JSON bodies with Rows of Data cells, as (page, row, the named columns).

    Missing cells at a row's end are null. Rows that repeat the column names, as the first page's header does, go.
    """
    cells = F.from_json(F.get_json_object(body, "$.ResultSet.Rows"), "array<struct<Data: array<struct<VarCharValue: string>>>>")
    rows = pages.select(page, F.posexplode(cells).alias("row", "r"))
    named = rows.select(page, "row", *(F.get(F.col("r.Data"), F.lit(i))["VarCharValue"].alias(c) for i, c in enumerate(columns)))
    header = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(c)) for c in columns))
    return named.where(~header)


def paged_search(starts: DataFrame, fetch: Callable[[str], str], url: str = "url", most: int = 1_000_000) -> DataFrame:
    """(url, page, position, resource) of searches whose pages name the next one by a link; fetch gives a page's JSON text.

    Pages of one search can only be read one after another, so searches, not pages, are spread over executors; a
    page's entries leave the worker as they are read. A search that links to a page it has read raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                at, seen = start, set()
                while at is not None and len(seen) < most:
                    if at in seen:
                        raise ValueError(f"the search's pages form a cycle at {at}")
                    bundle = json.loads(fetch(at))
                    found = [json.dumps(e["resource"], separators=(",", ":")) for e in bundle.get("entry", [])]
                    yield pa.RecordBatch.from_pydict(
                        {"url": pa.array([start] * len(found), pa.string()), "page": pa.array([len(seen)] * len(found), pa.int32()), "position": pa.array(range(len(found)), pa.int32()), "resource": pa.array(found, pa.string())}
                    )
                    seen.add(at)
                    at = next((link["url"] for link in bundle.get("link", []) if link.get("relation") == "next"), None)

    return starts.select(F.col(url).alias("url")).mapInArrow(run, "url string, page int, position int, resource string")


def channel_name(name: Column) -> Column:
    """A waveform channel's name without case, blanks or trailing commas."""
    return F.upper(F.trim(F.rtrim(F.trim(name), F.lit(","))))


#: Names under which records hold a vital.
CHANNELS = {"heart_rate": ("HR", "HEART RATE"), "respiratory_rate": ("RESP", "RR", "RESPIRATORY RATE"), "spo2": ("SPO2", "SPO2%", "O2 SAT")}


def _channel(names: list[str], wanted: tuple[str, ...]) -> int:
    """The channel of a name; else one whose last word it is, as some headers put stray fields before the name."""
    plain = lambda n: n.strip().rstrip(",").strip().upper()
    whole, last = [plain(n) for n in names], [plain(n.split()[-1]) if len(n.split()) > 1 else "" for n in names]
    for found in (whole, last):
        for i, n in enumerate(found):
            if n in wanted:
                return i
    raise ValueError(f"none of the channels {', '.join(wanted)} in {', '.join(names)}")


def _signals(header: str, data: bytes) -> tuple[str, float, list[str], np.ndarray]:
    """(record, samples a second, channel names, samples by channels) of a record in 16-bit format; NaN where it has none."""
    lines = [line for line in header.splitlines() if line.strip() and not line.startswith("#")]
    first = lines[0].split()
    count, rate = int(first[1]), float(first[2].split("/")[0]) if len(first) > 2 else 250.0
    gains, bases, names = [], [], []
    for line in lines[1 : 1 + count]:
        part = line.split(None, 8)
        if not part[1].startswith("16"):
            raise ValueError(f"format {part[1]} of {first[0]} is not read; only 16 is")
        gain = re.match(r"([0-9.eE+-]+)(?:\((-?[0-9]+)\))?", part[2] if len(part) > 2 else "200")
        zero = int(part[4]) if len(part) > 4 else 0
        gains.append(float(gain[1]) or 200.0)
        bases.append(int(gain[2]) if gain[2] else zero)
        names.append(part[8] if len(part) > 8 else "")
    raw = np.frombuffer(data, "<i2")
    raw = raw[: len(raw) // count * count].reshape(-1, count)
    return first[0], rate, names, np.where(raw == -32768, np.nan, (raw - np.array(bases)) / np.array(gains))


def waveform_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record, offset_seconds, heart_rate, respiratory_rate, spo2) of the records in a folder: a .hea and a .dat file each.

    A record is read by one task; records are spread over tasks by their names. Samples without a value are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hea,dat}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.(?:hea|dat)$", 1)
    body = lambda kind: F.max(F.when(F.col("path").endswith(kind), F.col("content")))
    pairs = files.groupBy(name.alias("record")).agg(body(".hea").alias("header"), body(".dat").alias("data")).where("header is not null and data is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for header, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record, rate, names, values = _signals(header.decode(), data)
                if rate <= 0:
                    raise ValueError(f"{record} has no sampling rate")
                columns = {"record": pa.array([record] * len(values)), "offset_seconds": pa.array((np.arange(len(values)) / rate).astype(np.int32))}
                columns |= {field: pa.array(values[:, _channel(names, wanted)], from_pandas=True) for field, wanted in CHANNELS.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return pairs.select("header", "data").mapInArrow(run, "record string, offset_seconds int, " + ", ".join(f"{f} double" for f in CHANNELS))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An inline relation; without rows an empty typed one."""
    return spark.createDataFrame(rows, schema)
