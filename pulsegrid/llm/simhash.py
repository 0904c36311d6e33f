"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into only two segments of 32. Of two fingerprints that differ in three
bits or fewer, one segment differs in at most one bit. Each segment is therefore indexed 33 times: as it
is, and once for each bit with that bit as a wildcard. Equal keys bring every such pair together; the
distance of the whole fingerprints is then verified. All work is on distinct fingerprints, so copies cost
one row each. A bucket gives a spanning forest of its verified links, never all its pairs.

A segment that very many fingerprints share would make hot buckets. Within one, the other segment differs in
at most three bits, so of its four bytes one is equal: such a bucket is dealt by these bytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import keep, map_rows, utf8
from pulsegrid.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
#: Fingerprints of a bucket that are compared at once. A segment of more than half as many is dealt further, by the
#: other segment's bytes; buckets that are larger even then are compared block by block.
BLOCK = 2048
#: Hot segments up to which their keys are broadcast, 33 longs each; beyond that the join shuffles.
BROADCAST_SEGMENTS = 10_000
#: Shingle hashes whose bits are unpacked at once.
HASH_STEP = 1 << 14


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text as an unsigned integer; zero without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    h64 = xxhash.xxh64_intdigest
    last = SHINGLE_WORDS - 1
    hashes = np.array(
        [h64(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASH_STEP):
        part = hashes[at : at + HASH_STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints():
    def step(ids: list, texts: list) -> list[tuple]:
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()
        return list(zip(ids, values, strict=True))

    return step


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, ["doc_id", "text"], _fingerprints, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(key, bit, fp): the 66 index entries of each distinct fp.

    key holds the segment, the wildcard (32: none) and the segment's bits without it; bit is what the
    wildcard hides. A wildcard only has to bring together fingerprints that differ in it, since equal
    segments already meet without one.
    """
    halves = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(F.col("fp"), 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1))))
    wild = F.explode(F.sequence(F.lit(0), F.lit(32)))
    mask = F.when(F.col("w") < 32, F.expr("shiftleft(1L, w)")).otherwise(F.lit(0).cast("long"))
    parts = distinct.select("fp", halves.alias("h")).select("fp", "h.s", "h.v", wild.alias("w"))
    return parts.select(
        F.expr("shiftleft(CAST(s * 33 + w AS BIGINT), 32)").bitwiseOR(F.col("v").bitwiseAND(F.bitwise_not(mask))).alias("key"),
        (F.col("v").bitwiseAND(mask) != 0).cast("byte").alias("bit"),
        "fp",
    )


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links (at most MAX_DISTANCE bits apart) among fingerprints."""
    left = np.arange(len(fps))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[node]) <= MAX_DISTANCE
            if near.any():
                reached = left[near]
                a.append(np.full(len(reached), fps[node]))
                b.append(fps[reached])
                frontier.extend(reached.tolist())
                left = left[~near]
    empty = np.empty(0, fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


_LINKS = "a long, b long, key long, block long"


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key; a bucket over BLOCK rows passes through with block numbers instead."""
    held = [np.empty(0, np.int64) for _ in range(3)]
    spill_key, spilled = None, 0
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64())])

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), none, none], schema=out_schema)

    def overflow(key: int, fps: np.ndarray) -> pa.RecordBatch:
        nonlocal spilled
        blocks = (spilled + np.arange(len(fps))) // BLOCK
        spilled += len(fps)
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), key)), pa.array(blocks)], schema=out_schema)

    def done(key: np.ndarray, bit: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        """The links of complete buckets."""
        if not len(key):
            return None
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        exact = (key[starts] >> 32 & 127) % 33 == 32
        mixed = np.minimum.reduceat(bit, starts) != np.maximum.reduceat(bit, starts)
        use = (sizes > 1) & (exact | mixed)
        two = starts[use & (sizes == 2)]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_DISTANCE
        found_a, found_b = [a[near]], [b[near]]
        for s, n in zip(starts[use & (sizes > 2)].tolist(), sizes[use & (sizes > 2)].tolist(), strict=True):
            x, y = forest(fp[s : s + n].view(np.uint64))
            found_a.append(x.view(np.int64))
            found_b.append(y.view(np.int64))
        a = np.concatenate(found_a)
        return links(a, np.concatenate(found_b)) if len(a) else None

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        key, bit, fp = (np.concatenate([h, n]) for h, n in zip(held, new, strict=True))
        if spill_key is not None:  # the rest of a bucket that is too large
            n = int(np.searchsorted(key, spill_key, "right"))
            if n:
                yield overflow(spill_key, fp[:n])
            key, bit, fp = key[n:], bit[n:], fp[n:]
            if len(key):
                spill_key, spilled = None, 0
        if not len(key):
            held = [key, bit, fp]
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        got = done(key[:last], bit[:last], fp[:last])
        if got is not None:
            yield got
        key, bit, fp = key[last:], bit[last:], fp[last:]
        if len(key) > BLOCK:
            spill_key, spilled = int(key[0]), 0
            yield overflow(spill_key, fp)
            key, bit, fp = key[:0], bit[:0], fp[:0]
        held = [key, bit, fp]
    got = done(*held)
    if got is not None:
        yield got


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (key, one, two, fp) sorted by pair of blocks; holds one pair at a time."""

    def done(fps: np.ndarray) -> pa.RecordBatch:
        a, b = forest(np.unique(fps).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held, parts = None, []
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        fp = batch.column(3).to_numpy(zero_copy_only=False)
        if not len(fp):
            continue
        starts = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1, [len(fp)]])
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            now = tuple(key[s].tolist())
            if held is not None and now != held:
                yield done(np.concatenate(parts))
                parts = []
            held = now
            parts.append(fp[s:e])
    if parts:
        yield done(np.concatenate(parts))


def hot_segments(distinct: DataFrame) -> DataFrame:
    """(key): the index keys, exact and with wildcards, of segments that more than half a BLOCK of fingerprints share.

    A bucket with a wildcard joins two segments, so one of more than BLOCK entries holds such a segment.
    """
    halves = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(F.col("fp"), 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1))))
    counts = distinct.select(halves.alias("h")).groupBy("h.s", "h.v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // 2)
    # a segment's own index keys do not depend on the other segment
    return keep(counts.select(F.when(F.col("s") == 0, F.col("v")).otherwise(F.shiftleft("v", 32)).alias("fp"), "s"))


def _dealt(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries whose key is hot, once for each byte of the other segment, which becomes part of the key."""
    count = hot.count()
    keys = variants(hot.select("fp")).select("key").join(hot.select(F.col("s").alias("of")).distinct(), F.floor(F.shiftright("key", 32) / 33) == F.col("of"), "left_semi").distinct()
    keys = keys.select(F.col("key").alias("hot"))
    marked = entries.join(F.broadcast(keys) if count <= BROADCAST_SEGMENTS else keys, F.col("key") == F.col("hot"), "left")
    other = F.when(F.shiftright("key", 32) < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    cut = F.array(*(F.shiftleft((F.shiftrightunsigned(other, 8 * i).bitwiseAND(255) + (256 * (i + 1))).cast("long"), 39).bitwiseOR(F.col("key")) for i in range(4)))
    return marked.select(F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(cut)).alias("key"), "bit", "fp")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough verified links between distinct fingerprints to connect all that are linked."""
    # fingerprints are small and their index entries are not: without a fixed number of partitions AQE would
    # join the small ones, and few tasks would make all entries
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = variants(distinct.select("fp").repartition(parts, "fp"))
    hot = hot_segments(distinct)
    if not hot.isEmpty():
        entries = _dealt(entries, hot)
    found = keep(entries.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links, _LINKS))
    edges = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", "block", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    blocks = large.groupBy("key").agg(F.max("block").alias("most"))
    pairs = large.join(blocks, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("other"))
    # such a bucket has two blocks or more, so a block's inner pairs are covered by its pairs with others
    pairs = pairs.where("block <> other").select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "fp")
    more = pairs.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").select("key", "one", "two", "fp").mapInArrow(_block_links, "a long, b long")
    return edges.union(more)


def _components(distinct: DataFrame) -> DataFrame:
    """(fp, component) for every distinct fp; component is its smallest fp."""
    parts = connected_components(links(distinct.select("fp")))
    return distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest id reachable.

    Null and empty texts have no words, so fingerprint zero, and are linked like any other; a text of any length
    is hashed whole, in steps. Rows with equal ids or texts are each returned, and ties need no order. Null ids
    pass through and never become a component's id unless all of its ids are null. Other columns of docs, with
    whatever names, are not looked at. An empty table gives an empty result.
    """
    marked = keep(fingerprints(docs, id_col, text_col))
    joined = _components(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _keyed_fingerprints():
    def step(ids: list, one: list, two: list, texts: list) -> list[tuple]:
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()
        return list(zip(ids, one, two, values, strict=True))

    return step


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near-duplicates, with all its columns.

    It is the one with the smallest id; ids that are null come last, and rows that share an id are told apart by
    a hash of id and text. So rows that repeat an id with texts that are no near-duplicates all stay, each for
    its own component, and of rows that agree in id and text one stays. Null and empty texts are one component.
    Texts of any length count whole. Column names that the operator uses itself may occur in docs. An empty table
    gives an empty result. Whole rows are shuffled once, by that hash, after equal ones have met in each task.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # 128 bits tell apart all pairs of id and text; the id's own value is kept beside them for the order
    key = [F.xxhash64(F.lit(n), ident.isNull(), ident, text.isNull(), text).alias(name) for n, name in ((1, "one"), (2, "two"))]
    marked = keep(map_rows(docs.select(ident.cast("long").alias("id"), *key, text.alias("text")), ["id", "one", "two", "text"], _keyed_fingerprints, "id long, one long, two long, fp long"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "one", "two")
    joined = _components(marked.groupBy("fp").agg(F.min(first).alias("first")))
    kept = joined.groupBy("component").agg(F.min("first").alias("first")).select("first.one", "first.two")
    rows = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    once = rows.groupBy("one", "two").agg(F.first("row").alias("row"))
    return once.join(kept, ["one", "two"], "left_semi").select("row.*")
