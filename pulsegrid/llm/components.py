"""Connected components of an edge table, with neither edges nor components on the driver.

Rounds of large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) turn the edges into one star for each component, centred on its smallest node. Each
round is two aggregations and two equality joins; the result of a round is a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import keep, ship

MAX_ROUNDS = 60
#: Edges that a task contracts at once, which bounds its memory.
CONTRACT_EDGES = 400_000


def contract(edges: DataFrame) -> DataFrame:
    """Replaces the edges (a, b) of a task by stars (node, smallest node), in bounded portions.

    Components stay the same, while repeated edges and cycles within a portion vanish before any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CONTRACT_EDGES:
                yield _stars(held)
                held, rows = [], 0
        if rows:
            yield _stars(held)

    ship(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
    b = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = smallest(len(nodes), ends[: len(a)], ends[len(a) :])
    moved = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 reaches along the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long); component: its smallest node.

    Self loops, repeated edges and either direction may occur. An empty table gives an empty one. Rows
    with a null end are no edges. The number of rounds grows with the logarithm of the longest chain.
    """
    stars = keep(contract(edges.where("a is not null and b is not null and a <> b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        # all edges, told by their number and 128 bits that do not depend on their order
        found = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))).first()
        if found == before or not found[0]:
            break
        before = found
        stars = keep(_small_star(_large_star(stars)))
    else:
        raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
    centres = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres.select("node", F.col("node").alias("component")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the node's smallest neighbour, or itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.where("b > a").join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them; edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b"))).distinct()
