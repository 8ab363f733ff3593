"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import discard, settle, shuffle_width

CHUNK_EDGES = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edges as stars around its components' least nodes."""
    root: dict[int, int] = {}
    edges = 0

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        rows = [(x, top(x)) for x in list(root)]
        rows = [(x, r) for x, r in rows if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        edges += batch.num_rows
        if edges >= CHUNK_EDGES:
            yield stars()
            root, edges = {}, 0
    yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (a, b); the label is the component's least node.

    Chunks of edges are contracted on their own first. Then large-star and small-star rounds, each a grouped minimum and
    a join back, halve path lengths, so rounds grow with the logarithm of what is left of a component's diameter. Minima
    are combined before the shuffle and settled before the join, whose larger side can then be split, so one node with
    many neighbours is no single task. Rounds end when count and hash of the edges stay. Self-loops are ignored.
    """
    loose = edges.where("a <> b").select("a", "b").repartition(shuffle_width(edges.sparkSession), "a", "b")
    edges, state = settle(loose.mapInArrow(_forest, "a long, b long").distinct()), None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != state:
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = settle(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, edges = edges, settle(small.select("e.a", "e.b").where("a <> b").distinct())
        discard(old, least, large, low)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
