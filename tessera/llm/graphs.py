"""Connected components of an edge table, by local contraction and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released, stage

#: Edges that one task contracts in memory, about 100 MB.
TASK_EDGES = 400_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (a, b) of one task, a forest of stars: each node with the smallest node it reaches."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots; a root is the smallest node of its component.

    Tasks first contract a bounded number of edges each; what one task could hold is then done. Otherwise
    rounds follow that link every node to the smallest of its neighbours; they grow with the logarithm of the
    nodes. Minima combine before the shuffle, and no neighbourhood is gathered.
    """
    own = stage(edges.where("a != b").select("a", "b"), "edges")
    tasks = max(1, -(-own.count() // TASK_EDGES))
    pairs = stage(own.coalesce(tasks).mapInArrow(released(contract), "a long, b long"), "forests")
    before, done = None, own.coalesce(tasks).rdd.getNumPartitions() == 1
    while not done:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        done, before = now == before, now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
