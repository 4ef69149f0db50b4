"""Nearest vectors of a stated query set by a block matrix join: int8 product tiles with error bounds, exact cosines of what survives, heaps.

Queries and candidates are dealt to blocks of bounded size; each pair of blocks is a tile, and meets in a task of its own through an equi-join on
the tile's number. Vectors are scaled to length 1 and written as int8 codes with one scale each. The product of two code matrices (exact, as
floats hold these integers up to 2^24; longer vectors are multiplied in slices) gives approximate cosines, and what the codes leave out bounds the error:
with x = x' + e and y = y' + f, |x.y - x'.y'| <= |e||y| + |x'||f|. A candidate survives for a query if its upper bound reaches the k-th
best lower bound, or the k-th cosine of the query's heap. Survivors' cosines are computed anew from the original vectors in double precision and put
into the heap; heaps of the tiles are merged by query. Results are exact: recall is 1.

Of equal vectors only the k + 1 least ids can be among anyone's k nearest (one may be the query's own), so the others are left out before
anything is compared; this is a ranking that Spark cuts before its shuffle. Rows that share an id count once, with the least of their vectors. Rows
without id, and vectors that are null, zero or hold null or non-finite components take no part; vectors of different lengths are not compared. An
empty table has no results. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

SLICE = 1024  # 127 * 127 * 1024 < 2^24: sums of so many products are exact in single precision
TILE = 1024  # queries and candidates that are multiplied at once


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles): rows with an id and finite components that are not all zero, one for each id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than infinity
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes from -127 to 127 (as floats), a scale for each vector, and the length of what codes leave out of the vector scaled to length 1."""
    unit = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])  # no square overflows or vanishes
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    return codes.astype(np.float32), scales, np.sqrt(((unit - codes * scales[:, None]) ** 2).sum(axis=1)) + 1e-12


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Correctly rounded sums, so equal vectors have equal cosines wherever they stand."""
    x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (x, y))
    return fsum(x * y) / sqrt(fsum(x * x) * fsum(y * y))


def tile(heaps: list[list], query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> int:
    """Puts the k nearest of `vectors` into the queries' heaps of (cosine, -id); how many cosines were computed."""
    codes_q, scale_q, rest_q = quantised(queries)
    codes_v, scale_v, rest_v = quantised(vectors)
    about = np.zeros((len(queries), len(vectors)), np.float64)
    for at in range(0, queries.shape[1], SLICE):
        about += codes_q[:, at : at + SLICE] @ codes_v[:, at : at + SLICE].T
    about *= scale_q[:, None] * scale_v
    error = rest_q[:, None] + (1 + rest_q)[:, None] * rest_v + 1e-9
    own = query_ids[:, None] == ids
    lower, upper = np.where(own, -2, about - error), np.where(own, -2, about + error)
    least = np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -2.0)
    least = np.maximum(least, [heap[0][0] if len(heap) == k else -2 for heap in heaps])
    rows, columns = np.nonzero((upper >= least[:, None]) & ~own)
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        entry = cosine(queries[i], vectors[j]), -int(ids[j])
        if len(heaps[i]) < k:
            heapq.heappush(heaps[i], entry)
        elif entry > heaps[i][0]:
            heapq.heapreplace(heaps[i], entry)
    return len(rows)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("embedding").combine_chunks()
    return table.column("vec_id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def blocks(rows: DataFrame, size: int) -> int:
    """How many blocks of about `size` rows a staged table needs; at least 8, so that small tables are shared out too."""
    return max(8, -(-rows.count() // size))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = 32_768, block: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other vectors of each row of vectors (vec_id, embedding) that is_query holds for.

    Largest cosine first, ties by the smaller vec_id; all candidates if they are fewer. A task holds one block of queries and one of candidates;
    each query is copied once for each block of candidates and the other way round, and a tile passes on k rows for each of its queries at most.
    """
    own = stage(usable(vectors), "vectors")
    queries = own.where(is_query)
    place = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = stage(own.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).drop("place"), "candidates")
    n_queries, n_blocks = max(1, -(-queries.count() // query_block)), blocks(candidates, block)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "embedding", F.size("embedding").alias("length"), deal(n_queries).alias("q"), every(n_blocks).alias("c"))
    right = candidates.select("vec_id", "embedding", F.size("embedding").alias("length"), deal(n_blocks).alias("c"), every(n_queries).alias("q"))
    tiles = ["length", "q", "c"]

    def multiply(own_queries: pa.Table, own_candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if own_queries.num_rows and own_candidates.num_rows:
            (query_ids, x), (ids, y) = matrix(own_queries), matrix(own_candidates)
            for at in range(0, len(x), TILE):
                heaps: list[list] = [[] for _ in query_ids[at : at + TILE]]
                for to in range(0, len(y), TILE):
                    tile(heaps, query_ids[at : at + TILE], x[at : at + TILE], ids[to : to + TILE], y[to : to + TILE], k)
                out += [(int(q), -i, s) for q, heap in zip(query_ids[at : at + TILE], heaps, strict=True) for s, i in heap]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = left.groupBy(*tiles).cogroup(right.groupBy(*tiles)).applyInArrow(multiply, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Heaps of k for the queries of a partition."""
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = heaps.setdefault(q, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -i))
        rows = [(q, rank, -i, s) for q, heap in heaps.items() for rank, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition(8 * n_queries, "query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
