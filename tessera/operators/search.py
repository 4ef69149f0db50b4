"""Vector search over an array column.

`neighbours` is exact: all queries meet all rows, as blocks of matrices in tasks. Products of unit vectors in single precision, with a bound on their error, leave
out what cannot be among a query's k nearest; what is left gets the cosine that `functions.vectors.cosine` has, in double precision and the same order of sums, and
is ranked by it as it is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine

ROWS, QUERIES, PAIRS = 4096, 512, 1 << 19  # rows and queries that are multiplied at once, and pairs that are compared exactly at once


def top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows most like the one vector of query (q), with their cosine; TakeOrdered, so no shuffle of the table."""
    scored = vectors.join(F.broadcast(query.limit(1))).withColumn("cosine", F.round(cosine(F.col("embedding"), F.col("q")), 6))
    return scored.drop("q").orderBy(F.desc("cosine"), "vec_id").limit(k)


def matrices(ids: np.ndarray, vectors: pa.Array) -> dict[int, tuple]:
    """length: ids, vectors, their norms, and unit vectors in single precision, which are zero where `regular` (the last) is not.

    Length 0 has the ids of vectors whose cosine with any other is 0: null, empty, or with a null component.
    """
    lengths = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    if flat.null_count:
        gaps = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=flat.is_null().to_numpy(zero_copy_only=False), minlength=len(lengths)) > 0
        lengths[gaps] = 0
        vectors = pc.if_else(pa.array(gaps), pa.scalar(None, vectors.type), vectors)
    out = {}
    for n in np.unique(lengths).tolist():
        own = lengths == n
        if n == 0:
            out[0] = (ids[own],)
            continue
        x = pc.list_flatten(vectors.filter(pa.array(own))).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, n)
        with np.errstate(all="ignore"):
            norms = np.zeros(len(x))
            for d in range(n):
                norms += x[:, d] * x[:, d]
            norms = np.sqrt(norms)
            regular = (norms > 1e-100) & (norms < 1e100)
            unit = np.where(regular[:, None], x / np.where(regular, norms, 1)[:, None], 0).astype(np.float32)
        out[n] = ids[own], x, norms, unit, regular
    return out


def rounded(value: np.ndarray) -> np.ndarray:
    """To six places as Spark rounds, halves away from zero, for ranking: not a number is above all."""
    large = np.abs(value) * 1e6
    out = np.copysign(np.floor(large + 0.5) / 1e6, value)
    for i in np.flatnonzero(np.abs(large - np.floor(large) - 0.5) < 1e-7).tolist():
        out[i] = float(Decimal(repr(float(value[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.where(np.isnan(out), np.inf, out)


class Best:
    """The k best rows of each query: largest rounded cosine first, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.key, self.id, self.value = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k))

    def add(self, query: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        key = rounded(value)
        some = key >= self.key[query, -1]
        query, ids, value, key = query[some], ids[some], value[some], key[some]
        touched = np.unique(query)
        every = np.concatenate([np.repeat(touched, self.k), query])
        keys, all_ids, values = (np.concatenate([a[touched].ravel(), b]) for a, b in ((self.key, key), (self.id, ids), (self.value, value)))
        order = np.lexsort((all_ids, -keys, every))
        every = every[order]
        place = np.arange(len(every)) - np.searchsorted(every, every)
        kept = order[place < self.k]
        at = every[place < self.k], place[place < self.k]
        self.key[at], self.id[at], self.value[at] = keys[kept], all_ids[kept], values[kept]


def compare(best: Best, at: np.ndarray, queries: tuple, rows: tuple) -> None:
    """Puts rows into the best of queries of the same length, which have the places `at` there."""
    query_ids, x, norms, unit, regular = queries
    ids, y, row_norms, row_unit, row_regular = rows
    error = 1.1 * (x.shape[1] + 8) * 2.0**-24 + 1e-9
    like = unit @ row_unit.T
    order = np.argsort(ids, kind="stable")
    first, last = np.searchsorted(ids[order], query_ids, "left"), np.searchsorted(ids[order], query_ids, "right")
    own = [(i, order[first[i] : last[i]]) for i in np.flatnonzero(first < last).tolist()]
    for i, same in own:
        like[i, same] = -3
    like[:, ~row_regular] = -3
    least = best.key[at, -1] - 0.5e-6 - error  # what is rounded to as much as the k-th
    few = np.flatnonzero((least == -np.inf) & regular)
    if len(few) and len(ids) > best.k:
        kth = np.partition(like[few], -best.k, axis=1)[:, -best.k].astype(np.float64)
        least[few] = np.where(kth > -2, kth - 1e-6 - 2 * error, -np.inf)
    like[:, ~row_regular], like[~regular] = 3, 3
    for i, same in own:
        like[i, same] = -np.inf
    least = np.clip(np.where(np.isinf(least), -3, least) - 1e-6, -3, 2).astype(np.float32)  # lower by more than a float's precision
    i, j = np.divmod(np.flatnonzero(like >= least[:, None]), len(ids))
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        with np.errstate(all="ignore"):
            dot = np.zeros(len(a))
            for d in range(x.shape[1]):
                dot += x[a, d] * y[b, d]
            both = norms[a] * row_norms[b]
            value = np.where((both > 0) | np.isnan(both), dot / both, 0.0)
        best.add(at[a], ids[b], value)


def zeros(best: Best, at: np.ndarray, query_ids: np.ndarray, ids: np.ndarray) -> None:
    """Puts rows whose cosine with these queries is 0 into their best; only the least ids can be there."""
    ids = np.sort(ids)
    ids = ids[ids <= np.unique(ids)[: best.k + 1][-1]]
    need = np.flatnonzero(best.key[at, -1] <= 0)
    step = max(1, PAIRS // len(ids))
    for lo in range(0, len(need), step):
        a, b = np.repeat(need[lo : lo + step], len(ids)), np.tile(ids, len(need[lo : lo + step]))
        other = query_ids[a] != b
        best.add(at[a[other]], b[other], np.zeros(int(other.sum())))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """query, vec_id, cosine, rank: the k nearest rows of each vector of a stated query set (query, q).

    The query set is sent to the tasks in blocks of at most about `block` vectors, which bounds their memory and the driver's; for each block vectors are read once,
    and each task passes on k rows for each query. The work is all pairs of queries and rows.
    """
    spark = vectors.sparkSession
    kinds = [queries.schema["query"].dataType, vectors.schema["vec_id"].dataType]
    queries = queries.select(F.col("query").cast("long").alias("query"), "q").where("query is not null")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").coalesce(4 * spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-queries.count() // block))
    deal = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")

    def scan(part: DataFrame) -> DataFrame:
        asked = part.toArrow().combine_chunks()  # a block of the query set
        stated = spark.sparkContext.broadcast((asked.column("query").to_numpy(), asked.column("q").combine_chunks()))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = stated.value
            groups, start, best = [], 0, Best(len(ids), k)
            for n, group in matrices(ids, q).items():
                for lo in range(0, len(group[0]), QUERIES):
                    tile = tuple(c[lo : lo + QUERIES] for c in group)
                    groups.append((n, np.arange(start, start + len(tile[0])), tile))
                    start += len(tile[0])
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(lo, ROWS)
                    found = matrices(rows.column("vec_id").to_numpy(), rows.column("embedding"))
                    for n, at, tile in groups:
                        if n and n in found:
                            compare(best, at, tile, found[n])
                        apart = [x[0] for m, x in found.items() if m != n or n == 0]
                        if apart:
                            zeros(best, at, tile[0], np.concatenate(apart))
            for _, at, tile in groups:
                i, place = np.nonzero(best.key[at] > -np.inf)
                columns = tile[0][i], best.id[at[i], place], best.value[at[i], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "vec_id", "cosine"])

        return own.mapInArrow(nearest, "query long, vec_id long, cosine double")

    pairs = reduce(DataFrame.unionByName, (scan(queries.where(deal == b)) for b in range(blocks)))
    pairs = pairs.select(F.col("query").cast(kinds[0]).alias("query"), F.col("vec_id").cast(kinds[1]).alias("vec_id"), F.round("cosine", 6).alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
