"""An approximate index of vectors: an inverted file of cells with product-quantised residuals, searched by probing cells.

`fit` learns cells and codebooks from a bounded sample; every row is then assigned to its nearest cell and coded. The index is a table of
Parquet files in a folder for each cell, so a search reads the cells that its queries probe. Queries and cells meet in an equi-join on cell and
part, a part being a bounded share of a cell; each part keeps its best candidates by coded distance for each query, and the best of all parts are ranked
again by exact cosine. Rows are added by appending; deleting rewrites only the cells that hold what is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators.staging import staged


@dataclass
class Codebooks:
    """cells: centroids; books: for each slice of the dimensions, the centroids of what the cells leave over."""

    cells: np.ndarray
    books: np.ndarray

    def units(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]

    def slices(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.books), -1).transpose(1, 0, 2)

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the codes of each vector."""
        x = self.units(vectors)
        cell = nearest(x, self.cells)
        return cell, np.stack([nearest(part, book) for part, book in zip(self.slices(x - self.cells[cell]), self.books, strict=True)], axis=1).astype(np.uint8)

    def about(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """The query's approximate products with coded vectors of a cell, by one table of products for each slice."""
        tables = np.einsum("skd,sd->sk", self.books, self.slices(query[None])[:, 0])
        return query @ self.cells[cell] + tables[np.arange(len(self.books)), codes].sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """k centroids; one that loses all of its rows is put on a row drawn anew."""
    own = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, own)
        n = np.bincount(at, minlength=k)
        own = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        own[n == 0] = x[random.choice(len(x), int((n == 0).sum()))]
    return own


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of rows that have both and whose components are finite and not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def fit(vectors: DataFrame, cells: int = 32, slices: int = 16, max_sample: int = 20_000, rounds: int = 12, seed: int = 1) -> Codebooks:
    """Learned from at most max_sample rows, those with the smallest hashes of their ids; slices must divide the dimensions."""
    sample = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toArrow()
    if not sample.num_rows:
        raise ValueError("no usable vector to learn from")
    x = sample.column("embedding").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    random = np.random.default_rng(seed)
    centroids = k_means(x, cells, rounds, random)
    rest = (x - centroids[nearest(x, centroids)]).reshape(len(x), slices, -1).transpose(1, 0, 2)
    return Codebooks(centroids, np.stack([k_means(part, 256, rounds, random) for part in rest]))


def assigned(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, embedding, codes, cell of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell, codes = books.coded(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], names=["vec_id", "embedding", "codes", "cell"])

    return usable(vectors).mapInArrow(run, "vec_id long, embedding array<double>, codes binary, cell int")


def add(vectors: DataFrame, books: Codebooks, path: str) -> None:
    """Code every row and append it to the cells' folders; rows of one cell are dealt to several files."""
    own = assigned(vectors, books).withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    own.repartition("cell", "deal").drop("deal").write.mode("append").partitionBy("cell").parquet(path)


def delete(spark: SparkSession, ids: DataFrame, path: str) -> None:
    """Take the rows that ids (vec_id) name out of the index. A cell that loses all of its rows keeps no folder."""
    index = spark.read.parquet(path)
    gone = ids.select("vec_id").distinct()
    touched = [r[0] for r in index.select("vec_id", "cell").join(gone, "vec_id", "left_semi").select("cell").distinct().collect()]  # as many as there are cells
    left = staged(index.where(F.col("cell").isin(touched)).join(gone, "vec_id", "left_anti"))
    full = {r[0] for r in left.select("cell").distinct().collect()}
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)
    for cell in set(touched) - full:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cell={cell}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def search(index: DataFrame, queries: DataFrame, books: Codebooks, k: int, probes: int, rerank: int = 100, part_rows: int = 100_000) -> DataFrame:
    """query, vec_id, cosine, rank: about the k nearest of each query (query, q) out of the cells nearest to it, itself apart.

    index is the table that `add` wrote. The best `rerank` candidates of all cells by coded product are ranked by exact cosine, ties by vec_id.
    """
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = books.units(batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1))
                cells = np.argsort(-x @ books.cells.T, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(at)), pa.array([*x[at]], pa.list_(pa.float64())), pa.array(cells.ravel(), pa.int32())], names=["query", "q", "cell"])

    asked = usable(queries.select(F.col("query").alias("vec_id"), F.col("q").alias("embedding"))).toDF("query", "q")
    probed = asked.mapInArrow(probe, "query long, q array<double>, cell int").join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    rows = index.select("vec_id", "codes", "cell").join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def scan(own: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if own.num_rows and candidates.num_rows:
            ids = candidates.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(candidates.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            cell = own.column("cell")[0].as_py()
            for query, q in zip(own.column("query").to_pylist(), own.column("q").to_pylist(), strict=True):
                about = np.where(ids == query, -np.inf, books.about(np.array(q), cell, codes))
                best = np.argpartition(-about, min(rerank, len(ids)) - 1)[:rerank]
                best = best[np.isfinite(about[best])]
                found.append((np.full(len(best), query), ids[best], about[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "vec_id", "about"])

    keys = ["cell", "part"]
    met = probed.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(scan, "query long, vec_id long, about double")
    first = Window.partitionBy("query").orderBy(F.desc("about"), "vec_id")
    kept = met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rerank).select("query", "vec_id")
    exact = kept.join(index.select("vec_id", "embedding"), "vec_id").join(asked, "query")
    exact = exact.select("query", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
