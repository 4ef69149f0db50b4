"""Tables that change: chunks, graphs and their provenance, as Parquet in folders of what changes together.

Chunks are dealt to BUCKETS folders by a hash of their document, so that millions of documents do not make millions of folders. A
change rewrites only the folders of the documents or graphs it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.staging import staged


#: Folders of a table of chunks; a table keeps the number it was first written with.
BUCKETS = 64


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(buckets)).cast("int"))


def append(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """All of the rows or none, by the job's commit."""
    bucketed(rows, buckets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_documents(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Delete the documents that rows name, if present, and insert the rows; their folders are written anew."""
    spark, new = rows.sparkSession, staged(bucketed(rows, buckets))
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        old = spark.read.parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi")
        new = staged(new.unionByName(without(old, new, ["document_id"]), allowMissingColumns=True))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def deleted_documents(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> None:
    """Delete the documents that ids (document_id) name. A folder that loses all of its rows is removed."""
    old = spark.read.parquet(path)
    touched = [r[0] for r in bucketed(ids.select("document_id"), buckets).select("bucket").distinct().collect()]  # BUCKETS at most
    left = staged(without(old.where(F.col("bucket").isin(*touched)), ids, ["document_id"]))
    full = {r[0] for r in left.select("bucket").distinct().collect()}
    left.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in set(touched) - full:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def without(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The table without the rows whose keys are given."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def upserted(table: DataFrame, changes: DataFrame, on: list[str], version: str) -> DataFrame:
    """The latest row of each key of both tables; of equal versions a change's, and of several of these the first by all columns."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [F.to_json(F.struct(*(c for c in both.columns if c != "_new")))]
    latest = Window.partitionBy(*on).orderBy(F.desc(version), F.desc("_new"), *rest)
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, graph_id: str) -> tuple[int, int]:
    """Replace one graph in a catalogue of graphs; returns the numbers of nodes and edges that are there afterwards."""
    spark: SparkSession = nodes.sparkSession
    counts = []
    for name, rows in (("nodes", nodes), ("edges", edges)):
        own = rows.withColumn("graph_id", F.lit(graph_id))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(f"{path}/{name}")
        counts.append(spark.read.parquet(f"{path}/{name}").where(F.col("graph_id") == graph_id).count())
    return counts[0], counts[1]


def load_graph(spark: SparkSession, path: str, graph_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one graph; only its partitions are read."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("graph_id") == graph_id).drop("graph_id")
    return read("nodes"), read("edges")
