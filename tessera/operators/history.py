"""What was asked and found before, as sums that can be put together: patterns of queries, important nodes, best paths.

A fact is one exploration: key (a normalised query), start, end, path, success, quality from 0 to 1, items (what helped), at (when). Facts become partial tables
by day; partial tables of batches, streams or folders are put together by the same grouping, in any order, so a stream gives what a batch over the same facts
gives. Days older than a time to live are left out of reports and can be dropped, as nothing in other days depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("patterns", "items", "nodes", "best")


def partials(facts: DataFrame) -> dict[str, DataFrame]:
    """The partial tables of some facts. Facts without a key count for nodes and paths alone, and those without a path for patterns alone; null qualities are 0."""
    own = facts.select("key", "start", "end", "path", "success", F.coalesce("quality", F.lit(0.0)).alias("quality"), "items", F.to_date("at").alias("day"))
    # sums of whole millionths, so that their order does not matter
    whole = lambda c: F.floor(c * 1_000_000 + 0.5)
    steps = own.where(F.size("path") > 0).select("day", F.explode("path").alias("node"), whole(F.col("quality") / F.size("path")).alias("w"))
    good = own.where(F.col("success") & (F.col("quality") > 0.5) & (F.size("path") > 0))
    return {
        "patterns": own.where("key is not null").groupBy("day", "key").agg(F.count("*").alias("n"), F.count(F.when(F.col("success"), 1)).alias("good"), F.sum(whole(F.col("quality"))).alias("quality")),
        "items": own.where("key is not null").select("day", "key", F.explode("items").alias("item")).groupBy("day", "key", "item").agg(F.count("*").alias("n")),
        "nodes": steps.groupBy("day", "node").agg(F.sum("w").alias("w"), F.count("*").alias("n")),
        "best": good.groupBy("day", "start", "end").agg(F.max_by("path", rank_of()).alias("path"), F.max("quality").alias("quality")),
    }


def rank_of() -> Column:
    """The better path: by quality, then fewer nodes, then the later in order of names."""
    return F.struct("quality", -F.size("path"), F.col("path"))


def record(facts: DataFrame, path: str, checkpoint: str):
    """A stream of facts as partial tables, batch by batch; a batch that comes again after a restart takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in partials(batch).items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}").drop("batch") for name in TABLES}


def together(tables: dict[str, DataFrame], since: Column | None = None) -> dict[str, DataFrame]:
    """All partial tables in one, without days; since leaves out what is older than a day."""
    own = {name: rows if since is None else rows.where(F.col("day") >= since) for name, rows in tables.items()}
    return {
        "patterns": own["patterns"].groupBy("key").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("quality").alias("quality")),
        "items": own["items"].groupBy("key", "item").agg(F.sum("n").alias("n")),
        "nodes": own["nodes"].groupBy("node").agg(F.sum("w").alias("w"), F.sum("n").alias("n")),
        "best": own["best"].groupBy("start", "end").agg(F.max_by("path", rank_of()).alias("path"), F.max("quality").alias("quality")),
    }


def patterns(tables: dict[str, DataFrame], least: int = 2, most: int = 5) -> DataFrame:
    """key, n, success_rate, mean_quality, items: each key, with what helped most if it was asked `least` times; tables come from `together`."""
    place = Window.partitionBy("key").orderBy(F.desc("n"), "item")
    top = tables["items"].withColumn("r", F.row_number().over(place)).where(F.col("r") <= most).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias("items"))
    rows = tables["patterns"].join(top, "key", "left")
    none = F.array().cast("array<string>")
    return rows.select("key", "n", F.round(F.col("good") / F.col("n"), 6).alias("success_rate"), F.round(F.col("quality") / F.col("n") / 1_000_000, 6).alias("mean_quality"), F.when(F.col("n") >= least, F.coalesce("items", none)).otherwise(none).alias("items"))


def importance(tables: dict[str, DataFrame]) -> DataFrame:
    """node, n, importance: quality over path length, summed, as a share of the largest sum; 0 if all are 0."""
    top = tables["nodes"].agg(F.max("w").alias("top"))  # one row
    return tables["nodes"].join(F.broadcast(top)).select("node", "n", F.when(F.col("top") > 0, F.floor(F.col("w") * 1_000_000 / F.col("top") + 0.5) / 1_000_000).otherwise(0.0).alias("importance"))


def adjusted(signs: DataFrame, nodes: DataFrame, high: float = 0.7, most: int = 5) -> DataFrame:
    """node, important, routes: signs (node, routes) by importance: whether a node's is above `high`, and its `most` routes to the most important nodes, ties by name."""
    rows = signs.select("node", F.explode_outer("routes").alias("route")).distinct().join(nodes.select(F.col("node").alias("route"), F.col("importance").alias("to")), "route", "left")
    place = Window.partitionBy("node").orderBy(F.desc(F.coalesce("to", F.lit(0.0))), "route")
    kept = rows.withColumn("r", F.row_number().over(place)).where(F.col("r") <= most).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("route").isNotNull(), F.struct("r", "route")))), lambda x: x["route"]).alias("routes"))
    return kept.join(nodes.select("node", "importance"), "node", "left").select("node", (F.coalesce("importance", F.lit(0.0)) > high).alias("important"), "routes")
