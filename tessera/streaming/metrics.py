"""An extension: search metrics as a stream, with event-time windows and a bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(facts: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, mean_value of each window; facts later than the watermark are left out of the state."""
    rows = facts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def sink(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows as Parquet, once; what is there is handled and the query ends."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def incremental_documents(stream: DataFrame, path: str, checkpoint: str):
    """Chunks of new or changed documents (document_id, text, version) replace those of the same document, batch by batch.

    Of several versions in a batch the latest counts; without a version column, the last text in order.
    """
    from tessera.sources.writers import replace_documents

    def index(batch: DataFrame, _: int) -> None:
        starts = F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(450)))
        latest = batch.groupBy("document_id").agg(F.max_by("text", F.struct("version", "text") if "version" in batch.columns else F.col("text")).alias("text"))
        replace_documents(latest.select("document_id", "text", starts.alias("start")).select("document_id", "start", F.substring("text", F.col("start") + 1, F.lit(500)).alias("chunk")), path)

    return stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
