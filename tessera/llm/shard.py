"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets by a seeded hash of id and text; there are as many buckets, and as many
partitions of the shuffle, as it takes for each to fit in a task's memory. Pass two puts each bucket in a fixed order, so that a
lost task repeats itself exactly, and shuffles it with Fisher-Yates. A record's place in the whole order is the
number of records in earlier buckets plus its place in its own; places are dealt to shards in turn, which
makes shard sizes at most one row apart and slots gapless.

Copies of one text have different ids and scatter like all else; rows without id are scattered by their number in the input as
well. The shuffled buckets are written before they are counted, so that counts and rows cannot differ. The counts
are added up in two steps: within runs of RUN buckets by a window, and over the runs on
the driver, which sees a number for every RUN buckets (about 32 GB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, small, stage

#: Bytes added to a record's text for the rest of it.
OVERHEAD = 16
#: Buckets whose rows are added up by one window.
RUN = 1024


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of range(n): position i is swapped with a random position of those up to i."""
    order, draws = list(range(n)), np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def offsets(counts: DataFrame, run: int) -> DataFrame:
    """sh_bucket, sh_offset of counts (sh_bucket, n): the rows in all buckets before each."""
    counts = stage(counts.withColumn("run", F.floor(F.col("sh_bucket") / run)), "bucket-counts")
    before, starts = 0, []
    for r, n in sorted(map(tuple, counts.groupBy("run").agg(F.sum("n")).collect())):
        starts.append((r, before))
        before += n
    starts = counts.sparkSession.createDataFrame(starts, "run long, start long")  # a row for each run of buckets
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("sh_bucket")) - F.col("n")
    own = counts.withColumn("inside", inside).join(small(starts), "run")
    return small(stage(own.select("sh_bucket", (F.col("start") + F.col("inside")).alias("sh_offset")), "bucket-offsets"))


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 32 << 20, run: int = RUN) -> DataFrame:
    """docs with all its columns, plus sh_size, sh_crc32, sh_shard and sh_slot.

    Null texts have no bytes; rows that are equal in id and text are interchangeable and stay separate rows; an empty table
    stays empty. If docs has a column of one of these names, it stays and the new one gets an underscore more.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    names = ["sh_size", "sh_crc32", "sh_shard", "sh_slot"]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long") + OVERHEAD), F.lit(0))).head()[0]
    buckets = max(1, -(-total // bucket_bytes))
    salt = F.when(docs["doc_id"].isNull(), F.monotonically_increasing_id())
    keyed = docs.select(
        F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("sh_size"), F.crc32(text.cast("binary")).alias("sh_crc32"),
        F.pmod(F.xxhash64(F.lit(seed), docs["doc_id"], text, salt), F.lit(buckets)).cast("long").alias("sh_bucket"),
    )
    schema = T.StructType([*(f for f in keyed.schema if f.name != "doc_id"), T.StructField("place", T.LongType())])

    def deal(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("sh_crc32", "ascending"), ("sh_size", "ascending")]))
        table = table.take(pa.array(fisher_yates(table.num_rows, [seed, table.column("sh_bucket")[0].as_py()])))
        return table.append_column("place", pa.array(np.arange(table.num_rows))).select(schema.names)

    dealt = stage(keyed.repartition(buckets, "sh_bucket").groupBy("sh_bucket").applyInArrow(deal, schema), "buckets")
    dealt = dealt.join(offsets(dealt.groupBy("sh_bucket").agg(F.count("*").alias("n")), run), "sh_bucket").withColumn("place", F.col("place") + F.col("sh_offset"))
    dealt = dealt.withColumns({"sh_shard": (F.col("place") % shards).cast("int"), "sh_slot": F.expr(f"place div {int(shards)}")})
    return dealt.select(*(F.col(f"row.`{n}`") for n in docs.columns), *(F.col(n).alias(free_name(docs, n)) for n in names))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled records as Parquet, a folder for each shard; rows carry their slot."""
    shuffled(docs, **options).write.partitionBy("sh_shard").parquet(path)
