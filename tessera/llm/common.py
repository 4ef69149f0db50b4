"""What several operators share: staged tables, row keys, size-checked broadcasts and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A table is broadcast up to this many rows and bytes, and is joined by a shuffle beyond either.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, only a local master gets a folder of its own; a cluster has to name one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a source for each file of a table that is derived from it.
FILE_BYTES = 4 << 20


def staged_bytes(df: DataFrame) -> int:
    """Bytes of the files of a staged table."""
    files = df.inputFiles()
    if not files:
        return 0
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def few_files(df: DataFrame, size: int, fewer: int = 1) -> DataFrame:
    """df, to be staged, in a partition for each FILE_BYTES of its source, which has `size` bytes, and two for each core at least.

    A shuffle's partitions are as many as the session says, however few rows there are; each would become a file. On a local file
    system Hadoop starts several processes for every file, each of which shares all pages of its executor until it runs chmod. A
    table that has few rows of its source is written in `fewer` times fewer partitions, one at least.
    """
    least = max(1, 2 * df.sparkSession.sparkContext.defaultParallelism // fewer)
    return df.coalesce(max(least, -(-size // (fewer * FILE_BYTES))))


#: Folders of staged tables that this driver has written and not removed.
STAGED: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables staged inside; results that were not written by then can no longer be read."""
    before = len(STAGED)
    try:
        yield
    finally:
        while len(STAGED) > before:
            remove(spark, STAGED.pop())


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has few enough rows, counted, and bytes, added up; as it is otherwise.

    Meant for staged tables, where a count reads only file footers. Bytes are those of the rows as JSON, and are counted only
    where a column has no fixed size.
    """
    if df.count() > rows:
        return df
    if any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) for f in df.schema):
        if df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).head()[0] > size:
            return df
    return F.broadcast(df)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Pass rows to Python in Arrow batches of at most this size in this session, unless it has a setting of its own already.

    A task holds a batch outside the heap, more than once while it grows; at Spark's 64 MB, executors of 3 GB had none left.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, size)


def give_back() -> None:
    """Return freed memory to the system; Arrow's pool and, where it can be told so, the C library keep it for themselves."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(f: Callable) -> Callable:
    """f, a generator of Arrow batches in a task, that gives back what it has freed.

    Arrow's memory pool kept 250 MB after the texts of one file, the C library keeps what all others free, and workers live on
    between tasks. Of 420 MB that a packing task held, 280 MB were such memory, so it goes back on the way as well.
    """

    def batches(*args):
        for n, out in enumerate(f(*args), 1):
            yield out
            if n % 4 == 0:
                give_back()
        give_back()

    return batches


def slices(batch: pa.RecordBatch, column: str, rows: int = 200, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows and bytes of a column of texts, about; a row is not cut."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right"))
        hi = max(lo + 1, min(lo + rows, most))
        yield batch.slice(lo, hi - lo)
        lo = hi


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; `lower` alone would change other letters as well."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Three columns that tell rows apart by id and text and are never null; equal rows have equal keys."""
    return [
        doc_id.isNull().alias("k_null"),
        F.coalesce(doc_id.cast("long"), F.lit(0)).alias("k_id"),
        F.xxhash64(text).alias("k_text"),
    ]


KEYS = ["k_null", "k_id", "k_text"]


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
