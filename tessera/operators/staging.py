"""Tables written between the rounds of an iteration: Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of local sessions that name none.
LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, only a local master gets a folder of its own, and a cluster has to name one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))).rstrip("/")


def written(rows: DataFrame) -> tuple[DataFrame, str]:
    path = f"{folder(rows.sparkSession)}/round-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def staged(rows: DataFrame) -> DataFrame:
    """rows, written and read again: short lineage, and nothing is computed anew if an executor is lost. The table stays, as lazy results read it."""
    return written(rows)[0]


@contextmanager
def rounds(spark: SparkSession) -> Iterator:
    """staged for tables that are of no more use at the end, when they are removed; what is to stay has to be staged before."""
    paths: list[str] = []

    def stage(rows: DataFrame) -> DataFrame:
        table, path = written(rows)
        paths.append(path)
        return table

    try:
        yield stage
    finally:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
