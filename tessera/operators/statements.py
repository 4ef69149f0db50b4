"""Relationships along statements: a statement without a source goes on from the last target before it, through nested bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(statements: DataFrame) -> DataFrame:
    """owner, place, src, dst, relation: the edges that statements (owner, place, kind, source, target) stand for, in order of place.

    place is an array of numbers, a statement's way through nested bodies, so that bodies are read where they stand. A statement whose source is missing takes the
    nearest target before it, or the nearest source if that is later; the first of an owner takes the owner itself. Statements without a target, and of kinds
    without a relation, give no edge but pass their ends on.
    """
    in_order = Window.partitionBy("owner").orderBy("place", "kind", "source", "target")
    before = F.last(F.coalesce("target", "source"), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    relation = F.when(F.col("kind").isin("then", "first", "succession"), "succession").when(F.col("kind") == "flow", "flow").when(F.col("kind") == "connect", "connected-to").when(F.col("kind") == "satisfy", "satisfied-by").when(F.col("kind") == "transition", "state-transition")
    rows = statements.withColumn("src", F.coalesce("source", before, F.col("owner").cast("string"))).withColumn("relation", relation)
    return rows.where("target is not null and relation is not null and src <> target").select("owner", "place", "src", F.col("target").alias("dst"), "relation")
