"""Shapes of static checks: each takes tables and gives issues (rule, severity, node, message).

What cannot be decided is never reported: a reference into an opaque scope is neither found nor missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.staging import staged


def issues(rows: DataFrame, rule: str, severity: str, node: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), node.cast("string").alias("node"), message.alias("message"))


def missing_reference(rows: DataFrame, reference: str, registry: DataFrame, key: str, rule: str, node: str, opaque: Column | None = None) -> DataFrame:
    """Rows whose reference is set, decidable and not in the registry."""
    own = rows.where(F.col(reference).isNotNull() & (~opaque if opaque is not None else F.lit(True)))
    gone = own.join(registry.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")
    return issues(gone, rule, "error", F.col(node), F.concat(F.lit("unknown reference "), F.col(reference).cast("string")))


def second_and_later(rows: DataFrame, parent: str, order: list[str], rule: str, node: Column) -> DataFrame:
    """Every member of a parent after the first, where one is allowed."""
    later = rows.withColumn("n", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where("n > 1")
    return issues(later, rule, "error", node, F.concat(F.lit("member number "), F.col("n").cast("string")))


def wrong_parent(rows: DataFrame, parent_kind: Column, allowed: tuple[str, ...], rule: str, node: Column) -> DataFrame:
    """Rows whose parent is of no allowed kind; rows without a parent are roots and pass."""
    bad = rows.where(parent_kind.isNotNull() & ~parent_kind.isin(*allowed))
    return issues(bad, rule, "error", node, F.concat(F.lit("parent is "), parent_kind))


def inheritance_cycles(bases: DataFrame, rule: str) -> DataFrame:
    """Nodes of bases (node, base; one base each) on a cycle of any length, and nodes whose bases lead into one.

    Steps are doubled: base becomes the base of the base, staged each round, until they outnumber the nodes. A walk
    that has not ended by then never ends, and stands on a cycle.
    """
    at = staged(bases.select("node", F.col("base").alias("at")))
    steps, nodes = 1, at.count()
    while steps <= nodes:
        at = staged(at.join(at.toDF("at", "next"), "at").select("node", F.col("next").alias("at")))
        steps *= 2
    on = at.select(F.col("at").alias("node"), F.lit(True).alias("on")).distinct()
    message = F.when(F.col("on"), "inheritance cycle").otherwise("leads into an inheritance cycle")
    return issues(at.select("node").join(on, "node", "left"), rule, "warning", F.col("node"), message)


def resolve(references: DataFrame, registries: list[DataFrame], last_part: bool = True) -> DataFrame:
    """ref, target, registry: the first registry (name, target) with one match decides; several there are ambiguous.

    registry is null and status 'missing' where none matches; a name's last :: part is tried after the whole.
    """
    found = None
    for k, r in enumerate(registries):
        own = r.groupBy("name").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n"))
        forms = [F.struct(F.lit(2 * k).alias("p"), F.col("ref").alias("name"))]
        if last_part:
            forms.append(F.struct(F.lit(2 * k + 1).alias("p"), F.element_at(F.split("ref", "::"), -1).alias("name")))
        hits = references.select("ref", F.inline(F.array(*forms))).join(own, "name").select("ref", F.struct("p", "target", "n").alias("m"), F.lit(k).alias("registry"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("ref").agg(F.min(F.struct("m", "registry")).alias("b"))
    rows = references.select("ref").distinct().join(best, "ref", "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.m.n") > 1, "ambiguous").otherwise("resolved")
    return rows.select("ref", F.when(status == "resolved", F.col("b.m.target")).alias("target"), status.alias("status"))
