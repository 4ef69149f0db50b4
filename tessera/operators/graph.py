"""Graphs as two tables: nodes (id, type) and edges (src, dst, relation).

Traversals go level by level: only the nodes that the last level found are joined with the edges, and those found before are left
out by an anti join, so each node is expanded once whatever the number of paths. Levels are staged as Parquet
and removed once the result is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import parts
from tessera.operators.staging import rounds, staged


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    both = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(both)).where("src <> dst").distinct()


def degrees(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """id, degree (in and out), centrality degree / (n - 1), importance degree / largest degree; 0 without edges.

    Without nodes, they are the ends of the edges.
    """
    rows = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    if nodes is not None:
        rows = nodes.select("id").join(rows, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    totals = rows.agg(F.count("*").alias("n"), F.max("degree").alias("top"))  # one row
    rows = rows.join(F.broadcast(totals))
    centrality = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("degree") / (F.col("n") - 1))
    return rows.select("id", "degree", centrality.alias("centrality"), F.when(F.col("top") > 0, F.col("degree") / F.col("top")).otherwise(0.0).alias("importance"))


def by_levels(steps: DataFrame, first: DataFrame, depth: int, grown: dict[str, Column]) -> DataFrame:
    """first (id and others), and what `depth` steps (src, dst and others) find anew from it.

    grown gives the other columns of a found node, as aggregates over all steps that lead to it from the level before.
    """
    with rounds(steps.sparkSession) as stage:
        steps = stage(steps)
        seen = level = stage(first)
        for _ in range(depth):
            met = level.join(steps, level["id"] == steps["src"]).groupBy(F.col("dst").alias("id")).agg(*[c.alias(n) for n, c in grown.items()] or [F.lit(1).alias("one")])
            level = stage(met.join(seen.select("id"), "id", "left_anti").select(*first.columns))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        return staged(seen)


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, distance: nodes within `depth` forward hops of any seed (id), with the least number of hops."""
    first = seeds.select("id", F.lit(0).alias("distance")).distinct()
    return by_levels(edges.select("src", "dst").distinct(), first, depth, {"distance": F.min("distance") + 1})


def shortest_paths(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """id, path (array): the shortest path from a node to each within depth; of several, the first in order of names."""
    first = edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path"))
    return by_levels(edges.select("src", "dst").distinct(), first, depth, {"path": F.min(F.concat("path", F.array("dst")))})


def neighbours(edges: DataFrame, node: Column, relations: tuple[str, ...]) -> DataFrame:
    """id, relation, direction: direct neighbours of a node by some relations, in both directions."""
    own = edges.where(F.col("relation").isin(*relations))
    out = own.where(F.col("src") == node).select(F.col("dst").alias("id"), "relation", F.lit("out").alias("direction"))
    return out.unionByName(own.where(F.col("dst") == node).select(F.col("src").alias("id"), "relation", F.lit("in").alias("direction")))


def common_neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id of nodes next to both a and b, in either direction: bridges between them."""
    both = undirected(edges.where(F.col("src").isin(a, b) | F.col("dst").isin(a, b))).where(F.col("src").isin(a, b))
    return both.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n")).where("n = 2").select("id")


def path_score(importances: Column, weights: Column) -> Column:
    """0.4 * mean importance + 0.4 * mean relation weight + 0.2 / (1 + 0.1 * (nodes - 2))."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    return 0.4 * mean(importances) + 0.4 * mean(weights) + 0.2 / (1 + 0.1 * F.greatest(F.size(importances) - 2, F.lit(0)))


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """only_a, only_b, shared and their difference rate, of the distinct keys of two tables."""
    x = a.select(*keys).distinct().withColumn("in_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, keys, "full").select(F.coalesce("in_a", F.lit(0)).alias("a"), F.coalesce("in_b", F.lit(0)).alias("b"))
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    counts = both.agg(n(F.col("b") == 0).alias("only_a"), n(F.col("a") == 0).alias("only_b"), n(F.col("a") + F.col("b") == 2).alias("shared"), F.count("*").alias("n"))
    return counts.select("only_a", "only_b", "shared", F.when(F.col("n") > 0, (F.col("only_a") + F.col("only_b")) / F.col("n")).otherwise(0.0).alias("difference_rate"))


def union_first(*graphs: DataFrame) -> DataFrame:
    """src, dst, relation of several graphs; the first graph's edge wins for each pair."""
    rows = graphs[0].withColumn("graph", F.lit(0))
    for k, g in enumerate(graphs[1:], 1):
        rows = rows.unionByName(g.withColumn("graph", F.lit(k)))
    return rows.groupBy("src", "dst").agg(F.min(F.struct("graph", "relation")).alias("m")).select("src", "dst", F.col("m.relation").alias("relation"))


def merged(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """edges with both ends renamed by canonical (alias, name), without loops and repeats."""
    names = canonical.select("alias", "name")
    rows = edges.join(names.toDF("src", "new_src"), "src", "left").join(names.toDF("dst", "new_dst"), "dst", "left")
    rows = rows.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "relation")
    return rows.where("src <> dst").distinct()


def impact(edges: DataFrame, directions: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, distance, kinds: elements that a change of the seeds reaches, by the direction of each kind of edge."""
    typed = edges.join(directions, "relation")
    forward = typed.where("direction <> 'reverse'").select("src", "dst", "relation")
    reverse = typed.where("direction <> 'forward'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    steps = forward.unionByName(reverse)
    first = seeds.select("id", F.lit(0).alias("distance"), F.array().cast("array<string>").alias("kinds")).distinct()
    grown = {"distance": F.min("distance") + 1, "kinds": F.array_sort(F.collect_set("relation"))}  # as many as there are kinds
    return by_levels(steps, first, depth, grown).where("distance > 0")


def band_pairs(rows: DataFrame, group: str, item: str, place: str, width: int, least: int) -> DataFrame:
    """a, b, n: pairs of items that stand within `width` places of each other in a group, at least `least` times.

    The band join is an equi-join on blocks of `width` places: each row meets its own block and the next one.
    """
    own = rows.select(group, F.col(item).alias("item"), F.col(place).alias("place"), F.floor(F.col(place) / width).alias("block"))
    right = own.select(group, F.col("item").alias("item2"), F.col("place").alias("place2"), F.explode(F.array("block", F.col("block") - 1, F.col("block") + 1)).alias("block"))
    met = own.join(right, [group, "block"]).where((F.col("item") < F.col("item2")) & (F.abs(F.col("place") - F.col("place2")) <= width))
    return met.groupBy(F.col("item").alias("a"), F.col("item2").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_per_pair(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each (src, dst): the first in the given order, as later relations of a pair are lost."""
    w = Window.partitionBy("src", "dst").orderBy(*order)
    return edges.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def first_items(rows: DataFrame, group: str, item: str, order: list[str], most: int, name: str) -> DataFrame:
    """group, name: the first `most` items of each group in an order, as an array; the rest is cut before it is gathered."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = rows.withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item]).alias(name))


def guarded(edges: DataFrame, nodes: DataFrame, allowed: tuple[str, ...], stop: tuple[str, ...], acyclic: tuple[str, ...] = ("part-of", "is-a")) -> DataFrame:
    """The edges whose ends are nodes (id) and no stop words, whose relation is allowed, and that leave hierarchies without cycles.

    Relations that make a hierarchy lose the edges that close a cycle: those inside a strongly connected part whose source is not the
    smaller name, as an order of names has no cycle. The result does not depend on the order in which edges come.
    """
    ids = nodes.select("id").where(~F.lower("id").isin(*stop)).distinct()
    kept = edges.where(F.col("relation").isin(*allowed)).join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst", "relation")
    if not acyclic:
        return kept
    tree = staged(kept.where(F.col("relation").isin(*acyclic)))
    part = parts(tree)
    both = tree.join(part.toDF("src", "p"), "src", "left").join(part.toDF("dst", "q"), "dst", "left").where("src = dst or (p = q and src > dst)").select("src", "dst", "relation")
    return kept.join(both, ["src", "dst", "relation"], "left_anti")
