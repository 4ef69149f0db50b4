"""Strongly connected parts of a graph, nodes on cycles, and layers: rounds grow with the logarithm of a chain's or cycle's length.

Nodes with one successor lead on without a choice, so their ways are doubled: after k rounds each knows where 2^k steps lead. That ends at a node
with several successors, at a dead end, or never; then it is on a cycle of such nodes or leads into one. Only the nodes with several successors
go on, with an edge for each way between them; the same is done to the reversed graph, and so on in turn, until nothing changes. What is left
is dense, and is parted by the largest name that reaches each node. Chains that lead back into a part belong to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.staging import rounds, staged

Stage = Callable[[DataFrame], DataFrame]


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def labelled(edges: DataFrame, stage: Stage, stuck: bool = False) -> DataFrame:
    """id, part: the nodes of edges (src, dst; staged, distinct, without loops) that are in a part with others; part is some name of it."""
    degree = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    degree = stage(degree)
    n_edges = edges.count()
    if not n_edges:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("part"))
    ones = degree.where("n = 1").select(F.col("src").alias("id"), F.col("next").alias("at"))
    several = degree.where("n > 1").select(F.col("src").alias("id"))
    n_ones = ones.count()
    if not n_ones:
        inner = stage(edges.join(several.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        if inner.count() == n_edges:
            return dense(edges, stage) if stuck else labelled(stage(reversed_(edges)), stage, True)
        return labelled(stage(reversed_(inner)), stage)
    own = ones.select(F.col("id").alias("one"))
    way = stage(ones.join(own, F.col("at") == F.col("one"), "left").select("id", "at", F.least("id", "at").alias("least"), F.col("one").isNotNull().alias("goes_on")))
    jumps, steps = [], 1
    while (left := way.where("goes_on").count()) and steps <= n_ones:
        jumps.append(way.where("goes_on").select("id", "at"))
        then = way.select(F.col("id").alias("mid"), F.col("at").alias("far"), F.col("least").alias("low"), F.col("goes_on").alias("more"))
        way = stage(way.join(then, F.col("goes_on") & (F.col("at") == F.col("mid")), "left").select("id", F.coalesce("far", "at").alias("at"), F.least("least", "low").alias("least"), F.coalesce("more", F.lit(False)).alias("goes_on")))
        steps *= 2
    ended = way.where(~F.col("goes_on")).join(several.withColumnRenamed("id", "at"), "at", "left_semi").select("id", "at")
    endless = way.where("goes_on")
    rings = endless.join(endless.select(F.col("at").alias("id")).distinct(), "id", "left_semi").select("id", F.col("least").alias("part")) if left else None
    # ways between nodes with several successors; through: the first node of a chain on the way
    out = edges.join(several.toDF("src"), "src", "left_semi")
    direct = out.join(several.toDF("dst"), "dst", "left_semi").select("src", "dst", F.lit(None).cast(edges.schema["dst"].dataType).alias("through"))
    ways = stage(direct.unionByName(out.join(ended.toDF("dst", "end"), "dst").select("src", F.col("end").alias("dst"), F.col("dst").alias("through"))))
    inner = stage(ways.where("src <> dst").select("src", "dst").distinct())
    parts = labelled(stage(reversed_(inner)), stage) if inner.count() else inner.select(F.col("src").alias("id"), F.col("dst").alias("part"))
    parts = stage(parts)
    back = ways.where("through is not null").join(parts.toDF("src", "p"), "src", "left").join(parts.toDF("dst", "q"), "dst", "left")
    back = stage(back.where((F.col("src") == F.col("dst")) | (F.col("p") == F.col("q"))).select("through", "dst", F.coalesce("q", "dst").alias("part")))
    met = stage(back.select(F.col("through").alias("id")).distinct())
    for jump in jumps:  # from a chain's first node to all behind it
        met = stage(met.unionByName(jump.join(met, "id", "left_semi").select(F.col("at").alias("id"))).distinct())
    chains = met.join(ended, "id").join(back.select(F.col("dst").alias("at"), "part").distinct(), "at").select("id", "part")
    alone = back.select(F.col("dst").alias("id"), "part").join(parts, "id", "left_anti")
    found = parts.unionByName(chains).unionByName(alone.distinct())
    return found.unionByName(rings) if rings is not None else found


def dense(edges: DataFrame, stage: Stage) -> DataFrame:
    """labelled for a graph of nodes with several successors and predecessors: the largest name that reaches a node, and back within it."""
    found, left = None, edges
    while left.count():
        names = stage(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("name")))
        while True:
            come = left.join(names, left["src"] == names["id"]).groupBy(F.col("dst").alias("id")).agg(F.max("name").alias("other"))
            new = stage(names.join(come, "id", "left").select("id", F.greatest("name", "other").alias("name"), (F.col("other") > F.col("name")).alias("changed")))
            names = new.select("id", "name")
            if new.where("changed").isEmpty():
                break
        inside = stage(left.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("part")))
        seen = level = stage(names.where("id = name").select("id", F.col("name").alias("part")))
        while not level.isEmpty():
            next_ = inside.join(level.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "part").distinct()
            level = stage(next_.join(seen.select("id"), "id", "left_anti"))
            seen = seen.unionByName(level)
        seen = stage(seen)
        several = seen.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
        own = stage(seen.join(several, "part", "left_semi").select("id", "part"))
        found = own if found is None else found.unionByName(own)
        gone = seen.select("id")
        left = stage(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    return found if found is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("part"))


def parts(edges: DataFrame) -> DataFrame:
    """id, part: nodes of edges (src, dst) that lie on cycles with others, and the least name of their strongly connected part. Nulls are no nodes."""
    with rounds(edges.sparkSession) as stage:
        found = stage(labelled(stage(edges.where("src <> dst").select("src", "dst").distinct()), stage))
        names = found.groupBy("part").agg(F.min("id").alias("least"))
        return staged(found.join(names, "part").select("id", F.col("least").alias("part")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """id of nodes on cycles, those of one edge included."""
    return parts(edges).select("id").unionByName(edges.where("src = dst").select(F.col("src").alias("id"))).distinct()


def layers(edges: DataFrame) -> DataFrame:
    """id, layer: the most edges on a way that leads to a node; edges inside a strongly connected part count 0, so its nodes share a layer.

    Nodes are peeled off layer by layer, those without predecessors left first: as many rounds as there are layers.
    """
    own = parts(edges)
    with rounds(edges.sparkSession) as stage:
        short = lambda x, c: x.join(own.toDF(c, f"{c}_part"), c, "left").withColumn(c, F.coalesce(f"{c}_part", c)).drop(f"{c}_part")
        left = stage(short(short(edges.select("src", "dst"), "src"), "dst").where("src <> dst").distinct())
        ids = stage(edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct())
        waiting = stage(short(ids, "id").distinct())
        done, layer = None, 0
        while not waiting.isEmpty():
            first = stage(waiting.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(layer).alias("layer")))
            done = first if done is None else done.unionByName(first)
            left = stage(left.join(first.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
            waiting = stage(waiting.join(first.select("id"), "id", "left_anti"))
            layer += 1
        if done is None:
            return staged(ids.select("id", F.lit(0).alias("layer")))
        members = ids.join(own, "id", "left").select("id", F.coalesce("part", "id").alias("part"))
        return staged(members.join(done.toDF("part", "layer"), "part").select("id", "layer"))
