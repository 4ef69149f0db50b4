"""Simple paths between asked ends under a bound, with filters on relations, kinds of nodes and stop words, the best of them by quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import path_score
from tessera.operators.staging import rounds, staged


def best_paths(nodes: DataFrame, edges: DataFrame, asked: DataFrame, depth: int, most: int = 3, beam: int | None = 1000, relations: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None, stop: tuple[str, ...] = (), least_quality: float = 0.3) -> DataFrame:
    """start, end, rank, path, relations, quality: the `most` best paths of each asked pair (start, end), of at most `depth` edges and no node twice.

    nodes has id, type, importance; edges has src, dst, relation, weight. Only edges of some relations are followed, and only nodes of some kinds, that are no stop
    words and have two letters, are entered; a pair whose own ends are stop words has no path. Paths grow edge by edge and only into nodes from which
    the pair's end can still be reached in the edges left. Of the paths of one length from one start to one node, the `beam` best so far go on, so
    a level never holds more than beam paths for each start, end and node; with beam None all go on and results are exact. Ties are ordered by path, then relations.
    """
    stopped = lambda c: F.lower(c).isin(*[w.lower() for w in stop]) if stop else F.lit(False)
    with rounds(edges.sparkSession) as stage:
        own = edges.where(F.col("relation").isin(*relations)) if relations else edges
        entered = nodes.where(~stopped(F.col("id")) & (F.char_length("id") >= 2))
        entered = entered.where(F.col("type").isin(*kinds)) if kinds else entered
        steps = own.join(entered.select(F.col("id").alias("dst"), F.col("importance").alias("i")), "dst").where("src <> dst")
        steps = stage(steps.groupBy("src", "dst", "relation").agg(F.max("weight").alias("w"), F.max("i").alias("i")))
        pairs = stage(asked.select("start", "end").where(~stopped(F.col("start")) & ~stopped(F.col("end")) & (F.col("start") != F.col("end"))).distinct())
        # how many edges each end is away from a node, at most depth: what cannot arrive in time is not entered
        left = level = stage(pairs.select("end", F.col("end").alias("id"), F.lit(0).alias("away")).distinct())
        back = stage(steps.select("src", "dst").distinct())
        for k in range(1, depth + 1):
            met = level.join(back, level["id"] == back["dst"]).select("end", F.col("src").alias("id"), F.lit(k).alias("away")).distinct()
            level = stage(met.join(left.select("end", "id"), ["end", "id"], "left_anti"))
            if level.isEmpty():
                break
            left = left.unionByName(level)
        left = stage(left)
        importance = nodes.groupBy("id").agg(F.max("importance").alias("i"))
        front = pairs.join(importance.toDF("start", "i"), "start", "left")
        front = stage(front.select("start", "end", F.col("start").alias("at"), F.array("start").alias("path"), F.array().cast("array<string>").alias("relations"), F.array(F.coalesce("i", F.lit(0.0))).alias("importances"), F.array().cast("array<double>").alias("weights")))
        found = None
        for k in range(1, depth + 1):
            grown = front.join(steps, front["at"] == steps["src"]).where(~F.array_contains("path", F.col("dst")))
            grown = grown.join(left.toDF("end", "dst", "away"), ["end", "dst"]).where(F.col("away") <= depth - k)
            grown = grown.select("start", "end", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"), F.array_append("importances", F.col("i")).alias("importances"), F.array_append("weights", F.col("w")).alias("weights"))
            if beam is not None:
                order = Window.partitionBy("start", "end", "at").orderBy(F.desc(path_score(F.col("importances"), F.col("weights"))), "path", "relations")
                grown = grown.withColumn("n", F.row_number().over(order)).where(F.col("n") <= beam).drop("n")
            grown = stage(grown)
            arrived = grown.where(F.col("at") == F.col("end"))
            found = arrived if found is None else found.unionByName(arrived)
            front = grown.where(F.col("at") != F.col("end"))
            if front.isEmpty():
                break
        scored = found.select("start", "end", "path", "relations", F.round(path_score(F.col("importances"), F.col("weights")), 6).alias("quality")).where(F.col("quality") >= least_quality)
        place = Window.partitionBy("start", "end").orderBy(F.desc("quality"), "path", "relations")
        return staged(scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).select("start", "end", "rank", "path", "relations", "quality"))


def linked_concepts(edges: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """start, end, way, via, confidence, overall: how asked pairs (start, end) hang together, by an edge (1.0) or else by concepts between them.

    A concept between is next after the start and leads to the end in one or two edges, or is next after both, or is next after the end and leads back to the
    start; the `most` of the highest degree count, ties by name. It has 0.9 if two edges at most lead from the start to it and from it to the end, 0.6 if only one
    of both holds, else 0.3; overall is a pair's mean. Pairs with neither have no row.
    """
    with rounds(edges.sparkSession) as stage:
        succ = stage(edges.select("src", "dst").where("src <> dst").distinct())
        degree = stage(edges.select(F.explode(F.array("src", "dst")).alias("via")).groupBy("via").agg(F.count("*").alias("degree")))
        pairs = stage(asked.select("start", "end").where("start <> end").distinct())
        one = lambda a, b: succ.toDF(a, b)
        direct = pairs.join(one("start", "end"), ["start", "end"], "left_semi")
        rest = stage(pairs.join(direct, ["start", "end"], "left_anti"))
        after = stage(rest.join(one("start", "via"), "start"))
        common = after.join(one("end", "via"), ["end", "via"], "left_semi")
        leads = after.join(one("via", "end"), ["via", "end"], "left_semi")
        by_two = after.join(one("via", "mid"), "via").join(one("mid", "end"), ["mid", "end"], "left_semi")
        back = rest.join(one("end", "via"), "end").join(one("via", "start"), ["via", "start"], "left_semi")
        own = [x.select("start", "end", "via") for x in (common, leads, by_two, back)]
        bridges = own[0].unionByName(own[1]).unionByName(own[2]).unionByName(own[3]).where("via <> start and via <> end").distinct().join(degree, "via")
        order = Window.partitionBy("start", "end").orderBy(F.desc("degree"), "via")
        bridges = stage(bridges.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n", "degree"))

        def near(ends: DataFrame) -> DataFrame:
            """src, dst: those of ends that one or two edges join."""
            two = ends.join(one("src", "mid"), "src").join(one("mid", "dst"), ["mid", "dst"], "left_semi")
            return ends.join(succ, ["src", "dst"], "left_semi").unionByName(two.select("src", "dst")).distinct()

        to = near(bridges.select(F.col("start").alias("src"), F.col("via").alias("dst")).distinct()).select(F.col("src").alias("start"), F.col("dst").alias("via"), F.lit(1).alias("to"))
        fro = near(bridges.select(F.col("via").alias("src"), F.col("end").alias("dst")).distinct()).select(F.col("src").alias("via"), F.col("dst").alias("end"), F.lit(1).alias("fro"))
        rows = bridges.join(to, ["start", "via"], "left").join(fro, ["via", "end"], "left")
        n = F.coalesce("to", F.lit(0)) + F.coalesce("fro", F.lit(0))
        rows = rows.select("start", "end", F.lit("between").alias("way"), "via", F.when(n == 2, 0.9).when(n == 1, 0.6).otherwise(0.3).alias("confidence"))
        rows = rows.unionByName(direct.select("start", "end", F.lit("direct").alias("way"), F.lit(None).cast("string").alias("via"), F.lit(1.0).alias("confidence")))
        return staged(rows.withColumn("overall", F.round(F.avg("confidence").over(Window.partitionBy("start", "end")), 6)))
