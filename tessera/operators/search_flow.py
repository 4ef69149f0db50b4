"""The whole of a hybrid search for a set of queries, in its fixed order: weights, fusion, graph, filter, re-ranking, diversity, context.

Everything after the two result lists works on top-k rows, so its windows are small; queries are spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import query_type, weights
from tessera.operators import fusion
from tessera.operators.graph import degrees, undirected


def fused(queries: DataFrame, vector: DataFrame, text: DataFrame, k: int = 60) -> DataFrame:
    """query, id, score: both lists (query, id, pos) by weighted reciprocal ranks; the first place of an id counts.

    Weights come from the kind of each query (query, text); a list that is empty for a query leaves all weight to the other.
    """
    wv, wt = weights(query_type(F.col("text")))
    asked = queries.select("query", wv.alias("wv"), wt.alias("wt"))
    first = lambda x, name: x.groupBy("query", "id").agg(F.min("pos").alias(name))
    both = first(vector, "v").join(first(text, "t"), ["query", "id"], "full").join(asked, "query")
    some = lambda c: F.max(F.col(c).isNotNull().cast("int")).over(Window.partitionBy("query")) == 1
    a = F.when(some("v") & some("t"), F.col("wv")).when(some("v"), 1.0).otherwise(0.0)
    b = F.when(some("v") & some("t"), F.col("wt")).when(some("t"), 1.0).otherwise(0.0)
    part = lambda w, c: w * F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return both.select("query", "id", (part(a, "v") + part(b, "t")).alias("score"))


def expanded(hits: DataFrame, edges: DataFrame, seeds: int, depth: int = 2, share: float = 0.5) -> DataFrame:
    """query, id, score, distance: hits and what lies within `depth` edges of a query's best `seeds` hits, in either direction.

    What is new gets the share of the query's best score that its distance leaves; distance is 0 for seeds and null for hits that no seed is near.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= seeds).select("query", "id", F.lit(0).alias("distance"))
    both, level = undirected(edges), near
    for d in range(1, depth + 1):
        level = level.join(both, level["id"] == both["src"]).select("query", F.col("dst").alias("id"), F.lit(d).alias("distance")).distinct()
        near = near.unionByName(level)
    near = near.groupBy("query", "id").agg(F.min("distance").alias("distance"))
    best = hits.groupBy("query").agg(F.max("score").alias("best"))
    rows = hits.join(near, ["query", "id"], "full").join(best, "query")
    return rows.select("query", "id", F.coalesce("score", share * F.col("best") / F.greatest("distance", F.lit(1))).alias("score"), "distance")


def searched(queries: DataFrame, vector: DataFrame, text: DataFrame, edges: DataFrame, docs: DataFrame, k: int, per_source: int | None = 2, seeds: int = 5, depth: int = 2, keep: Column | None = None, balance: float | None = 0.7, pool: int = 40) -> DataFrame:
    """query, rank, id, source, score: the k results of each query.

    docs has id, source, embedding and what `keep` (a filter on metadata) asks for. After fusion and expansion, scores are scaled by a query's best and raised by closeness
    to the seeds (0.3 / (1 + distance)) and by degree (0.2 of its share of the largest); the `pool` best are ordered by maximal marginal relevance, unless
    balance is None, and at most `per_source` of a source stay.
    """
    rows = expanded(fused(queries, vector, text), edges, seeds, depth)
    own = docs if keep is None else docs.where(keep)
    rows = rows.join(own.select("id", "source", "embedding"), "id").join(degrees(None, edges).select("id", "importance"), "id", "left")
    top = F.max("score").over(Window.partitionBy("query"))
    score = F.col("score") / top + F.coalesce(0.3 / (1 + F.col("distance")), F.lit(0.0)) + 0.2 * F.coalesce("importance", F.lit(0.0))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("step", F.row_number().over(order)).where(F.col("step") <= pool)
    if balance is not None:
        chosen = fusion.mmr(rows.select("query", "id", "score", F.col("embedding").cast("array<double>").alias("embedding")), pool, balance)
        rows = rows.drop("step").join(chosen, ["query", "id"])
    rows = rows.select("query", "id", "source", "score", "step")
    if per_source is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query", "source").orderBy("step"))).where(F.col("n") <= per_source).drop("n")
    place = F.row_number().over(Window.partitionBy("query").orderBy("step"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "id", "source", "score")
