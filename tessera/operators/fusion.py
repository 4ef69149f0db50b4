"""Fusion of two ranked lists, and what follows it: caps, windows and re-ranking.

Lists are top-k results: their windows run over k rows, never over a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """hits(id, ...) with their arrival order, first occurrence of an id only."""
    w = Window.orderBy(*order)
    first = Window.partitionBy("id").orderBy("pos")
    rows = hits.withColumn("pos", F.row_number().over(w)).withColumn("again", F.row_number().over(first)).where("again = 1").drop("again")
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("pos")))


def rank_score(pos: Column, n: Column) -> Column:
    return (n - pos + 1) / n


def combine(vector: DataFrame, text: DataFrame, wv: float, wt: float) -> DataFrame:
    """Full outer join of two lists (id, score) into id, score_vector, score_text, score_hybrid."""
    both = vector.select("id", F.col("score").alias("v")).join(text.select("id", F.col("score").alias("t")), "id", "full")
    v, t = F.coalesce("v", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    return both.select("id", v.alias("score_vector"), t.alias("score_text"), (wv * v + wt * t).alias("score_hybrid"))


def by_rank(vector: DataFrame, text: DataFrame, wv: float = 0.7, wt: float = 0.3) -> DataFrame:
    """Lists (id, pos) fused by linear rank scores."""
    scored = lambda x: x.select("id", rank_score(F.col("pos"), F.count("*").over(Window.partitionBy())).alias("score"))
    return combine(scored(vector), scored(text), wv, wt)


def by_reciprocal_rank(vector: DataFrame, text: DataFrame, wv: float = 1.0, wt: float = 1.0, k: int = 60) -> DataFrame:
    """Lists (id, pos) fused by 1 / (k + rank)."""
    scored = lambda x: x.select("id", (1 / (k + F.col("pos"))).alias("score"))
    return combine(scored(vector), scored(text), wv, wt)


def min_max(value: Column, smaller_is_better: bool = False) -> Column:
    """Values of a list scaled to 0..1; a constant list becomes 1."""
    w = Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = (value - low) / (high - low)
    return F.when(high == low, F.lit(1.0)).otherwise(1 - scaled if smaller_is_better else scaled)


def by_score(vector: DataFrame, text: DataFrame, wv: float = 0.7, wt: float = 0.3) -> DataFrame:
    """Lists (id, pos, distance) and (id, pos, bm25) fused by scaled scores."""
    v = vector.select("id", min_max(F.col("distance"), smaller_is_better=True).alias("score"))
    return combine(v, text.select("id", min_max(F.col("bm25")).alias("score")), wv, wt)


def capped(hits: DataFrame, key: str, n: int | None, order: list[Column]) -> DataFrame:
    """The first n hits of each key in rank order; all if n is None, none if it is not positive."""
    if n is None:
        return hits
    if n <= 0:
        return hits.limit(0)
    return hits.withColumn("rank_in_key", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank_in_key") <= n).drop("rank_in_key")


def with_context(hits: DataFrame, chunks: DataFrame, file: str, index: str, text: str, width: int) -> DataFrame:
    """hits (file, index) with the texts of the chunks within width, in order, joined by line ends.

    The range join is an equi-join on the places asked for, so it shuffles like any other.
    """
    asked = hits.select(file, F.col(index).alias("hit"), F.explode(F.sequence(F.col(index) - width, F.col(index) + width)).alias(index))
    met = asked.join(chunks.select(file, index, text), [file, index])
    parts = F.array_sort(F.collect_list(F.struct(index, text)))
    return met.groupBy(file, "hit").agg(parts.alias("p")).select(file, "hit", F.array_join(F.col(f"p.{text}"), "\n").alias("context"), F.size("p").cast("long").alias("n_chunks"))


def mmr(candidates: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance per query over candidates (query, id, score, embedding): query, id, step.

    Greedy and sequential, so a query's candidates, a top-k list, are handled in one task; queries are spread.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        e = np.stack([np.asarray(x, float) for x in rows["embedding"]])
        norm = np.linalg.norm(e, axis=1, keepdims=True)
        e = np.divide(e, norm, out=np.zeros_like(e), where=norm > 0)
        like = np.maximum(e @ e.T, 0)
        relevance = rows["score"].to_numpy() / max(rows["score"].max(), 1e-12)
        left, chosen, closest = list(range(len(rows))), [], np.zeros(len(rows))
        while left and len(chosen) < k:
            value = [(-round(balance * relevance[i] - (1 - balance) * closest[i], 12), i) for i in left]
            best = min(value)[1]
            chosen.append(best)
            left.remove(best)
            closest = np.maximum(closest, like[best])
        return pd.DataFrame({"query": rows["query"].iloc[0], "id": rows["id"].iloc[chosen].to_numpy(), "step": range(1, len(chosen) + 1)})

    return candidates.groupBy("query").applyInPandas(pick, "query long, id long, step long")
