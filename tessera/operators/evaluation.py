"""Retrieval metrics, agreement classes and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """case_id, rr, ndcg, precision, recall of results (case_id, rank, id) against judged (case_id, id).

    The ideal gain is that of min(relevant, k) hits; precision divides by k even if fewer came back; recall and
    nDCG are 0 without relevant ids.
    """
    relevant = judged.groupBy("case_id").agg(F.countDistinct("id").alias("n_relevant"))
    hits = results.where(F.col("rank") <= k).join(judged.select("case_id", "id").distinct().withColumn("hit", F.lit(1)), ["case_id", "id"], "left")
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hits.groupBy("case_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.count("hit").alias("n_hits"))
    rows = per.join(relevant, "case_id", "left")
    n = F.coalesce("n_relevant", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        "case_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(n > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        (F.col("n_hits") / k).alias("precision"), F.when(n > 0, F.col("n_hits") / n).otherwise(0.0).alias("recall"),
    )


def agreement(a: Column, b: Column) -> Column:
    """Class of two verdicts on errors."""
    return F.when(a & b, "both_error").when(~a & ~b, "both_clean").when(a, "local_only").otherwise("reference_only")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def summary(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, least and largest value of each group of the keys asked for; one row if there are none."""
    measures = [F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value")]
    return facts.groupBy(*keys).agg(*measures) if keys else facts.agg(*measures)


def share(rows: DataFrame, key: str) -> DataFrame:
    """key, n, share: counts of each key and their part of all."""
    from pyspark.sql import Window

    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def same_multiset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how often each row is in a and in b, for rows that are not in both equally often."""
    x, y = (t.groupBy(*keys).agg(F.count("*").alias(n)) for t, n in ((a, "n_a"), (b, "n_b")))
    on = [x[k].eqNullSafe(y[k]) for k in keys]
    both = x.join(y, on, "full").select(*(F.coalesce(x[k], y[k]).alias(k) for k in keys), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")


def rule_confidence(files: DataFrame, least: int = 5, left_out: tuple[str, ...] = ("parse",)) -> DataFrame:
    """rule, sole_agree, sole_disagree, confidence: for each rule, the files (file, rules, agrees) where it alone reports, and the share that agree.

    Rules with fewer than `least` such files have no confidence and are left out, and so are rules that are none.
    """
    sole = files.where(F.size(F.array_distinct("rules")) == 1).select(F.col("rules")[0].alias("rule"), "agrees").where(~F.col("rule").isin(*left_out))
    counts = sole.groupBy("rule").agg(F.count_if(F.col("agrees")).alias("sole_agree"), F.count_if(~F.col("agrees")).alias("sole_disagree"))
    n = F.col("sole_agree") + F.col("sole_disagree")
    return counts.where(n >= least).withColumn("confidence", F.round(F.col("sole_agree") / n, 6))
