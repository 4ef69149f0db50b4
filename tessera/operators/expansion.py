"""Matching query terms with node names: exact, alias and edit-distance joins, and their fold.

Names and terms are vocabularies. The edit-distance join is an equi-join on deletion variants, not a cross join: two
words within one edit share a variant with at most one letter deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(terms: DataFrame, names: DataFrame) -> DataFrame:
    """term, name, score 1 where both are equal in lower case."""
    return terms.join(names.withColumn("term", F.lower("name")), "term").select("term", "name", F.lit(1.0).alias("score"), F.lit("exact").alias("match"))


def by_alias(terms: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """term, name, score 0.8 where the name is an alias's variant of the term (alias, variant)."""
    met = terms.join(aliases, F.col("term") == F.col("variant")).select("term", F.col("alias").alias("name_key"))
    return met.join(names.withColumn("name_key", F.lower("name")), "name_key").select("term", "name", F.lit(0.8).alias("score"), F.lit("alias").alias("match"))


def deletions(word: Column) -> Column:
    """A word and all that is left of it when one letter goes."""
    n = F.char_length(word)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n > 0, F.array_distinct(F.concat(F.array(word), shorter))).otherwise(F.array(word))


def fuzzy(terms: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """term, name, score 1 - distance / longer length, for pairs one edit apart whose score reaches `least`."""
    a = terms.select("term", F.explode(deletions(F.col("term"))).alias("v"))
    b = names.select("name", F.explode(deletions(F.lower("name"))).alias("v"))
    pairs = a.join(b, "v").select("term", "name").distinct()
    gap = F.levenshtein("term", F.lower("name"))
    scored = pairs.withColumn("d", gap).where("d = 1").withColumn("score", F.round(1 - F.col("d") / F.greatest(F.char_length("term"), F.char_length("name")), 9))
    return scored.where(F.col("score") >= least).select("term", "name", "score", F.lit("fuzzy").alias("match"))


def folded(candidates: DataFrame) -> DataFrame:
    """name, score, n_matches, best_match: the best score and 0.05 for each further kind of match, at most 1."""
    best = candidates.groupBy("name").agg(F.max("score").alias("s"), F.countDistinct("match").alias("kinds"), F.count("*").alias("n_matches"), F.min(F.struct((-F.col("score")).alias("x"), "match", "term")).alias("b"))
    return best.select("name", F.round(F.least(F.lit(1.0), F.col("s") + 0.05 * (F.col("kinds") - 1)), 9).alias("score"), "n_matches", F.col("b.match").alias("best_match"))


def node_scores(nodes: DataFrame, query: str) -> DataFrame:
    """name, score of nodes (name, degree) that hold any word of a query; exact 1, part 0.2 + 0.3 * length ratio, plus 0.2 * degree share."""
    name = F.lower("name")
    hit = None
    for w in query.lower().split():
        part = F.when(F.contains(name, F.lit(w)), 0.2 + 0.3 * len(w) / F.char_length("name"))
        hit = part if hit is None else F.greatest(F.coalesce(hit, part), F.coalesce(part, hit))
    base = F.when(name == query.lower(), F.lit(1.0)).otherwise(hit)
    rows = nodes.withColumn("base", base).join(F.broadcast(nodes.agg(F.max("degree").alias("top"))))  # one row
    return rows.where("base IS NOT NULL").select("name", F.round(F.least(F.lit(1.0), F.col("base") + 0.2 * F.col("degree") / F.col("top")), 6).alias("score"))
