"""Ways into a graph: resolving names, valid partial matches, attributes, hashed embeddings and semantic entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_name
from tessera.operators.graph import first_items


def resolved(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (name) with node: the node (id) that a name means, or null.

    A node of that very name comes first, then nodes that are equal once normalised, then those equal without spaces; of
    several the shortest, and of these the first. Each way is an equi-join on one key.
    """
    keys = lambda c: F.array(c, normal_name(c), F.replace(normal_name(c), F.lit(" "), F.lit("")))
    mine = asked.select("name").distinct().select("name", F.posexplode(keys(F.col("name"))).alias("way", "key"))
    theirs = nodes.select("id").distinct().select("id", F.posexplode(keys(F.col("id"))).alias("way", "key"))
    met = mine.join(theirs, ["way", "key"]).groupBy("name").agg(F.min(F.struct("way", F.char_length("id").alias("n"), "id")).alias("m"))
    return asked.join(met.select("name", F.col("m.id").alias("node")), "name", "left")


def partial_match(phrase: Column, name: Column) -> Column:
    """Whether a phrase and a node name match in part: as whole words, or one at the other's beginning or end."""
    inside = F.contains(F.concat(F.lit(" "), F.regexp_replace(name, r"\W", " "), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
    return inside | F.startswith(name, phrase) | F.endswith(name, phrase) | F.startswith(phrase, name) | F.endswith(phrase, name)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard index of the words of two texts."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def by_attribute(terms: DataFrame, attributes: DataFrame, least: float = 0.3) -> DataFrame:
    """term, name, attribute, score 0.6 * Jaccard of words, for attributes (name, attribute) that share more than `least` of their words.

    Texts of which one holds the other and that share words meet in one of them, so an equi-join on words finds all.
    """
    a = terms.select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("word"))
    b = attributes.select("name", "attribute", F.explode(F.array_distinct(F.split("attribute", " "))).alias("word"))
    met = a.join(b, "word").select("term", "name", "attribute").distinct()
    held = F.contains("attribute", F.col("term")) | F.contains("term", F.col("attribute"))
    score = word_overlap(F.col("term"), F.col("attribute"))
    return met.where(held & (score > least)).select("term", "name", "attribute", F.round(0.6 * score, 9).alias("score"))


def embedded(rows: DataFrame, key: str, text: str, dims: int = 100, words: int = 100) -> DataFrame:
    """key, dim, weight: a text's first words as a unit vector, each in the dimension its hash says, with the weight 1 / place.

    Vectors are rows and not arrays, as they are sparse; texts without words have none.
    """
    own = rows.select(key, F.posexplode(F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, words)).alias("at", "w"))
    dim = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dims
    sums = own.groupBy(key, dim.alias("dim")).agg(F.sum(1 / (F.col("at") + 1)).alias("x"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norms, key).select(key, "dim", (F.col("x") / F.col("norm")).alias("weight"))


def described(nodes: DataFrame, edges: DataFrame, texts: DataFrame, most: int = 3, chars: int = 200) -> DataFrame:
    """id, description: a node's name, its first neighbours by name, the beginning of its text (id, text) and its type."""
    near = first_items(edges.select("src", "dst").distinct(), "src", "dst", ["dst"], most, "near").withColumnRenamed("src", "id")
    rows = nodes.select("id", "type").join(near, "id", "left").join(texts.groupBy("id").agg(F.min("text").alias("text")), "id", "left")
    return rows.select("id", F.concat_ws(" ", "id", F.array_join("near", " "), F.substring("text", 1, chars), "type").alias("description"))


def entry_points(described_nodes: DataFrame, queries: DataFrame, least: float = 0.3, most: int = 5) -> DataFrame:
    """query, id, similarity, rank: the nodes (id, description) most like a stated set of queries (query, text), from `least` on."""
    a, b = embedded(queries, "query", "text"), embedded(described_nodes, "id", "description").withColumnRenamed("weight", "other")
    scores = a.join(b, "dim").groupBy("query", "id").agg(F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("similarity")).where(F.col("similarity") >= least)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= most)
