"""From texts to a graph in one go: names found in sentences, relations between them, guarded edges and the texts they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sentences, terms
from tessera.operators.graph import band_pairs, first_items, guarded
from tessera.operators.staging import staged


def words(docs: DataFrame) -> DataFrame:
    """doc_id, sentence, place, word for each word of each sentence."""
    own = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence", "s"))
    return own.select("doc_id", "sentence", F.posexplode(terms(F.col("s"))).alias("place", "word"))


def relations(found: DataFrame, names: DataFrame, marks: DataFrame) -> DataFrame:
    """src, dst, relation: the nearest names before and behind each relation word (word, relation) of a sentence of found (words).

    The first relation of a pair, by document and place, stays.
    """
    flagged = found.join(names.select(F.col("name").alias("word"), F.col("name").alias("entity")).distinct(), "word", "left").join(marks, "word", "left")
    w = Window.partitionBy("doc_id", "sentence").orderBy("place")
    before = F.last("entity", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("entity", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    edges = flagged.withColumns({"src": before, "dst": behind}).where("relation IS NOT NULL AND src <> dst")
    return edges.groupBy("src", "dst").agg(F.min_by("relation", F.struct("doc_id", "sentence", "place")).alias("relation"))


def built(docs: DataFrame, names: DataFrame, marks: DataFrame, stop: tuple[str, ...], acyclic: tuple[str, ...] = ("part-of", "is-a"), sources: int = 5, with_edges: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(nodes (id, n_docs, sources), edges (src, dst, relation)) of docs (doc_id, text): names (name) that occur, and what relates them.

    Where no sentence relates any two names, names that stand within ten words of each other twice depend on each other. A node has
    the first `sources` documents that hold it. Null and empty texts hold nothing. Without edges, only the nodes are made.
    """
    found = words(docs)
    kept = names.select("name").where(~F.lower("name").isin(*stop)).distinct()
    met = found.join(kept.withColumnRenamed("name", "word"), "word", "left_semi")
    holds = met.select(F.col("word").alias("id"), "doc_id").distinct()
    nodes = holds.groupBy("id").agg(F.count("*").alias("n_docs")).join(first_items(holds, "id", "doc_id", ["doc_id"], sources, "sources"), "id")
    if not with_edges:
        return nodes, None
    edges = staged(relations(found, kept, marks))
    if edges.isEmpty():
        places = met.withColumn("group", F.struct("doc_id", "sentence"))
        edges = band_pairs(places, "group", "word", "place", 10, 2).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("depends-on").alias("relation"))
    allowed = tuple(r[0] for r in marks.select("relation").distinct().collect()) + ("depends-on",)  # of a vocabulary
    return nodes, guarded(edges, nodes, allowed, stop, acyclic)
