"""A question to a graph: nodes by name, or else by their words; what lies around them; and the texts they come from, all within bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import first_items, undirected
from tessera.operators.staging import rounds, staged


def answered(queries: DataFrame, nodes: DataFrame, edges: DataFrame, texts: DataFrame, most_nodes: int = 5, depth: int = 2, most_around: int = 20, sources: int = 3) -> DataFrame:
    """query, way, id, score, distance, sources: for each query (query, term), in order of distance, score and name.

    Found nodes (distance 0): those named by the term (1.0) or, in any case, with the term in their name (0.2 + 0.3 times the term's share of the letters), the `most_nodes`
    best; way is `name`. A query without any gets the nodes that share words of three letters with it, by the share of its words; way is `words`. Around them, up
    to `depth` edges away in either direction, the `most_around` nearest, of which those with more ways from the last step come first; way is `around`. sources are the first
    texts (id, text_id) of each. A query that finds nothing has no row.
    """
    with rounds(edges.sparkSession) as stage:
        low = F.lower("term")
        asked = stage(queries.select("query", low.alias("term")).where("term <> ''").distinct())
        ids = stage(nodes.select("id", F.lower("id").alias("low")).distinct())
        # a term inside a name is met at one of the name's places: queries are a stated, small set
        score = F.when(F.col("low") == F.col("term"), 1.0).otherwise(0.2 + 0.3 * F.char_length("term") / F.char_length("low"))
        named = ids.join(F.broadcast(asked), F.contains("low", "term")).select("query", "id", F.round(score, 6).alias("score"), F.lit("name").alias("way"))
        named = stage(named)
        rest = asked.join(named.select("query").distinct(), "query", "left_anti")
        words = lambda c: F.array_distinct(F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: F.char_length(w) >= 3))
        of_query = rest.select("query", words(F.col("term")).alias("w")).select("query", F.size("w").alias("all"), F.explode("w").alias("word"))
        by_word = ids.select("id", F.explode(words(F.col("low"))).alias("word")).join(of_query, "word").groupBy("query", "id", "all").agg(F.count("*").alias("n"))
        found = named.unionByName(by_word.select("query", "id", F.round(F.col("n") / F.col("all"), 6).alias("score"), F.lit("words").alias("way")))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        first = stage(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_nodes).select("query", "way", "id", "score", F.lit(0).alias("distance")))
        both = stage(undirected(edges))
        seen, level, around = first.select("query", "id"), first.select("query", "id"), None
        for d in range(1, depth + 1):
            level = level.join(both, level["id"] == both["src"]).groupBy("query", F.col("dst").alias("id")).agg(F.count("*").alias("ways")).join(seen, ["query", "id"], "left_anti")
            level = stage(level.withColumn("distance", F.lit(d)))
            around = level if around is None else around.unionByName(level)
            seen, level = seen.unionByName(level.select("query", "id")), level.select("query", "id")
        rows = first
        if around is not None:
            near = Window.partitionBy("query").orderBy("distance", F.desc("ways"), "id")
            kept = around.withColumn("n", F.row_number().over(near)).where(F.col("n") <= most_around)
            rows = rows.unionByName(kept.select("query", F.lit("around").alias("way"), "id", F.lit(0.0).alias("score"), "distance"))
        rows = stage(rows)
        own = first_items(texts.select("id", "text_id").distinct().join(rows.select("id").distinct(), "id", "left_semi"), "id", "text_id", ["text_id"], sources, "sources")
        return staged(rows.join(own, "id", "left").select("query", "way", "id", "score", "distance", "sources"))
