"""Further queries: views and signs of the graph, suggestions, matching of issues, coverage of concepts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vocabulary as voc
from tessera.operators import graph
from tessera.plans.graphs import BOTH, NODES_SQL, STAR_SQL, levels, nodes, star
from tessera.plans.naming import NAMES, names
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 10")
def node_types_top(spark: SparkSession, d: str) -> DataFrame:
    """Counts of node types, the ten largest."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("SELECT conv_id, min(turn) AS nearest, arg_min(role, turn) AS role FROM conversations WHERE contains(lower(text), 'that') GROUP BY 1")
def nearest_entity(spark: SparkSession, d: str) -> DataFrame:
    """The entity with the least distance for each id."""
    hits = table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("that")))
    return hits.groupBy("conv_id").agg(F.min("turn").alias("nearest"), F.min_by("role", "turn").alias("role"))


@query("SELECT user_id, count(*) AS n, round(sum((event_type <> 'error')::INT) / count(*)::DOUBLE, 9) AS success_share FROM events GROUP BY 1")
def success_share(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("event_type") != "error").cast("int")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(ok) / F.count("*"), 9).alias("success_share"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_score, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS errors, round(sum(value), 3) AS total FROM events")
def judge_totals(spark: SparkSession, d: str) -> DataFrame:
    bad = (F.col("event_type") == "error").cast("long")
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_score"), F.sum(bad).alias("errors"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT user_id, CAST(sum(again) AS BIGINT) AS hits, round(sum(again) / count(*)::DOUBLE, 9) AS hit_rate FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1)::INT AS again FROM events) GROUP BY 1")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    """A request hits if the same user made it before."""
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(w) > 1).cast("long").alias("again"))
    return rows.groupBy("user_id").agg(F.sum("again").alias("hits"), F.round(F.sum("again") / F.count("*"), 9).alias("hit_rate"))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in voc.STOPWORDS) + ")"


@query(rf"""SELECT word, length(word) >= 3 AND word NOT IN {STOP_SQL} AND NOT regexp_matches(word, '^[^\p{{L}}]') AND NOT contains(word, 'and') AS valid FROM
(SELECT DISTINCT unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS word FROM benchmark)""")
def valid_node_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that may be nodes: three letters and more, no stop word, no leading sign, without `and`."""
    words = table(spark, d, "benchmark").select(F.explode(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", ((F.char_length(w) >= 3) & ~w.isin(*voc.STOPWORDS) & ~w.rlike(r"^[^\p{L}]") & ~F.contains(w, F.lit("and"))).alias("valid"))


@query(f"WITH {STAR_SQL}, {BOTH}, {levels(chr(83) + 'ELECT unnest([' + chr(39) + 'C:3' + chr(39) + ', ' + chr(39) + 'P:5' + chr(39) + ']) AS id', 2, 'u')} SELECT e.src, e.dst, e.relation FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)")
def verification_view(spark: SparkSession, d: str) -> DataFrame:
    """Edges among all nodes within two steps of findings, in either direction."""
    e = star(spark, d)
    seeds = spark.range(1).select(F.explode(F.array(F.lit("C:3"), F.lit("P:5"))).alias("id"))
    near = graph.reachable(graph.undirected(e), seeds, 2).select("id")
    return e.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi").select("src", "dst", "relation")


@query(f"""WITH {STAR_SQL}, {NODES_SQL}, o AS (SELECT src AS id, count(*) AS n_out, array_to_string(list_sort(list_distinct(list(relation))), ',') AS exits FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n_in FROM e GROUP BY 1)
SELECT id, coalesce(exits, '') AS exits, CASE WHEN coalesce(n_out, 0) + coalesce(n_in, 0) > 50 THEN 'hub' WHEN n_out IS NULL THEN 'dead end' ELSE 'passage' END AS hint FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def node_signage(spark: SparkSession, d: str) -> DataFrame:
    """Where each node leads by relation, and a hint from its degree."""
    e = star(spark, d)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("exits"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    rows = nodes(e).join(out, "id", "left").join(into, "id", "left")
    hint = F.when(F.coalesce("n_out", F.lit(0)) + F.coalesce("n_in", F.lit(0)) > 50, "hub").when(F.col("n_out").isNull(), "dead end").otherwise("passage")
    return rows.select("id", F.coalesce("exits", F.lit("")).alias("exits"), hint.alias("hint"))


@query(f"""WITH {NAMES}, w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS name FROM part), p AS (SELECT DISTINCT a.name, b.name AS other FROM w a JOIN w b USING (p_partkey) WHERE a.name <> b.name)
SELECT name, array_to_string(list_sort(list(other))[1:3], ',') AS related FROM p GROUP BY name""")
def suggestions_with_related(spark: SparkSession, d: str) -> DataFrame:
    """Three related names for each name: those that stand with it in a part's name."""
    words = F.split("p_name", " ")
    rows = table(spark, d, "part").select(F.explode(words).alias("name"), words.alias("w")).select("name", F.explode("w").alias("other")).where("name <> other").distinct()
    return graph.first_items(rows, "name", "other", ["other"], 3, "related").withColumn("related", F.array_join("related", ","))


@query(f"""WITH {NAMES}, c AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS concept FROM benchmark),
d AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS concept FROM conversations)
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT CASE WHEN d.concept IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status FROM c LEFT JOIN d USING (concept)) GROUP BY 1""")
def concept_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many concepts of one model the other has."""
    long = F.filter(tx.terms(F.col("text")), lambda x: F.char_length(x) >= 3)
    a = table(spark, d, "benchmark").select(F.explode(long).alias("concept")).distinct()
    b = table(spark, d, "conversations").select(F.explode(F.array_distinct(long)).alias("concept")).distinct().withColumn("found", F.lit(True))
    counts = a.join(b, "concept", "left").groupBy(F.when(F.col("found"), "matched").otherwise("unmatched").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("SELECT o_orderkey, min(s_suppkey) AS only_supplier FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS s_suppkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) = 1")
def unique_definition(spark: SparkSession, d: str) -> DataFrame:
    """References that have exactly one candidate; those with more stay undecided."""
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    one = pairs.groupBy("o_orderkey").agg(F.min("l_suppkey").alias("only_supplier"), F.count("*").alias("n")).where("n = 1").drop("n")
    return one.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("SELECT event_id, event_type AS rule, CASE event_type WHEN 'error' THEN 1.0::DOUBLE WHEN 'click' THEN 0.75::DOUBLE END AS confidence FROM events WHERE value > 200")
def issue_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Issues with the measured confidence of their rule; null where none was measured."""
    measured = spark.createDataFrame([("error", 1.0), ("click", 0.75)], "rule string, confidence double")
    issues = table(spark, d, "events").where("value > 200").select("event_id", F.col("event_type").alias("rule"))
    return issues.join(F.broadcast(measured), "rule", "left").select("event_id", "rule", "confidence")


def matched(rows: DataFrame) -> DataFrame:
    """case_id, expected, actual: expected issues take actual ones greedily, in order, one to one.

    rows: case_id, side, ord, severity, text. An actual issue fits if its severity is equal and its text holds the
    expected text. One case, a file's issues, is handled in one task.
    """

    def run(case: pd.DataFrame) -> pd.DataFrame:
        case = case.sort_values("ord")
        left = list(case[case["side"] == "actual"][["ord", "severity", "text"]].itertuples(index=False))
        out = []
        for e in case[case["side"] == "expected"].itertuples(index=False):
            hit = next((a for a in left if a.severity == e.severity and e.text in a.text), None)
            if hit is not None:
                left.remove(hit)
            out.append((e.case_id, e.ord, None if hit is None else hit.ord))
        return pd.DataFrame({"case_id": [o[0] for o in out], "expected": [o[1] for o in out], "actual": pd.array([o[2] for o in out], dtype="Int64")})

    return rows.groupBy("case_id").applyInPandas(run, "case_id long, expected long, actual long")


@query()
def issue_matching(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions as expected issues, answers as actual ones."""
    turns = table(spark, d, "conversations")
    expected = turns.where("role = 'user'").select(F.col("conv_id").alias("case_id"), F.lit("expected").alias("side"), F.col("turn").alias("ord"), F.lit("error").alias("severity"), F.try_element_at(tx.terms(F.col("text")), F.lit(1)).alias("text"))
    actual = turns.where("role = 'assistant'").select(F.col("conv_id").alias("case_id"), F.lit("actual").alias("side"), F.col("turn").alias("ord"), F.lit("error").alias("severity"), F.lower("text").alias("text"))
    return matched(expected.where("text IS NOT NULL").unionByName(actual))
