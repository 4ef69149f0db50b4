"""Queries on the history of explorations and on statements; hours of users' events stand for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history, statements
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


FACTS = """f AS (SELECT 'u' || user_id % 7 AS key, list(event_type ORDER BY ts, event_id) AS path, arg_min(event_type, (ts, event_id)) AS start, arg_max(event_type, (ts, event_id)) AS "end", count(*) FILTER (event_type = 'error') = 0 AS success,
least(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(*), 10000) / 10000 AS quality, list(DISTINCT event_type) AS items FROM events GROUP BY user_id, CAST(ts AS DATE), hour(ts))"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Each hour of a user as one exploration: its events in order are the path, and their mean value its quality."""
    events = table(spark, d, "events")
    place = F.struct("ts", "event_id")
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    own = events.groupBy("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        path.alias("path"), F.min_by("event_type", place).alias("start"), F.max_by("event_type", place).alias("end"), (F.count(F.when(F.col("event_type") == "error", 1)) == 0).alias("success"),
        (F.least(F.expr("sum(cast(round(value * 100) as bigint)) div count(*)"), F.lit(10_000)) / 10_000).alias("quality"), F.collect_set("event_type").alias("items"), F.max("ts").alias("at"),
    )
    return own.withColumn("key", F.concat(F.lit("u"), F.col("user_id") % 7))


def told(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return history.together(history.partials(facts(spark, d)))


@query(f"""WITH {FACTS}, i AS (SELECT key, item, count(*) AS n FROM (SELECT key, unnest(items) AS item FROM f) GROUP BY ALL), t AS (SELECT key, string_agg(item, ',' ORDER BY n DESC, item) AS items FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS r FROM i) WHERE r <= 5 GROUP BY key)
SELECT key, count(*) AS n, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(sum(CAST(floor(quality * 1000000 + 0.5) AS BIGINT)) / count(*) / 1000000, 6) AS mean_quality, CASE WHEN count(*) >= 2 THEN any_value(t.items) ELSE '' END AS items FROM f JOIN t USING (key) GROUP BY key""")
def history_patterns(spark: SparkSession, d: str) -> DataFrame:
    """How often each pattern was asked, how well that went, and what helped most."""
    return history.patterns(told(spark, d)).withColumn("items", F.array_join("items", ","))


@query(f"""WITH {FACTS}, s AS (SELECT unnest(path) AS node, CAST(floor(quality / len(path) * 1000000 + 0.5) AS BIGINT) AS w FROM f), g AS (SELECT node, CAST(sum(w) AS BIGINT) AS w, count(*) AS n FROM s GROUP BY node)
SELECT node, n, CASE WHEN max(w) OVER () > 0 THEN floor(w * 1000000 / max(w) OVER () + 0.5) / 1000000 ELSE 0 END AS importance FROM g""")
def history_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Which nodes the paths of explorations went through, weighted by their quality."""
    return history.importance(told(spark, d))


@query(f"""WITH {FACTS} SELECT start AS source, "end" AS target, array_to_string(arg_max(path, (quality, -len(path), path)), ' ') AS path, max(quality) AS quality FROM f WHERE success AND quality > 0.5 GROUP BY ALL""")
def history_best_paths(spark: SparkSession, d: str) -> DataFrame:
    """The best successful path of each start and end."""
    return told(spark, d)["best"].select(F.col("start").alias("source"), F.col("end").alias("target"), F.array_join("path", " ").alias("path"), "quality")


@query("""WITH s AS (SELECT conv_id AS owner, turn, CASE role WHEN 'system' THEN 'note' WHEN 'user' THEN 'first' ELSE CASE turn % 3 WHEN 0 THEN 'flow' ELSE 'then' END END AS kind,
CASE WHEN role = 'user' THEN split_part(text, ' ', 1) END AS source, CASE WHEN turn % 4 <> 2 THEN split_part(text, ' ', 2) END AS target FROM conversations),
b AS (SELECT *, coalesce(source, last_value(coalesce(target, source) IGNORE NULLS) OVER (PARTITION BY owner ORDER BY turn // 2, turn % 2, kind, source, target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(owner AS VARCHAR)) AS src FROM s)
SELECT owner, turn, src, target AS dst, CASE kind WHEN 'flow' THEN 'flow' ELSE 'succession' END AS relation FROM b WHERE target IS NOT NULL AND kind <> 'note' AND src <> target""")
def statement_relations(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as statements in nested bodies, two to a body: who follows whom."""
    turns = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "system", "note").when(F.col("role") == "user", "first").when(F.col("turn") % 3 == 0, "flow").otherwise("then")
    own = turns.select(
        F.col("conv_id").alias("owner"), F.array(F.expr("turn div 2"), F.col("turn") % 2).alias("place"), kind.alias("kind"), F.when(F.col("role") == "user", F.split_part("text", F.lit(" "), F.lit(1))).alias("source"),
        F.when(F.col("turn") % 4 != 2, F.split_part("text", F.lit(" "), F.lit(2))).alias("target"),
    )
    return statements.carried(own).select("owner", (2 * F.col("place")[0] + F.col("place")[1]).alias("turn"), "src", "dst", "relation")
