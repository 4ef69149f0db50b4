"""Queries on evaluation: ranking metrics, usage, agreement, cost and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vocabulary as voc
from tessera.operators import evaluation as ev
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """For each source, its ten longest documents: case_id, rank, id, metrics against documents marked good."""
    docs = table(spark, d, "documents")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    results = docs.select(F.col("source").alias("case_id"), F.row_number().over(w).alias("rank"), F.col("doc_id").alias("id")).where("rank <= 10")
    good = table(spark, d, "labels").where("toxic = 1").join(docs, "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"))
    return ev.ranking_metrics(results, good, 10)


RANKING = """r AS (SELECT source AS case_id, doc_id AS id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 10),
g AS (SELECT DISTINCT source AS case_id, doc_id AS id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1), ng AS (SELECT case_id, count(*) AS n FROM g GROUP BY 1),
m AS (SELECT r.case_id, min(CASE WHEN g.id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN g.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(g.id) AS hits FROM r LEFT JOIN g ON g.case_id = r.case_id AND g.id = r.id GROUP BY 1),
x AS (SELECT m.*, coalesce(n, 0) AS n, list_sum(list_transform(generate_series(1, greatest(least(coalesce(n, 0), 10), 1)), lambda i: 1 / log2(i + 1))) AS ideal FROM m LEFT JOIN ng USING (case_id))"""


@query(f"WITH {RANKING} SELECT case_id, round(coalesce(1 / first, 0), 6) AS rr FROM x")
def eval_mrr(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).select("case_id", F.round("rr", 6).alias("rr"))


@query(f"WITH {RANKING} SELECT case_id, round(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM x")
def eval_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).select("case_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {RANKING} SELECT case_id, round(hits / 10::DOUBLE, 6) AS precision_at_k, round(CASE WHEN n > 0 THEN hits / n::DOUBLE ELSE 0 END, 6) AS recall_at_k FROM x")
def eval_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).select("case_id", F.round("precision", 6).alias("precision_at_k"), F.round("recall", 6).alias("recall_at_k"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events WHERE event_type = 'purchase'")
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(table(spark, d, "events").where("event_type = 'purchase'"), [], "value")


@query("SELECT event_type, user_id, count(*) AS n, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2")
def metrics_by_config(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(table(spark, d, "events"), ["event_type", "user_id"], "value")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the plain grouping: subtotals by type and over all."""
    return table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT user_id, event_type, n, mean_value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE r <= 3")
def query_pattern_stats(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent patterns of each user among those seen twice at least."""
    stats = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).where("n >= 2")
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return stats.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("WITH s AS (SELECT event_type, sum(value / (1 + user_id % 5)) AS s FROM events GROUP BY 1) SELECT event_type, round(s / max(s) OVER (), 6) AS importance FROM s")
def node_importance(spark: SparkSession, d: str) -> DataFrame:
    """Quality over path length, summed for each node and scaled by the largest."""
    sums = table(spark, d, "events").groupBy("event_type").agg(F.sum(F.col("value") / (1 + F.col("user_id") % 5)).alias("s"))
    return sums.select("event_type", F.round(F.col("s") / F.max("s").over(Window.partitionBy()), 6).alias("importance"))


@query("SELECT user_id, arg_max(event_id, {'v': value, 'e': -event_id}) AS best_event, max(value) AS best_value FROM events WHERE event_type <> 'error' AND value > 50 GROUP BY 1")
def best_history(spark: SparkSession, d: str) -> DataFrame:
    """Each user's best successful event above a least value."""
    good = table(spark, d, "events").where("event_type <> 'error' AND value > 50")
    return good.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_event"), F.max("value").alias("best_value"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def backend_usage_share(spark: SparkSession, d: str) -> DataFrame:
    return ev.share(table(spark, d, "events"), "event_type")


VERDICT_SQL = "CASE WHEN n = 0 THEN 'no-tool-call' WHEN n = 1 AND has THEN 'ok' WHEN has AND n = 2 THEN 'ok(both)' WHEN has THEN 'ok(+other)' ELSE 'miss' END"


@query(f"SELECT user_id, {VERDICT_SQL} AS verdict FROM (SELECT user_id, count(DISTINCT CASE WHEN value > 100 THEN event_type END) AS n, bool_or(value > 100 AND event_type = 'click') AS has FROM events GROUP BY 1)")
def backend_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which tools each user's heavy events used, held against the expected one."""
    used = table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.when(F.col("value") > 100, F.col("event_type"))).alias("n"), F.bool_or((F.col("value") > 100) & (F.col("event_type") == "click")).alias("has"))
    n, has = F.col("n"), F.col("has")
    return used.select("user_id", F.when(n == 0, "no-tool-call").when((n == 1) & has, "ok").when(has & (n == 2), "ok(both)").when(has, "ok(+other)").otherwise("miss").alias("verdict"))


BEFORE_AFTER = f"x AS (SELECT doc_id, source, CASE WHEN q AND t THEN 'both_error' WHEN NOT q AND NOT t THEN 'both_clean' WHEN q THEN 'local_only' ELSE 'reference_only' END AS before, CASE WHEN l AND t THEN 'both_error' WHEN NOT l AND NOT t THEN 'both_clean' WHEN l THEN 'local_only' ELSE 'reference_only' END AS after FROM (SELECT doc_id, source, quality = 0 AS q, toxic = 1 AS t, n_chars < 600 AS l FROM labels JOIN documents USING (doc_id)))"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, before, after: agreement of two checks of a document with a third."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    q, t, s = F.col("quality") == 0, F.col("toxic") == 1, F.col("n_chars") < 600
    return rows.select("doc_id", "source", ev.agreement(q, t).alias("before"), ev.agreement(s, t).alias("after"))


@query(f"WITH {BEFORE_AFTER} SELECT before AS agreement, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM x GROUP BY 1")
def agreement_classes(spark: SparkSession, d: str) -> DataFrame:
    return ev.share(verdicts(spark, d).withColumnRenamed("before", "agreement"), "agreement")


@query(f"WITH {BEFORE_AFTER} SELECT before, after, count(*) AS n FROM x GROUP BY 1, 2")
def agreement_transitions(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"WITH {BEFORE_AFTER}, s AS (SELECT source, sum((before IN ('both_error', 'both_clean'))::INT) AS agree, count(*) AS n FROM x GROUP BY 1) SELECT source, CAST(agree AS BIGINT) AS agree, n - CAST(agree AS BIGINT) AS disagree, CASE WHEN n >= 3 THEN round(agree / n::DOUBLE, 3) END AS ratio FROM s")
def rule_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of agreement by rule (here by source); null below three samples."""
    s = verdicts(spark, d).groupBy("source").agg(F.sum(F.col("before").isin("both_error", "both_clean").cast("long")).alias("agree"), F.count("*").alias("n"))
    return s.select("source", "agree", (F.col("n") - F.col("agree")).alias("disagree"), F.when(F.col("n") >= 3, F.round(F.col("agree") / F.col("n"), 3)).alias("ratio"))


@query("SELECT message, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(event_type || ' ' || props || ' took ' || value, '\"[^\"]*\"|''[^'']*''', '<X>', 'g'), '[0-9]+([.][0-9]+)?', '<N>', 'g') AS message FROM events) GROUP BY 1")
def message_clusters(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "event_type", "props", F.lit("took"), F.col("value").cast("string"))
    return table(spark, d, "events").groupBy(tx.normal_message(text).alias("message")).agg(F.count("*").alias("n"))


WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"


@query(f"SELECT conv_id, cited FROM (SELECT DISTINCT conv_id, unnest({WORDS}) AS cited FROM conversations WHERE role = 'assistant') EXCEPT SELECT DISTINCT conv_id, unnest({WORDS}) FROM conversations WHERE role <> 'assistant'")
def fabricated_citations(spark: SparkSession, d: str) -> DataFrame:
    """Words of answers that nothing else in their conversation has."""
    rows = table(spark, d, "conversations").select("conv_id", "role", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("cited"))
    mine = rows.where("role = 'assistant'").select("conv_id", "cited").distinct()
    return mine.join(rows.where("role <> 'assistant'"), ["conv_id", "cited"], "left_anti")


REFUSAL_SQL = " OR ".join(f"contains(lower(answer), '{m}')" for m in voc.REFUSALS)
ANSWERS = "(SELECT role, CASE WHEN (conv_id + turn) % 5 = 3 THEN text || ' ' || " + f"{list(voc.REFUSALS)}[1 + conv_id % {len(voc.REFUSALS)}]" + " ELSE text END AS answer FROM conversations)"


@query(f"SELECT role, count(*) AS n, CAST(sum(({REFUSAL_SQL})::INT) AS BIGINT) AS refused, round(sum(({REFUSAL_SQL})::INT) / count(*)::DOUBLE, 9) AS rate FROM {ANSWERS} GROUP BY 1")
def refusal_rate(spark: SparkSession, d: str) -> DataFrame:
    """How many turns decline; a fifth of them ends with one of the ways to decline, as the tables' own language has none."""
    way = F.get(F.array(*map(F.lit, voc.REFUSALS)), (F.col("conv_id") % len(voc.REFUSALS)).cast("int"))
    answer = F.when((F.col("conv_id") + F.col("turn")) % 5 == 3, F.concat_ws(" ", "text", way)).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("role", tx.refuses(answer, voc.REFUSALS).cast("long").alias("r"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum("r").alias("refused"), F.round(F.sum("r") / F.count("*"), 9).alias("rate"))


@query(f"SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) AS BIGINT) AS chars_in, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS chars_out, round((sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) * {voc.PRICE_IN}::DOUBLE + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) * {voc.PRICE_OUT}::DOUBLE) / 4000000, 9) AS dollars FROM conversations GROUP BY 1")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Cost of each conversation at four characters a token."""
    n, answer = F.char_length("text").cast("long"), F.col("role") == "assistant"
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(answer, 0).otherwise(n)).alias("chars_in"), F.sum(F.when(answer, n).otherwise(0)).alias("chars_out"))
    return rows.withColumn("dollars", F.round((F.col("chars_in") * voc.PRICE_IN + F.col("chars_out") * voc.PRICE_OUT) / 4_000_000, 9))


GRADE_SQL = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"


@query(f"SELECT source, score, {GRADE_SQL} AS grade FROM (SELECT source, CAST(greatest(0, 100 - 20 * sum(toxic) - 5 * sum((quality = 0)::INT)) AS BIGINT) AS score FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def quality_score_grade(spark: SparkSession, d: str) -> DataFrame:
    """100 less 20 for each error and 5 for each warning of a source, with its grade."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source")
    score = rows.agg(F.greatest(F.lit(0), 100 - 20 * F.sum("toxic") - 5 * F.sum((F.col("quality") == 0).cast("int"))).cast("long").alias("score"))
    return score.withColumn("grade", ev.grade(F.col("score")))


@query("SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'only_after' WHEN b.k IS NULL THEN 'only_before' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE quality = 1 OR toxic = 1) a FULL JOIN (SELECT doc_id AS k, toxic AS v FROM labels WHERE toxic = 1 OR quality = 0) b ON a.k = b.k")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two runs side by side: samples in both, changed or not, and those in one only."""
    labels = table(spark, d, "labels")
    a, b = labels.where("quality = 1 OR toxic = 1").select("doc_id", F.col("quality").alias("v")), labels.where("toxic = 1 OR quality = 0").select("doc_id", F.col("toxic").alias("w"))
    status = F.when(F.col("v").isNull(), "only_after").when(F.col("w").isNull(), "only_before").when(F.col("v") == F.col("w"), "same").otherwise("changed")
    return a.join(b, "doc_id", "full").select("doc_id", status.alias("status"))
