"""Queries on ways into a graph, guarded edges, code blocks and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vocabulary as voc
from tessera.operators import chunking, entry, evaluation, graph
from tessera.operators import text_graph as text_graphs
from tessera.plans.checking import BASES, part_bases
from tessera.plans.naming import ASKED_SQL, MARKS, NAMES, STOP_SQL, asked, names
from tessera.plans.retrieval import TERMS
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH a AS (SELECT DISTINCT replace(upper(p_name), ' ', '') AS name FROM part UNION SELECT DISTINCT p_name || '!' FROM part UNION SELECT p_type FROM part UNION SELECT p_name FROM part), n AS (SELECT DISTINCT p_name AS id FROM part),
k AS (SELECT name, unnest([0, 1, 2]) AS way, unnest([name, {NORMAL.format('name')}, replace({NORMAL.format('name')}, ' ', '')]) AS key FROM a),
m AS (SELECT id, unnest([0, 1, 2]) AS way, unnest([id, {NORMAL.format('id')}, replace({NORMAL.format('id')}, ' ', '')]) AS key FROM n)
SELECT a.name, f.node FROM a LEFT JOIN (SELECT name, min({{'way': way, 'n': length(id), 'id': id}}).id AS node FROM k JOIN m USING (way, key) GROUP BY name) f USING (name)""")
def node_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of part names, and names that are none, as nodes."""
    part = table(spark, d, "part")
    spelt = F.array(F.regexp_replace(F.upper("p_name"), " ", ""), F.concat("p_name", F.lit("!")), "p_type", "p_name")
    return entry.resolved(part.select(F.explode(spelt).alias("name")).distinct(), part.select(F.col("p_name").alias("id")))


@query(f"""WITH {NAMES}, {ASKED_SQL} SELECT term, name FROM t, names WHERE contains(' ' || regexp_replace(name, '[^A-Za-z0-9_]', ' ', 'g') || ' ', ' ' || term || ' ')
OR starts_with(name, term) OR ends_with(name, term) OR starts_with(term, name) OR ends_with(term, name)""")
def expand_partial(spark: SparkSession, d: str) -> DataFrame:
    """A stated set of terms against all names."""
    rows = names(spark, d).select("name").join(F.broadcast(asked(spark)), entry.partial_match(F.col("term"), F.col("name")))
    return rows.select("term", "name")


@query(f"""WITH {ASKED_SQL}, a AS (SELECT DISTINCT p_brand AS name, p_name AS attribute FROM part), s AS (SELECT term, name, attribute, len(list_intersect(string_split(term, ' '), string_split(attribute, ' '))) / len(list_distinct(list_concat(string_split(term, ' '), string_split(attribute, ' '))))::DOUBLE AS s
FROM t, a WHERE contains(attribute, term) OR contains(term, attribute)) SELECT term, name, attribute, round(0.6::DOUBLE * s, 9) AS score FROM s WHERE s > 0.3""")
def expand_attribute(spark: SparkSession, d: str) -> DataFrame:
    attributes = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("attribute")).distinct()
    return entry.by_attribute(asked(spark), attributes)


def embedded_sql(rows: str) -> str:
    return f"""w AS (SELECT key, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT key, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')[1:100] AS l FROM {rows})),
x AS (SELECT key, ('0x' || substring(md5(w), 1, 8))::BIGINT % 100 AS dim, sum(1.0::DOUBLE / pos) AS x FROM w GROUP BY ALL), e AS (SELECT key, dim, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS weight FROM x)"""


@query(f"WITH r AS (SELECT item_id AS key, text FROM benchmark), {embedded_sql('r')} SELECT key AS item_id, dim, round(weight, 9) AS weight FROM e")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return entry.embedded(table(spark, d, "benchmark"), "item_id", "text").select("item_id", "dim", F.round("weight", 9).alias("weight"))


#: What is looked for among parts.
WANTED = ("small widget", "a large bolt of good quality", "cold ring economy")


@query(f"""WITH q AS (SELECT unnest({list(WANTED)}) AS text), pr AS (SELECT DISTINCT p_name AS src, p_type AS dst FROM part),
near AS (SELECT src AS id, array_to_string(list(dst ORDER BY dst)[1:3], ' ') AS near FROM pr GROUP BY src), d AS (SELECT id, id || ' ' || near || ' ' || 'part' AS text FROM near),
r AS (SELECT 'q' || text AS key, text FROM q UNION ALL SELECT 'd' || id, text FROM d), {embedded_sql('r')},
s AS (SELECT a.key[2:] AS query, b.key[2:] AS id, round(sum(a.weight * b.weight), 6) AS similarity FROM e a JOIN e b USING (dim) WHERE a.key[1] = 'q' AND b.key[1] = 'd' GROUP BY ALL)
SELECT query, id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.3) WHERE rank <= 5""")
def semantic_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Part names, described by themselves and the types they come in, that are most like three wishes."""
    part = table(spark, d, "part")
    nodes = part.select(F.col("p_name").alias("id")).distinct().withColumn("type", F.lit("part"))
    edges = part.select(F.col("p_name").alias("src"), F.col("p_type").alias("dst"))
    wishes = spark.range(1).select(F.explode(F.array(*(F.lit(w) for w in WANTED))).alias("query")).withColumn("text", F.col("query"))
    return entry.entry_points(entry.described(nodes, edges, nodes.select("id", F.lit(None).cast("string").alias("text"))), wishes)


@query(f"""WITH RECURSIVE {BASES}, walk AS (SELECT node, base AS x FROM b UNION SELECT walk.node, b.base FROM walk JOIN b ON b.node = walk.x), c AS (SELECT node FROM walk WHERE node = x)
SELECT node AS src, base AS dst, 'is-a' AS relation FROM b WHERE NOT (node IN (SELECT node FROM c) AND base IN (SELECT node FROM c) AND node >= base)""")
def guarded_edges(spark: SparkSession, d: str) -> DataFrame:
    """Bases of parts as a hierarchy without cycles; edges of a relation that is not allowed, and of stop words, go."""
    bases = part_bases(spark, d).select(F.col("node").alias("src"), F.col("base").alias("dst"), F.lit("is-a").alias("relation"))
    nodes = bases.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    more = bases.withColumn("relation", F.lit("likes")).unionByName(bases.select("src", F.lit("the").alias("dst"), "relation"))
    return graph.guarded(bases.unionByName(more), nodes.unionByName(spark.range(1).select(F.lit("the").alias("id"))), ("is-a", "part-of"), voc.STOPWORDS)


@query("""WITH f AS (SELECT user_id, day(ts), hour(ts), list(DISTINCT event_type) AS rules, sum(value) > 150 AS agrees FROM events WHERE event_type <> 'view' GROUP BY ALL),
s AS (SELECT rules[1] AS rule, agrees FROM f WHERE len(rules) = 1) SELECT rule, count(*) FILTER (agrees) AS sole_agree, count(*) FILTER (NOT agrees) AS sole_disagree, round(count(*) FILTER (agrees) / count(*)::DOUBLE, 6) AS confidence
FROM s WHERE rule <> 'click' GROUP BY rule HAVING count(*) >= 5""")
def rule_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Hours of users as files and kinds of their events, views apart, as rules."""
    files = table(spark, d, "events").where("event_type <> 'view'").groupBy("user_id", F.dayofmonth("ts"), F.hour("ts")).agg(F.collect_set("event_type").alias("rules"), (F.sum("value") > 150).alias("agrees"))
    return evaluation.rule_confidence(files, 5, ("click",))


def day(spark: SparkSession, d: str, n: int) -> DataFrame:
    return table(spark, d, "events").where(F.dayofmonth("ts") == n).select("user_id", "event_type")


DAY = "(SELECT user_id, event_type, {1} AS a, {2} AS b FROM events WHERE day(ts) = {0})"


@query(f"SELECT user_id, event_type, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM (SELECT * FROM {DAY.format(1, 1, 0)} UNION ALL SELECT * FROM {DAY.format(2, 0, 1)}) GROUP BY ALL HAVING sum(a) <> sum(b)")
def diagnostics_multiset(spark: SparkSession, d: str) -> DataFrame:
    """What two runs, the events of two days, do not report equally often."""
    rows = evaluation.same_multiset(day(spark, d, 1), day(spark, d, 2), ["user_id", "event_type"])
    return rows.select("user_id", "event_type", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"))


@query("""SELECT item_id, item_id % 4 < 2 AS balanced, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM benchmark""")
def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of the benchmark's texts, and whether parentheses around their sentences are balanced: nested, in a row, left open or closed too early."""
    k, text = F.col("item_id") % 4, F.col("text")
    put = F.when(k == 0, F.concat(F.lit("(("), text, F.lit(") )"))).when(k == 1, F.concat(F.lit("()("), text, F.lit(")"))).when(k == 2, F.concat(F.lit("("), text)).otherwise(F.concat(F.lit(")"), text, F.lit("(")))
    return table(spark, d, "benchmark").select("item_id", tx.balanced(put).alias("balanced"), tx.slug(text).alias("slug"))


@query()
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut into blocks of code and the rest; held against a plain walk over lines in the tests."""
    return chunking.code_blocks(table(spark, d, "documents"))


MARK_ROWS = "mk AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MARKS) + ") x(word, relation))"
TEXT_GRAPH = rf"""WITH n AS (SELECT DISTINCT name FROM (SELECT unnest({TERMS}) AS name FROM benchmark) WHERE length(name) >= 3 AND name NOT IN {STOP_SQL}),
st AS (SELECT doc_id, generate_subscripts(l, 1) AS s, unnest(l) AS t FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[。！？.!?
]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)),
w AS (SELECT doc_id, s, generate_subscripts(l, 1) AS i, unnest(l) AS word FROM (SELECT doc_id, s, {TERMS.replace('text', 't')} AS l FROM st))"""


def text_graph(spark: SparkSession, d: str, with_edges: bool = True) -> tuple[DataFrame, DataFrame | None]:
    named = table(spark, d, "benchmark").select(F.explode(tx.terms(F.col("text"))).alias("name")).where(F.char_length("name") >= 3).distinct()
    return text_graphs.built(table(spark, d, "documents"), named, spark.createDataFrame(list(MARKS), "word string, relation string"), voc.STOPWORDS, with_edges=with_edges)


@query(f"""{TEXT_GRAPH.replace('WITH n', 'WITH RECURSIVE n', 1)}, {MARK_ROWS}, f AS (SELECT w.*, n.name AS entity, mk.relation FROM w LEFT JOIN n ON n.name = w.word LEFT JOIN mk ON mk.word = w.word),
x AS (SELECT doc_id, s, i, relation, last_value(entity IGNORE NULLS) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src,
first_value(entity IGNORE NULLS) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS dst FROM f),
e AS (SELECT src, dst, arg_min(relation, {{'d': doc_id, 's': s, 'i': i}}) AS relation FROM x WHERE relation IS NOT NULL AND src <> dst GROUP BY src, dst), t AS (SELECT src, dst FROM e WHERE relation = 'part-of'),
r AS (SELECT src, dst FROM t UNION SELECT r.src, t.dst FROM r JOIN t ON r.dst = t.src) SELECT src, dst, relation FROM e WHERE NOT (relation = 'part-of' AND src > dst AND EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src))""")
def text_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark as names in all documents, and what relates them."""
    return text_graph(spark, d)[1]


@query(f"""{TEXT_GRAPH}, h AS (SELECT DISTINCT word AS id, doc_id FROM w WHERE word IN (SELECT name FROM n))
SELECT id, count(*) AS n_docs, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS sources FROM h GROUP BY id""")
def text_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return text_graph(spark, d, with_edges=False)[0].withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))
