"""Queries on names, words and relations found in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vocabulary as voc
from tessera.operators import expansion
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS node_name FROM part")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.normal_name(F.concat_ws(" ", "p_name", "p_brand")).alias("node_name"))


IRREGULAR_SQL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}' WHEN '{v}' THEN '{k}'" for k, v in tx.IRREGULAR.items()) + " END"


@query(f"""SELECT w AS word, CASE WHEN o = w THEN w ELSE w || ',' || o END AS variants FROM (SELECT w, coalesce({IRREGULAR_SQL}, CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN w[:-4] || 'y' WHEN w LIKE '%es' AND length(w) > 3 THEN w[:-3]
WHEN w LIKE '%s' AND length(w) > 2 THEN w[:-2] WHEN regexp_matches(w, '[^aeiou]y$') THEN w[:-2] || 'ies' WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' ELSE w || 's' END) AS o
FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part))""")
def plural_variants(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", F.array_join(tx.variants(F.col("word")), ",").alias("variants"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of part names as node names, with their degree: the parts that have them."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"), "p_partkey")
    return words.groupBy("name").agg(F.countDistinct("p_partkey").alias("degree"))


NAMES = "names AS (SELECT name, count(DISTINCT p_partkey) AS degree FROM (SELECT unnest(string_split(p_name, ' ')) AS name, p_partkey FROM part) GROUP BY name)"


@query(f"""WITH {NAMES} SELECT name, round(least(1, base + 0.2::DOUBLE * degree / top), 6) AS score FROM (SELECT name, degree, max(degree) OVER () AS top, CASE WHEN lower(name) = 'red in' THEN 1 WHEN contains(lower(name), 'red') OR contains(lower(name), 'in')
THEN greatest(CASE WHEN contains(lower(name), 'red') THEN 0.2::DOUBLE + 0.9::DOUBLE / length(name) ELSE 0 END, CASE WHEN contains(lower(name), 'in') THEN 0.2::DOUBLE + 0.6::DOUBLE / length(name) ELSE 0 END) END AS base FROM names) WHERE base IS NOT NULL""")
def node_search_scored(spark: SparkSession, d: str) -> DataFrame:
    return expansion.node_scores(names(spark, d), "red in")


@query(f"""WITH {NAMES} SELECT name, round(0.4::DOUBLE * (3.0::DOUBLE / length(name)) + 0.3::DOUBLE * degree / (SELECT max(degree) FROM names) + 0.3::DOUBLE, 6) AS quality FROM names WHERE contains(name, 'red') OR name IN ('ring', 'bolt')""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by keyword or by the concept's subconcepts; quality of 0.4 name, 0.3 centrality and 0.3 domain."""
    rows = names(spark, d)
    found = rows.join(F.broadcast(rows.agg(F.max("degree").alias("top"))))  # one row
    found = found.where(F.contains("name", F.lit("red")) | F.col("name").isin("ring", "bolt"))
    return found.select("name", F.round(0.4 * (3 / F.char_length("name")) + 0.3 * F.col("degree") / F.col("top") + 0.3, 6).alias("quality"))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in voc.STOPWORDS) + ")"


@query(rf"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)
SELECT DISTINCT item_id, phrase FROM (SELECT item_id, unnest(w) AS phrase FROM w UNION ALL
SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w) UNION ALL
SELECT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)) WHERE length(phrase) >= 3 AND phrase NOT IN {STOP_SQL}""")
def keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """Words, pairs and triples of words of each query, without stop words and short ones."""
    rows = table(spark, d, "benchmark").select("item_id", tx.terms(F.col("text")).alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    phrases = rows.select("item_id", F.explode(F.array_distinct(F.concat("w", runs(2), runs(3)))).alias("phrase"))
    return phrases.where((F.char_length("phrase") >= 3) & ~F.col("phrase").isin(*voc.STOPWORDS))


#: Words of a question, some of them misspelt or aliases.
ASKED = ("ring", "rings", "boltt", "screw", "wigdet", "blue", "bleu", "gadget", "small", "smal")


def asked(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(w) for w in ASKED))).alias("term"))


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, v) for a, vs in voc.ALIASES.items() for v in vs], "alias string, variant string")


ASKED_SQL = f"t AS (SELECT unnest({list(ASKED)}) AS term), al AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{v}')" for a, vs in voc.ALIASES.items() for v in vs) + ") x(alias, variant))"
EXACT = "SELECT term, name, 1.0::DOUBLE AS score, 'exact' AS match FROM t JOIN names ON lower(name) = term"
ALIAS = "SELECT term, name, 0.8::DOUBLE AS score, 'alias' AS match FROM t JOIN al ON term = variant JOIN names ON lower(name) = alias"
FUZZY = "SELECT term, name, round(1 - 1::DOUBLE / greatest(length(term), length(name)), 9) AS score, 'fuzzy' AS match FROM t JOIN names ON levenshtein(term, lower(name)) = 1 WHERE 1 - 1::DOUBLE / greatest(length(term), length(name)) >= 0.6"


@query(f"WITH {NAMES}, {ASKED_SQL} {EXACT}")
def expand_exact(spark: SparkSession, d: str) -> DataFrame:
    return expansion.exact(asked(spark), names(spark, d))


@query(f"WITH {NAMES}, {ASKED_SQL} {ALIAS}")
def expand_alias(spark: SparkSession, d: str) -> DataFrame:
    return expansion.by_alias(asked(spark), names(spark, d), alias_table(spark))


@query(f"WITH {NAMES}, {ASKED_SQL} {FUZZY}")
def expand_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return expansion.fuzzy(asked(spark), names(spark, d))


@query(f"""WITH {NAMES}, {ASKED_SQL}, c AS ({EXACT} UNION ALL {ALIAS} UNION ALL {FUZZY})
SELECT name, round(least(1, max(score) + 0.05::DOUBLE * (count(DISTINCT match) - 1)), 9) AS score, count(*) AS n_matches, min({{'x': -score, 'match': match, 'term': term}}).match AS best_match FROM c GROUP BY name""")
def expand_all(spark: SparkSession, d: str) -> DataFrame:
    t, n = asked(spark), names(spark, d)
    return expansion.folded(expansion.exact(t, n).unionByName(expansion.by_alias(t, n, alias_table(spark))).unionByName(expansion.fuzzy(t, n)))


def ends(column: str, endings: tuple[str, ...]):
    return F.col(column).rlike("(" + "|".join(endings) + ")$")


WORD_SQL = r"SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents"


@query(f"""SELECT concept_type, count(*) AS n FROM (SELECT CASE WHEN (identity::INT + persistent::INT + referable::INT + (attributes > 0)::INT) >= 3 THEN 'ENTITY' WHEN persistent AND referable THEN 'RELATION' WHEN NOT persistent AND referable THEN 'EVENT' ELSE 'VALUE' END AS concept_type
FROM (SELECT w, regexp_matches(w, '[0-9]') OR length(w) >= 12 AS identity, NOT regexp_matches(w, '({"|".join(voc.EVENT_ENDINGS)})$') AS persistent, length(w) >= 4 AND w NOT IN {STOP_SQL} AS referable, CASE WHEN regexp_matches(w, '({"|".join(voc.ABSTRACT_ENDINGS)})$') THEN 3 ELSE 0 END AS attributes FROM ({WORD_SQL}))) GROUP BY concept_type""")
def concept_classify(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents as concepts: three of four features make an entity; else relation, event or value."""
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("w")).distinct()
    w = w.select(
        (F.col("w").rlike("[0-9]") | (F.char_length("w") >= 12)).alias("identity"), (~ends("w", voc.EVENT_ENDINGS)).alias("persistent"),
        ((F.char_length("w") >= 4) & ~F.col("w").isin(*voc.STOPWORDS)).alias("referable"), ends("w", voc.ABSTRACT_ENDINGS).alias("abstract"),
    )
    score = sum(F.col(c).cast("int") for c in ("identity", "persistent", "referable", "abstract"))
    kind = F.when(score >= 3, "ENTITY").when(F.col("persistent") & F.col("referable"), "RELATION").when(~F.col("persistent") & F.col("referable"), "EVENT").otherwise("VALUE")
    return w.groupBy(kind.alias("concept_type")).agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM conversations)),
n AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM w WHERE length(w) >= 3)
SELECT conv_id, turn, CAST(min(pos) - 1 AS INTEGER) AS start, string_agg(w, ' ' ORDER BY pos) AS compound, count(*) AS n_words FROM n GROUP BY conv_id, turn, island HAVING count(*) >= 2""")
def noun_runs(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of words that may be names (three letters and more): gaps and islands within each turn."""
    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(tx.terms(F.col("text"))).alias("pos", "w")).where(F.char_length("w") >= 3)
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    islands = words.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("conv_id", "turn", "island")
    runs = islands.agg(F.min("pos").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("compound"), F.count("*").alias("n_words"))
    return runs.where("n_words >= 2").drop("island")


SYNONYM_SQL = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(voc.TOOL_SYNONYMS)) + ") x(ord, word, relation))"


@query(f"WITH {SYNONYM_SQL} SELECT event_type, relation, count(*) AS n FROM (SELECT event_id, event_type, arg_min(relation, {{'a': (word <> event_type)::INT, 'b': ord}}) AS relation FROM events JOIN s ON contains(event_type, word) GROUP BY 1, 2) GROUP BY 1, 2")
def relation_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Types of events as relations: a whole match first, then a part of the name, in the vocabulary's order."""
    syn = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(voc.TOOL_SYNONYMS)], "ord int, word string, relation string")
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    met = counts.join(F.broadcast(syn), F.contains("event_type", F.col("word")))
    best = F.min_by("relation", F.struct((F.col("word") != F.col("event_type")).cast("int"), F.col("ord")))
    return met.groupBy("event_type", "n").agg(best.alias("relation")).select("event_type", "relation", "n")


#: Words that stand for relations in these tables' invented language.
MARKS = (("with", "uses"), ("for", "satisfies"), ("from", "depends-on"), ("of", "part-of"))
MARK_SQL = "CASE w[i] " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MARKS) + " END"


@query(rf"""WITH s AS (SELECT doc_id, pos, list_filter(string_split_regex(lower(s), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM
(SELECT doc_id, string_split_regex(text, '[。！？.!?\n]+') AS l FROM documents))),
e AS (SELECT doc_id, pos, i, list_filter(w[1 : i - 1], lambda x: length(x) >= 3) AS a, {MARK_SQL} AS relation, list_filter(w[i + 1 :], lambda x: length(x) >= 3) AS b FROM (SELECT doc_id, pos, w, unnest(generate_series(1, len(w))) AS i FROM s) WHERE w[i] IN ('with', 'for', 'from', 'of'))
SELECT src, dst, arg_min(relation, {{'d': doc_id, 'p': pos, 'i': i}}) AS relation FROM (SELECT doc_id, pos, i, a[-1] AS src, b[1] AS dst, relation FROM e WHERE len(a) > 0 AND len(b) > 0) WHERE src <> dst GROUP BY src, dst""")
def sentence_relations(spark: SparkSession, d: str) -> DataFrame:
    """Nearest name (three letters and more, the least length of one) before and after each relation word of a sentence; the first relation of a pair stays."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "[。！？.!?\n]+")).alias("pos", "s")).select("doc_id", "pos", tx.terms(F.col("s")).alias("w"))
    at = s.select("doc_id", "pos", "w", F.posexplode("w").alias("i", "word")).where(F.col("word").isin(*(a for a, _ in MARKS)))
    entity = lambda x: F.char_length(x) >= 3
    a, b = F.filter(F.slice("w", 1, F.col("i")), entity), F.filter(F.slice("w", F.col("i") + 2, F.size("w")), entity)
    relation = F.lit(None).cast("string")
    for word, name in MARKS:
        relation = F.when(F.col("word") == word, name).otherwise(relation)
    edges = at.select("doc_id", "pos", "i", F.try_element_at(a, F.lit(-1)).alias("src"), F.try_element_at(b, F.lit(1)).alias("dst"), relation.alias("relation")).where("src <> dst")
    return edges.groupBy("src", "dst").agg(F.min_by("relation", F.struct("doc_id", "pos", "i")).alias("relation"))


@query(r"""WITH n AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3)) AS name FROM benchmark),
t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3)) AS name FROM documents)
SELECT name, doc_id FROM (SELECT name, doc_id, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM n JOIN t USING (name)) WHERE r <= 5""")
def entity_chunk_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents that hold each entity name of the benchmark as a word: an equi-join on words."""
    long = F.filter(tx.terms(F.col("text")), lambda x: F.char_length(x) >= 3)
    own = table(spark, d, "benchmark").select(F.explode(long).alias("name")).distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(long)).alias("name"))
    order = Window.partitionBy("name").orderBy("doc_id")
    return words.join(own, "name", "left_semi").withColumn("r", F.row_number().over(order)).where("r <= 5").select("name", "doc_id")


@query(r"""SELECT doc_id, pos AS line_no, kind FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
(SELECT unnest(['constraint', 'clause', 'term']) AS kind) WHERE (kind = 'constraint' AND regexp_matches(s, '(^|[^A-Za-z])(must|shall|should|rights)([^A-Za-z]|$)')) OR (kind = 'clause' AND regexp_matches(s, '^[0-9]+([.][0-9]+)*[.)]? ')) OR (kind = 'term' AND regexp_matches(s, '^[A-Za-z][A-Za-z ]{0,30}: '))""")
def rule_entities(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that state a constraint, begin a numbered clause or define a term."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "s"))
    kinds = F.array_compact(F.array(
        F.when(F.col("s").rlike("(^|[^A-Za-z])(must|shall|should|rights)([^A-Za-z]|$)"), "constraint"), F.when(F.col("s").rlike("^[0-9]+([.][0-9]+)*[.)]? "), "clause"), F.when(F.col("s").rlike("^[A-Za-z][A-Za-z ]{0,30}: "), "term"),
    ))
    return lines.select("doc_id", "line_no", F.explode(kinds).alias("kind"))
