"""Queries on names and terms: where they stand, how they are written, what they may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names as nm
from tessera.functions import text as tx
from tessera.functions import vocabulary as voc
from tessera.operators import fulltext, node_query, search, search_flow, suggestions
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


ALIAS_CASES = " || ".join(rf"CASE WHEN regexp_matches(lower(p_name), '\b{a}\b') THEN {list(n)} ELSE [] END" for a, n in voc.ALIASES.items())


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct({ALIAS_CASES})), ',') AS expanded FROM part")
def alias_expansion(spark: SparkSession, d: str) -> DataFrame:
    """What the aliases inside parts' names stand for."""
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(nm.aliases_in(F.col("p_name"), voc.ALIASES)), ",").alias("expanded"))


def place_sql(term: str, phrase: bool) -> str:
    left = "" if phrase and " " in term else "[^0-9a-z]"
    pattern = f"(?s)^(.*?){left}{term}{'' if phrase else '(?:es|s)?'}[^0-9a-z]"
    back = 1 if left else 0
    return f"CASE WHEN regexp_matches(' ' || lower(text) || ' ', '{pattern}') THEN length(regexp_extract(' ' || lower(text) || ' ', '{pattern}', 1)) - {1 - back} ELSE -1 END"


@query(f"SELECT doc_id, CAST({place_sql('thing', False)} AS INTEGER) AS name_at, CAST({place_sql('of the', True)} AS INTEGER) AS phrase_at, CAST({place_sql('und', True)} AS INTEGER) AS word_at FROM documents WHERE lang <> 'fr'")
def term_places(spark: SparkSession, d: str) -> DataFrame:
    """Where a name, a phrase and a word first stand in texts."""
    text = F.col("text")
    rows = table(spark, d, "documents").where("lang <> 'fr'")
    return rows.select("doc_id", nm.term_place(text, "thing").alias("name_at"), nm.term_place(text, "of the", phrase=True).alias("phrase_at"), nm.term_place(text, "und", phrase=True).alias("word_at"))


@query("""WITH n AS (SELECT p_partkey, p_type || CASE p_size % 3 WHEN 0 THEN '::' || replace(p_name, ' ', '_') WHEN 1 THEN '.' || replace(p_name, ' ', '::') ELSE '::' || p_name END AS name FROM part)
SELECT p_partkey, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)*$') AS qualified, replace(name, '::', '.') AS dotted FROM n""")
def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    """Which names are made of identifiers, and the names with points between their parts."""
    k = F.col("p_size") % 3
    end = F.when(k == 0, F.concat(F.lit("::"), F.regexp_replace("p_name", " ", "_"))).when(k == 1, F.concat(F.lit("."), F.regexp_replace("p_name", " ", "::"))).otherwise(F.concat(F.lit("::"), "p_name"))
    own = table(spark, d, "part").select("p_partkey", F.concat("p_type", end).alias("name"))
    return own.select("p_partkey", nm.is_qualified(F.col("name")).alias("qualified"), nm.rebuilt(F.col("name")).alias("dotted"))


KIND_SQL = "event_type || '_' || CASE user_id % 3 WHEN 0 THEN 'def' WHEN 1 THEN 'usage' ELSE 'flow_instance' END"


@query(f"""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type || ' def' WHEN user_id % 3 = 1 THEN event_type ELSE event_type || ' flow' END AS keyword,
array_to_string(list_distinct([w]) || CASE WHEN l <> '' AND l <> w THEN [l] ELSE [] END, ',') AS terms, CASE WHEN l = '' THEN {KIND_SQL} ELSE l END AS label
FROM (SELECT *, event_type || CASE WHEN user_id % 3 = 2 THEN ' flow' ELSE '' END AS w, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE 'e' || event_id END AS l FROM events)""")
def element_terms(spark: SparkSession, d: str) -> DataFrame:
    """How kinds are written, what to search for an element, and what to call it; events stand for elements."""
    k, n = F.col("user_id") % 3, F.col("event_id") % 4
    kind = F.concat_ws("_", "event_type", F.when(k == 0, "def").when(k == 1, "usage").otherwise("flow_instance"))
    own = F.when(n == 0, "").when(n == 1, F.col("event_type")).otherwise(F.concat(F.lit("e"), "event_id"))
    rows = table(spark, d, "events").select("event_id", kind.alias("kind"), own.alias("own"))
    return rows.select("event_id", nm.keyword(F.col("kind")).alias("keyword"), F.array_join(nm.search_terms(F.col("kind"), F.col("own")), ",").alias("terms"), nm.label(F.col("own"), F.col("kind")).alias("label"))


@query("""WITH n AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'Part' || CASE event_id % 2 WHEN 0 THEN 'Usage' ELSE 'Definition' END WHEN 1 THEN 'ViewpointDefinition' WHEN 2 THEN 'viewpointusage' WHEN 3 THEN 'namespace' WHEN 4 THEN event_type ELSE 'my' || event_type || 'port' END AS name FROM events)
SELECT event_id, CASE WHEN lower(name) IN ('partusage', 'partdefinition') THEN 1.0::DOUBLE WHEN name = 'ViewpointDefinition' THEN 0.8::DOUBLE WHEN name = 'namespace' THEN 0.6::DOUBLE WHEN regexp_matches(name, 'usage|port|part|item|case') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS priority FROM n""")
def domain_priorities(spark: SparkSession, d: str) -> DataFrame:
    """How central names are; names are made of events."""
    k = F.col("user_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("Part"), F.when(F.col("event_id") % 2 == 0, "Usage").otherwise("Definition"))).when(k == 1, "ViewpointDefinition").when(k == 2, "viewpointusage").when(k == 3, "namespace")
        .when(k == 4, F.col("event_type")).otherwise(F.concat(F.lit("my"), "event_type", F.lit("port")))
    )
    return table(spark, d, "events").select("event_id", nm.domain_priority(name).alias("priority"))


MEMBERS = "m AS (SELECT DISTINCT p_brand AS package, p_name || CASE WHEN p_size % 4 = 0 THEN 'Value' ELSE '' END AS member FROM part), a AS (SELECT DISTINCT p_brand AS package, CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(split_part(p_name, ' ', 2)) ELSE 'x' || p_name END AS name FROM part WHERE p_partkey % 5 = 0)"


def member_names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members of brands, and names that were asked for and may not exist: beginnings, words in capitals, misspelt names."""
    part, k = table(spark, d, "part"), F.col("p_size") % 3
    members = part.select(F.col("p_brand").alias("package"), F.concat("p_name", F.when(F.col("p_size") % 4 == 0, "Value").otherwise("")).alias("name")).distinct()
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    asked = part.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("package"), F.when(k == 0, word(1)).when(k == 1, F.upper(word(2))).otherwise(F.concat(F.lit("x"), "p_name")).alias("name")).distinct()
    return asked, members


@query(f"""WITH {MEMBERS}, s AS (SELECT package, name, member, round(1 - levenshtein(name, member) / greatest(length(name), length(member), 1), 6) AS alike, starts_with(member, name) AS b, contains(lower(member), lower(name)) AS c FROM a JOIN m USING (package) WHERE member <> name),
k AS (SELECT *, CASE WHEN b THEN 0 WHEN c THEN 1 WHEN alike >= 0.75 THEN 2 END AS kind FROM s)
SELECT package, name, CAST(rank AS INTEGER) AS rank, package || '::' || CASE WHEN regexp_matches(member, '^[A-Za-z_][A-Za-z0-9_]*$') THEN member ELSE '''' || member || '''' END AS suggestion FROM
(SELECT *, row_number() OVER (PARTITION BY package, name ORDER BY kind, CASE WHEN kind = 2 THEN -alike WHEN ends_with(member, 'Value') THEN 0 ELSE 1 END, CASE WHEN kind = 2 THEN 0 ELSE length(member) END, member) AS rank FROM k WHERE kind IS NOT NULL) WHERE rank <= 3""")
def member_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """What was probably meant by names that a package does not have."""
    return suggestions.similar_members(*member_names(spark, d))


@query(f"""WITH {MEMBERS}, p AS (SELECT DISTINCT member AS name, package FROM m) SELECT name, CAST(rank AS INTEGER) AS rank, package FROM
(SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE package WHEN 'Brand#7' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END, length(package), package) AS rank FROM p) WHERE rank <= 2""")
def import_hints(spark: SparkSession, d: str) -> DataFrame:
    """Two packages that each name could be imported from."""
    _, members = member_names(spark, d)
    return suggestions.import_hints(members.select("name"), members, ("Brand#7", "Brand#12"))


QUESTIONS = [(1, "ring"), (2, "a small thing of steel"), (3, "nothing fits"), (4, "WIDGET")]
PART_GRAPH = """n AS (SELECT DISTINCT p_name AS id FROM part UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part), e AS (SELECT DISTINCT p_name AS a, unnest(string_split(p_name, ' ')) AS b FROM part),
u AS (SELECT a AS src, b AS dst FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)"""


@query(f"""WITH {PART_GRAPH}, q AS (SELECT query, lower(term) AS term FROM (VALUES {', '.join(f"({q}, '{t}')" for q, t in QUESTIONS)}) x(query, term)),
named AS (SELECT query, id, round(CASE WHEN lower(id) = term THEN 1.0::DOUBLE ELSE 0.2::DOUBLE + 0.3::DOUBLE * length(term) / length(id) END, 6) AS score, 'name' AS way FROM n JOIN q ON contains(lower(id), term)),
qw AS (SELECT query, len(w) AS total, unnest(w) AS word FROM (SELECT query, list_distinct(list_filter(string_split(term, ' '), lambda x: length(x) >= 3)) AS w FROM q WHERE query NOT IN (SELECT query FROM named))),
nw AS (SELECT DISTINCT id, unnest(list_filter(string_split(lower(id), ' '), lambda x: length(x) >= 3)) AS word FROM n),
found AS (SELECT * FROM named UNION ALL SELECT query, id, round(count(*) / total::DOUBLE, 6), 'words' FROM qw JOIN nw USING (word) GROUP BY query, id, total),
f AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5),
l1 AS (SELECT query, dst AS id, count(*) AS ways FROM f JOIN u ON src = id WHERE (query, dst) NOT IN (SELECT (query, id) FROM f) GROUP BY query, dst),
l2 AS (SELECT query, dst AS id, count(*) AS ways FROM l1 JOIN u ON src = id WHERE (query, dst) NOT IN (SELECT (query, id) FROM f) AND (query, dst) NOT IN (SELECT (query, id) FROM l1) GROUP BY query, dst),
a AS (SELECT * FROM (SELECT *, 1 AS distance FROM l1 UNION ALL SELECT *, 2 FROM l2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, ways DESC, id) <= 20),
r AS (SELECT query, way, id, score, 0 AS distance FROM f UNION ALL SELECT query, 'around', id, 0.0, distance FROM a), s AS (SELECT p_name AS id, array_to_string(list(p_partkey ORDER BY p_partkey)[1:3], ',') AS sources FROM part GROUP BY p_name)
SELECT CAST(query AS BIGINT) AS query, way, id, CAST(score AS DOUBLE) AS score, CAST(distance AS INTEGER) AS distance, sources FROM r LEFT JOIN s USING (id)""")
def graph_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions to the graph of parts' names and their words: what is named, what shares words, what lies around, and the parts they come from."""
    part = table(spark, d, "part")
    has = part.select(F.col("p_name").alias("src"), F.explode(F.split("p_name", " ")).alias("dst"), F.lit("has").alias("relation")).distinct()
    nodes = has.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    asked = spark.createDataFrame(QUESTIONS, "query long, term string")
    found = node_query.answered(asked, nodes, has, part.select(F.col("p_name").alias("id"), F.col("p_partkey").alias("text_id")))
    return found.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query()
def hybrid_search_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole search for every hundredth document with a vector: nearest vectors and best words, fused, widened along neighbouring ids, filtered, re-ranked and made diverse; tests hold its steps against plain loops."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    both = docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select(F.col("doc_id").alias("id"), "source", "lang", "text", "embedding")
    asked = both.where("id % 100 = 0")
    near = search.neighbours(vectors, asked.select(F.col("id").alias("query"), F.col("embedding").alias("q")), 20).select("query", F.col("vec_id").alias("id"), F.col("rank").alias("pos"))
    words = asked.select(F.col("id").alias("query"), F.slice(F.array_distinct(tx.terms(F.col("text"))), 1, 3).alias("terms"))
    best = fulltext.bm25(docs, words, 20).select("query", F.col("doc_id").alias("id"), F.col("rank").alias("pos"))
    edges = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"), F.lit("next").alias("relation")).where("src % 10 < 9")
    queries = asked.select(F.col("id").alias("query"), F.array_join(F.slice(tx.terms(F.col("text")), 1, 3), " ").alias("text"))
    return search_flow.searched(queries, near, best, edges, both, 10, 2, keep=F.col("lang") != "de")
