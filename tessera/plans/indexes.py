"""Queries on stored indexes of vectors and words, and on names inside texts; each builds its index over the whole table and searches that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import inverted, substrings, vector_index
from tessera.operators.staging import folder
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def indexed_vectors(spark: SparkSession, d: str, cells: int) -> tuple[DataFrame, DataFrame, vector_index.Codebooks]:
    """The index read back, every hundredth vector as a query, and the codebooks."""
    vectors, path = table(spark, d, "embeddings"), f"{folder(spark)}/vectors-{uuid.uuid4().hex}"
    books = vector_index.fit(vectors, cells=cells, slices=16)
    vector_index.add(vectors, books, path)
    return spark.read.parquet(path), vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), books


@query()
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """About the ten nearest of every hundredth vector: three quarters of 16 cells are probed; tests hold its recall against all vectors."""
    index, queries, books = indexed_vectors(spark, d, 16)
    return vector_index.search(index, queries, books, 10, probes=12, rerank=150)


@query("""SELECT query, vec_id, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 10""")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same with all cells probed and a thousand candidates ranked again, which gives the exact ten."""
    index, queries, books = indexed_vectors(spark, d, 8)
    return vector_index.search(index, queries, books, 10, probes=8, rerank=1000)


#: Searches by clauses: query, clause, kind, op, terms, distance.
SEARCHES = [
    (1, 1, "must", "all", ["the", "and"], 0), (2, 1, "should", "any", ["le", "und"], 0), (2, 2, "not", "any", ["the"], 0), (3, 1, "must", "near", ["the", "and"], 1), (3, 2, "not", "all", ["of"], 0),
    (4, 1, "must", "phrase", ["in", "the"], 0), (4, 2, "should", "all", ["is"], 0), (5, 1, "must", "phrase", ["license", "version"], 0), (6, 1, "must", "any", ["license", "copyright"], 0), (6, 2, "not", "all", ["version"], 0),
]
TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def holds(op: str, terms: list[str], distance: int) -> str:
    """SQL for whether the tokens w meet a clause."""
    every = " AND ".join(f"list_contains(w, '{t}')" for t in terms)
    if op == "any":
        return "(" + every.replace(" AND ", " OR ") + ")"
    if op == "phrase":
        return f"contains(' ' || array_to_string(w, ' ') || ' ', ' {' '.join(terms)} ')"
    if op == "near":
        a, b = terms
        return f"(len(list_filter(range(1, len(w)), lambda i: (w[i] = '{a}' AND w[i + 1] = '{b}') OR (w[i] = '{b}' AND w[i + 1] = '{a}'))) > 0)"
    return f"({every})"


def searches_sql(k: int) -> str:
    rows, words = [], []
    for q in sorted({c[0] for c in SEARCHES}):
        own = [c for c in SEARCHES if c[0] == q]
        of = lambda kind: [holds(op, terms, distance) for _, _, c, op, terms, distance in own if c == kind]  # noqa: E731, B023
        must, should, without = of("must"), of("should"), of("not")
        rule = must + [f"NOT {x}" for x in without] + ([f"({' OR '.join(should)})"] if should and not must else [])
        rows.append(f"SELECT {q} AS query, doc_id, w FROM d WHERE {' AND '.join(rule)}")
        words += [f"({q}, '{t}')" for t in sorted({t for _, _, kind, _, terms, _ in own if kind != "not" for t in terms})]
    return f"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d), asked AS (SELECT * FROM (VALUES {', '.join(words)}) x(query, term)),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM asked) JOIN d ON list_contains(w, term) GROUP BY term), kept AS ({' UNION ALL '.join(rows)}),
tf AS (SELECT query, doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS len FROM kept JOIN asked USING (query)),
s AS (SELECT query, doc_id, round(sum(CASE WHEN tf = 0 THEN 0 ELSE ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) END), 6) AS bm25 FROM tf JOIN df USING (term) CROSS JOIN n GROUP BY query, doc_id)
SELECT CAST(query AS BIGINT) AS query, doc_id, bm25, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc_id) AS rank FROM s WHERE bm25 > 0) WHERE rank <= {k}"""


@query(searches_sql(20))
def word_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best documents of searches with words that must, may or must not occur, in a row or near each other."""
    path = f"{folder(spark)}/words-{uuid.uuid4().hex}"
    inverted.add(table(spark, d, "documents"), path)
    return inverted.search(spark, path, spark.createDataFrame(SEARCHES, "query long, clause long, kind string, op string, terms array<string>, distance int"), 20)


ELEMENTS = "el AS (SELECT DISTINCT 'Bench::' || substring(text, 1, 14) AS element, substring(text, 1, 14) AS name FROM benchmark WHERE text NOT LIKE '%.%' OR strpos(text, '.') > 14)"


@query(f"WITH {ELEMENTS} SELECT DISTINCT element, doc_id FROM el JOIN documents ON contains(text, name) OR contains(text, element)")
def element_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the first letters of benchmark items, which stand for names of elements, anywhere inside."""
    first = F.substring("text", 1, 14)
    elements = table(spark, d, "benchmark").where("text NOT LIKE '%.%' OR instr(text, '.') > 14").select(F.concat(F.lit("Bench::"), first).alias("element")).distinct()
    return substrings.short_or_full(elements, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("element", F.col("id").alias("doc_id"))


@query(f"""WITH {ELEMENTS}, h AS (SELECT DISTINCT element, doc_id FROM el JOIN documents ON contains(text, name) OR contains(text, element)), e AS (SELECT a.element AS src, min(b.element) AS dst FROM el a JOIN el b ON b.element > a.element GROUP BY a.element)
SELECT DISTINCT src, dst, 'next' AS relation, x.doc_id AS source_id, y.doc_id AS target_id FROM e JOIN h x ON x.element = src JOIN h y ON y.element = dst WHERE x.doc_id <> y.doc_id""")
def element_relations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that mention an element and the next one in order of names."""
    hits = element_mentions(spark, d).withColumnRenamed("doc_id", "id")
    first = F.substring("text", 1, 14)
    own = table(spark, d, "benchmark").where("text NOT LIKE '%.%' OR instr(text, '.') > 14").select(F.concat(F.lit("Bench::"), first).alias("src")).distinct()
    pairs = own.join(own.withColumnRenamed("src", "dst"), F.col("dst") > F.col("src")).groupBy("src").agg(F.min("dst").alias("dst"))  # of the benchmark's items alone
    edges = pairs.withColumn("relation", F.lit("next"))
    return substrings.pairs(edges, hits)
