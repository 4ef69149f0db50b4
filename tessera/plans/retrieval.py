"""Queries on retrieval: scans, full text, vectors, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, fulltext, fusion, search
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' AND n_chars >= 200 ORDER BY n_chars DESC, doc_id LIMIT 50")
def meta_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where((F.col("lang") == "en") & (F.col("source") == "src3") & (F.col("n_chars") >= 200))
    return rows.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


IDS = [42, 7, 999_999_999, 7, 0, 13]


@query(f"SELECT CAST(i.pos - 1 AS INTEGER) AS pos, doc_id, n_chars FROM (SELECT unnest({IDS}) AS id, generate_subscripts({IDS}, 1) AS pos) i JOIN documents ON doc_id = i.id")
def chunks_by_ids_in_order(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in IDS))).alias("pos", "doc_id"))
    return F.broadcast(asked).join(table(spark, d, "documents"), "doc_id").select("pos", "doc_id", "n_chars").orderBy("pos")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 10 AND turn BETWEEN 0 AND 3")
def chunk_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id = 10 AND turn BETWEEN 0 AND 3").select("conv_id", "turn", "role", "text").orderBy("turn")


@query("SELECT conv_id, count(*) AS n_chunks, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.min_by("role", "turn").alias("first_role"))


@query("""SELECT page_id, CASE WHEN e IN ('md', 'markdown') THEN 'md' WHEN e IN ('pdf', 'docx', 'xlsx', 'pptx', 'sysml') THEN e ELSE 'txt' END AS file_type
FROM (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS e FROM pages)""")
def file_type_from_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.file_type(F.col("url")).alias("file_type"))


TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

@query(f"""WITH q AS (SELECT item_id AS query, unnest(list_distinct({TERMS})) AS term FROM benchmark),
t AS (SELECT doc_id, {TERMS} AS t FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM t),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS bm25, count(*) AS got
      FROM q JOIN p USING (term) JOIN df USING (term), n GROUP BY query, doc_id)
SELECT query, doc_id, bm25, CAST(rank AS INTEGER) AS rank FROM (SELECT query, doc_id, bm25, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc_id) AS rank
FROM s WHERE got = (SELECT count(*) FROM q x WHERE x.query = s.query)) WHERE rank <= 10""")
def fulltext_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents that hold all words of each query."""
    return fulltext.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query"), tx.terms(F.col("text")).alias("terms")), 10)


#: A query in clauses: all clauses have to be met, each by any of its terms, which are words, beginnings of words or phrases.
CLAUSES = ((0, "word", "worthless"), (0, "word", "idiot"), (1, "prefix", "th"), (2, "phrase", "of the"), (2, "phrase", "in the"), (2, "word", "was"))


@query(rf"""WITH t AS (SELECT doc_id, {TERMS} AS t FROM documents), c AS (SELECT * FROM (VALUES {", ".join(map(str, CLAUSES))}) x(clause, kind, term)),
m AS (SELECT DISTINCT doc_id, clause FROM t, c WHERE (kind = 'word' AND list_contains(t, term)) OR (kind = 'prefix' AND len(list_filter(t, lambda w: starts_with(w, term))) > 0)
OR (kind = 'phrase' AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || term || ' ')))
SELECT 'q' AS query, doc_id FROM m GROUP BY doc_id HAVING count(*) = 3""")
def fulltext_clauses(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("q", *c) for c in CLAUSES], "query string, clause int, kind string, term string")
    return fulltext.by_clauses(table(spark, d, "documents"), asked)


@query("SELECT doc_id, n_chars, CAST(NULL AS DOUBLE) AS bm25 FROM documents WHERE contains(text, 'worthless') ORDER BY n_chars DESC, doc_id LIMIT 20")
def fulltext_like_fallback(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.like(table(spark, d, "documents"), "worthless", 20)


def like_first(spark: SparkSession, d: str, k: int) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return search.top_k(vectors, vectors.where("vec_id = 0").select(F.col("embedding").alias("q")), k)


COSINE = "round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
NEAR_FIRST = f"SELECT v.vec_id, v.label, {COSINE} AS cosine FROM embeddings v, embeddings q WHERE q.vec_id = 0 ORDER BY cosine DESC, v.vec_id LIMIT "


@query(NEAR_FIRST + "20")
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return like_first(spark, d, 20).select("vec_id", "label", "cosine")


@query(f"SELECT * FROM ({NEAR_FIRST}50) WHERE label = 3")
def vector_filtered_postfilter(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes after the top k, so fewer rows may be left."""
    return like_first(spark, d, 50).select("vec_id", "label", "cosine").where("label = 3")


@query(f"""SELECT query, vec_id, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, {COSINE} AS cosine,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 10""")
def vector_knn_query_set(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    vectors = table(spark, d, "embeddings")
    return search.neighbours(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 10)


def two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, pos, distance) by likeness to the first vector, and (id, pos, bm25) by how often a text says `the`."""
    vector = like_first(spark, d, 30).select(F.col("vec_id").alias("id"), F.round(1 - F.col("cosine"), 6).alias("distance"))
    docs = table(spark, d, "documents")
    share = F.round((F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("the"), F.lit("")))) / F.col("n_chars"), 6)
    text = docs.select(F.col("doc_id").alias("id"), share.alias("bm25")).orderBy(F.desc("bm25"), "id").limit(30)
    return fusion.ranked(vector, [F.col("distance"), F.col("id")]), fusion.ranked(text, [F.desc("bm25"), F.col("id")])


LISTS = f"""v AS (SELECT vec_id AS id, round(1 - cosine, 6) AS distance, row_number() OVER (ORDER BY round(1 - cosine, 6), vec_id) AS pos FROM ({NEAR_FIRST}30)),
t AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS pos FROM (SELECT doc_id AS id, round((length(text) - length(replace(text, 'the', ''))) / n_chars, 6) AS bm25 FROM documents ORDER BY bm25 DESC, id LIMIT 30))"""


def fused_sql(vector: str, text: str, wv: str, wt: str) -> str:
    return f"""WITH {LISTS}, a AS (SELECT id, {vector} AS s FROM v), b AS (SELECT id, {text} AS s FROM t)
SELECT id, round(coalesce(a.s, 0), 9) AS score_vector, round(coalesce(b.s, 0), 9) AS score_text, round({wv}::DOUBLE * coalesce(a.s, 0) + {wt}::DOUBLE * coalesce(b.s, 0), 9) AS score_hybrid FROM a FULL JOIN b USING (id)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.round(c, 9).alias(c) for c in ("score_vector", "score_text", "score_hybrid"))).orderBy(F.desc("score_hybrid"), "id")


@query(fused_sql("CAST(30 - pos + 1 AS DOUBLE) / 30", "CAST(30 - pos + 1 AS DOUBLE) / 30", "0.7", "0.3"))
def fusion_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.by_rank(*two_lists(spark, d)))


@query(fused_sql("1.0::DOUBLE / (60 + pos)", "1.0::DOUBLE / (60 + pos)", "1", "1"))
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.by_reciprocal_rank(*two_lists(spark, d)))


@query(fused_sql(
    "CASE WHEN max(distance) OVER () = min(distance) OVER () THEN 1 ELSE 1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) END",
    "CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1 ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END", "0.7", "0.3",
))
def fusion_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.by_score(*two_lists(spark, d)))


@query(r"""SELECT item_id, kind AS query_type, CASE WHEN kind = 'keyword' THEN 0.45::DOUBLE ELSE 0.8::DOUBLE END AS w_vector, CASE WHEN kind = 'keyword' THEN 0.55::DOUBLE ELSE 0.2::DOUBLE END AS w_text
FROM (SELECT item_id, CASE WHEN length(text) <= 10 OR regexp_matches(text, '[0-9:/\\._-]') THEN 'keyword' ELSE 'semantic' END AS kind FROM benchmark)""")
def query_type_weights(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "benchmark").select("item_id", tx.query_type(F.col("text")).alias("query_type"))
    wv, wt = tx.weights(F.col("query_type"))
    return kinds.select("*", wv.alias("w_vector"), wt.alias("w_text"))


QUERY_TERMS = ("idiot", "clown", "scum")
HITS = """hits AS (SELECT q.n AS query_no, doc_id, n_chars FROM (SELECT unnest(['idiot', 'clown', 'scum']) AS w, unnest([0, 1, 2]) AS n) q JOIN documents ON contains(text, q.w)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY n_chars DESC, doc_id) AS pos FROM hits)"""


@query(f"""WITH {HITS}, r AS (SELECT query_no, doc_id, pos, row_number() OVER (ORDER BY query_no, pos) AS arrival FROM top WHERE pos <= 10),
c AS (SELECT query_no, sum(count(*)) OVER (ORDER BY query_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r GROUP BY query_no)
SELECT doc_id, CAST(min(query_no) AS INTEGER) AS query_no, CAST(min(arrival) AS INTEGER) AS arrival FROM r JOIN c USING (query_no) WHERE coalesce(before, 0) < 15 GROUP BY doc_id""")
def multi_query_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits a query, until fifteen have arrived; the first arrival of a document counts."""
    docs = table(spark, d, "documents")
    per = [docs.where(F.contains("text", F.lit(w))).orderBy(F.desc("n_chars"), "doc_id").limit(10).select(F.lit(n).alias("query_no"), "doc_id", "n_chars") for n, w in enumerate(QUERY_TERMS)]
    hits = per[0].unionByName(per[1]).unionByName(per[2])
    rows = hits.withColumn("arrival", F.row_number().over(Window.orderBy("query_no", F.desc("n_chars"), "doc_id")))
    before = F.count("*").over(Window.orderBy("query_no").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where("before < 15").groupBy("doc_id").agg(F.min("query_no").alias("query_no"), F.min("arrival").alias("arrival"))


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM
(SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)) WHERE r <= 2""")
def diversity_cap_per_source(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return fusion.capped(hits, "source", 2, [F.desc("n_chars"), F.col("doc_id")])


@query()
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Ten of the forty vectors most like each query vector (ids divisible by 100), for relevance and variety."""
    vectors = table(spark, d, "embeddings")
    near = search.neighbours(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 40)
    return fusion.mmr(near.join(vectors.select("vec_id", "embedding"), "vec_id").select("query", F.col("vec_id").alias("id"), F.col("cosine").alias("score"), "embedding"), 10)


@query("""WITH h AS (SELECT conv_id, turn AS hit FROM conversations WHERE role = 'assistant' AND contains(text, ' the '))
SELECT h.conv_id, h.hit, string_agg(c.text, chr(10) ORDER BY c.turn) AS context, count(*) AS n_chunks
FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.hit - 1 AND h.hit + 1 GROUP BY h.conv_id, h.hit""")
def context_window_join(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return fusion.with_context(turns.where((F.col("role") == "assistant") & F.contains("text", F.lit(" the "))), turns, "conv_id", "turn", "text", 1)


@query("SELECT conv_id, turn AS src, next AS dst, 'next' AS relation FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL UNION ALL "
       "SELECT conv_id, next, turn, 'prev' FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL")  # fmt: skip
def next_prev_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next")).where("next IS NOT NULL")
    both = F.array(F.struct(F.col("turn").alias("src"), F.col("next").alias("dst"), F.lit("next").alias("relation")), F.struct(F.col("next").alias("src"), F.col("turn").alias("dst"), F.lit("prev").alias("relation")))
    return rows.select("conv_id", F.inline(both))


CHUNKS = """w AS (SELECT doc_id, s AS start, substring(text, s + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS s FROM documents))"""


@query(f"""WITH {CHUNKS} SELECT doc_id, CAST(start AS INTEGER) AS start, chunk, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index
FROM w WHERE trim(regexp_replace(chunk, '[\\t\\n\\r]', ' ', 'g')) <> ''""")
def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "documents"))


@query("""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM
(SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[。！？.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query(r"""SELECT doc_id FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) WHERE NOT (
len(list_filter(l, lambda x: regexp_matches(x, '([. ]{3,}[0-9]+$)|(^[0-9]+([.][0-9]+)* .*[0-9]+$)|^(contents|table of contents|index)$'))) / greatest(len(l), 1) >= 0.3::DOUBLE
OR (len(list_filter(l, lambda x: length(x) < 40)) / greatest(len(l), 1) >= 0.6::DOUBLE AND len(list_filter(l, lambda x: regexp_matches(x, '([. ]{3,}[0-9]+$)|(^[0-9]+([.][0-9]+)* .*[0-9]+$)|^(contents|table of contents|index)$'))) / greatest(len(l), 1) >= 0.1::DOUBLE))""")
def toc_chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    return chunking.without_contents(table(spark, d, "documents")).select("doc_id")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
m AS (SELECT *, regexp_matches(line, '^(#{1,6} +\S.*|[0-9]+([.][0-9]+)* +[A-Z].*)$') AS is_title FROM l), s AS (SELECT *, CAST(sum(is_title::INT) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS section_no FROM m)
SELECT doc_id, section_no, coalesce(max(CASE WHEN is_title THEN regexp_replace(line, '^(#{1,6}|[0-9]+([.][0-9]+)*) +', '') END), '') AS title, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT is_title), '') AS body
FROM s GROUP BY doc_id, section_no""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(table(spark, d, "documents"))


@query()
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.packed_sentences(table(spark, d, "documents"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE (CASE WHEN a > 0 THEN '...' ELSE '' END) || substring(text, a + 1, 120) || (CASE WHEN a + 120 < length(text) THEN '...' ELSE '' END) END AS snippet,
regexp_replace(text, 'worthless', '**worthless**', 'gi') AS highlighted FROM (SELECT doc_id, text, greatest(instr(lower(text), 'worthless') - 1 - 40, 0) AS a FROM documents WHERE contains(lower(text), 'worthless'))""")
def snippet_highlight(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("worthless")))
    return hits.select("doc_id", tx.snippet(F.col("text"), "worthless", 120).alias("snippet"), tx.highlighted(F.col("text"), "worthless").alias("highlighted"))


@query("SELECT item_id, md5(concat_ws('|', 'hybrid', text, '10', 'rank')) AS cache_key FROM benchmark")
def search_cache_key(spark: SparkSession, d: str) -> DataFrame:
    """A key over all parameters of a search."""
    return table(spark, d, "benchmark").select("item_id", F.md5(F.concat_ws("|", F.lit("hybrid"), "text", F.lit("10"), F.lit("rank"))).alias("cache_key"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[ぁ-んァ-ン一-龯]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[ぁ-んァ-ン一-龯]') THEN 'ja'
WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM documents""")
def language_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.language(F.col("text")).alias("language"))


@query("""SELECT doc_id, n_sentences, summary, CASE WHEN n_sentences >= 5 THEN 0.9::DOUBLE WHEN n_sentences >= 2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM (SELECT doc_id, CAST(len(l) AS INTEGER) AS n_sentences, array_to_string(l[1:3], '. ') AS summary FROM
(SELECT doc_id, list_filter(list_filter(list_transform(string_split_regex(text, '[。！？.!?\n]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: contains(lower(x), 'tion')) AS l FROM documents)) WHERE n_sentences > 0""")
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first three sentences that mention a node name, and how much they are trusted."""
    about = F.filter(tx.sentences(F.col("text")), lambda s: F.contains(F.lower(s), F.lit("tion")))
    rows = table(spark, d, "documents").select("doc_id", about.alias("l")).select("doc_id", F.size("l").alias("n_sentences"), F.array_join(F.slice("l", 1, 3), ". ").alias("summary")).where("n_sentences > 0")
    n = F.col("n_sentences")
    return rows.withColumn("confidence", F.when(n >= 5, 0.9).when(n >= 2, 0.7).otherwise(0.5))


@query(f"""WITH {LISTS}, f AS (SELECT id, coalesce(1.0::DOUBLE / (60 + v.pos), 0) + coalesce(1.0::DOUBLE / (60 + t.pos), 0) AS s FROM v FULL JOIN t USING (id)),
m AS (SELECT id, source, round(s, 9) AS score_hybrid FROM f JOIN documents ON doc_id = id WHERE lang = 'en'),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score_hybrid DESC, id) AS r FROM m) SELECT id, source, score_hybrid FROM c WHERE r <= 2 ORDER BY score_hybrid DESC, id LIMIT 10""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: two lists, reciprocal-rank fusion, a filter on metadata after it, a cap for each source, the best ten."""
    fused = fusion.by_reciprocal_rank(*two_lists(spark, d))
    docs = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source")
    rows = docs.join(F.broadcast(fused), "id").select("id", "source", F.round("score_hybrid", 9).alias("score_hybrid"))
    return fusion.capped(rows, "source", 2, [F.desc("score_hybrid"), F.col("id")]).orderBy(F.desc("score_hybrid"), "id").limit(10)
