"""Queries on made-up tables that are larger or longer than the given ones, against their SQL or brute force."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators import fulltext, inverted, search, substrings
from tessera.plans import catalogue


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(catalogue.oracle_sql()[name]).fetchall()


def test_names_come_over_twelve_imports_at_most(spark, tmp_path):
    # package p imports p // 2, so a way of 14 imports leads from package 8192 to package 0
    parts = [(20 * p, f"name {p}", "kind") for p in [0] + [2**n for n in range(14)]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = by_sql("library_names", tmp_path, "part")
    got = catalogue.queries()["library_names"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(g.steps for g in got) == 12


def test_neighbours_of_odd_vectors_are_those_of_all_pairs(spark):
    r = np.random.default_rng(9)
    base = r.normal(size=6)
    rows = [(i, r.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, (base * (1 + i % 3)).tolist()) for i in range(40)]  # more copies than are asked for
    rows += [(300 + i, (base + 3e-4 * r.normal(size=6)).tolist()) for i in range(60)]  # cosines that are rounded alike
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None] * 3), (404, [float("nan")] * 6), (405, [float("inf")] + [1.0] * 5), (406, [1.0] * 3), (407, [2.0, 1.0, 0.0])]
    rows += [(408, [1e200] * 6), (409, [1e-200] * 6), (410, [1e-170] * 6), (None, base.tolist()), (3, base.tolist()), (411, [5e-324] * 6), (412, [1e160] + [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 7 = 3 or vec_id >= 400").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    pairs = table.join(asked, F.col("query") != F.col("vec_id")).select("query", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))
    for k in (1, 7, 500):
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k).collect()
        for block in (8192, 9):
            got = search.neighbours(table, asked, k, block)
            assert got.dtypes == [("query", "bigint"), ("vec_id", "bigint"), ("cosine", "double"), ("rank", "int")]
            assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert search.neighbours(table, asked.limit(0), 5).count() == 0 and search.neighbours(table.limit(0), asked, 5).count() == 0


def test_many_queries_are_compared_as_matrices():
    r = np.random.default_rng(10)
    x, y = r.normal(size=(300, 32)), r.normal(size=(5000, 32))
    unit = lambda m: (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    group = lambda ids, m: (ids, m, np.sqrt((m * m).sum(axis=1)), unit(m), np.ones(len(m), bool))
    best, exact = search.Best(300, 10), []
    add = best.add
    best.add = lambda query, ids, value: (exact.append(len(ids)), add(query, ids, value))
    for lo in range(0, 5000, 1000):
        search.compare(best, np.arange(300), group(np.arange(300), x), group(np.arange(1000 + lo, 2000 + lo), y[lo : lo + 1000]))
    assert best.id.tolist() == (np.argsort(-unit(x).astype(float) @ unit(y).astype(float).T, axis=1)[:, :10] + 1000).tolist()
    assert sum(exact) < 300 * 5000 / 50  # pairs whose cosine is computed in full


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["vector_knn_query_set", "mmr_rerank"])
def test_query_sets_meet_rows_without_nested_loops(spark, sf_dir, name):
    assert not re.search("NestedLoopJoin|CartesianProduct", plan_of(catalogue.queries()[name](spark, sf_dir)))


def test_index_is_built_with_one_shuffle_of_packed_postings(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices("a bb ccc dddd Straße x9 中文".split() + [f"w{i}"], k=r.randint(0, 60)))) for i in range(300)] + [(400, None), (401, ""), (7, "other bb"), (None, "a")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    own = table.where("doc_id < 300").selectExpr("doc_id", "split(text, ' ') AS words", "cast(doc_id % 5 AS int) AS block")
    plan = plan_of(inverted.posted(own))
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    monkeypatch.setattr(inverted, "WORDS", 500)  # several runs for each task
    inverted.add(table, str(tmp_path), blocks=5)
    want, texts = defaultdict(list), {}
    for i, t in docs:
        if i is not None:
            texts[i] = min(t or "", texts.get(i, t or ""))
    for i, t in texts.items():
        words = re.findall(r"[^\W_]+", t.lower())
        for w in set(words):
            want[w].append((i, len(words), [n for n, x in enumerate(words) if x == w]))
    got, blocks = defaultdict(list), defaultdict(set)
    for row in spark.read.parquet(f"{tmp_path}/postings").collect():
        assert row.most == max(len(p.places) for p in row.postings) and row.least == min(p.len for p in row.postings)
        got[row.term] += [(p.doc_id, p.len, p.places) for p in row.postings]
        for p in row.postings:
            blocks[p.doc_id].add(row.block)
    assert {t: sorted(p) for t, p in got.items()} == {t: sorted(p) for t, p in want.items()} and {len(b) for b in blocks.values()} == {1}
    assert sorted((x.doc_id, x.len) for x in spark.read.parquet(f"{tmp_path}/documents").collect()) == sorted((i, len(re.findall(r"[^\W_]+", t))) for i, t in texts.items())
    asked = spark.createDataFrame([(t,) for t in want], "term string")
    places = {(x.term, x.bucket) for x in spark.read.parquet(f"{tmp_path}/postings").select("term", "bucket").collect()}
    assert places == {(x.term, x.b) for x in asked.select("term", inverted.bucket(F.col("term")).alias("b")).collect()}


def test_hashes_are_those_of_spark(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcéß中xyz09", k=n % 70)) for n in range(300)]
    got = inverted.hashes(pa.array(words)).astype(np.int64).tolist()
    assert got == [x.h for x in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(F.xxhash64("w").alias("h")).collect()]


def test_names_are_looked_up_in_texts_without_a_row_for_each_letter(spark, monkeypatch):
    r = random.Random(6)
    word = lambda n: "".join(r.choices("abé文 :", weights=[9, 9, 1, 1, 2, 2], k=n))
    texts = {i: word(r.randint(0, 400)) for i in range(60)} | {100: "", 101: "a" * 300, 102: None}
    whole = [t for t in texts.values() if t]
    parts = [t[i : i + n] for t in r.choices(whole, k=150) for n in (r.randint(1, 40),) for i in (r.randrange(len(t)),)]
    names = parts + [p + "x" for p in parts[:40]] + [word(r.randint(1, 12)) for _ in range(80)] + ["a" * n for n in (7, 8, 9, 16, 17, 200, 300, 301)] + whole[:5] + ["", None]
    table = spark.createDataFrame([*texts.items(), (None, "aaaaaaaa"), (0, "second aaaaaaaaa")], "id long, text string").coalesce(2)
    named = lambda rows: spark.createDataFrame([(n,) for n in rows], "name string")
    want = {(n, i) for n in names if n for i, t in [*texts.items(), (0, "second aaaaaaaaa")] if t and n in t}
    found = substrings.contained(named(names), table)
    assert "Generate" not in plan_of(found) and "Join" not in plan_of(found)
    assert sorted((x.name, x.id) for x in found.collect()) == sorted(want)
    for name, size in (("NAMES", 50), ("CHUNK", 300), ("PAIRS", 20)):
        monkeypatch.setattr(substrings, name, size)
    assert sorted((x.name, x.id) for x in substrings.contained(named(names), table).collect()) == sorted(want)
    assert substrings.contained(named(["", None]), table).count() == 0 and substrings.contained(named(names), table.limit(0)).count() == 0


def test_best_documents_of_odd_tables_are_those_of_sql(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    words = "the of and a in is ring bolt nut gear cam rod pin hub".split()
    text = lambda n: " ".join(r.choices(words, weights=range(28, 0, -2), k=n))
    docs = [(i, text(r.randint(0, 30))) for i in range(300)] + [(i, text(9)) for i in range(40) for _ in range(2)] + [(500, None), (501, ""), (502, "the ring"), (502, "of the"), (503, "ring"), (503, "bolt")]
    asked = [(q, text(r.randint(1, 4))) for q in range(80)] + [(90, "ring bolt"), (91, "unheard of"), (92, ""), (93, "the"), (94, "the the of"), (5, "the"), (5, "the of")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(by_sql("fulltext_bm25_topk", tmp_path, "documents", "benchmark"))
    run = lambda: sorted(map(tuple, catalogue.queries()["fulltext_bm25_topk"](spark, str(tmp_path)).collect()))
    assert any(x[1] == 503 for x in want) and run() == want
    monkeypatch.setattr(fulltext, "DOCS", 50)
    monkeypatch.setattr(fulltext, "PAIRS", 10)
    assert run() == want
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    queries = spark.createDataFrame([(q, t.split()) for q, t in asked], "query long, terms array<string>")
    assert sorted(map(tuple, fulltext.bm25(table, queries, 10, block=7).collect())) == want
    assert fulltext.bm25(table, queries.limit(0), 3).count() == 0 and fulltext.bm25(table.limit(0), queries, 3).count() == 0


def test_documents_of_frequent_terms_are_cut_in_tasks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the of ' || id AS text").coalesce(1)
    queries = spark.range(50).selectExpr("id AS query", "array('the', 'of') AS terms")
    got = fulltext.bm25(docs, queries, 3)
    assert got.count() == 150 and "Join" not in plan_of(got)
