"""The stored indexes of vectors and words, and the join of names with texts, against plain searches."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted, substrings, vector_index


def test_vector_index_recall_and_changes(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 32))
    vectors = {i: (centres[i % 20] + 0.9 * r.normal(size=32)) for i in range(3000)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32)], "vec_id long, embedding array<double>")
    path = f"{tmp_path}/index"
    books = vector_index.fit(table, cells=16, slices=8, max_sample=1500, rounds=6)
    vector_index.add(table.where("vec_id < 2000 or vec_id >= 9000"), books, path)
    vector_index.add(table.where("vec_id between 2000 and 2999"), books, path)
    vector_index.delete(spark, spark.createDataFrame([(i,) for i in range(0, 3000, 7)], "vec_id long"), path)
    index = spark.read.parquet(path)
    left = {i: v / np.linalg.norm(v) for i, v in vectors.items() if i % 7}
    assert sorted(x.vec_id for x in index.select("vec_id").collect()) == sorted(left)
    asked = [i for i in left if i % 60 == 1]
    queries = table.where(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = {}
    for x in vector_index.search(index, queries, books, 10, probes=6, part_rows=50).collect():
        got.setdefault(x.query, []).append((x["rank"], x.vec_id, x.cosine))
    hits = 0
    for q in asked:
        best = sorted((-round(float(left[q] @ v), 6), i) for i, v in left.items() if i != q)[:10]
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, 11)) and all(abs(c - float(left[q] @ left[i])) < 1e-5 for _, i, c in own)
        hits += len({i for _, i in best} & {i for _, i, _ in own})
    assert hits >= 0.9 * 10 * len(asked)
    whole = vector_index.search(index, queries, books, 10, probes=16, rerank=2000)
    assert {(x.query, x.vec_id) for x in whole.collect()} == {(q, i) for q in asked for _, i in sorted((-round(float(left[q] @ v), 6), i) for i, v in left.items() if i != q)[:10]}


WORDS = "alpha beta gamma delta eps zeta eta theta".split()
SCHEMA = "query long, clause long, kind string, op string, terms array<string>, distance int"
CLAUSES = [
    (1, 1, "must", "all", ["alpha", "beta"], 0), (2, 1, "should", "any", ["gamma", "theta"], 0), (2, 2, "should", "all", ["zeta"], 0), (3, 1, "must", "phrase", ["alpha", "beta", "alpha"], 0),
    (4, 1, "must", "near", ["delta", "eps"], 2), (4, 2, "not", "any", ["eta", "zeta"], 0), (5, 1, "must", "all", ["nowhere"], 0), (6, 1, "must", "all", ["theta"], 0), (6, 2, "should", "all", ["eta"], 0),
    (6, 3, "not", "phrase", ["theta", "eta"], 0),
]


def plain_search(docs, k):
    tokens = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs.items()}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)

    def holds(c, w):
        _, _, _, op, terms, distance = c
        if op == "any":
            return any(t in w for t in terms)
        if not all(t in w for t in terms):
            return False
        if op == "phrase":
            return any(w[i : i + len(terms)] == terms for i in range(len(w)))
        return op == "all" or any(all(t in w[i : i + distance + 1] for t in terms) for i in range(len(w)))

    out = set()
    for q in {c[0] for c in CLAUSES}:
        own = [c for c in CLAUSES if c[0] == q]
        must, should, without = ([c for c in own if c[2] == kind] for kind in ("must", "should", "not"))
        ranked = {t for c in must + should for t in c[4]}
        scores = []
        for d, w in tokens.items():
            if all(holds(c, w) for c in must) and not any(holds(c, w) for c in without) and (must or any(holds(c, w) for c in should)):
                tf, score = Counter(w), 0.0
                for t in ranked:
                    df = sum(t in x for x in tokens.values())
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf[t] else 0
                scores.append((-round(score, 6), d))
        out |= {(q, d, -s, rank) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_word_index_search_and_changes(spark, tmp_path):
    r = random.Random(8)
    text = lambda: " ".join(r.choices(WORDS, weights=[9, 7, 4, 3, 3, 2, 2, 1], k=r.randint(0, 14)))
    docs = {d: text() for d in range(90)}
    table = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    path, clauses = f"{tmp_path}/words", spark.createDataFrame(CLAUSES, SCHEMA)
    inverted.add(table({d: t for d, t in docs.items() if d < 60}), path, blocks=7)
    inverted.add(table({d: t for d, t in docs.items() if d >= 60}), path, blocks=7)
    inverted.delete(spark, spark.createDataFrame([(d,) for d in range(0, 90, 9)], "doc_id long"), path)
    docs = {d: t for d, t in docs.items() if d % 9} | {d: text() for d in (3, 9, 91, 92)}
    inverted.add(table({d: docs[d] for d in (3, 9, 91, 92)}), path, blocks=7)
    found = lambda p, k: {(x.query, x.doc_id, x.bm25, x["rank"]) for x in inverted.search(spark, p, clauses, k).collect()}
    for k in (3, 100):
        assert found(path, k) == plain_search(docs, k)
    inverted.compact(spark, path, f"{tmp_path}/compact")
    assert found(f"{tmp_path}/compact", 5) == plain_search(docs, 5)


def test_only_buckets_of_asked_terms_are_read(spark, tmp_path):
    inverted.add(spark.createDataFrame([(d, f"word{d} other{d}") for d in range(80)], "doc_id long, text string"), str(tmp_path))
    files = inverted.read_terms(spark, str(tmp_path), ["word3"]).select(F.input_file_name()).distinct().collect()
    plan = inverted.read_terms(spark, str(tmp_path), ["word3"])._jdf.queryExecution().executedPlan().toString()
    assert len(files) == 1 and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in re.search(r"PartitionFilters: \[([^\]]*)", plan)[1]


@pytest.mark.parametrize("q", [1, 2, 3])
def test_names_in_texts(spark, q):
    r = random.Random(q)
    names = ["".join(r.choices("abcé ", k=r.randint(1, 5))) for _ in range(60)] + ["", None, "zzz", "ab", "ab"]
    texts = {i: "".join(r.choices("abcé ", k=r.randint(0, 30))) for i in range(40)} | {99: "", 98: "ababab"}
    table = spark.createDataFrame([*texts.items(), (97, None)], "id long, text string")
    got = substrings.contained(spark.createDataFrame([(n,) for n in names], "name string"), table, q).collect()
    assert sorted((x.name, x.id) for x in got) == sorted({(n, i) for n in names if n for i, t in texts.items() if n in t})


def test_elements_by_short_or_full_name(spark):
    elements = spark.createDataFrame([("Lib::Cat.Sys",), ("Lib::Core",), ("x",), ("Gone::Nope",)], "element string")
    texts = spark.createDataFrame([(1, "part def Sys"), (2, "use Lib::Core here"), (3, "Core only"), (4, "nothing")], "id long, text string")
    hits = substrings.short_or_full(elements, texts)
    assert {(h.element, h.id) for h in hits.collect()} == {("Lib::Cat.Sys", 1), ("Lib::Core", 2), ("Lib::Core", 3)}
    edges = spark.createDataFrame([("Lib::Cat.Sys", "Lib::Core", "uses"), ("Lib::Core", "Lib::Core", "x")], "src string, dst string, relation string")
    assert {(p.source_id, p.target_id) for p in substrings.pairs(edges, hits).collect()} == {(1, 2), (1, 3), (2, 3), (3, 2)}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_registered_search(spark, sf):
    from tessera.plans import indexes

    sf_dir = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in indexes.vector_index_search(spark, sf_dir).collect():
        got.setdefault(r.query, set()).add(r.vec_id)
    hits = n = 0
    for q in np.flatnonzero(ids % 100 == 0):
        near = x @ x[q]
        near[q] = -2
        best = set(ids[np.argsort(-near)[:10]].tolist())
        hits, n = hits + len(best & got[int(ids[q])]), n + len(best)
    assert hits >= 0.9 * n, (hits, n)
