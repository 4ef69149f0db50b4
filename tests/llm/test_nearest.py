"""Nearest vectors against all cosines, with hard vectors, and the registered query by its contract and SQL."""

from math import fsum, isfinite, sqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest, queries

SCHEMA = "vec_id long, embedding array<double>"


def all_nearest(rows, is_query, k):
    """(query, rank) -> (vec_id, cosine) from every pair."""
    of = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] and all(x is not None and isfinite(x) for x in r[1]) and any(r[1])), key=lambda r: (r[0], r[1])):
        of.setdefault(i, np.ldexp(np.array(v, float), -int(np.frexp(np.abs(np.array(v, float)).max())[1])))
    out = {}
    for q in filter(is_query, of):
        x = of[q]
        score = lambda y: fsum(x * y) / sqrt(fsum(x * x) * fsum(y * y))  # noqa: E731, B023
        best = sorted((-score(y), i) for i, y in of.items() if i != q and len(y) == len(x))[:k]
        out |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def found(table, k=5, every=3, **sizes):
    got = nearest.nearest(table, F.col("vec_id") % every == 0, k, **sizes).collect()
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}


def test_hard_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    rows = [(i, r.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, base.tolist()) for i in range(40)]  # more copies than neighbours are asked for
    rows += [(300 + i, (base + 1e-9 * r.normal(size=8)).tolist()) for i in range(40)]  # closer than int8 codes can tell
    rows += [(400 + i, (base * 10.0 ** (i * 8 - 160)).tolist()) for i in range(40)]  # squares that overflow and vanish
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, None] * 4), (505, [float("inf")] * 8), (None, base.tolist())]
    rows += [(510, [1.0, 2.0]), (513, [2.0, 1.0]), (516, [-1.0, 0.5]), (519, [5e-324] * 8), (522, [1e308] * 8), (300, (base * 2).tolist()), (3, rows[3][1])]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit(1)).withColumn("length", F.lit("x")).repartition(4)
    want = all_nearest(rows, lambda i: i % 3 == 0, 5)
    assert found(table) == want
    assert found(table, query_block=40, block=30) == want


def test_few_and_no_candidates(spark):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert found(table([])) == {} and found(table([(0, [1.0])])) == {}
    assert found(table([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])])) == {(0, 1): (2, 1.0), (0, 2): (1, 0.0)}


def test_long_vectors_and_few_exact_cosines():
    r = np.random.default_rng(6)
    x, y = r.normal(size=(20, 3000)), r.normal(size=(900, 3000))
    heaps = [[] for _ in x]
    assert nearest.tile(heaps, np.arange(20), x, np.arange(100, 1000), y, 5) < 20 * 900 / 4
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    want = np.argsort(-unit(x) @ unit(y).T, axis=1)[:, :5] + 100
    assert [[-i for _, i in sorted(h, reverse=True)] for h in heaps] == want.tolist()


def test_error_bound_holds():
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(60, 33)), r.standard_cauchy(size=(60, 33)), np.eye(33)])
    codes, scales, rest = nearest.quantised(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    about = (codes @ codes.T) * scales[:, None] * scales
    assert (np.abs(unit @ unit.T - about) <= rest[:, None] + (1 + rest)[:, None] * rest + 1e-12).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_by_its_contract(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.queries()["op13_nearest_vectors"](spark, sf_dir)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = got.collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == all_nearest(rows, lambda i: i % 50 == 0, 5)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_nearest_vectors"]).fetchall()
    assert [(q, k, i, round(s, 9)) for q, k, i, s in sorted(map(tuple, got))] == [(q, k, i, round(s, 9)) for q, k, i, s in sorted(want)]
