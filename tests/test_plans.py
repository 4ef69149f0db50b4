"""Each query against its SQL on the smallest tables, and the ones without SQL against brute force."""

import math

import duckdb
import numpy as np
import pytest

from tessera.functions import text as tx
from tessera.operators import chunking, components, expansion, fusion, graph, rules
from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(values):
    def plain(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else f"{x:.6f}"
        return "null" if x is None else str(x)

    return sorted(tuple(plain(x) for x in r) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_mmr_is_greedy(spark, sf_dir):
    random = np.random.default_rng(1)
    e, score = random.normal(size=(12, 5)), random.random(12)
    table = spark.createDataFrame([(0, i, float(score[i]), e[i].tolist()) for i in range(12)], "query long, id long, score double, embedding array<double>")
    got = [r.id for r in fusion.mmr(table, 6).orderBy("step").collect()]
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = []
    while len(want) < 6:
        left = [i for i in range(12) if i not in want]
        want.append(max(left, key=lambda i: (0.7 * score[i] / score.max() - 0.3 * max([0, *(unit[i] @ unit[j] for j in want)]), -i)))
    assert got == want


def test_sections_and_packs(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\na\nb\n2.1 Two words\nc"), (2, "no title")], "doc_id long, text string")
    got = sorted((r.doc_id, r.section_no, r.title, r.body) for r in chunking.sections(docs).collect())
    assert got == [(1, 0, "", "intro"), (1, 1, "One", "a\nb"), (1, 2, "Two words", "c"), (2, 0, "", "no title")]
    assert chunking.pack(["aaaa", "bbbb", "cc", "dddd"], 8, 3) == ["aaaabbbb", "ccdddd"]
    assert chunking.pack(["aaaa", "bb", "cccc"], 6, 2) == ["aaaabb", "bbcccc"]


def test_fixed_windows_cover_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(1234))
    got = chunking.fixed_windows(spark.createDataFrame([(1, text), (2, ""), (3, "  \n ")], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.chunk_index, r.start, r.chunk) for r in got] == [(k, s, text[s : s + 500]) for k, s in enumerate(range(0, 1234, 450))]


def test_ranks_drop_repeats_and_fuse(spark):
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8), (1, 0.7), (3, 0.1)], "id long, s double")
    from pyspark.sql import functions as F

    a = fusion.ranked(hits, [F.desc("s")])
    assert {r.id: r.pos for r in a.collect()} == {1: 1, 2: 2, 3: 3}
    b = spark.createDataFrame([(9, 1)], "id long, pos int")
    got = {r.id: round(r.score_hybrid, 6) for r in fusion.by_rank(a, b, 0.5, 0.5).collect()}
    assert got == {1: 0.5, 2: round(1 / 3, 6), 3: round(1 / 6, 6), 9: 0.5}
    assert fusion.capped(a, "id", 0, [F.col("pos")]).count() == 0 and fusion.capped(a, "id", None, [F.col("pos")]).count() == 3


def test_traversal_of_odd_graphs(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "y"), ("e", "e", "x")], "src string, dst string, relation string")
    seeds = spark.createDataFrame([("a",), ("nowhere",)], "id string")
    assert {r.id: r.distance for r in graph.reachable(edges, seeds, 5).collect()} == {"a": 0, "nowhere": 0, "b": 1, "c": 2, "d": 3}
    assert {r.id for r in components.on_cycles(edges).collect()} == {"a", "b", "c", "e"}
    assert {r.id: r.path for r in graph.shortest_paths(edges, "a", 3).collect()}["d"] == ["a", "b", "c", "d"]
    assert graph.first_per_pair(edges.union(edges), ["relation"]).count() == 5


def test_cycles_of_any_length(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    bases = spark.createDataFrame([*ring, ("in", "r0"), ("far", "in"), ("self", "self"), ("ends", "root"), ("root", "gone")], "node string, base string")
    got = {r.node: r.message for r in rules.inheritance_cycles(bases, "x").collect()}
    on = {f"r{i}" for i in range(9)} | {"self"}
    assert got == {n: "inheritance cycle" for n in on} | {n: "leads into an inheritance cycle" for n in ("in", "far")}


def test_on_cycles_strips_long_chains(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(130)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.id for r in components.on_cycles(edges).collect()} == {"x", "y"}


def test_band_pairs_at_the_edge(spark):
    from collections import Counter

    places = [(g, f"w{i % 7}", (i * 13) % 57) for g in range(2) for i in range(30)]
    got = {(r.a, r.b): r.n for r in graph.band_pairs(spark.createDataFrame(places, "g int, item string, place int"), "g", "item", "place", 10, 1).collect()}
    want = Counter((a[1], b[1]) for a in places for b in places if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 10)
    assert got == dict(want)


def test_edit_join_finds_all_pairs(spark):
    words = ["ring", "rings", "rig", "king", "bring", "gnir", "a", "ab", "", "ringg"]
    a, b = spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(w,) for w in words], "name string")

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            old, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != e))
        return row[-1]

    want = {(x, y) for x in words for y in words if distance(x, y) == 1}
    assert {(r.term, r.name) for r in expansion.fuzzy(a, b, 0.0).collect()} == want


def test_resolution_order_and_ambiguity(spark):
    refs = spark.createDataFrame([("A::x",), ("A::y",), ("z",), ("w",)], "ref string")
    near = spark.createDataFrame([("A::x", "1"), ("x", "9"), ("z", "2"), ("z", "3")], "name string, target string")
    far = spark.createDataFrame([("y", "4"), ("z", "5")], "name string, target string")
    got = {r.ref: (r.target, r.status) for r in rules.resolve(refs, [near, far]).collect()}
    assert got == {"A::x": ("1", "resolved"), "A::y": ("4", "resolved"), "z": (None, "ambiguous"), "w": (None, "missing")}


def test_variants(spark):
    from pyspark.sql import functions as F

    words = spark.createDataFrame([(w,) for w in ("city", "cities", "bus", "day", "men", "mouse", "part")], "w string")
    got = {r[0]: r[1] for r in words.select("w", tx.variants(F.col("w"))).collect()}
    assert got["city"] == ["city", "cities"] and got["cities"] == ["cities", "city"] and got["day"] == ["day", "days"] and got["men"] == ["men", "man"] and got["mouse"] == ["mouse", "mice"]


def test_issues_match_once_and_in_order(spark):
    from tessera.plans.views import matched

    rows = [(1, "expected", 0, "error", "a"), (1, "expected", 1, "error", "a"), (1, "expected", 2, "warning", "b"), (1, "actual", 0, "error", "xx a"), (1, "actual", 1, "error", "b"), (1, "actual", 2, "error", "aa"), (2, "expected", 0, "error", "q")]
    got = sorted((r.case_id, r.expected, r.actual) for r in matched(spark.createDataFrame(rows, "case_id long, side string, ord long, severity string, text string")).collect())
    assert got == [(1, 0, 0), (1, 1, 2), (1, 2, None), (2, 0, None)]


def test_cycles_are_told_from_ways_between_them(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(120)]
    ring = lambda name, n: [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]
    between = [("a0", "way1"), ("way1", "way2"), ("way2", "b0")]
    table = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    got = {r.id for r in components.on_cycles(table(ring("a", 3) + ring("b", 4) + between + [("s", "s"), ("s", "t")])).collect()}
    assert got == {"a0", "a1", "a2", "b0", "b1", "b2", "b3", "s"}
    assert components.on_cycles(table(chain)).count() == 0


def test_code_blocks(spark):
    text = "Intro\n\npart def A {\n  attribute x;\n\n}\n\nmore text\nport p;\n# Heading\naction open {\n"
    got = chunking.code_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "segment_no").collect()
    assert [(r.doc_id, r.kind, r.segment) for r in got] == [
        (1, "text", "Intro"), (1, "code", "part def A {\n  attribute x;\n\n}"), (1, "text", "more text"), (1, "code", "port p;"), (1, "text", "# Heading"), (1, "code", "action open {"),
    ]


def test_small_text_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        tx.qualified_parts(F.lit("A::'b c'::D")).alias("parts"), tx.balanced(F.lit("(a)(b(c))")).alias("yes"), tx.balanced(F.lit(")(")).alias("no"),
        tx.tool_name(F.lit("My Server"), F.lit("find")).alias("tool"), tx.tool_name(F.lit("s" * 80), F.lit("find")).alias("cut"),
        tx.file_key(F.lit(""), F.lit(None).cast("string"), F.lit("doc-7")).alias("key"), tx.chunk_number(F.lit("x"), F.lit("doc-7")).alias("number"),
        tx.replaced_between(F.lit("aXbXc"), F.lit("X"), F.lit("--"), F.lit(2), F.lit(4)).alias("fixed"), tx.error_class(F.lit("Unexpected token")).alias("class"),
    ).head()
    assert row.parts == ["A", "b c", "D"] and row.yes and not row.no and row.tool == "my-server__find" and len(row.cut) == 64 and row.cut.endswith("__find")
    assert (row.key, row.number, row.fixed, row["class"]) == ("doc", 7, "aXb--c", "syntax")
