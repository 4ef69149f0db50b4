"""The whole search and the question to a graph against plain loops over small tables."""

import random

import numpy as np

from tessera.operators import node_query, search_flow


def test_whole_search(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    n = 40
    vectors = np.random.default_rng(1).normal(size=(n, 6))
    docs = [(i, f"s{i % 5}", vectors[i].tolist(), "en" if i % 4 else "de") for i in range(n)]
    edges = [(r.randrange(n), r.randrange(n), "next") for _ in range(45)]
    queries = [(1, "short"), (2, "a long question about things"), (3, "only text finds this one here")]
    vector = [(q, r.randrange(n), p) for q in (1, 2) for p in range(1, 9)]
    text = [(q, r.randrange(n), p) for q in (1, 2, 3) for p in range(1, 9)]
    table = spark.createDataFrame
    t = lambda rows: table(rows, "query long, id long, pos int")
    got = search_flow.searched(table(queries, "query long, text string"), t(vector), t(text), table(edges, "src long, dst long, relation string"), table(docs, "id long, source string, embedding array<double>, lang string"), 6, 2, 3, 2, F.col("lang") == "en", 0.7, 15).collect()
    want = set()
    after = {i: {b for a, b, _ in edges if a == i and b != i} | {a for a, b, _ in edges if b == i and a != i} for i in range(n)}
    degree = {i: sum((a == i) + (b == i) for a, b, _ in edges) for i in range(n)}
    for q, words in queries:
        first = lambda rows: {i: min(p for c, j, p in rows if c == q and j == i) for c, i, _ in rows if c == q}  # noqa: E731, B023
        v, x = first(vector), first(text)
        wv, wt = ((0.45, 0.55) if len(words) <= 10 else (0.8, 0.2)) if v and x else (float(bool(v)), float(bool(x)))
        score = {i: wv * (1 / (60 + v[i]) if i in v else 0) + wt * (1 / (60 + x[i]) if i in x else 0) for i in {*v, *x}}
        best = max(score.values())
        level = sorted(score, key=lambda i: (-score[i], i))[:3]  # noqa: B023
        far = dict.fromkeys(level, 0)
        for d in (1, 2):
            level = {j for i in level for j in after[i]}
            for j in level:
                far.setdefault(j, d)
        for i, d in far.items():
            score.setdefault(i, 0.5 * best / max(d, 1))
        top = max(score[i] for i in score if i % 4)
        ranked = {i: round(s / top + (0.3 / (1 + far[i]) if i in far else 0) + 0.2 * degree[i] / max(degree.values()), 6) for i, s in score.items() if i % 4}
        pool = sorted(ranked, key=lambda i: (-ranked[i], i))[:15]  # noqa: B023
        unit, chosen = vectors / np.linalg.norm(vectors, axis=1)[:, None], []
        while len(chosen) < len(pool):
            value = lambda i: round(0.7 * ranked[i] / ranked[pool[0]] - 0.3 * max([0, *(float(unit[i] @ unit[j]) for j in chosen)]), 12)  # noqa: E731, B023
            chosen.append(min((i for i in pool if i not in chosen), key=lambda i: (-value(i), i)))  # noqa: B023
        kept = []
        for i in chosen:
            if sum(j % 5 == i % 5 for j in kept) < 2:
                kept.append(i)
        want |= {(q, k, i, f"s{i % 5}", ranked[i]) for k, i in enumerate(kept[:6], 1)}
    assert {tuple(g) for g in got} == want


def test_questions_to_a_graph(spark):
    table = spark.createDataFrame
    nodes = table([(x,) for x in ("Engine", "engine block", "Wheel", "axle", "Bolt head", "lone")], "id string")
    edges = table([("Engine", "engine block", "x"), ("engine block", "Bolt head", "x"), ("Wheel", "axle", "x"), ("axle", "Engine", "x"), ("Bolt head", "Wheel", "x")], "src string, dst string, relation string")
    texts = table([("Engine", k) for k in (4, 2, 9, 7)] + [("axle", 1)], "id string, text_id long")
    queries = table([(1, "engine"), (2, "the head of a wheelbarrow"), (3, "nothing at all"), (4, ""), (5, "LONE")], "query long, term string")
    got = node_query.answered(queries, nodes, edges, texts, most_nodes=2, depth=2, most_around=3, sources=2).collect()
    rows = {(g.query, g.way, g.id, g.score, g.distance, tuple(g.sources or ())) for g in got}
    assert rows == {
        (1, "name", "Engine", 1.0, 0, (2, 4)), (1, "name", "engine block", 0.35, 0, ()), (1, "around", "Bolt head", 0.0, 1, ()), (1, "around", "axle", 0.0, 1, (1,)), (1, "around", "Wheel", 0.0, 2, ()),
        (2, "words", "Bolt head", 0.333333, 0, ()), (2, "around", "Wheel", 0.0, 1, ()), (2, "around", "engine block", 0.0, 1, ()), (2, "around", "Engine", 0.0, 2, (2, 4)),
        (5, "name", "lone", 1.0, 0, ()),
    }
