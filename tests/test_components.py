"""Strongly connected parts and layers against plain searches on many small graphs, and their rounds on long ones."""

import random

import pytest

from tessera.operators import components, staging


def plain_parts(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {n: reach(n) for e in edges for n in e}
    out = {}
    for n in far:
        own = {m for m in far[n] if n in far[m]} | {n}
        if len(own) > 1:
            out[n] = min(own)
    return out


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_many_small_graphs_at_once(spark):
    r = random.Random(2)
    edges = []
    for g in range(120):
        n, dense = r.randint(1, 9), r.choice([1, 1.3, 2, 3])
        edges += [(f"{g}.{r.randrange(n)}", f"{g}.{r.randrange(n)}") for _ in range(int(n * dense))]
    got = components.parts(table(spark, edges * 2)).collect()
    assert {x.id: x.part for x in got} == plain_parts(edges) and len(got) == len({x.id for x in got})
    assert {x.id for x in components.on_cycles(table(spark, edges)).collect()} == set(plain_parts(edges)) | {a for a, b in edges if a == b}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    written, own = [], staging.written
    monkeypatch.setattr(staging, "written", lambda rows: written.append(1) or own(rows))
    ring = [(f"r{i:03}", f"r{(i + 1) % 300:03}") for i in range(300)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(300)]
    handles = [("r000", "h0"), *((f"h{i}", f"h{i + 1}") for i in range(90)), ("h90", "r150"), ("r007", "c000"), ("c300", "x"), ("x", "y"), ("y", "x"), ("y", "z")]
    got = {x.id: x.part for x in components.parts(table(spark, ring + chain + handles)).collect()}
    assert got == plain_parts(ring + chain + handles) and len(got) == 300 + 91 + 2
    assert len(written) < 90


def test_layers(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("s", "s"), ("g", "h"), (None, "q")]
    got = {x.id: x.layer for x in components.layers(table(spark, edges)).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 2, "f": 3, "s": 0, "g": 0, "h": 1, "q": 0}
    assert components.layers(table(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_stays_but_the_result(spark, n, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "folder", lambda _: f"file://{tmp_path}")
    components.parts(table(spark, [("a", "b"), ("b", "a")] * n)).count()
    assert len(list(tmp_path.iterdir())) == 1
