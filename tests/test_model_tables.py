"""Names, types, expressions and paths over tables, each against a plain recursion."""

import random

from tessera.operators import expressions, namespaces, paths, typegraph


def test_names_flow_through_imports(spark):
    r = random.Random(1)
    packages = [f"p{k}" for k in range(14)]
    owned = [(p, f"n{r.randrange(30)}", r.choice("xyz")) for p in packages for _ in range(3)]
    imports = [(p, k, r.choice([*packages, "nowhere"] if r.random() < 0.2 else packages), r.choice(["all", "all", "member", "deep"] if r.random() < 0.2 else ["all", "member"]), f"n{r.randrange(30)}") for p in packages for k in range(r.randint(0, 2))]
    own = spark.createDataFrame(owned, "package string, name string, kind string")
    edges = spark.createDataFrame(imports, "package string, ord int, target string, form string, name string")
    names = {}
    for p, n, k in owned:
        names[p, n] = (min(k, names[p, n][0]), 0) if (p, n) in names else (k, 0)
    for step in range(1, 40):
        new = {}
        for p, o, t, form, only in imports:
            for (q, n), (kind, at) in names.items():
                if q == t and at == step - 1 and (p, n) not in names and (form == "all" or form == "member" and n == only):
                    new[p, n] = min(new.get((p, n), (o, kind)), (o, kind))
        names |= {key: (kind, step) for key, (_, kind) in new.items()}
    bad = {p for p, _, t, form, n in imports if t not in packages or form == "deep" or form == "member" and (t, n) not in names}
    while more := {p for p, _, t, form, _ in imports if form == "all" and t in bad} - bad:
        bad |= more
    got = namespaces.visible(own, edges)
    assert {(x.package, x.name): (x.kind, x.steps) for x in got.collect()} == names
    whole = namespaces.complete(own.select("package"), edges, got).collect()
    assert {x.package: x.complete for x in whole} == {p: p not in bad for p in packages}


def test_names_in_scopes(spark):
    scopes = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("c", "b"), ("d", "root")], "scope string, parent string")
    members = spark.createDataFrame([("root", "x", "X0"), ("a", "x", "X1"), ("b", "y", "c"), ("c", "z", "Z"), ("d", "w", "W2"), ("d", "w", "W1")], "scope string, name string, target string")
    opaque = spark.createDataFrame([("a",), ("c",)], "scope string")
    refs = [(1, "c", "x"), (2, "d", "x"), (3, "c", "nope"), (4, "d", "nope"), (5, "c", "y::z"), (6, "c", "y::q"), (7, "d", "w"), (8, "elsewhere", "x"), (9, "d", "w::q"), (10, "c", "q::z")]
    got = {x.ref: (x.status, x.target, x.depth) for x in namespaces.resolved(spark.createDataFrame(refs, "ref int, scope string, name string"), scopes, members, opaque).collect()}
    assert got == {
        1: ("exists", "X1", 2), 2: ("exists", "X0", 1), 3: ("unverifiable", None, None), 4: ("missing", None, None), 5: ("exists", "Z", 1), 6: ("unverifiable", None, None),
        7: ("exists", "W1", 0), 8: ("missing", None, None), 9: ("missing", None, None), 10: ("unverifiable", None, None),
    }


def test_types_with_several_bases(spark):
    r = random.Random(5)
    names = [f"T::t{k}" for k in range(25)]
    bases = [(names[k], names[r.randrange(k)]) for k in range(4, 25) for _ in range(r.randint(1, 2))] + [("T::t2", "T::t3"), ("T::t3", "T::t2")]
    kinds = {n: r.choice(["Part", "Item", "action", "port", "unknown"]) for n in names[:23]}
    up = {n: set() for n in names}
    for _ in names:
        for n, b in bases:
            up[n] |= {b} | up[b]

    def depth(n, seen=()):
        own = [b for m, b in bases if m == n and not (b in up[n] and n in up[b])]
        ring = [m for m in names if m != n and m in up[n] and n in up[m]]
        own += [b for m in ring for k, b in bases if k == m and not (b in up[m] and m in up[b])]
        return max((1 + depth(b) for b in own), default=0)

    pairs = [(a, b) for a in names for b in names if r.random() < 0.3]
    pair_table, base_table = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(bases, "node string, base string")
    got = {(x.a, x.b): x.base for x in typegraph.common_bases(pair_table, base_table).collect()}
    want = {(a, b): min((up[a] | {a}) & (up[b] | {b}), key=lambda n: (-depth(n), n), default=None) for a, b in pairs}
    assert got == want
    types = spark.createDataFrame([*kinds.items()], "name string, category string")
    verdicts = {(x.a, x.b): x.verdict for x in typegraph.compatible(pair_table, types, base_table).collect()}
    for (a, b), verdict in verdicts.items():
        ka, kb = (kinds.get(n, "").lower() for n in (a, b))
        fits = ka == kb or {ka, kb} <= {"part", "item"} or "unknown" in (ka, kb)
        assert verdict == ("same" if a == b else "undefined" if not ka or not kb else "specialization" if b in up[a] or a in up[b] else "common base" if want[a, b] else "category" if fits else "none")


def test_types_by_the_end_of_a_name(spark):
    types = spark.createDataFrame([("A::B::c",), ("A::c",), ("c2",), ("B::c2",)], "name string")
    asked = spark.createDataFrame([("c",), ("B::c",), ("c2",), ("d",), ("::c",)], "asked string")
    assert {x.asked: x.name for x in typegraph.by_suffix(asked, types).collect()} == {"c": "A::B::c", "B::c": "A::B::c", "c2": "c2", "d": None, "::c": None}
    bases = spark.createDataFrame([("x", "c"), ("x", "gone"), ("y", "maybe"), ("y", None)], "node string, base string")
    assert [tuple(x) for x in typegraph.unknown_bases(types, bases, spark.createDataFrame([("maybe",)], "base string")).collect()] == [("x", "gone")]


def test_expressions(spark):
    r = random.Random(9)
    rows, want = [], {}

    def grow(tree, parent, at, height):
        node = f"{len(rows):05}"
        kind = r.choice(["literal", "name"]) if not height else r.choice(["literal", "name", "binary", "binary", "unary", "call", "conditional", "chain", "other"])
        value = {"literal": r.choice(["1", "2.5", "true", '"s"', "?", None]), "name": r.choice(["i", "r", "b", "c", "zz", "7"]), "binary": r.choice(["+", "*", "<", "==", "and", "^"]), "unary": r.choice(["-", "not"]), "call": r.choice(["size", "isEmpty", "other"])}.get(kind)
        rows.append([tree, node, parent, at, kind, value])
        n = {"binary": r.choice([2, 2, 2, 1]), "unary": 1, "call": r.randint(0, 2), "conditional": 3, "chain": 2, "other": 1}.get(kind, 0)
        below = [grow(tree, node, k, height - 1) for k in range(n)]
        types, texts = [t for t, _ in below], [x for _, x in below]
        width = lambda t: {"Integer": 1, "Real": 2, "Complex": 3}.get(t)
        widest = lambda ts: ["Integer", "Real", "Complex"][max(map(width, ts)) - 1] if all(map(width, ts)) else None
        literal = {"1": "Integer", "7": "Integer", "2.5": "Real", "true": "Boolean", '"s"': "String"}
        if kind == "literal":
            out = literal.get(value), value or "…"
        elif kind == "name":
            out = {"i": "Integer", "r": "Real", "b": "Boolean", "c": "Complex"}.get(value) or literal.get(value), value
        elif kind == "binary" and n == 2:
            a = widest(types) if value in "+*" else "Boolean" if value in ("<", "==") and all(types) else "Boolean" if value == "and" and types == ["Boolean"] * 2 else None
            out = a, f"{texts[0]} {value} {texts[1]}"
        elif kind == "unary":
            out = (types[0] if (value == "-" and width(types[0])) or (value == "not" and types[0] == "Boolean") else None), "…"
        elif kind == "conditional":
            out = ((types[1] if types[1] == types[2] else widest(types[1:])) if types[0] == "Boolean" else None), "…"
        else:
            out = {"call": {"size": "Integer", "isEmpty": "Boolean"}.get(value), "chain": types[-1] if types else None}.get(kind), "…"
        want[tree, node] = out
        return out

    for tree in range(60):
        grow(tree, None, 0, r.randint(0, 6))
    table = spark.createDataFrame(rows, "tree int, node string, parent string, ord int, kind string, value string")
    symbols = spark.createDataFrame([("i", "Integer"), ("r", "Real"), ("b", "Boolean"), ("c", "Complex")], "name string, type string")
    assert {(x.tree, x.node): (x.type, x.text) for x in expressions.evaluated(table, symbols).collect()} == want


def test_paths_are_all_simple_paths(spark):
    r = random.Random(6)
    ids = ["the", "z", *(f"n{k}" for k in range(9))]
    nodes = [(i, r.choice("ab"), round(r.random(), 3)) for i in ids]
    edges = [(a, b, rel, round(r.random(), 3)) for a in ids for b in ids for rel in ("uses", "has", "likes") if r.random() < 0.1]
    asked = [(a, b) for a in ids for b in ids if r.random() < 0.3]
    importance, kind = {i: x for i, _, x in nodes}, {i: k for i, k, _ in nodes}

    def found(relations, kinds, stop, most, depth):
        out = set()
        for start, end in asked:
            if start == end or start in stop or end in stop:
                continue
            todo, own = [([start], [], [])], []
            while todo:
                path, rels, weights = todo.pop()
                if path[-1] == end:
                    n = len(path)
                    q = 0.4 * sum(map(importance.get, path)) / n + 0.4 * sum(weights) / (n - 1) + 0.2 / (1 + 0.1 * (n - 2))
                    own += [(-round(q, 6), path, rels)] if round(q, 6) >= 0.3 else []
                elif len(path) <= depth:
                    todo += [([*path, b], [*rels, rel], [*weights, w]) for a, b, rel, w in edges if a == path[-1] and b not in path and rel in relations and b not in stop and len(b) >= 2 and (not kinds or kind[b] in kinds)]
            out |= {(start, end, k, tuple(p), tuple(rels), -q) for k, (q, p, rels) in enumerate(sorted(own)[:most], 1)}
        return out

    n, e, a = spark.createDataFrame(nodes, "id string, type string, importance double"), spark.createDataFrame(edges, "src string, dst string, relation string, weight double"), spark.createDataFrame(asked, "start string, end string")
    for relations, kinds, stop, most, depth, beam in ((("uses", "has"), ("a",), ("the",), 3, 4, None), (("uses", "has", "likes"), None, (), 2, 3, 100_000)):
        got = paths.best_paths(n, e, a, depth, most, beam, relations, kinds, stop).collect()
        assert {(x.start, x.end, x["rank"], tuple(x.path), tuple(x.relations), x.quality) for x in got} == found(relations, kinds, stop, most, depth)


def test_concepts_between(spark):
    edges = [("s", "c"), ("e", "c"), ("s", "b"), ("b", "e"), ("s", "m"), ("m", "k"), ("k", "e"), ("e", "d"), ("d", "s"), ("x", "y"), ("s", "lone")]
    asked = [("s", "e"), ("x", "y"), ("x", "e"), ("y", "x")]
    got = paths.linked_concepts(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(asked, "start string, end string")).collect()
    assert {(g.start, g.end, g.way, g.via, g.confidence) for g in got} == {("s", "e", "between", "c", 0.6), ("s", "e", "between", "b", 0.9), ("s", "e", "between", "m", 0.9), ("s", "e", "between", "d", 0.3), ("x", "y", "direct", None, 1.0)}
    assert {g.overall for g in got} == {0.675, 1.0}
