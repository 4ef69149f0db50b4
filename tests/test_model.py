"""Semantic models: ids, edges, owners, labels and views, on a small tree."""

from pyspark.sql import functions as F

from tessera.operators import model

NODES = [
    (0, None, "package", None, 0, []), (1, 0, "package", "P", 0, []), (2, 1, "part_def", "A", 0, []), (3, 1, "part_def", "B", 1, [("specializes", "P::A"), ("subsets", "ISQ::mass")]),
    (4, 1, "part_usage", "a", 2, [("typed_by", "A")]), (5, 1, "part_usage", "a", 3, [("typed_by", "Nothing")]), (6, 3, "comment", None, 0, []), (7, 3, "comment", None, 1, []), (8, 3, "doc", "", 2, []),
]
SCHEMA = "node_id int, parent_id int, type string, name string, ordinal int, bases array<struct<kind:string,ref:string>>"


def test_ids_edges_and_views(spark):
    nodes = model.with_stable_ids(spark.createDataFrame(NODES, SCHEMA))
    ids = {r.node_id: r.stable_id for r in nodes.collect()}
    assert ids == {0: "$root", 1: "P", 2: "P::A", 3: "P::B", 4: "P::a", 5: "P::a#2", 6: "P::B/comment#1", 7: "P::B/comment#2", 8: "P::B/doc#1"}
    declared = nodes.where("name <> ''").select(F.col("stable_id").alias("name"), F.col("stable_id").alias("target"))
    short = nodes.where("type LIKE '%_def'").select("name", F.col("stable_id").alias("target"))
    edges = model.inheritance_edges(nodes, [declared, short], spark.createDataFrame([("ISQ",)], "package string"))
    got = {(r.from_id, r.to_id, r.kind, r.resolution_status) for r in edges.collect()}
    assert got == {("P::B", "P::A", "specialization", "resolved"), ("P::B", None, "subsetting", "unresolved_external"), ("P::a", "P::A", "feature_typing", "resolved"), ("P::a#2", None, "feature_typing", "unresolved_error")}
    drawn, kept = model.view(nodes, edges, "structure")
    assert drawn.count() == 4 and kept.count() == 2


def test_nearest_owner(spark):
    drawn = spark.createDataFrame([("P",), ("P::B",)], "id string")
    items = spark.createDataFrame([("P::B/comment#1",), ("P::A::x",), ("Q::y",), ("P::B",)], "id string")
    assert {r.id: r.owner for r in model.nearest_drawn(items, drawn).collect()} == {"P::B/comment#1": "P::B", "P::A::x": "P", "P::B": "P::B"}


def test_labels_and_places(spark):
    rows = spark.createDataFrame([(1, 1), (0, None), (None, None), (2, 5)], "low int, high int")
    assert [r[0] for r in rows.select(model.multiplicity_label(F.col("low"), F.col("high"))).collect()] == ["1", "0..*", None, "2..5"]
    rows = spark.createDataFrame([("t", "g", "e"), (None, "g", None), (None, None, None)], "t string, g string, e string")
    assert [r[0] for r in rows.select(model.transition_label(F.col("t"), F.col("g"), F.col("e"))).collect()] == ["t [g] / e", "[g]", None]
    boxes = spark.createDataFrame([("a", 0, 90.0), ("b", 0, 100.0), ("c", 1, 90.0)], "id string, layer int, width double")
    assert {r.id: (r.x, r.y) for r in model.layered_places(boxes, "width").collect()} == {"a": (0.0, 0.0), "b": (130.0, 0.0), "c": (0.0, 80.0)}


def test_ids_of_deep_trees(spark):
    rows = [(i, i - 1 if i else None, "part_def", f"n{i}", 0) for i in range(50)]
    got = model.with_stable_ids(spark.createDataFrame(rows, "node_id long, parent_id long, type string, name string, ordinal int"))
    assert got.count() == 50 and got.where("node_id = 49").head().stable_id.count("::") == 48


def test_relation_edges(spark):
    schema = "stable_id string, parent_id string, type string, name string, ends array<struct<ref:string,multiplicity:string>>, has_body boolean"
    end = lambda ref, m=None: (ref, m)
    rows = [
        ("c1", "p", "connection", "link", [end("a", "1"), end("b", "*")], False), ("c2", "p", "connection", None, [end("a"), end("b"), end("x")], False), ("c3", "p", "connection", None, [end("a"), end("b")], True),
        ("s1", "p", "satisfy", None, [end("r"), end("a")], None), ("s2", "p", "verify", None, [end("r")], None), ("t1", "p", "transition", "go", [end("b")], None), ("f1", "p", "flow", None, [end("a"), end("nowhere")], None), ("z", "p", "part", None, [], None),
    ]
    registry = spark.createDataFrame([(n, f"id:{n}") for n in "abrx"], "name string, target string")
    got = model.relation_edges(spark.createDataFrame(rows, schema), [registry]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("id:a", "id:b", "connection", "[1] link [*]"), ("c2", "id:a", "connection", None), ("c2", "id:b", "connection", None), ("c2", "id:x", "connection", None), ("c3", "id:a", "connection", None),
        ("c3", "id:b", "connection", None), ("id:a", "id:r", "satisfy", None), ("p", "id:r", "verify", None), ("p", "id:b", "transition", "go"), ("id:a", None, "flow", None),
    ], key=str)


def test_findings_have_places_and_owners(spark):
    nodes = spark.createDataFrame([("a", 3), ("a::b", None), ("a::b::c", 9)], "stable_id string, line int")
    issues = spark.createDataFrame([("a::b/x#1", "warning"), ("a::b::c::d", "error"), ("a::b", "error"), ("q", "error")], "id string, severity string")
    got = {r.id: (r.owner, r.line) for r in model.located(issues, nodes).collect()}
    assert got == {"a::b/x#1": ("a", 3), "a::b::c::d": ("a::b::c", 9), "a::b": ("a", 3), "q": (None, None)}
    drawn = spark.createDataFrame([("a",), ("a::b::c",)], "id string")
    assert sorted(map(tuple, model.attached(issues, drawn).collect())) == [("a", 2, "error"), ("a::b::c", 1, "error")]
