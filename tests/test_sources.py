"""Readers, writers and streams, on small files made for the purpose."""

import json
import zipfile

from pyspark.sql import functions as F

from tessera.sources import readers, writers
from tessera.streaming import metrics


def test_office_files_become_units(spark, tmp_path):
    w = "xmlns:w='w'"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:p><w:t>One </w:t><w:t>text</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c t='s'><v>0</v></c><c/><c><v>7</v></c></row></sheetData></worksheet>")
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<sld xmlns:a='a'><a:p><a:t>Slide</a:t></a:p></sld>")
    (tmp_path / "d.md").write_text("# Title\ntext")
    (tmp_path / "e.docx").write_text("broken")
    got = {(r.path.rsplit("/", 1)[1], r.unit_no): r.text for r in readers.units(spark, str(tmp_path)).collect()}
    assert got[("a.docx", 1)] == "One text" and got[("a.docx", 2)] == "Two" and got[("b.xlsx", 1)] == "name | 7" and got[("c.pptx", 1)] == "Slide" and got[("d.md", 1)] == "# Title\ntext"
    assert got[("e.docx", 0)].startswith("error")
    assert [r.text for r in readers.texts(spark, str(tmp_path), "*.md").collect()] == ["# Title\ntext"]


def test_graph_files_and_catalogue(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "x"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "uses"}, {"source": "a", "target": "b", "relation": "is-a"}]}))
    nodes, edges = readers.node_link_graph(spark, str(tmp_path / "g.json"))
    assert writers.save_graph(nodes, edges, str(tmp_path / "store"), "one") == (2, 1)
    assert writers.save_graph(nodes.limit(1), edges, str(tmp_path / "store"), "two") == (1, 1)
    assert writers.save_graph(nodes.where("id = 'a'"), edges, str(tmp_path / "store"), "one") == (1, 1)
    assert writers.load_graph(spark, str(tmp_path / "store"), "two")[0].count() == 1


def test_logs_and_cases(spark, tmp_path):
    (tmp_path / "log.md").write_text("- `graph__find_path(x)`\n- `vector_search(q)`\nno call\n- `other(1)`\n")
    got = sorted((r.server, r.tool) for r in readers.tool_log(spark, str(tmp_path / "log.md"), {"vector_search": "hybrid"}).collect())
    assert got == [("graph", "find_path"), ("hybrid", "vector_search"), ("unknown", "other")]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "1", "query": "q"}, {"id": "2", "query": "r", "relevant_chunk_ids": ["x"]}]}))
    assert [r.query for r in readers.cases(spark, str(tmp_path / "cases.json"), ["2"]).collect()] == ["r"]


def test_documents_are_replaced(spark, tmp_path):
    path = str(tmp_path / "chunks")
    writers.append(spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "document_id string, chunk_index int, text string"), path)
    writers.replace_documents(spark.createDataFrame([("a", 0, "new")], "document_id string, chunk_index int, text string"), path)
    table = spark.read.parquet(path)
    assert sorted((r.document_id, r.text) for r in table.collect()) == [("a", "new"), ("b", "z")]
    assert writers.without(table, spark.createDataFrame([("b",)], "document_id string"), ["document_id"]).count() == 1
    up = writers.upserted(spark.createDataFrame([(1, "old", 1)], "k int, v string, t int"), spark.createDataFrame([(1, "new", 2), (2, "x", 1)], "k int, v string, t int"), ["k"], "t")
    assert sorted((r.k, r.v) for r in up.collect()) == [(1, "new"), (2, "x")]


def test_stream_of_metrics_agrees_with_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    metrics.sink(metrics.windowed(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {(r.start, r.event_type): (r.n, r.mean_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = events.agg(F.max("ts")).head()[0]
    want = {(r.start, r.event_type): (r.n, r.mean_value) for r in metrics.windowed(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert all(k in got or (last - k[0]).total_seconds() < 4 * 3600 for k in want)


def test_incremental_documents(spark, tmp_path):
    spark.createDataFrame([("a", "x" * 900), ("b", "y")], "document_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
    metrics.incremental_documents(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted((r.document_id, r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 0), ("a", 450), ("b", 0)]


def test_large_files_and_deleted_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("small")
    (tmp_path / "b.txt").write_text("x" * 5000)
    rows = {r.path[-5:]: (r.unit_no, r.text) for r in readers.units(spark, str(tmp_path), largest=1000).collect()}
    assert rows["a.txt"] == (1, "small") and rows["b.txt"][0] == 0 and "5000 bytes" in rows["b.txt"][1]
    path = str(tmp_path / "chunks")
    writers.append(spark.createDataFrame([(f"d{k}", k) for k in range(40)], "document_id string, n int"), path, buckets=4)
    writers.deleted_documents(spark, path, spark.createDataFrame([(f"d{k}",) for k in range(30)], "document_id string"), buckets=4)
    assert sorted(r.n for r in writers.read_chunks(spark, path).collect()) == list(range(30, 40))


def test_equal_versions_have_an_order(spark):
    old, new = (spark.createDataFrame([(1, v, 1)], "k int, v string, t int") for v in ("old", "new"))
    assert writers.upserted(old, new.unionByName(new.withColumn("v", F.lit("a"))), ["k"], "t").head().v == "a"
