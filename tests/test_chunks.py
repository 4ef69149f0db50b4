"""Chunks of model documents: sections, code kept whole, text packed."""

from tessera.operators import chunking


def test_code_stays_whole_and_text_is_packed(spark):
    text = "# One\nSome text. More text here.\n\nPart def A {\n  attribute x;\n}\n\ntail.\n# Two\npart of prose\nstate of things; and more {\n"
    got = [tuple(r) for r in chunking.model_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 20, 5).orderBy("doc_id", "section_no", "segment_no", "part_no").collect()]
    assert got == [
        (1, 1, "One", 0, 0, "text", "Some text."), (1, 1, "One", 0, 1, "text", "More text here."), (1, 1, "One", 1, 0, "code", "Part def A {\n  attribute x;\n}"), (1, 1, "One", 2, 0, "text", "tail."),
        (1, 2, "Two", 0, 0, "text", "part of prose"), (1, 2, "Two", 1, 0, "code", "state of things; and more {"),
    ]


def test_prose_is_no_code(spark):
    text = "part of the text is prose\nmore prose here\n\nlast words"
    got = [tuple(r) for r in chunking.code_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got == [(1, 0, "text", text)]
