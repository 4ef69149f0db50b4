"""Each registered query of this subpackage by its columns and values, over the smallest tables."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest

from tessera.llm import queries, token_counts


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    return {name: read(name) for name in ("documents", "pages", "benchmark")}


def rows(spark, sf_dir, name, columns):
    got = queries.queries()[name](spark, sf_dir)
    assert got.dtypes[: len(columns)] == columns
    return got.collect()


@pytest.mark.parametrize("name", ["op1_decontamination", "op7_near_dedup"])
def test_sql_agrees(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_shards(spark, sf_dir, tables):
    got = rows(spark, sf_dir, "op2_sharding", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    want = sorted((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in tables["documents"])
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    slots = [sorted(r.slot for r in got if r.shard == k) for k in range(40)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_token_counts(spark, sf_dir, tables):
    tokenizer = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, sf_dir, "op3_token_counts", [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")])
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = sorted((d["doc_id"], len((d["text"] or "").encode()), k := n(d["text"] or ""), k > 1024) for d in tables["documents"])
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize(("name", "folds", "out"), [("op4_toxicity", 5, 0), ("op10_quality", 3, 1)])
def test_scores(spark, sf_dir, tables, name, folds, out):
    got = rows(spark, sf_dir, name, [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert sorted(r.doc_id for r in got) == sorted(d["doc_id"] for d in tables["documents"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pages(spark, sf_dir, tables):
    got = rows(spark, sf_dir, "op5_html_extraction", [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")])
    assert sorted((r.page_id, r.url) for r in got) == sorted((p["page_id"], p["url"]) for p in tables["pages"])
    assert all(r.n_chars == len(r.text) and "  " not in r.text and r.text == r.text.strip() for r in got)


def test_lines(spark, sf_dir, tables):
    got = rows(spark, sf_dir, "op6_line_dedup", [("doc_id", "bigint"), ("text", "string"), ("n_chars", "bigint"), ("n_removed", "bigint")])
    whole = {d["doc_id"]: (d["text"] or "").split("\n") for d in tables["documents"]}
    assert sorted(r.doc_id for r in got) == sorted(whole)
    for r in got:
        left = iter(whole[r.doc_id])
        lines = r.text.split("\n") if len(whole[r.doc_id]) > r.n_removed else []
        assert all(x in left for x in lines) and len(lines) == len(whole[r.doc_id]) - r.n_removed and r.n_chars == len(r.text)


def test_pieces(spark, sf_dir, tables):
    import struct

    tokenizer = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    columns = [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    got = rows(spark, sf_dir, "op8_packing", columns)
    ids = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2] for d in tables["documents"]}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for doc, own in ids.items():
        cuts = sorted((r.start, r.length) for r in got if r.doc_id == doc)
        assert [a for a, _ in cuts] == [sum(n for _, n in cuts[:k]) for k in range(len(cuts))] and sum(n for _, n in cuts) == len(own)
    for s in {r.sequence_id for r in got}:
        cuts = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [a for a, _ in cuts] == [sum(n for _, n in cuts[:k]) for k in range(len(cuts))] and sum(n for _, n in cuts) <= 4096


def test_fingerprints(spark, sf_dir, tables):
    columns = [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op9_fingerprints", columns)}
    docs = sorted((d["doc_id"], d["text"] or "") for d in tables["documents"])
    for (i, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(text) // 2
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
