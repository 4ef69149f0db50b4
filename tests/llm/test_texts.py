"""Token counts, packing, sharding and fingerprints, against the libraries themselves and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import imatch, packing, shard, token_counts

SCHEMA = "doc_id long, text string, n_words int, sh_size string"
ODD = [
    (1, None, 1, "x"), (2, "", 2, "y"), (3, "a  b   c\n \nd", 3, None), (4, "word " * 5000, None, "z"), (4, "word " * 5000, None, "z"),
    (None, "no id <|endoftext|> here", 1, "q"), (5, "x" * 30_000, 0, ""), (6, "é ü ß\x1c \x85 ́a", 0, ""), (7, "\x00 null \x00", 1, ""),
]
BYTES = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "don't", "1234", "é", "漢字", "<|endoftext|>", "!?", " ", "\x1c", "\x85", "İΣ", "é", "zq" * 9]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_counts_are_the_tokenizers_own(text):
    want = len(BYTES.encode(text, add_special_tokens=False).ids)
    assert token_counts.Counter(BYTES).many([text]) == [want]
    assert token_counts.Counter(BYTES, chunk=40, overlap=12).many([text]) == [want]


def test_overlaps_widen_where_no_cut_is_safe():
    counter = token_counts.Counter(BYTES, chunk=100, overlap=8)
    text = "ab cd " * 30 + "x" * 700 + " ef gh" * 40
    assert counter.many([text]) == [len(BYTES.encode(text, add_special_tokens=False).ids)]
    assert counter.widened


def test_long_texts_without_spaces():
    rng = np.random.default_rng(3)
    kana = [chr(c) for c in range(0x3042, 0x3094)] + list("日本語東京学生時間人年大") + ["。", "、"]
    short, long = ("".join(rng.choice(kana, n)) for n in (60_000, 1_000_000))
    plain = short.replace("。", "か").replace("、", "か")  # letters alone
    counter = token_counts.Counter(BYTES)
    for text in (short, plain, long, "x" * 150_000, "ab" * 40_000 + " it's " + "'s" * 30_000):
        assert counter.many([text]) == [len(BYTES.encode(text, add_special_tokens=False).ids)]


def test_long_texts_take_time_in_proportion():
    from time import perf_counter

    counter, text = token_counts.Counter(BYTES), "".join(np.random.default_rng(5).choice([chr(c) for c in range(0x3042, 0x3094)], 800_000))
    seconds = []
    for n in (100_000, 800_000):
        start = perf_counter()
        counter.many([text[:n]])
        seconds.append(perf_counter() - start)
    assert seconds[1] < 20 * seconds[0] + 1


def test_other_tokenizers_see_whole_texts():
    assert token_counts.Counter(BYTES).known and not token_counts.Counter(WORDS).known
    assert packing.WordIds(WORDS, 2).whole is None and packing.WordIds(BYTES, 2).whole is not None
    text = "Some words, and 123 more. " * 300
    assert token_counts.Counter(WORDS, chunk=100).many([text]) == [len(WORDS.encode(text, add_special_tokens=False).ids)]
    assert np.frombuffer(packing.WordIds(BYTES, 2)(text), "<u2").tolist() == BYTES.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_word_ids_are_the_tokenizers_own(text):
    got = np.frombuffer(packing.WordIds(WORDS, 2)(text), "<u2").tolist()
    assert got == WORDS.encode(text, add_special_tokens=False).ids


def test_new_words_go_to_the_model_in_one_call():
    ids_of, calls = packing.WordIds(WORDS, 2, memory=40), []
    inner, full = ids_of.model, ids_of.full
    ids_of.model = type("Model", (), {"encode_batch_fast": lambda self, texts, **k: calls.append(texts) or inner.encode_batch_fast(texts, **k)})()
    ids_of.full = lambda text: calls.append(text) or full(text)
    texts = ["The ÉTÉ, straße (été)!! the end...", "", "  ", "The\nend", "x<|endoftext|>.", "don't", "Été!! " * 3, "ÀÞßÿ×÷ ÀÞß ÷", "\n"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in ids_of.many(texts)] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(isinstance(c, list) for c in calls) == 1 and len(calls) == len({str(c) for c in calls})  # nothing is asked twice
    for k in range(30):  # more parts than are remembered
        more = [f"{chr(97 + k % 26)}{chr(97 + j)}{'z' * k}, W{chr(65 + j)}!!" for j in range(9)]
        assert [np.frombuffer(x, "<u2").tolist() for x in ids_of.many(more)] == [WORDS.encode(t, add_special_tokens=False).ids for t in more]


def test_counts_of_odd_rows(spark):
    rows = token_counts.counted(spark.createDataFrame(ODD, SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(BYTES.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts.counted(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pieces_give_back_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    docs = [tuple(d) for d in docs] + [(10**6 + k, r[1]) for k, r in enumerate(ODD)]
    for limits in ({}, {"segments": 3}, {"loss": 100, "tokens": 256, "gap": 0}):
        size = limits.get("tokens", 4096)
        rows = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), block_bytes=40_000, **limits).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        assert set(by_doc) == {d[0] for d in docs}
        for i, text in docs:
            own = sorted(by_doc[i], key=lambda r: r.start)
            ids = b"".join(bytes(r.ids) for r in own)
            want = [*WORDS.encode(text or "", add_special_tokens=False).ids, 2]
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and own[0].doc_tokens == len(want)
        for own in by_sequence.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert sum(r.length for r in own) <= min(size, limits.get("loss", size)) and len(own) <= limits.get("segments", 512)
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_a_packing_task_cuts_texts_in_small_parts(spark, monkeypatch):
    """Vectors of a task are bounded, and what it frees goes back before it ends."""
    import tracemalloc

    import pyarrow as pa

    from tessera.llm import common

    tasks, given = [], []
    monkeypatch.setattr(packing, "released", lambda f: tasks.append(f) or common.released(f))
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    text = "Some words, and more (of them)! " * 64
    docs = [(i, text, None, 1) for i in range(6_000)]
    packing.packed(spark.createDataFrame(docs[:9], "doc_id long, text string, loss long, count int"), public_tokenizers.path("word_bpe_49k.json"))
    names, kinds = ["doc_id", "text", "loss", "count"], [pa.int64(), pa.string(), pa.int64(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*docs, strict=True), kinds, strict=True)], names=names)
    rows = sum(out.num_rows for out in tasks[0](iter([batch.slice(0, 600)])))  # what loads once is loaded
    tracemalloc.start()
    try:
        rows += sum(out.num_rows for out in common.released(tasks[0])(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 110 << 20
    finally:
        tracemalloc.stop()
    assert rows == 6_600 and len(given) > 1


def test_loss_limit_counts_the_end_of_a_document():
    got = packing.place([100, 100, 50], [10, 10, 50], tokens=200, segments=9, loss=20, gap=0)
    loss = {}
    for item, start, n, sequence, _ in got:
        first = {0: 90, 1: 90, 2: 0}[item]
        loss[sequence] = loss.get(sequence, 0) + max(0, start + n - max(start, first))
    assert max(loss.values()) <= 20 and sum(n for _, _, n, _, _ in got) == 250


def test_the_three_limits_count_together():
    draw = np.random.default_rng(2)
    n = draw.integers(1, 120, 300)
    lengths, counts = n.tolist(), draw.integers(1, 9, 300).tolist()
    losses = [int(x * f) for x, f in zip(n, draw.random(300), strict=True)]
    rows = packing.place(lengths, losses, 400, 12, 90, 0, counts)
    used, parts = {}, {}
    for item, start, size, sequence, offset in rows:
        t, s, x = used.get(sequence, (0, 0, 0))
        assert offset == t and size > 0
        used[sequence] = (t + size, s + counts[item], x + max(0, start + size - max(start, lengths[item] - losses[item])))
        parts.setdefault(item, []).append((start, size))
    assert all(t <= 400 and s <= 12 and x <= 90 for t, s, x in used.values())
    assert all(sorted(p)[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(sorted(p), sorted(p)[1:], strict=False)) and sum(b for _, b in p) == lengths[i] for i, p in parts.items())
    assert len(parts) == 300 and len(used) <= 1.5 * max(sum(lengths) / 400, sum(counts) / 12, sum(losses) / 90)


def test_instruction_data(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = packing.conversation_texts(turns).limit(40).collect()
    length = lambda t: len(WORDS.encode(t, add_special_tokens=False).ids)
    docs = [(r.doc_id, r.text, length(r.answer_text) + 1, r.turns) for r in rows]
    pieces = packing.packed(spark.createDataFrame(docs, "doc_id long, text string, bearing int, turns int"), public_tokenizers.path("word_bpe_49k.json"), loss=300, loss_tokens="bearing", segments=20, segment_count="turns").collect()
    by = {d[0]: d for d in docs}
    assert {p.doc_id for p in pieces} == set(by) and sum(p.length for p in pieces) == sum(length(d[1]) + 1 for d in docs)
    for q in {p.sequence_id for p in pieces}:
        own = [p for p in pieces if p.sequence_id == q]
        assert sum(min(20, by[p.doc_id][3]) for p in own) <= 20
        assert sum(max(0, p.start + p.length - max(p.start, p.doc_tokens - by[p.doc_id][2])) for p in own) <= 300


def test_equal_rows_are_packed_in_many_blocks(spark):
    docs = spark.createDataFrame([(None, "the same words " * 20)] * 400, "doc_id long, text string")
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), block_bytes=5_000).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 10 and sum(r.length for r in rows) == 400 * 61


def test_sequences_and_shards_are_written(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(k, f"words of {k} " * (k % 7)) for k in range(50)], "doc_id long, text string")
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=64)
    for r in packing.sequences(pieces).collect():
        assert len(r.ids) == 4 * sum(r.lengths) <= 4 * 64 and len(r.doc_ids) == len(r.lengths)
    shard.write_shards(docs, f"{tmp_path}/shards", shards=4, bucket_bytes=400, run=2)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted(map(tuple, docs.collect()))
    assert all(sorted(r.sh_slot for r in back if r.sh_shard == k) == list(range(13 if k < 2 else 12)) for k in range(4))


def test_shards_hold_each_row_once_and_evenly(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small, large = ([tuple(r) for r in shard.shuffled(docs, 7, bucket_bytes=b).orderBy("doc_id").select("doc_id", "sh_shard", "sh_slot").collect()] for b in (20_000, 1 << 30))
    for rows in (small, large):
        sizes = np.bincount([s for _, s, _ in rows])
        assert len(rows) == docs.count() and sizes.max() - sizes.min() <= 1
        assert all(sorted(x for _, s, x in rows if s == k) == list(range(sizes[k])) for k in range(7))
    assert small == [tuple(r) for r in shard.shuffled(docs.repartition(5), 7, bucket_bytes=20_000).orderBy("doc_id").select("doc_id", "sh_shard", "sh_slot").collect()]


def test_shards_of_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "mine", i) for i, r in enumerate(ODD)], SCHEMA + ", sh_bucket string, place int")
    rows = shard.shuffled(odd, 4).collect()
    assert sorted((str(r.sh_size), r.place) for r in rows) == sorted((str(r.sh_size), r.place) for r in odd.collect()) and {r.sh_bucket for r in rows} == {"mine"}
    same = spark.createDataFrame([(None, "")] * 300, "doc_id long, text string")
    assert len({(r.sh_shard, r.sh_slot) for r in shard.shuffled(same, 3, bucket_bytes=400).collect()}) == 300
    assert sorted((r.sh_size_, r.sh_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)
    assert shard.shuffled(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_fisher_yates_reaches_all_orders_alike():
    seen = [tuple(shard.fisher_yates(3, [s])) for s in range(3000)]
    assert all(400 < seen.count(x) < 600 for x in set(seen)) and len(set(seen)) == 6


def test_fingerprints_compare_with_the_next_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in imatch.compared(docs, rows_per_range=17).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, text) in enumerate(rows):
        text, follow = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + follow[:half]).encode()).hexdigest()
        assert got[i].n_chars == len(text) and by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert got[i].near_next == imatch.likeness(imatch.read(got[i].fingerprint), imatch.read(got[rows[(k + 1) % len(rows)][0]].fingerprint))
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.15


def test_fingerprints_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    h = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    often = Counter(w for t in texts for w in set(t.lower().split()))
    known = {h(w) for w, n in often.items() if max(2, 0.0005 * len(texts)) <= n <= max(2, 0.2 * len(texts))}
    got = imatch.lexicon(docs)
    assert got.tolist() == sorted(known)
    own, m = imatch.Fingerprints(got), (1 << 64) - 1
    for text in texts[:25]:
        terms = {h(w) for w in set(text.lower().split())}
        terms = terms & known or terms
        want = np.zeros((imatch.LEVELS, imatch.SEEDS), np.uint32)
        for s, factor in enumerate(own.factors[:, 0].tolist()):
            for k in range(imatch.LEVELS):
                total, some = 0, False
                for t in terms:
                    x = t * factor & m
                    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 & m
                    x ^= x >> 32
                    if x >> (64 - k) == 0:
                        total, some = total + (x * 0x9E3779B97F4A7C15 & m ^ 0x5851F42D4C957F2D) & m, True
                want[k, s] = 1 + (total ^ total >> 29) % 0xFFFFFFFF if some else 0
        assert (own(text) == want).all() and (imatch.read(imatch.written(want)) == want).all()


def test_likeness_follows_the_shared_terms():
    words = [f"w{i}" for i in range(4000)]
    own = imatch.Fingerprints(np.zeros(0, np.uint64))
    for n in (40, 400, 2000):
        near = [np.mean([imatch.likeness(own(" ".join(words[:n])), own(" ".join(words[round(n * (1 - share)) :][:n]))) for n in (n, n + 7, n + 13)]) for share in (1.0, 0.9, 0.5, 0.0)]
        assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] == 0


def test_fingerprints_of_odd_rows(spark):
    assert imatch.compared(spark.createDataFrame(ODD, SCHEMA), rows_per_range=2).count() == len(ODD)
    assert imatch.compared(spark.createDataFrame(ODD, SCHEMA).where(F.col("doc_id") == 1)).count() == 1
    assert imatch.compared(spark.createDataFrame([], SCHEMA)).count() == 0
