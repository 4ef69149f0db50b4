"""Token alignment against a plain one over whole texts, and the registered query by its contract."""

import hashlib
import json
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Of a text: ids and ends of A and B over the whole text, or nothing."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(k): k for k in printable} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in printable)}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [*map(piece, ids_b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], [], []
        return ids_a, [*accumulate(map(len, bytes_a))], ids_b, [*accumulate(map(len, bytes_b))]

    return tokens


def compared(ids_a, ends_a, ids_b, ends_b):
    """Numbers, groups as text and counted links, by comparing the byte ranges of all tokens near each other."""
    links, first = Counter(), 0
    for i, (start, end) in enumerate(zip([0, *ends_a], ends_a, strict=False)):
        while ends_b[first] <= start:
            first += 1
        for j in range(first, len(ids_b)):
            if (ends_b[j - 1] if j else 0) >= end:
                break
            links[ids_a[i], ids_b[j]] += 1
    groups, at_a, at_b = [], 0, 0
    for cut in sorted({*ends_a} & {*ends_b}):
        to_a, to_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
        at_a, at_b = to_a, to_b
    return (len(ids_a), len(ids_b), len(groups), links.total()), ";".join(groups), links


def of(found):
    *numbers, groups, codes, times = found
    return tuple(numbers), groups, Counter({divmod(c, 32000): n for c, n in zip(codes.tolist(), times.tolist(), strict=True)})


HARD = [*"abe  \n\t'’.,-1239éüßçñ中文字あ🙂▁ 　<>|x", "<|endoftext|>", "<s>", "<0x41>", " the", "  ", "\n\n", "'s", "\x00", "\x1c", "́", "ment", "tion,", "Über."]


def test_random_texts(plain):
    r = random.Random(4)
    texts = ["".join(r.choice(HARD) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [None]
    few = alignment.Aligner(A, B, memory=50)
    got = [f for k in range(0, len(texts), 97) for f in few.texts(texts[k : k + 97])]
    assert few.known and len(few.new) <= 2000
    assert [of(f) for f in got] == [compared(*plain(t)) for t in texts]


@pytest.mark.parametrize("text", ["中文字" * 4000, "é🙂z" * 5000, "a" * 20_000, "xy1" * 4000 + " the end", "1234567" * 2000, "word " * 9000], ids=lambda t: t[:4])
def test_long_pieces(plain, text):
    assert of(alignment.aligner(A, B, 100).texts([text])[0]) == compared(*plain(text))


def test_other_tokenizers_get_whole_texts(plain, tmp_path):
    file = json.load(open(A))
    file["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(file))
    other = alignment.Aligner(str(tmp_path / "lower.json"), B)
    same, changed = other.texts(["two words, two lines\nend", "Two Words"])
    assert not other.known and of(same) == compared(*plain("two words, two lines\nend")) and changed[:5] == (0, 0, 0, 0, "")


def test_bits():
    import numpy as np

    r = np.random.default_rng(1)
    places = np.flatnonzero(r.random(1000) < 0.3)
    bits = alignment.Bits.of(places, 1000)
    assert bits.places().tolist() == places.tolist() and bits.rank(np.arange(1000)).tolist() == [(places < k).sum() for k in range(1000)]


def rows_of(docs, plain):
    """The contract's columns of (doc_id, text) rows."""
    found = [compared(*plain(t)) for _, t in docs]
    count = Counter(pair for _, _, links in found for pair in links)
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    return sorted(
        (doc, *numbers, sum(n for p, n in links.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for (doc, _), (numbers, groups, links) in zip(docs, found, strict=True)
    )


ODD = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "a ▁ b"), (5, "one two three."), (6, "中文 one\n"), (None, "two"), (7, " two  one ")]


def test_odd_rows_and_clashing_names(spark, plain):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(ODD, "doc_id long, text string")
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    got = alignment.compared(table.withColumn("pair", F.lit(1)), A, B).select(F.coalesce("doc_id", F.lit(99)).cast("long"), *names)
    assert sorted(map(tuple, got.collect())) == rows_of([(99 if d is None else d, t) for d, t in ODD], plain)
    wide = alignment.alignments(table.withColumn("al_groups", F.lit("mine")), A, B, rows=2)
    assert wide.columns == ["doc_id", "text", "al_groups", "al_n_a", "al_n_b", "al_n_groups", "al_n_links", "al_groups_", "al_pairs", "al_times"] and {r.al_groups for r in wide.collect()} == {"mine"}
    assert alignment.compared(table.limit(0), A, B).collect() == []


def test_rare_pairs_meet_in_a_shuffle(spark, plain):
    docs = [(k, "alpha beta " * (k % 3) + f"gamma{k % 5} delta{k}") for k in range(40)]
    rows = alignment.alignments(spark.createDataFrame(docs, "doc_id long, text string"), A, B)
    counts = alignment.pair_counts(rows, 32000)
    whole, split, none = ({r.doc_id: (r.n_best, r.count_sum) for r in alignment.weighed(rows, counts, "doc_id", most=m).collect()} for m in (1000, 10, 0))
    assert whole == split == none == {r[0]: (r[5], r[6]) for r in rows_of(docs, plain)}


def test_query_by_its_contract(spark, sf_dir, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.queries()["op12_token_alignment"](spark, sf_dir)
    names = "doc_id n_a n_b n_groups n_links n_best count_sum".split()
    assert got.dtypes == [*((n, "bigint") for n in names), ("groups_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == rows_of(docs, plain)
