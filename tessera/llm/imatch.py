"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band: neither so common that all texts have
them nor so rare that a typing error makes one. Document frequencies are exact counts of 64-bit hashes of terms over the whole
corpus. A term of the lexicon is in a share `low` of all texts at least, so the lexicon has at most 1 / low times as many terms as
a text has distinct ones on average; that is what the driver and the tasks hold.

The lexicon has SEEDS * LEVELS fixed random subsets, the same for every text: for each seed a whole one, and then halves of
halves. The hashes of a text's distinct terms in a subset are added up, which gives one hash for each subset, the same whatever the
terms' order, as sorting them first would. A text without any term of the lexicon is fingerprinted by its own terms, which lie outside the band. Small subsets are what an edit leaves
alone: with half of a text replaced, some of them still have the same terms as before, while large ones do not.

The likeness of two fingerprints is the share of equal hashes among subsets that either text has terms in, over the
levels at which a text has few terms in a subset; there it estimates the share of terms that both have.

Each text's successor by id is met without a global sort in one task: ids are dealt into ranges, and each
range gets a copy of the first row of the next. Ranges are read in order and never held, so long ones only take longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

SEEDS, LEVELS = 16, 14
NULL_ID = -(1 << 63)
TEXT, REAL = pa.string(), pa.float64()
RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", TEXT), ("fingerprint", TEXT), ("edited_fingerprint", TEXT), ("near_edited", REAL), ("near_next", REAL)])


class Terms:
    """64-bit hashes of a text's distinct terms: words between white space, in lower case."""

    def __init__(self, memory: int = 300_000):
        class Words(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > memory:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
                return h

        self.words = Words()

    def __call__(self, text: str) -> np.ndarray:
        own = text.lower().split()
        return np.unique(np.fromiter(map(self.words.__getitem__, own), np.uint64, len(own)))


def lexicon(docs: DataFrame, low: float = 0.0005, high: float = 0.2, memory: int = 400_000) -> np.ndarray:
    """Sorted hashes of the terms that are in a share of low to high of all texts, and in two at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(), 0
        held, size = [], 0

        def merged() -> pa.RecordBatch:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(times.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(terms(text or ""))
                size += len(held[-1])
                if size > 10 * memory:
                    yield merged()
                    held, size = [], 0
            n += batch.num_rows
        if held:
            yield merged()

    n = docs.count()
    counts = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = stage(counts.where((F.col("n") >= max(2, low * n)) & (F.col("n") <= max(2, high * n))).select("term"), "lexicon")
    return np.sort(kept.toArrow().column("term").to_numpy().view(np.uint64))


class Fingerprints:
    """Hashes of a text's terms in each subset; numbers, from which `written` makes text."""

    def __init__(self, lexicon: np.ndarray, seeds: int = SEEDS, levels: int = LEVELS, seed: int = 3):
        self.lexicon, self.terms, self.levels = lexicon, Terms(), levels
        self.zeros = np.array([levels - 1 - x.bit_length() for x in range(1 << (levels - 1))])  # leading zero bits of the first levels - 1
        self.factors = np.random.default_rng(seed).integers(0, 1 << 63, (seeds, 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        """One number for each level and seed, 0 where the text has no term in the subset."""
        own = self.terms(text)
        if len(own) and len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, own), len(self.lexicon) - 1)
            known = own[self.lexicon[at] == own]
            own = known if len(known) else own  # if no term is in the lexicon, the text's own terms stand in for it
        h = own[None, :] * self.factors
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        shape = (self.levels, len(self.factors))
        row, value = np.repeat(np.arange(shape[1]), len(own)), h.ravel()
        # a term is in the subsets up to the level of its leading zero bits: add up by level, then from the smallest subset on
        level = self.zeros[(value >> np.uint64(65 - self.levels)).astype(np.int64)]
        total = np.zeros(shape, np.uint64)
        np.add.at(total, (level, row), value * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D))
        n = np.bincount(level * shape[1] + row, minlength=shape[0] * shape[1]).reshape(shape)
        total, n = (np.cumsum(x[::-1], axis=0)[::-1] for x in (total, n))
        return np.where(n > 0, np.uint64(1) + (total ^ (total >> np.uint64(29))) % np.uint64(0xFFFFFFFF), np.uint64(0)).astype(np.uint32)


def written(hashes: np.ndarray) -> str:
    """A fingerprint as text: levels apart by a hyphen, 8 hexadecimal digits for each seed; levels without terms are left out."""
    last = np.flatnonzero(hashes.any(axis=1))
    return "-".join(x.astype(">u4").tobytes().hex() for x in hashes[: last[-1] + 1 if len(last) else 0])


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """From 0 to 1; 1 for equal fingerprints, texts without terms among them.

    Counted are the levels at which at most three quarters of the subsets have terms of either text, and the last level if
    none is so empty.
    """
    if (x == y).all():
        return 1.0
    used, same = (x != 0) | (y != 0), (x == y) & (x != 0)
    few = used.mean(axis=1) <= 0.75
    few[-1] = few[-1] or not few.any()
    n = used[few].sum()
    if not n:  # a few terms, which no small subset has
        few[:] = True
        n = used.sum()
    return float(same[few].sum() / n) if n else 0.0


def read(fingerprint: str, levels: int = LEVELS, seeds: int = SEEDS) -> np.ndarray:
    """The numbers that `written` wrote."""
    out = np.zeros((levels, seeds), np.uint32)
    for k, x in enumerate(fingerprint.split("-") if fingerprint else []):
        out[k] = np.frombuffer(bytes.fromhex(x), ">u4")
    return out


def compared(docs: DataFrame, rows_per_range: int = 4_000, **options) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text has the last half of its characters replaced by as many of the first ones of the next
    row's text, by id and then text; the last row's next is the first. Null texts count as empty. Rows without id
    come first. Repeated rows follow each other. An empty table gives no rows.
    """
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, **options))
    of = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = of.select("doc_id")
    parts = max(1, min(20_000, -(-ids.count() // rows_per_range)))
    bounds = np.array(sorted(set(ids.stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else [], float)

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy().astype(float)).astype("int32"))

    firsts = sorted(ids.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id")).collect())
    if not firsts:  # nothing to compare, but the columns stay
        firsts = [(0, NULL_ID)]
    before = [(i, firsts[k - 1][0]) for k, (_, i) in enumerate(firsts)]  # a range's first id, and the range in front
    moved = of.join(F.broadcast(docs.sparkSession.createDataFrame(before, "doc_id long, part int")), "doc_id")
    moved = moved.groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("part", F.lit(True).alias("copy"), "doc_id", "text")
    rows = of.select(part_of("doc_id").alias("part"), F.lit(False).alias("copy"), "doc_id", "text").unionByName(moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprints(terms.value)
        out: list[tuple] = []
        last = None  # doc_id, text and fingerprint of the row before
        for batch in batches:
            for copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("copy", "doc_id", "text")), strict=True):
                mine = own(text)
                if last is not None:
                    n = len(last[1])
                    half = n // 2
                    edited = last[1][: n - half] + text[:half]
                    other = own(edited)
                    out.append((None if last[0] == NULL_ID else last[0], n, hashlib.sha256(edited.encode()).hexdigest(), written(last[2]), written(other), likeness(last[2], other), likeness(last[2], mine)))
                last = None if copy else (doc, text, mine)  # a copy ends its range
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)
                out = []

    return rows.repartition("part").sortWithinPartitions("part", "copy", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
