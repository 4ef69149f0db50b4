"""Quality by supervised subword embeddings.

Words and their character n-grams are hashed to rows of one table of vectors; a document is the mean of its
rows, and a softmax over the mean gives the class. The table and the softmax are trained together by plain numpy
stochastic gradient descent, on at most `max_docs` labelled rows, those with the smallest hashes of their
ids. As the softmax is linear in the mean, each row of the table adds a fixed amount to the class margin, which is
all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name
from tessera.llm.toxicity import labelled

GRAMS = (2, 3, 4)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the table for 64-bit values."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(rows)).astype(np.int32)


def features(texts: list[str | None], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for all words and n-grams of some texts, and the number of the text of each.

    Words are what white space separates. N-grams are of UTF-8 bytes; they may have a space, the mark of a
    word's beginning or end, at their ends only.
    """
    parts = [b" " + b" ".join((t or "").encode("utf-8", "replace").split()) + b" " for t in texts]
    lengths = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
    data32, space = data.astype(np.uint32), data == 32
    ids, docs = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, np.uint32(n))
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ data32[j : len(data) - n + 1 + j]
        bad = space[1 : len(data) - n + 2] if n > 2 else space[:-1] & space[1:]
        for j in range(2, n - 1):
            bad = bad | space[j : len(data) - n + 1 + j]
        ok = np.flatnonzero(~bad & (of[: len(h)] == of[n - 1 :]))
        h = h[ok] * np.uint32(0x9E3779B1)
        ids.append(((h ^ (h >> np.uint32(15))) % np.uint32(rows)).astype(np.int32))
        docs.append(of[ok])
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(first):  # a word's value: its bytes times a factor for their places in it
        at = np.arange(len(data))
        at[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(data))))
        value = (data + np.uint64(1)) * mixing((at & 1023).astype(np.uint64))
        value[space] = 0
        ids.append(mixed(np.add.reduceat(value, first), rows))
        docs.append(of[first])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(docs)


def mixing(at: np.ndarray) -> np.ndarray:
    """An odd factor for each position in a word."""
    h = (at + np.uint64(1)) * BASE
    return (h ^ (h >> np.uint64(31))) | np.uint64(1)


@dataclass
class Model:
    amounts: np.ndarray  # of each row of the table, to the margin of class 1
    bias: float
    rows: int

    def scores(self, texts: list[str | None], bytes_at_once: int = 1 << 17) -> np.ndarray:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= bytes_at_once:
                out.append(self._scores(held))
                held, size = [], 0
        return np.concatenate([*out, self._scores(held)]) if held or out else np.zeros(0)

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, docs = features(texts, self.rows)
        total = np.bincount(docs, self.amounts[ids], len(texts))
        n = np.bincount(docs, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + self.bias, -60, 60)))


def train(texts: list[str | None], ys: np.ndarray, rows: int = 1 << 16, dims: int = 8, epochs: int = 6, rate: float = 20.0, seed: int = 5) -> Model:
    """Stochastic gradient descent over single documents; classes are weighted to be equal."""
    random = np.random.default_rng(seed)
    if not len(texts) or ys.min() == ys.max():
        return Model(np.zeros(rows), float(4 * (ys.mean() - 0.5)) if len(texts) else 0.0, rows)
    bags = []
    for text in texts:
        at, n = np.unique(features([text], rows)[0], return_counts=True)
        bags.append((at, (n / max(1, n.sum())).astype(np.float32)))
    table = random.normal(0, 0.1, (rows, dims)).astype(np.float32)
    soft, bias = random.normal(0, 0.1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean())).astype(np.float32)
    steps, k = epochs * len(bags), 0
    for _ in range(epochs):
        for d in random.permutation(len(bags)):
            at, share = bags[d]
            step = rate * (1 - k / steps)
            k += 1
            mean = share @ table[at]
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(ys[d])] -= 1
            p *= weight[d]
            back = soft @ p
            soft -= 0.02 * step * np.outer(mean, p).astype(np.float32)
            bias -= 0.002 * step * p.astype(np.float32)
            table[at] -= step * share[:, None] * back[None, :].astype(np.float32)
    side = soft[:, 1] - soft[:, 0]
    return Model((table @ side).astype(np.float64), float(bias[1] - bias[0]), rows)


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 5_000, max_chars: int = 50_000, max_total: int = 40_000_000) -> Model:
    """Learn from rows of docs (doc_id, text) that labels (doc_id, quality) mark.

    The driver gets at most max_docs texts of at most max_chars characters, and no more of them than have max_total characters
    together; the others are left out of the sample. Rows without id or label teach nothing; null texts count as empty. With no
    rows every score is 0.5.
    """
    n = F.coalesce(F.char_length("text"), F.lit(0))
    rows = labelled(docs, labels, "quality", max_docs).where(n <= max_chars)
    until = F.sum(n).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample, which is bounded
    rows = rows.withColumn("until", until).where(F.col("until") <= max_total)
    rows = rows.select("doc_id", "text", "y").toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), (rows["y"].to_numpy() > 0).astype(np.int64))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with all its columns and a score from 0 to 1; null and empty texts get the score of the bias alone.

    If docs has a column of that name, it stays and the score's name gets an underscore more.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.amounts.astype(np.float32), model.bias, model.rows))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series(own.scores(texts.tolist()), dtype="float64")

    return docs.withColumn(free_name(docs, name), score(docs["text"]))
