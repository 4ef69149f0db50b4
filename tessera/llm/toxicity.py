"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded texts.

Folding undoes disguises: a word is read as it is written or plain, without compatibility forms and accents and with look-alike letters of
other scripts as Latin ones; digits or symbols in a word that has letters become the letters they stand for, of which there may be several, or
none at a word's end. The first reading that has an entry of the lexicon is taken. Terms are learned as written and plain, as accents tell
words of many languages apart. Entries are whole words or beginnings of words, with a weight. Exception phrases, an entry with the word before or behind it, cancel the entries
inside them. The sum of weights is divided by the text's length in words, and a logistic curve makes a score of it.

Entries, weights, exceptions and the curve are learned from labelled rows: a phrase is an exception if it is met in harmless
texts and hardly in toxic ones, and an entry is judged by where it stands outside such phrases. At most `max_docs` labelled rows
are used, those with the smallest hashes of their ids; everything else is done for every row.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, give_back, released, stage

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ο": "o", "ν": "v", "ρ": "p",
    "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ε": "e", "ɑ": "a", "ɡ": "g", "ı": "i",
}
# What stands for a letter inside a word; the first letter is the likelier one.
SUBSTITUTES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "il", "|": "li"}

#: Terms, or pairs of words, that a task gathers before it passes them on; one text may add more.
HELD = 100_000

TABLE = str.maketrans(LOOKALIKES)
READINGS = [str.maketrans({c: own[min(k, len(own) - 1)] for c, own in SUBSTITUTES.items()}) for k in (0, 1)]
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[013457@$!|](?:[^\W_]|[@$!|])*")
SIGN, LETTER = re.compile(r"[013457@$!|]"), re.compile(r"[^\W\d_]")
REST = re.compile(r"[\W\d_]+")


def plain(word: str) -> str:
    """A word without compatibility forms and accents, with look-alike letters as Latin ones."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).translate(TABLE)


def readings(word: str) -> list[str]:
    """What a word with digits or symbols may stand for, as written before plain; words without a letter stand for themselves."""
    core = word.rstrip("!|")  # marks at the end are more often just that
    if not LETTER.search(core):
        return [word]
    out = [core.rstrip("013457@$").translate(READINGS[0])]
    for table in READINGS:
        for x in (core, word):
            out.append(x.translate(table))
    return list(dict.fromkeys(out + [*map(plain, out)]))


def folded(text: str | None, known: Callable[[str], bool] = lambda word: False) -> str:
    """Words of a text without disguise, lower-case, one space before, between and after them.

    Of a word's readings, the first is taken that is known, and the first of all if none is.
    """
    low = (text or "").lower()
    simple = low.isascii()
    if not simple:
        low = unicodedata.normalize("NFC", low)
        low = "".join(c for c in low if not unicodedata.combining(c))  # accents that no letter has

    def read(m: re.Match) -> str:
        own = readings(m[0])
        return next((w for w in own if len(own) > 1 and known(f" {w} ")), own[0])

    if SIGN.search(low):
        low = DISGUISED.sub(read, low)
    low = REST.sub(" ", low).strip()
    if not simple:
        low = " ".join([w if w.isascii() or known(f" {w} ") or not known(f" {plain(w)} ") else plain(w) for w in low.split(" ")])
    return f" {low} "


@dataclass
class Lexicon:
    """entries: " word " or " beginning" with its weight; a and b: the curve over the density of weights."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    a: float = -4.0
    b: float = 8.0
    _automaton: object = field(default=None, repr=False)
    _known: dict[str, bool] = field(default_factory=dict, repr=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._automaton.add_word(e, (len(e), w))
            for e in (folded(x) for x in self.exceptions):
                self._automaton.add_word(e, (len(e), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def known(self, word: str) -> bool:
        """Whether a word, with its spaces, has an entry; the answers for a bounded number of words are remembered."""
        if word not in self._known:
            if len(self._known) >= 50_000:
                self._known.clear()
            self._known[word] = any(w is not None for _, (_, w) in self.automaton().iter(word))
        return self._known[word]

    def found(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, weight) of the entries in a folded text that no exception covers, and the text's words."""
        own = self.automaton()
        if not len(own):
            return [], 0
        read = folded(text, self.known)
        found = [(end - n + 1, end, w) for end, (n, w) in own.iter(read)]
        excused = [(i, j) for i, j, w in found if w is None]
        return [(i, j, w) for i, j, w in found if w is not None and not any(x <= i and j <= y for x, y in excused)], read.count(" ") - 1

    def density(self, text: str | None) -> float:
        """Weights found per 100 words, on a log scale; 0 if there are none."""
        found, n = self.found(text)
        return math.log1p(100 * max(0.0, sum(w for *_, w in found)) / max(1, n))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.a + self.b * self.density(text)))))


def terms(text: str | None, longest: int = 16) -> set[str]:
    """" word " for each word, as written and plain, and " beginning" for its beginnings of 3 characters and more."""
    out = set()
    for w in {x for w in set(folded(text).split()) for x in (w, plain(w))}:
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(3, min(len(w), longest) + 1))
    return out


def weight_of(bad: int, good: int, n_bad: int, n_good: int) -> float:
    """How much likelier a term is in toxic texts than in others, on a log scale; half a text is added to either."""
    return math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))


def choose(counts: list[tuple[str, int, int]], n_bad: int, n_good: int, most: int, ratio: float = 30.0) -> dict[str, float]:
    """Entries and weights out of (term, toxic documents, other documents).

    A term is kept if it is `ratio` times likelier in toxic documents and no longer term covers as many of them; longer
    terms are left out where a kept one covers more.
    """
    found = {t: (x, y) for t, x, y in counts}
    weight = {t: weight_of(x, y, n_bad, n_good) for t, (x, y) in found.items()}
    strong = {t for t in found if weight[t] >= math.log(ratio)}
    covered = {}  # the most toxic documents that an extension has
    for t in strong:
        for k in range(4, len(t)):
            covered[t[:k]] = max(covered.get(t[:k], 0), found[t][0])
    tight = [t for t in strong if covered.get(t, 0) < 0.9 * found[t][0]]
    kept = {}
    for t in sorted(tight, key=lambda t: (len(t), t)):
        if not any(t[:k] in kept for k in range(4, len(t))):
            kept[t] = weight[t]
    return dict(sorted(kept.items(), key=lambda x: (-found[x[0]][0], x[0]))[:most])


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic curve over one value, by Newton's method, each class with half of the weight."""
    if not len(x) or y.min() == y.max() or not x.any():
        return -4.0, 8.0
    v, w = np.stack([np.ones_like(x), x]), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(t @ v, -60, 60)))
        slope = v @ (w * (p - y)) + ridge * t
        t = t - np.linalg.solve((v * (w * p * (1 - p))) @ v.T + ridge * np.eye(2), slope)
    return min(float(t[0]), -0.5), max(float(t[1]), 0.5)  # without a finding no text is toxic


def labelled(docs: DataFrame, labels: DataFrame, column: str, max_docs: int) -> DataFrame:
    """doc_id, text, y for at most max_docs labelled rows, those with the smallest hashes of their ids.

    An id that is labelled more than once has its largest label, and one with several texts the least of them.
    """
    own = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def phrases(text: str | None, wanted: frozenset[str]) -> set[str]:
    """" before word " and " word behind " for each word that is wanted as " word "."""
    words = folded(text).split()
    out = set()
    for k, w in enumerate(words):
        if f" {w} " in wanted:
            out.update(f" {' '.join(p)} " for p in (words[max(0, k - 1) : k + 1], words[k : k + 2]) if len(p) == 2)
    return out


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, min_docs: int = 5, min_places: int = 5, most: int = 2_000, min_excuses: int = 3, ratio: float = 30.0) -> Lexicon:
    """Learn from rows of docs (doc_id, text) that labels (doc_id, toxic) mark.

    Rows without id, text or label teach nothing. With no rows, or only one class, the lexicon is empty and
    every score is low. Terms met in fewer than min_docs toxic texts, behind fewer than min_places words, or less than `ratio` times as often in toxic texts as in
    others outside exceptions (four times inside and outside), are no entries; phrases met in
    fewer than min_excuses harmless texts, or in more than a twentieth as many toxic ones, are no exceptions.
    """
    sample = stage(labelled(docs, labels, "toxic", max_docs).where("text is not null"), "toxic-sample")

    def counted(own: Callable[[str], Iterable[str]]) -> DataFrame:
        """term, bad, good: in how many texts of either class own() finds each term."""

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both: dict[str, list[int]] = {}

            def rows() -> pa.RecordBatch:
                bad, good = ([x[k] for x in both.values()] for k in (0, 1))
                return pa.RecordBatch.from_pydict({"term": list(both), "bad": bad, "good": good}, schema=pa.schema({"term": pa.string(), "bad": pa.int64(), "good": pa.int64()}))

            for batch in batches:
                for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    for t in own(text):
                        both.setdefault(t, [0, 0])[0 if y else 1] += 1
                    if len(both) >= HELD:  # the sums of all rows are the same
                        yield rows()
                        both.clear()
            yield rows()

        return sample.select("text", F.col("y").cast("long").alias("y")).mapInArrow(released(seen), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    totals = {bool(y): n for y, n in sample.groupBy(F.col("y") > 0).count().collect()}
    n_bad, n_good = totals.get(True, 0), totals.get(False, 0)
    if not n_bad or not n_good:
        return Lexicon({})
    top = counted(terms).where((F.col("bad") >= min_docs) & (F.col("bad") * n_good >= 4 * F.col("good") * n_bad)).orderBy(F.desc("bad"), "term").limit(50 * most)
    counts = {r["term"]: (r["bad"], r["good"]) for r in top.collect()}
    wanted = frozenset(counts)
    whole = frozenset(t for t, (_, y) in counts.items() if t[-1] == " " and y >= min_excuses)  # others have nothing to be excused
    excuses = counted(lambda text: phrases(text, whole)).where((F.col("good") >= min_excuses) & (F.col("good") >= 20 * F.col("bad")))
    exceptions = tuple(sorted(r["term"] for r in excuses.orderBy(F.desc("good"), "term").limit(most).collect()))
    if exceptions:  # count again what they do not cover
        excused = frozenset(f" {w} " for e in exceptions for w in e.split())
        again = whole & excused
        bare = Lexicon(dict.fromkeys(again, 1.0), exceptions)

        def outside(text: str | None) -> set[str]:
            found, read = bare.found(text)[0], folded(text, bare.known)
            return {read[i : j + 1] for i, j, _ in found}

        rest = {r["term"]: (r["bad"], r["good"]) for r in counted(outside).collect()} if again else {}
        counts |= {t: rest.get(t, (0, 0)) for t in again}
    counts = {t: (x, y) for t, (x, y) in counts.items() if x >= min_docs and weight_of(x, y, n_bad, n_good) >= math.log(ratio)}
    strict = frozenset(counts)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = set()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": [p[0] for p in pairs], "before": [p[1] for p in pairs]}, schema=pa.schema({"term": pa.string(), "before": pa.string()}))

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = folded(text).split()
                for before, written in zip(["", *words], words, strict=False):
                    for w in {written, plain(written)}:
                        pairs.update((t, before) for t in (f" {w} ", *(f" {w[:k]}" for k in range(3, len(w) + 1))) if t in strict)
                if len(pairs) >= HELD:  # pairs that come again are counted once
                    yield rows()
                    pairs.clear()
        yield rows()

    # copies repeat a word in one place; an abusive word is met after many different ones
    places = sample.where("y > 0").select("text").mapInArrow(released(around), "term string, before string").groupBy("term").agg(F.countDistinct("before").alias("n"))
    varied = {r["term"] for r in places.where(F.col("n") >= min_places).collect()}
    entries = choose([(t, x, y) for t, (x, y) in counts.items() if t in varied], n_bad, n_good, most, ratio)
    lexicon = Lexicon(entries, tuple(e for e in exceptions if any(f" {w} ".startswith(t) for w in e.split() for t in entries)))

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("y").cast("int64")], names=["x", "y"])

    points = sample.select("text", "y").mapInArrow(released(densities), "x double, y long").collect()
    lexicon.a, lexicon.b = fit_curve(np.array([p[0] for p in points]), np.array([float(p[1] > 0) for p in points]))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """docs with all its columns and a score from 0 to 1; null and empty texts get the score of no finding.

    If docs has a column of that name, it stays and the score's name gets an underscore more.
    """
    own = Lexicon(lexicon.entries, lexicon.exceptions, lexicon.a, lexicon.b)  # its automaton is built in each task

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")
            pa.default_memory_pool().release_unused()
        give_back()

    return docs.withColumn(free_name(docs, name), score(docs["text"]))
