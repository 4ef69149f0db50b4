"""Which names occur in which texts, as substrings and not only as words: every place of the texts is looked up among pieces of the names.

A name can only occur where one of its pieces of eight bytes does. So each name is keyed by the piece that it shares with the fewest names, and the keys are sent to the
tasks, in blocks of names; tasks read the eight bytes at each place of their texts as a number, look it up, and compare the whole name where it is a key. Names shorter
than eight bytes are keyed whole. Texts are read once for each block of names and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.staging import staged

Q = 8  # bytes of a key, which is a number of 64 bits
NAMES, CHUNK, PAIRS = 100_000, 1 << 20, 1 << 19  # names in a block; bytes of texts, and places and names, that are compared at once
ODD = np.uint64(0x9E3779B97F4A7C15)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in a row, and where each text begins and ends; null texts are empty."""
    own = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    data = own.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


def numbers(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first as its lowest; zeros stand behind the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] | (x[n:] << np.uint64(8 * n))
    return x


def low(n: np.ndarray | int) -> np.ndarray:
    """Masks of the lowest n of eight bytes."""
    return np.uint64(2**64 - 1) >> (8 * (8 - np.asarray(n))).astype(np.uint64)


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for n places each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Keys:
    """Names, none of them empty, by their keys."""

    def __init__(self, names: pa.Array, q: int = Q):
        self.names = names
        data, ends = flat(names)
        self.start, self.size, self.word = ends[:-1], np.diff(ends), numbers(data)
        width = np.minimum(self.size, q)
        n = np.minimum(self.size - width + 1, 64)  # pieces to choose from
        own, place = np.repeat(np.arange(len(n)), n), spans(self.start, n)
        piece, size = self.word[place] & low(width[own]), width[own]
        by = np.lexsort((piece, size))
        new = np.append(True, (np.diff(piece[by]) != 0) | (np.diff(size[by]) != 0)) if len(by) else np.zeros(0, bool)
        shared = np.empty(len(by), np.int64)
        shared[by] = np.diff(np.append(np.flatnonzero(new), len(by)))[np.cumsum(new) - 1]
        order = np.lexsort((place, shared, own))
        best = order[np.searchsorted(own[order], np.arange(len(n)))]
        self.offset = place[best] - self.start
        self.tables = []
        for w in np.unique(width).tolist():  # q at most
            mine = np.flatnonzero(width == w)
            mine = mine[np.argsort(piece[best[mine]], kind="stable")]
            keys, first, count = np.unique(piece[best[mine]], return_index=True, return_counts=True)
            shift = np.uint64(64 - min(24, 5 + max(11, int(len(keys)).bit_length())))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[(keys * ODD) >> shift] = True
            self.tables.append((low(w), shift, seen, keys, mine, first, count))

    def within(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """text, name: places of both for each name in each text, perhaps more than once."""
        words = numbers(data)
        for mask, shift, seen, keys, mine, first, count in self.tables:
            piece = words[: len(data)] & mask
            at = np.flatnonzero(seen[(piece * ODD) >> shift])
            key = np.minimum(np.searchsorted(keys, piece[at]), len(keys) - 1)
            met = keys[key] == piece[at]
            at, key = at[met], key[met]
            total, lo = np.cumsum(count[key]), 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
                n = count[key[lo:hi]]
                name, place = mine[spans(first[key[lo:hi]], n)], np.repeat(at[lo:hi], n)
                text = np.searchsorted(ends, place, "right") - 1
                start = place - self.offset[name]
                inside = (start >= ends[text]) & (start + self.size[name] <= ends[text + 1])
                name, text, start = name[inside], text[inside], start[inside]
                done, lo = 0, hi
                while len(name) and done < self.size[name].max():
                    left = np.clip(self.size[name] - done, 0, 8)
                    some = np.flatnonzero(left)
                    other = np.zeros(len(name), bool)
                    other[some] = ((words[start[some] + done] ^ self.word[self.start[name[some]] + done]) & low(left[some])) != 0
                    name, text, start, done = name[~other], text[~other], start[~other], done + 8
                yield text, name


def contained(names: DataFrame, texts: DataFrame, q: int = Q) -> DataFrame:
    """name, id: each name (names.name) with each text (texts.id, text) that holds it as it is written. Empty and null names and texts meet nothing."""
    spark = texts.sparkSession
    own = staged(names.where("name is not null and name <> ''").select("name").distinct())
    texts = texts.select("id", "text").where("id is not null and text is not null")
    blocks = max(1, -(-own.count() // NAMES))
    deal = F.pmod(F.xxhash64("name"), F.lit(blocks))

    def scan(part: DataFrame) -> DataFrame:
        stated = spark.sparkContext.broadcast(part.toArrow().column("name").combine_chunks())  # a block of names

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = Keys(stated.value, q)
            for batch in batches:
                size, lo = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
                    met = [text * len(keys.names) + name for text, name in keys.within(*flat(batch.column("text").slice(lo, hi - lo)))]
                    text, name = np.divmod(np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64), max(1, len(keys.names)))
                    yield pa.RecordBatch.from_arrays([keys.names.take(pa.array(name)), batch.column("id").take(pa.array(text + lo))], names=["name", "id"])
                    lo = hi

        return texts.mapInArrow(find, f"name string, id {texts.schema['id'].dataType.simpleString()}")

    return reduce(DataFrame.unionByName, (scan(own.where(deal == b)) for b in range(blocks))).distinct()


def short_or_full(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """element, id: texts that hold an element's qualified name or what stands behind its last `::` or point."""
    short = F.element_at(F.split(F.element_at(F.split("element", "::"), -1), r"\."), -1)
    forms = elements.select("element", F.explode(F.array_distinct(F.array("element", short))).alias("name"))
    return forms.join(contained(forms.select("name"), texts), "name").select("element", "id").distinct()


def pairs(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """src, dst, relation, source_id, target_id: edges between elements with texts of either end, the same text left out."""
    edges, hits = edges.select("src", "dst", "relation").distinct(), staged(hits.select("element", "id").distinct())
    ends = lambda c: hits.select(F.col("element").alias(c), F.col("id").alias(f"{'source' if c == 'src' else 'target'}_id"))
    return edges.join(ends("src"), "src").join(ends("dst"), "dst").where("source_id <> target_id").select("src", "dst", "relation", "source_id", "target_id")
