"""Token counts with overlap resynchronisation for huge documents.

A huge document is encoded in chunks that overlap, with offsets. Two neighbouring chunks are spliced at a place in their
overlap where both have a token boundary that is proven to be one whatever stands before or after: in front of a single
space, between a letter, a digit and a mark, or wherever no token of the vocabulary lies across (what is merged into a token
is a token itself, so nothing is ever merged across such a place; this finds places in scripts without spaces). If the overlap
has no such place, it is widened, up to the last splice; then the left chunk is encoded anew at twice its length, which keeps the
work in proportion to the text.

The same boundaries let ordinary texts be counted by their space-led pieces, of which each task remembers a
bounded number, so that the library meets a frequent piece once. All of this rests on the tokenizer's normalizer and
pre-tokenizer, which are read from its file: a tokenizer of another kind is called with whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A space between two other spaces, or between one and the end: no safe place to cut.
UNSAFE = re.compile(r"\s (?=\s|$)")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Byte-level tokenizers write each byte as a letter: printable bytes as they are, others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = str.maketrans({b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)})

#: Words of letters that are composed, have simple lower-case forms and are one pre-token.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def spelled(word: str) -> str:
    """A word as the model of a byte-level tokenizer sees it."""
    return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(LETTERS)


# What the files of byte-level tokenizers say whose pre-tokens are letters, digits or marks, each with a space in front.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_BPE = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False}


def has(found: dict | None, wanted: dict) -> bool:
    return found is not None and all(k in found and found[k] == v for k, v in wanted.items())


def apart(tokenizer: dict) -> bool:
    """Whether added tokens stand apart from words: without white space, and not of letters or digits alone."""
    return all(not re.search(r"\s", a["content"]) and not a["content"].isalnum() and not (a["lstrip"] or a["rstrip"]) for a in tokenizer["added_tokens"])


def kind(c: str) -> str:
    """L for letters, N for digits, P for marks; nothing for white space, apostrophes and what Unicode 3.2 does not know as such."""
    of = unicodedata.category(c)
    if c == "'" or c.isspace() or of[0] in "ZC" or of != unicodedata.ucd_3_2_0.category(c):
        return ""
    return of[0] if of[0] in "LN" else "P"


class Counter:
    """Counts tokens as the tokenizer's own encode() does, without adding special tokens."""

    def __init__(self, tokenizer, chunk: int = 32_768, overlap: int = 512, memory: int = 400_000):
        self.tokenizer, self.chunk, self.overlap, self.memory = tokenizer, chunk, overlap, memory
        self.widened = 0
        own, model, file = self, tokenizer.model, json.loads(tokenizer.to_str())
        self.known = plain = file["normalizer"] is None and has(file["pre_tokenizer"], BYTE_LEVEL) and has(file["model"], PLAIN_BPE) and apart(file)
        self.vocabulary = frozenset(file["model"]["vocab"]) if plain else frozenset()
        self.longest = max(map(len, self.vocabulary), default=0)
        self.added = [a["content"] for a in file["added_tokens"]]

        class Pieces(dict):
            """Tokens of pieces; a space-led word and a mark behind it are pre-tokens of their own, and so is a line end."""

            def __missing__(self, piece: str) -> int:
                if len(self) > own.memory:
                    self.clear()
                word = piece[1:] if piece[:1] == " " else piece
                if plain and SIMPLE.fullmatch(word):
                    n = len(model.tokenize(spelled(piece)))
                elif plain and piece[-1:] in (",", ".") and SIMPLE.fullmatch(word[:-1]):
                    n = self[piece[:-1]] + 1
                elif plain and "\n" in word and len(parts := piece.split("\n")) < 99 and all(x and not x[-1].isspace() and not x[0].isspace() for x in (word.split("\n")[0], *parts[1:])):
                    n = sum(self[x] for x in parts) + len(parts) - 1
                else:
                    n = own.whole(piece)
                if len(piece) <= 64:
                    self[piece] = n
                return n

        self.pieces = Pieces()

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def many(self, texts: list[str]) -> list[int]:
        if not self.known:
            return [self.whole(t) for t in texts]
        return [self.huge(t) if len(t) > self.chunk else self.plain(t) for t in texts]

    def plain(self, text: str) -> int:
        """A text of ordinary length, by its pieces; as a whole if a cut would not be safe."""
        if UNSAFE.search(text) or "\x00" in text:
            return self.whole(text)
        return sum(map(self.pieces.__getitem__, text.replace(" ", "\x00 ").split("\x00")))

    def encode(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Where the tokens of a chunk start, in the whole text's offsets, and those starts where the token before has ended."""
        offsets = self.tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        return [start + a for a, _ in offsets], [start + b[0] for a, b in zip(offsets, offsets[1:], strict=False) if a[1] <= b[0] and a[0] < b[0]]

    def stable(self, text: str, place: int) -> bool:
        """Whether a token boundary at this place is certain, whatever stands further off."""
        if any(a in text[max(0, place - len(a) + 1) : place + len(a) - 1] for a in self.added):
            return False
        before, after = text[place - 1], text[place]
        if after == " ":
            return not before.isspace() and place + 1 < len(text) and not text[place + 1].isspace()
        x, y = kind(before), kind(after)
        if x and y and x != y:
            return True
        if before.isspace() or after.isspace() or "'" in text[max(0, place - 3) : place + 3]:
            return False
        left, right = spelled(text[max(0, place - self.longest) : place])[-self.longest :], spelled(text[place : place + self.longest])[: self.longest]
        return not any(left[-k:] + right[: n - k] in self.vocabulary for n in range(2, self.longest + 1) for k in range(max(1, n - len(right)), min(n - 1, len(left)) + 1))

    def huge(self, text: str) -> int:
        total, end, kept = 0, self.chunk, 0  # tokens before the place `kept` are counted
        left = self.encode(text, 0, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(kept, end - overlap)
                stop = min(len(text), end + max(self.chunk, end - kept) if begin == kept else end + self.chunk)
                right = self.encode(text, begin, stop)
                common = set(left[1])
                place = next((p for p in reversed(right[1]) if begin < p < end and p in common and self.stable(text, p)), None)
                if place is not None or begin == kept:
                    break
                overlap *= 4
                self.widened += 1
            if place is not None:
                total += sum(1 for t in left[0] if kept <= t < place)
                kept = place
            left, end = right, stop  # without a place, right begins at kept
        return total + sum(1 for t in left[0] if t >= kept)


def counted(docs: DataFrame, path: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes and n_tokens for each row of docs; null texts count as empty.

    path names a tokenizer file that exists on every executor. Only the counts leave a task; rows
    are neither shuffled nor regrouped, so repeated rows, hot keys and ties make no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(path), chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.many(texts), pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    of = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = T.StructType([of.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])
    return of.mapInArrow(run, schema)
