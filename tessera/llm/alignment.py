"""Alignment of the tokens of two tokenizers: A, byte-level BPE (tokenizers), and B, pieces with byte fallback (sentencepiece).

Both read a space and the text. Token ends are bits of packed bitsets, a bit for each byte. The AND of both sets has the cuts that both share, and
between two of them lies a group of tokens. The OR has all ends: each marks the last byte that one A and one B token have in common, so each is
a link. The popcount of the bits before a cut is the place of its token.

Texts are aligned by pieces that both tokenizers keep apart: a word with its space, a line end, a comma or full stop behind a letter. That these
are apart is read from the tokenizers' files (A: byte-level pre-tokens; B: no entry with such a place inside); tokenizers of another kind get
whole texts. Tasks remember the alignments of a bounded number of pieces. Pieces of many letters without a space are cut where no entry of
either vocabulary lies across.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros, no groups, no links. Rows that are
equal are aligned as rows of their own and count as documents of their own. Other columns of docs stay; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import token_counts
from tessera.llm.common import BROADCAST_ROWS, free_name, stage

LONG = 4096

#: Texts with white space beside white space, at an end, or of another kind than spaces and line ends: cut at single spaces alone.
ODD = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
PIECES = re.compile(r"\n| ?[^ \n]+")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
LETTER_MARK = re.compile(r"(?=([^\W\d_][,.]))")


class Bits:
    """A packed set of places with their ranks."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(size, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.packed & other.packed)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.packed | other.packed)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.packed))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many members stand before each place."""
        at = places >> 3
        above = (0xFF00 >> (places & 7) & 0xFF).astype(np.uint8)  # the bits of a byte that come first
        return self.before[at] + np.bitwise_count(self.packed[at] & above)


#: Of one piece: numbers of A and B tokens, groups and links, its links as codes (64-bit integers), its groups as text, each ended by `;`.
Aligned = tuple[int, int, int, int, bytes, str]


class Aligner:
    """Aligns texts piece by piece; remembers between `memory` and twice as many pieces."""

    def __init__(self, path_a: str, path_b: str, memory: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.memory = token_counts.load(path_a), SentencePieceProcessor(model_file=path_b), memory
        self.count, self.model = token_counts.Counter(self.a), self.a.model
        self.a.encode_special_tokens = True
        written = {chr(k): k for k in token_counts.PRINTABLE} | {letter: k for k, letter in token_counts.LETTERS.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(written.__getitem__, token)) if all(c in written for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size_b = len(names)
        plain = [n for i, n in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.names, self.longest = frozenset(plain), max(map(len, plain), default=1)
        self.known = self.count.known and not any("\n" in n or "▁" in n.lstrip("▁") for n in plain) and self.identity()
        self.joined = {pair for n in plain for pair in LETTER_MARK.findall(n)}  # letters and marks that an entry of B holds together
        self.size = [np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b)]
        # an id as text with what follows it: a comma, or at the end of its group a bar (A) or semicolon (B)
        self.written = [np.array([[f"{i},", f"{i}{end}"] for i in range(len(x))], object) for x, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        self.new: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def identity(self) -> bool:
        """Whether B changes nothing in a text but the space that it puts in front."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        how = model.normalizer_spec
        byte_fallback = model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
        return how.add_dummy_prefix and not how.remove_extra_whitespaces and not how.precompiled_charsmap and byte_fallback

    def ids_a(self, piece: str) -> list[int]:
        if self.known and token_counts.SIMPLE.fullmatch(piece, piece[:1] == " "):
            return [t.id for t in self.model.tokenize(token_counts.spelled(piece))]
        return self.a.encode(piece, add_special_tokens=False).ids

    def ids_b(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces; one that does not begin with a space is read behind a line end, whose tokens are taken off again."""
        plain = [p[1:] if len(p) > 1 and p[0] == " " else "\n" + p for p in pieces]
        return [ids if len(p) > 1 and p[0] == " " else ids[2:] for p, ids in zip(pieces, self.b.encode(plain, num_threads=1), strict=True)]

    def apart(self, text: str, place: int) -> bool:
        """Whether both tokenizers have a boundary at this place, whatever stands further off."""
        left, right = text[max(0, place - self.longest) : place].replace(" ", "▁"), text[place : place + self.longest].replace(" ", "▁")
        if any(left[-k:] + right[:n] in self.names for k in range(1, min(len(left), self.longest - 1) + 1) for n in range(1, min(len(right), self.longest - k) + 1)):
            return False
        return self.count.stable(text, place)

    def parts(self, piece: str) -> list[str]:
        """A piece of many letters, cut about every 4,096 letters where that is safe."""
        out, start = [], 0
        while self.known and len(piece) - start > 2 * LONG:
            place = next((p for p in range(start + LONG, len(piece) - 1) if self.apart(piece, p)), None)
            if place is None:
                break
            out.append(piece[start:place])
            start = place
        return [*out, piece[start:]]

    def aligned(self, pieces: list[str]) -> list[Aligned | None]:
        """Alignments of pieces; None where the bytes of either tokenizer's tokens are not the piece's."""
        parts = {p: self.parts(p) for p in pieces if len(p) > 2 * LONG}
        a = [self.ids_a(p) if p not in parts else [*chain.from_iterable(map(self.ids_a, parts[p]))] for p in pieces]
        b = self.ids_b([p if p not in parts else " " for p in pieces])
        for k in [k for k, p in enumerate(pieces) if p in parts]:
            b[k] = [*chain.from_iterable(self.ids_b(parts[pieces[k]]))]
        own = [p.encode() for p in pieces]
        joined = lambda ids, of: [b"".join(map(of.__getitem__, x)) for x in ids]
        same = [x == y == z for x, y, z in zip(joined(b, self.bytes_b), own, own if self.known else joined(a, self.bytes_a), strict=True)]  # byte-level tokens give all bytes back
        kept = iter(self.bitwise([x for x, ok in zip(a, same, strict=True) if ok], [y for y, ok in zip(b, same, strict=True) if ok]))
        return [next(kept) if ok else None for ok in same]

    def bitwise(self, a: list[list[int]], b: list[list[int]]) -> list[Aligned]:
        """Alignments of pieces from their ids, all in one bitset; a and b have as many bytes in each piece."""
        if not a:
            return []
        n_a, n_b = np.array([*map(len, a)]), np.array([*map(len, b)])
        ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int64, n_a.sum()), np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        last_a, last_b = np.cumsum(self.size[0][ids_a]) - 1, np.cumsum(self.size[1][ids_b]) - 1  # the last byte of each token
        bits_a, bits_b = Bits.of(last_a, last_a[-1] + 1), Bits.of(last_b, last_b[-1] + 1)
        shared, either = bits_a & bits_b, bits_a | bits_b
        ends = either.places()
        codes = ids_a[bits_a.rank(ends)] * self.size_b + ids_b[bits_b.rank(ends)]
        cuts = shared.places()
        to_a, to_b = bits_a.rank(cuts) + 1, bits_b.rank(cuts) + 1  # tokens up to the end of each group
        group_a, group_b = shared.rank(last_a), shared.rank(last_b)
        text = np.empty(len(ids_a) + len(ids_b), object)
        text[np.arange(len(ids_a)) + np.concatenate([[0], to_b])[group_a]] = self.written[0][ids_a, np.isin(last_a, cuts).astype(int)]
        text[np.arange(len(ids_b)) + to_a[group_b]] = self.written[1][ids_b, np.isin(last_b, cuts).astype(int)]
        piece_ends = last_a[np.cumsum(n_a) - 1]
        n_groups, n_links = np.diff(shared.rank(piece_ends) + 1, prepend=0), np.diff(either.rank(piece_ends) + 1, prepend=0)
        tokens, links, blob = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist(), np.concatenate([[0], np.cumsum(n_links)]) * 8, codes.tobytes()
        links = links.tolist()
        numbers = zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)
        return [(*own, blob[links[k] : links[k + 1]], "".join(text[tokens[k] : tokens[k + 1]].tolist())) for k, own in enumerate(numbers)]

    def learn(self, pieces: set[str]) -> dict[str, Aligned | None]:
        """Alignments of pieces, remembered or made; a comma or full stop behind a word is put behind the word's."""
        known = {p: self.new[p] if p in self.new else self.old[p] for p in pieces if p in self.new or p in self.old}
        left = pieces - known.keys()
        joint = {p for p in left if self.known and p[-1] in ",." and p[-2:] not in self.joined and token_counts.SIMPLE.fullmatch(p, p[0] == " ", len(p) - 1)}
        if joint:
            known |= self.learn({p[:-1] for p in joint} | {p[-1] for p in joint})
            for p in joint:
                word, mark = known[p[:-1]], known[p[-1]]
                known[p] = word and mark and tuple(x + y for x, y in zip(word, mark, strict=True))
        own = [*(left - known.keys())]
        made = dict(zip(own, self.aligned(own), strict=True)) | {p: known[p] for p in joint}
        self.new |= {p: v for p, v in made.items() if len(p) <= 64}
        if len(self.new) >= self.memory:
            self.old, self.new = self.new, {}
        return known | made

    def split(self, text: str) -> list[str]:
        if not self.known:
            return [" " + text]
        if ODD.search(text):
            first, *others = SINGLE.split(" " + text)
            return [first, *(" " + p for p in others)]
        return PIECES.findall(" " + text)

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: numbers of A and B tokens, groups and links, groups as text, distinct codes of links and how often each occurs."""
        pieces = [self.split(t) if t else [] for t in texts]
        return [self.whole(own, found) for own, found in zip(pieces, [self.learn({*chain.from_iterable(pieces)})] * len(pieces), strict=True)]

    def whole(self, pieces: list[str], known: dict[str, Aligned | None]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        times = Counter(pieces)
        found = [known[p] for p in times]
        if not found or None in found:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_a, n_b, n_groups, n_links, blobs, _ = zip(*found, strict=True)
        numbers = [sum(map(mul, times.values(), x)) for x in (n_a, n_b, n_groups, n_links)]
        codes, weights = np.frombuffer(b"".join(blobs), np.int64), np.repeat(np.fromiter(times.values(), np.int64, len(times)), n_links)
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return *numbers, "".join([known[p][5] for p in pieces])[:-1], codes[first], np.add.reduceat(weights, first)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, memory: int) -> Aligner:
    """One for each Python worker, which several tasks use one after the other."""
    return Aligner(path_a, path_b, memory)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, path_a: str, path_b: str, memory: int = 200_000, rows: int = 256) -> DataFrame:
    """docs with al_n_a, al_n_b, al_n_groups, al_n_links, al_groups (`a1,a2|b1;a3|b2`), al_pairs and al_times.

    al_pairs are the distinct linked ids as A id * (entries of B) + B id, ascending, al_times how many links have them. Nothing is shuffled; a
    task holds one batch of texts and, of results, `rows` at once. Paths name files that exist on every executor.
    """
    names = [free_name(docs, f"al_{n}") for n in (*NUMBERS, "groups", "pairs", "times")]
    kinds = [T.LongType()] * 4 + [T.StringType()] + [T.ArrayType(T.LongType(), False)] * 2
    at, all_names = docs.columns.index("text"), [*docs.columns, *names]

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_aligner = aligner(path_a, path_b, memory)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                found = [*zip(*own_aligner.texts(batch.column(at).to_pylist()), strict=True)]
                own = [pa.array(found[k], pa.int64()) for k in range(4)] + [pa.array(found[4], pa.string()), lists(found[5]), lists(found[6])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=all_names)

    fields = [*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]
    return docs.mapInArrow(run, T.StructType(fields))


def pair_counts(rows: DataFrame, size_b: int, pairs: str = "al_pairs") -> DataFrame:
    """pair, n_docs, best: in how many rows each pair of ids is linked, and whether no other pair of its A id is in more."""
    counts = rows.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / size_b))  # at most as many rows as B has entries
    return counts.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(of_a)).alias("best"))


def weighed(rows: DataFrame, counts: DataFrame, key: str, pairs: str = "al_pairs", times: str = "al_times", most: int = BROADCAST_ROWS) -> DataFrame:
    """key, n_best, count_sum: links of each row by their pairs' counts; rows without links are left out.

    The pairs that most documents have, `most` at most, are broadcast; links of other pairs meet their counts in a shuffle.
    """
    levels = dict(counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("level")).count().collect())  # 63 rows at most
    least, held = 64, 0
    while least and held + levels.get(least - 1, 0) <= most:
        least -= 1
        held += levels.get(least, 0)
    floor = 1 << least
    links = rows.select(key, F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(times).alias("n"))))
    met = links.join(F.broadcast(counts.where(F.col("n_docs") >= floor)), "pair", "left")
    sums = lambda x: x.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    if least == 0:
        return sums(met)
    rare = met.where(F.col("n_docs").isNull()).drop("n_docs", "best").join(counts.where(F.col("n_docs") < floor), "pair")
    both = sums(met.where(F.col("n_docs").isNotNull())).unionByName(sums(rare))
    return both.groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compared(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (empty without tokens) of every row of docs (doc_id, text)."""
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = alignments(docs.select("doc_id", "text"), path_a, path_b).drop("text")
    digest = F.when(F.col("al_n_links") > 0, F.sha2(F.col("al_groups").cast("binary"), 256)).otherwise("")
    rows = found.select("doc_id", *[F.col(f"al_{n}").alias(n) for n in NUMBERS], digest.alias("groups_sha256"), "al_pairs", "al_times")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    sums = weighed(rows, stage(pair_counts(rows, size_b), "pairs"), "row")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("al_pairs", "al_times").join(sums, "row", "left").select("doc_id", *NUMBERS, zero("n_best"), zero("count_sum"), "groups_sha256")
