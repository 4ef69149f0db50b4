"""Packing by vector bin packing with the dot-product heuristic.

A document's tokens are cut into pieces of the sequence length and one shorter rest; full pieces are sequences of
their own. Rests are placed under three limits at once: tokens, segments and loss-bearing tokens of
a sequence. An open sequence takes, of the rests that still fit, the one whose demand has the largest dot
product with what is left of the three limits, each demand and rest as a share of its limit and weighted by
how scarce that resource is overall. When nothing fits, the next rest is cut so that it fills the sequence. Where
every document is one segment and all its tokens bear loss, as in pretraining text, that is the longest rest that fits; instruction
data have columns for both (`conversation_texts`).

Pieces are dealt to blocks of bounded size by a hash of document, start, tokens and a running number among equal pieces of a
task, so one huge document, many copies and many equal rows spread alike, and a task that is run again deals alike; each
block is packed on its own, and only its last sequence is short.
"""

from __future__ import annotations

import json
import re
import zlib
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import released, slices
from tessera.llm.token_counts import apart, has, LETTERS, load, PLAIN_BPE, SIMPLE

# What the file of a tokenizer says that lowers case, drops white space and takes runs of letters, digits or marks apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BPE = PLAIN_BPE | {"end_of_word_suffix": "</w>"}
#: A word as in `SIMPLE` with marks behind it, or none; no apostrophe, which takes letters along.
MARKED = re.compile(f"({SIMPLE.pattern})([!-&(-/:-@[-`{{-~]*)")
#: How byte-level tokenizers write each byte, and a space, which no word has.
SPELLED = bytes(range(256)).decode("latin-1").translate(LETTERS)
BETWEEN = SPELLED[32]
#: By byte of UTF-8: letters and marks of one byte, as in `MARKED`; those in upper case; second bytes of letters whose first byte is C3.
LETTER, MARK = (np.array([b < 128 and bool(MARKED.fullmatch(x)) for b in range(256) for x in [before + chr(b)]]) for before in ("", "a"))
MARK &= ~LETTER
UPPER = LETTER & (np.arange(256) < 97)
LATIN = np.array([128 <= b < 192 and bool(SIMPLE.fullmatch(chr(b + 64))) for b in range(256)])
#: Bytes of texts that are cut at once; the vectors for them take many times as much.
SLICE = 1 << 20


class WordIds:
    """Token ids of texts for a byte-level tokenizer that lowers case and drops white space.

    Such a tokenizer treats what stands between spaces or line ends on its own, and marks behind a word apart
    from the word, so ids of a text are those of its parts in a row. Texts are cut in vectors, and each distinct part is looked up once; a bounded
    number of parts is remembered. New words go to the model in one call; each ends with a token that only ends words. A tokenizer whose
    file says otherwise is called with whole texts.
    """

    def __init__(self, tokenizer, width: int, memory: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.kind, self.width, self.memory = f"<u{width}", width, memory
        self.full = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        file = json.loads(tokenizer.to_str())
        parts = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = (file["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(parts) == 2 and parts[0] == SPLIT
        plain = plain and has(parts[1], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}) and has(file["model"], WORD_BPE) and apart(file)
        plain = plain and not any(MARKED.fullmatch(a["content"]) for a in file["added_tokens"])
        self.whole = None if plain else self.full
        self.parts: dict[bytes, bytes] = {}
        if plain:
            self.model = Tokenizer(tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit(BETWEEN)
            vocabulary = file["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # by id: whether it ends a word
            self.last[[k for token, k in vocabulary.items() if token.endswith(WORD_BPE["end_of_word_suffix"])]] = True

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case letters, each by itself."""
        if not words:
            return []
        ids = np.array(self.model.encode_batch_fast([charmap_decode(b" ".join(words), "strict", SPELLED)[0]], add_special_tokens=False)[0].ids, np.int64)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
        if len(ends) != len(words):  # the vocabulary has not all last letters
            return [self.full(w.decode()) for w in words]
        raw = ids.astype(self.kind).tobytes()
        return [raw[a:b] for a, b in pairwise([0, *ends])]

    def ids(self, parts: list[bytes], word: list[bool]) -> list[bytes]:
        """Ids of different parts, of which some are words of lower-case letters."""
        found = list(map(self.parts.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            if len(self.parts) + len(new) > self.memory:
                self.parts.clear()
            own = iter(self.words([parts[i] for i in new if word[i]]))
            for i in new:
                found[i] = ids = next(own) if word[i] else self.full(parts[i].decode())
                if len(parts[i]) <= 64:
                    self.parts[parts[i]] = ids
        return found

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian bytes."""
        if self.whole:
            return list(map(self.whole, texts))
        raw = [text.encode() for text in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        apart = (data == 32) | (data == 10)
        edges = np.flatnonzero(np.diff(apart, prepend=True))  # the last byte stands apart, so each part ends
        starts, ends = edges[::2], edges[1::2]
        wide = np.append(False, data[:-1] == 0xC3) & LATIN[data]  # second bytes of letters
        letters, marks = (np.append(0, np.cumsum(x, dtype=np.int32)) for x in (LETTER[data] | wide | np.append(wide[1:], False), MARK[data]))
        sizes = ends - starts
        behind = sizes - (letters[ends] - letters[starts])  # bytes that are no letters
        word = (behind < sizes) & (marks[ends] - marks[ends - behind] == behind)
        cut = word & (behind > 0)
        # a word is one item and the marks behind it are another; any other part is one item as it is
        at = np.arange(len(starts)) + np.cumsum(cut) - cut
        first = np.zeros(len(starts) + int(cut.sum()) + 1, np.int64)
        words = np.zeros(len(first) - 1, bool)
        first[at], words[at] = np.cumsum(sizes) - sizes, word
        first[at[cut] + 1] = (np.cumsum(sizes) - behind)[cut]
        first[-1] = sizes.sum()
        kept = data[~apart]
        high = UPPER[kept] | wide[~apart] & (kept < 0x9F)
        kept += (high & np.repeat(word, sizes)).astype(np.uint8) * np.uint8(32)
        items = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(first), pa.py_buffer(kept)]).dictionary_encode()
        which, distinct = items.indices.to_numpy(), items.dictionary
        simple = np.zeros(len(distinct), bool)
        simple[which[words]] = True
        bounds, whole = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1).tolist(), distinct.buffers()[2].to_pybytes()
        found = self.ids([whole[a:b] for a, b in pairwise(bounds)], simple.tolist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        flat, begin = np.frombuffer(b"".join(found), self.kind), np.cumsum(lengths) - lengths
        own = lengths[which]
        upto = np.append(0, np.cumsum(own))
        ids = flat[np.repeat(begin[which] - upto[:-1], own) + np.arange(upto[-1])].tobytes()
        parts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))  # parts up to the end of each text
        bounds = (upto[np.append(at, len(words))[parts]] * self.width).tolist()
        return [ids[a:b] for a, b in pairwise([0, *bounds])]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def place(lengths: list[int], losses: list[int], tokens: int, segments: int, loss: int, gap: int, counts: list[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for each piece; sequences count from 0.

    The last losses[i] tokens of item i bear loss; it has counts[i] segments (one if not given, the limit at most), and so has
    each piece of it. Gaps of more than `gap` tokens are filled by cutting an item.
    """
    counts = [1] * len(lengths) if counts is None else [max(1, min(segments, c)) for c in counts]
    demand = lambda i, start: (lengths[i] - start, min(losses[i], lengths[i] - start), counts[i])
    todo: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # tokens, loss, segments -> (item, start)
    for i in range(len(lengths)):
        todo.setdefault(demand(i, 0), []).append((i, 0))
    keys = np.array(list(todo), np.int64).reshape(-1, 3)

    def add(item: int, start: int) -> None:
        nonlocal keys
        if (key := demand(item, start)) not in todo:
            todo[key] = []
            keys = np.append(keys, [key], axis=0)
        todo[key].append((item, start))

    def take(k: int) -> tuple[int, int]:
        nonlocal keys
        got = todo[key := tuple(keys[k].tolist())].pop()
        if not todo[key]:
            del todo[key]
            keys = np.delete(keys, k, axis=0)
        return got

    limits = np.array([tokens, max(1, loss), segments], float)
    scarce = np.array([sum(lengths), sum(losses), sum(counts)]) / limits  # sequences that each would need
    weights = scarce / max(scarce.max(initial=0), 1e-9) / limits**2
    out, sequence = [], 0
    while todo:
        left, offset = np.array([tokens, loss, segments]), 0
        while todo and left[0] and left[2]:
            fits = (keys <= left).all(axis=1)
            if fits.any():
                item, start = take(int(np.where(fits, keys @ (weights * left), -1.0).argmax()))
                length = lengths[item] - start
            elif (left[0] > gap or not offset) and (keys[:, 2] <= left[2]).any():
                item, start = take(int(np.where(keys[:, 2] <= left[2], keys[:, 0], -1).argmax()))
                length = int(min(lengths[item] - start, left[0], max(0, lengths[item] - losses[item] - start) + left[1]))
                add(item, start + max(0, length))
                if length <= 0:
                    break
            else:
                break
            out.append((item, start, length, sequence, offset))
            borne = max(0, start + length - max(start, lengths[item] - losses[item]))
            left, offset = left - [length, borne, counts[item]], offset + length
        sequence += 1
    return out


def packed(docs: DataFrame, path: str, end_id: int = 2, tokens: int = 4096, segments: int = 512, loss: int | None = None, loss_tokens: str | None = None, segment_count: str | None = None, gap: int = 16, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset for each piece.

    path names a tokenizer file that drops white space and exists on every executor; end_id closes each
    document. loss_tokens names a column with the number of loss-bearing tokens at a document's end (null or
    absent: all); loss limits them in a sequence (absent: as tokens). segment_count names a column with a document's segments
    (null or absent: one). Null texts are empty and become the end id alone; other columns do not matter. Repeated rows are packed as often as they occur; an empty table gives no pieces.
    """
    loss = tokens if loss is None else max(1, loss)
    of = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col(loss_tokens) if loss_tokens else F.lit(None)).cast("long").alias("loss"), (F.col(segment_count) if segment_count else F.lit(1)).cast("int").alias("count"))
    size = of.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0))).head()[0]
    blocks = max(1, -(-size // block_bytes))
    schema = T.StructType([of.schema["doc_id"], *T.StructType.fromDDL("start long, length long, doc_tokens long, ids binary, loss long, count int, pk_block int").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        ids_of, last = WordIds(tokenizer, width), end_id.to_bytes(width, "little")
        rows: list[tuple] = []
        seen: Counter[int] = Counter()  # how often a hash of id, start and tokens was met
        for batch in chain.from_iterable(slices(whole, "text", 2_000, SLICE) for whole in batches):
            docs_, texts, losses, counts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "loss", "count"))
            for doc, ids, own, count in zip(docs_, ids_of.many(texts), losses, counts, strict=True):
                ids += last
                n = len(ids) // width
                own = n if own is None else max(0, min(own, n))
                for a in range(0, n, tokens):
                    b = min(n, a + tokens)
                    part = ids[a * width : b * width]
                    h = zlib.crc32(part, zlib.crc32(f"{doc} {a}".encode()))
                    rows.append((doc, a, b - a, n, part, max(0, b - max(a, n - own)), count, zlib.crc32(seen[h].to_bytes(8, "little"), h) % blocks))
                    seen[h] += 1
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema]

    def fill(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")]))
        docs_, starts, lengths, totals, ids, losses, counts, block = (table.column(c).to_pylist() for c in schema.names)
        width = max(2, len(ids[0]) // lengths[0])
        rows = []
        for item, a, n, sequence, offset in place(lengths, losses, tokens, segments, loss, gap, [c or 1 for c in counts]):
            part = np.frombuffer(ids[item], f"<u{width}", n, a * width).astype("<u4").tobytes()
            rows.append((docs_[item], starts[item] + a, n, totals[item], part, (block[item] << 32) + sequence, offset))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*kinds[:5], pa.int64(), pa.int64()], strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    out = T.StructType([*schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return of.mapInArrow(released(cut), schema).groupBy("pk_block").applyInArrow(fill, out)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (int array), doc_ids and lengths of its segments, in order: what a trainer reads."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (x, y) -> concat(x, y.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def conversation_texts(turns: DataFrame, answer: str = "assistant") -> DataFrame:
    """doc_id, text, answer_text, turns for each conversation of turns (conv_id, turn, role, text): instruction data for packing.

    text has all turns in order, a line each; answer_text is the last turn if `answer` gave it, and empty otherwise: its tokens
    bear loss. Turns without text count as empty; equal turn numbers are ordered by role and text. Turns without conv_id form
    one conversation. A conversation is gathered in one row, as it is one training example.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    last = F.element_at("t", -1)
    return rows.select("doc_id", F.array_join("t.text", "\n").alias("text"), F.when(last["role"] == answer, last["text"]).otherwise("").alias("answer_text"), F.size("t").alias("turns"))
