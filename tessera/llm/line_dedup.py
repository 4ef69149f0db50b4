"""Line deduplication by a deletion-neighbourhood join.

A line's words, in lower case, are its symbols (and, on request, each letter of a script that is written without spaces);
two lines are near if a few words inserted, deleted or replaced make them equal: one, or as many as `allowed` says for the
shorter line. Every occurrence of a line after its first goes, and so does a line that is near to any line that came
earlier, by document id and then by place. The steps:

1. Equal lines become one, with its first occurrence.
2. Where k edits are allowed, a line is cut into k + 1 parts of equal length, of which k edits leave one as it is. The first
   and the last part stay where they are, from the line's beginning or end; those between are only needed where both of
   them are edited, and are moved by few places then. Lines that have none of their parts, at all such places, in common with
   another line cannot have a neighbour; only the rest goes on. This loses nothing.
3. Lines of one edit emit their deletion neighbourhood: the line itself and the line without each of its words, as
   hashed keys. Lines that meet in a key after losing the word at one place are near (replaced), and so are a
   line that lost a word and the line that equals the key (inserted or deleted). The earliest of each is found by
   minima, which combine before the shuffle, so a key that thousands of lines share makes no pairs.
4. The edit distance of each line to the earlier line found is verified on their words.
5. Lines of k > 1 edits would emit n over k variants each. They emit in place of them the variants that lost all words but one
   part. A part that many lines share is no key by itself: it is joined with each part of what is left of the line without it,
   to which the same bound applies. First each line meets the earliest line of its key and length; only lines
   that are not near to that one meet the others of their keys, by length. Parity bitmaps of words bound the distance
   inside the join, and a banded edit distance verifies what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_files, free_name, KEYS, released, row_keys, slices, small, stage, staged_bytes

BASE = 0x9E3779B97F4A7C15
ORDER = [*KEYS, "ln"]
#: Letters of scripts that are written without spaces between words: Thai, Lao, Myanmar, Khmer, Japanese and Chinese, by code.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3040-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


#: What str.split takes for white space: as bytes of UTF-8, and the characters of more bytes than one.
SPACE = np.array([chr(b).isspace() and b < 128 for b in range(256)])
WIDE_SPACE = re.compile(f"[{''.join(c for c in map(chr, range(128, 0x3001)) if c.isspace())}]")
#: Bits of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: How many times fewer files than `few_files` gives otherwise hold lines to compare, and what names few lines or parts.
SOME, FEW = 2, 8
#: Words of more bytes are hashed one by one.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values whose bits all depend on all bits of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(text: str, letters: bool) -> Iterator[list[str]]:
    """The words of each line, in lower case; letters: unspaced ones are words of their own."""
    low = text.lower()
    if letters and not low.isascii():
        low = UNSPACED.sub(r" \1 ", low)
    return map(str.split, low.split("\n"))


def hashed_words(texts: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each line, lines of each text), with the words of `words_of`, eight bytes at a time."""
    plain = []
    for text in texts:
        low = text.lower()
        if not low.isascii():
            low = WIDE_SPACE.sub(" ", UNSPACED.sub(r" \1 ", low) if letters else low)
        plain.append(low)
    raw = "\n".join(plain).encode("utf-8", "surrogatepass") + b"\n"
    data = np.frombuffer(raw + bytes(8), np.uint8)
    space = SPACE[data[: len(raw)]]
    edges = np.flatnonzero(np.diff(space, prepend=True))  # the last byte is white space, so each word ends
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    eight = np.ndarray((len(raw) + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = sizes.astype(np.uint64) * np.uint64(BASE)
    at = np.flatnonzero(sizes <= LONG)
    for k in range(0, LONG, 8):
        at = at[sizes[at] > k]
        if not len(at):
            break
        h[at] = mixed(h[at] ^ eight[starts[at] + k] & FIRST[np.minimum(sizes[at] - k, 8)])
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    breaks = np.flatnonzero(data[: len(raw)] == 10)
    return h, np.diff(np.searchsorted(starts, breaks), prepend=0), np.array([x.count("\n") + 1 for x in plain], np.int64)


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, place, which) for each variant of each line; place 0 is the line itself."""
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            keys, places, which = [], [], []
            for i, words in enumerate(part.column("words").to_pylist()):
                h = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)
                powers = np.cumprod(np.full(len(h), BASE, np.uint64))
                sums = np.cumsum(h * powers)
                without = (sums - h * powers) + (sums[-1] - sums) * inverse  # the words behind move up by one
                keys.append(np.append(sums[-1:], without))
                places.append(np.arange(len(h) + 1))
                which.append(np.full(len(h) + 1, i))
            rows = np.concatenate(which)
            own = part.select(ORDER).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), *own.columns], names=["v", "p", *ORDER])


def one_edit(x: Column, y: Column) -> Column:
    """Whether two word arrays differ by exactly one word inserted, deleted or replaced."""
    differ = lambda a, b: F.zip_with(a, b, lambda p, q: F.coalesce(p != q, F.lit(True)))

    def grown(long: Column, short: Column) -> Column:
        at = F.array_position(differ(F.slice(long, 1, F.size(short)), short), True)
        at = F.when(at == 0, F.size(long)).otherwise(at).cast("int")
        return F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(long))

    n, m = F.size(x), F.size(y)
    return (
        F.when(n == m, F.size(F.filter(differ(x, y), lambda d: d)) == 1).when(n == m + 1, grown(x, y)).when(m == n + 1, grown(y, x)).otherwise(False)
    )


def allowed(n: int, most: int, per: int) -> int:
    """Edits allowed between lines of which the shorter has n words: one for each `per` words, 1 at least and `most` at most."""
    return max(1, min(most, n // per))


def edits(n: Column, most: int, per: int) -> Column:
    """`allowed` as a column."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n / per))).cast("int")


def rung(s: int) -> int:
    """A part's length, rounded down so that lines of similar length have parts of the same: three binary digits are kept."""
    drop = max(0, s.bit_length() - 3)
    return s >> drop << drop


def cuts(n: int, k: int, s: int) -> list[tuple[int, int]]:
    """(tag, start) of the parts of length s of a line of n words, at all places where k edits may have moved them."""
    out = [(0, 0), (1, n - s)]
    if k == 2:
        out += [(2, s + d) for d in (-1, 0, 1)]
    if k == 3:
        out += [(2, s + d) for d in (-2, -1, 0, 1, 2)] + [(3, n - 2 * s + d) for d in (-1, 0, 1)]
    return [(tag, at) for tag, at in out if 0 <= at <= n - s]


@lru_cache(maxsize=20_000)
def plan(n: int, ks: tuple[int, ...], least: int) -> tuple[tuple[int, int, int, int], ...]:
    """(seed, start, end, k) of the parts of a line of n words, for each length that a near line may have, from `least` words on."""
    cut = {(k, rung((n - d) // (k + 1))) for k in ks for d in range(k + 1) if n - d >= max(least, k + 1)}
    return tuple(dict.fromkeys(((k << 16 | s) << 2 | tag, at, at + s, k) for k, s in sorted(cut) for tag, at in cuts(n, k, s)))


def kinds(n: int, most: int, per: int, least: int) -> tuple[int, ...]:
    """Numbers of edits that a line of n words and one of as many or fewer, but `least`, may be apart."""
    return tuple(sorted({k for d in range(most + 1) if n - d >= least and d <= (k := allowed(n - d, most, per))}))


def distinct_keys(docs: DataFrame, min_words: int, near_words: int, most: int, per: int, letters: bool) -> DataFrame:
    """ORDER, a, b, parts for each line of docs: two hashes of its words, and hashes of its parts if it may have near lines.

    Of equal lines, one at least has the parts; most of those that a task meets again have none.
    """
    of = docs.where("text is not null").select(*row_keys(F.col("doc_id"), F.col("text")), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(maxsize=20_000)(lambda n: np.array(plan(n, kinds(n, most, per, near_words), near_words), np.int64).reshape(-1, 4)[:, :3])
        none, powers, inverse, met = np.zeros((0, 3), np.int64), np.ones(1, np.uint64), np.ones(1, np.uint64), set()
        for whole in batches:
            for part in slices(whole, "text"):
                flat, sizes, counts = hashed_words(part.column("text").to_pylist(), letters)
                ends = np.cumsum(sizes)
                rows = np.repeat(np.arange(len(counts)), counts)
                numbers = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
                long = sizes >= min_words
                rows, numbers, sizes, ends = rows[long], numbers[long], sizes[long], ends[long]
                starts = ends - sizes
                if len(flat) >= len(powers):
                    powers, inverse = (np.cumprod(np.append(np.uint64(1), np.full(2 * len(flat), b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))
                sums = np.append(np.uint64(0), np.cumsum(flat * powers[: len(flat)]))  # polynomials of all runs of words are differences
                others = np.append(np.uint64(0), np.cumsum(mixed(flat) * powers[: len(flat)]))
                a, b = (mixed((x[ends] - x[starts]) * inverse[starts] + sizes.astype(np.uint64)) for x in (sums, others))
                cut = []
                for n, name in zip(sizes.tolist(), a.tolist(), strict=True):
                    new = n >= near_words and name not in met
                    if new:
                        met.add(name)
                    cut.append(own(n) if new else none)
                if len(met) > 100_000:
                    met.clear()
                counts = np.array([len(c) for c in cut], np.int64)
                seed, first, last = (np.concatenate(cut) if cut else none).T
                at = np.repeat(starts, counts)
                parts = mixed((sums[at + last] - sums[at + first]) * inverse[at + first] ^ mixed(seed.astype(np.uint64)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(parts.view(np.int64)))
                mine = part.select(KEYS).take(pa.array(rows.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(numbers.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=[*ORDER, "a", "b", "parts"])

    return of.mapInArrow(released(emit), "k_null boolean, k_id long, k_text long, ln int, a long, b long, parts array<bigint>")


def with_words(docs: DataFrame, close: DataFrame, letters: bool) -> DataFrame:
    """ORDER, words, n of the lines of docs that close (KEYS, lns: their numbers) names, each once."""
    met = docs.where("text is not null").select(*row_keys(F.col("doc_id"), F.col("text")), "text").join(close, KEYS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                rows, numbers, lines = [], [], []
                for i, (text, lns) in enumerate(zip(part.column("text").to_pylist(), part.column("lns").to_pylist(), strict=True)):
                    own = text.split("\n")
                    rows += [i] * len(lns)
                    numbers += lns
                    lines += [" ".join(next(words_of(own[ln], letters))) for ln in lns]
                mine = part.select(KEYS).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], names=[*ORDER, "line"])

    lines = met.mapInArrow(released(cut), "k_null boolean, k_id long, k_text long, ln int, line string").distinct()
    return lines.select(*ORDER, F.split("line", " ").alias("words")).withColumn("n", F.size("words"))


def within(x: list, y: list, k: int) -> bool:
    """Whether at most k edits lead from x to y: the furthest place that e edits reach on each diagonal of the band."""
    n, m = len(x), len(y)
    reach: dict[int, int] = {}
    for e in range(k + 1):
        now = {}
        for d in range(-e, e + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if e else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            now[d] = i
        if now.get(m - n) == n:
            return True
        reach = now
    return False


def line_parts(h: np.ndarray, ks: tuple[int, ...], least: int, before: int = 0) -> dict[int, tuple[int, int, int]]:
    """Key -> (start, end, k) of the parts of a line with the word hashes h."""
    raw = h.tobytes()
    return {xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b], (seed ^ before) & 0xFFFFFFFFFFFFFFFF) - (1 << 63): (a, b, k) for seed, a, b, k in plan(len(h), ks, least)}


#: Lines that may share a key before it is joined with another.
SHARED = 200


def near_by_parts(close: DataFrame, most: int, per: int, least: int, shared: int = SHARED, size: int = 0) -> DataFrame:
    """mine: lines of close (ORDER, words; different lines) of `least` words and more with an earlier line within the edits allowed.

    size: bytes of the table of lines, for `few_files`.
    """
    who = F.struct(*ORDER)
    texts = close.select(who.alias("who"), "words")
    hashed = close.select(who.alias("who"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    who_type = hashed.schema["who"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key of each line; lines that come with keys give these joined with the parts of what is left."""
        for batch in batches:
            more = "hot" in batch.schema.names
            for lo in range(0, batch.num_rows, 500):
                part, rows, keys, n, x0, x1 = batch.slice(lo, 500), [], [], [], [], []
                hot = part.column("hot").to_pylist() if more else [None] * part.num_rows
                for i, (h, own) in enumerate(zip(part.column("h"), hot, strict=True)):
                    h = h.values.to_numpy().view(np.uint64)
                    found = line_parts(h, kinds(len(h), most, per, least), least)
                    if more:
                        found = {v for key in own for a, b, k in [found[key]] for v in line_parts(np.delete(h, slice(a, b)), (k,), 1, key)}
                    side = (h >> np.uint64(6) & np.uint64(1)).astype(bool)
                    bit = np.uint64(1) << (h & np.uint64(63))
                    keys += found
                    rows += [i] * len(found)
                    n += [len(h)] * len(found)
                    x0 += [int(np.bitwise_xor.reduce(bit[~side]).view(np.int64))] * len(found)
                    x1 += [int(np.bitwise_xor.reduce(bit[side]).view(np.int64))] * len(found)
                yield pa.RecordBatch.from_arrays([part.column("who").take(pa.array(rows, pa.int32())), pa.array(n, pa.int32()), pa.array(x0, pa.int64()), pa.array(x1, pa.int64()), pa.array(keys, pa.int64())], names=["who", "n", "x0", "x1", "v"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            good = [i for i, (x, y) in enumerate(pairs) if within(x, y, allowed(min(len(x), len(y)), most, per))]
            yield batch.select(["mine"]).take(pa.array(good, pa.int32()))

    def near(pairs: DataFrame) -> DataFrame:
        """mine of the pairs (mine, earlier) that are near."""
        both = pairs.distinct().join(texts.toDF("mine", "x"), "mine").join(texts.toDF("earlier", "y"), "earlier").select("mine", "x", "y")
        return both.mapInArrow(released(verified), f"mine {who_type}").distinct()

    def likely(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        k = edits(F.least(n, m), most, per)
        apart = sum(F.bit_count(F.col(f"{x}.x{i}").bitwiseXOR(F.col(f"{y}.x{i}"))) for i in (0, 1))
        return (F.abs(n - m) <= k) & (apart <= 2 * k)

    keyed = f"who {who_type}, n int, x0 long, x1 long, v long"
    keys = stage(few_files(hashed.mapInArrow(released(emit), keyed), size, SOME), "part-keys")
    counts = stage(few_files(keys.groupBy("v").agg(F.count("*").alias("lines")).where("lines > 1"), size, FEW), "shared-parts")
    hot = counts.where(F.col("lines") > shared).select("v")
    keys_of = keys.join(small(counts.where(F.col("lines") <= shared).select("v")), "v", "left_semi")
    if hot.head(1):
        own = keys.join(small(hot), "v", "left_semi").groupBy("who").agg(F.collect_list("v").alias("hot"))  # as many as a line has parts
        own = small(stage(few_files(own, size, FEW), "lines-of-hot-parts"))  # few; the lines' words need not travel to them
        keys_of = keys_of.unionByName(hashed.join(own, "who").mapInArrow(released(emit), keyed))
    keys = stage(few_files(keys_of, size, SOME), "keys")

    cell = F.floor(F.col("n") / (most + 1)).alias("cell")
    x = keys.select("*", cell).alias("x")
    first = keys.select("v", cell, F.struct("who", "n", "x0", "x1").alias("l")).groupBy("v", "cell").agg(F.min("l").alias("l")).select("v", "cell", "l.*").alias("y")
    on = (F.col("x.v") == F.col("y.v")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.who") != F.col("y.who"))
    found = stage(few_files(near(x.join(first, on & likely("x", "y")).select(F.col("x.who").alias("mine"), F.col("y.who").alias("earlier"))), size, FEW), "near-to-first")

    lengths = F.explode(F.sequence(F.col("n") - most, F.col("n") + most)).alias("m")
    rest = keys.join(found, keys["who"] == found["mine"], "left_anti").select("*", lengths).alias("x")
    on = (F.col("x.v") == F.col("y.v")) & (F.col("x.m") == F.col("y.n")) & (F.col("y.who") < F.col("x.who"))
    pairs = rest.join(keys.alias("y"), on & likely("x", "y")).select(F.col("x.who").alias("mine"), F.col("y.who").alias("earlier"))
    return found.unionByName(near(pairs))


def removals(docs: DataFrame, min_words: int = 4, near_words: int = 8, most_edits: int = 1, words_per_edit: int = 10, letters: bool = False) -> DataFrame:
    """k_null, k_id, k_text and the numbers (from 0) of the lines to remove, for documents that lose any.

    Lines of fewer than min_words words always stay; lines of fewer than near_words words go only if equal. Lines of
    20 words and more (twice words_per_edit) may differ in one word for each words_per_edit, up to most_edits.
    """
    if not 1 <= most_edits <= 3 or words_per_edit < 4 or near_words < 2:
        raise ValueError("most_edits is 1 to 3, words_per_edit 4 at least and near_words 2 at least")
    n, several = F.col("n"), max(near_words, 2 * words_per_edit)
    one, more = (n >= near_words, F.lit(False)) if most_edits < 2 else ((n >= near_words) & (n <= several), n >= several)
    lines = stage(distinct_keys(docs, min_words, near_words, most_edits, words_per_edit, letters), "lines")
    size = staged_bytes(lines)
    first = F.min(F.struct(*ORDER)).alias("o")
    own = stage(few_files(lines.groupBy("a", "b").agg(first, F.count("*").alias("times")), size), "distinct-lines")

    keyed = lines.select("a", F.explode("parts").alias("part"))
    shared = stage(few_files(keyed.groupBy("part").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("lines")).where("lo < hi"), size, SOME), "shared-parts")
    # the least and the largest are all of two; of more, the lines are looked up
    many = small(stage(few_files(shared.where("lines > 2").select("part"), size, FEW), "parts-of-many"))
    close = shared.select(F.explode(F.array("lo", "hi")).alias("a")).unionByName(keyed.join(many, "part", "left_semi").select("a")).distinct()
    first_close = stage(few_files(own.join(close, "a", "left_semi").select("a", "b", "o"), size, SOME), "first-close-lines")
    close = first_close.select("o.*").groupBy(*KEYS).agg(F.collect_set("ln").alias("lns"))
    both = stage(few_files(with_words(docs, small(stage(few_files(close, size, FEW), "close-lines")), letters), size, SOME), "close-words")
    close = both.where(one).drop("n")

    met = close.mapInArrow(released(variants), "v long, p int, k_null boolean, k_id long, k_text long, ln int")
    met = stage(few_files(met, size, SOME), "variants")
    mine = F.struct(*ORDER)
    # by key: its earliest line, its last, and the line that equals the key; keys of one line are done with
    whole = met.groupBy("v").agg(F.min(mine).alias("any"), F.max(mine).alias("last"), F.min(F.when(F.col("p") == 0, mine)).alias("same")).where("any < last")
    met = met.join(whole.drop("last"), "v")
    at = met.groupBy("v", "p").agg(first)
    found = met.join(at, ["v", "p"]).withColumn("mine", mine)
    earlier = F.when(F.col("p") == 0, F.col("any")).otherwise(F.least("o", F.coalesce("same", "o")))
    found = found.select("mine", earlier.alias("earlier")).where("earlier < mine").distinct()
    texts = close.select(mine.alias("who"), "words")
    found = found.join(texts.toDF("mine", "x"), "mine").join(texts.toDF("earlier", "y"), "earlier")
    near = found.where(one_edit(F.col("x"), F.col("y"))).select("mine")
    if most_edits > 1:
        near = near.unionByName(near_by_parts(both.where(more).drop("n"), most_edits, words_per_edit, several, size=size))
    near = stage(few_files(near.distinct(), size, FEW), "near-lines")

    # near lines are among the close ones, so not all lines need to meet them
    touched = first_close.join(near.select(F.col("mine").alias("o")), "o").select("a", "b", "o", F.lit(True).alias("near"))
    touched = touched.unionByName(own.where("times > 1").select("a", "b", "o", F.lit(False).alias("near"))).groupBy("a", "b", "o").agg(F.max("near").alias("near"))
    touched = small(stage(few_files(touched, size, FEW), "touched-lines"))
    gone = lines.join(touched, ["a", "b"]).where(F.col("near") | (F.struct(*ORDER) != F.col("o")))
    return few_files(gone.groupBy(*KEYS).agg(F.collect_set("ln").alias("gone")), size, FEW)


def deduplicated(docs: DataFrame, min_words: int = 4, near_words: int = 8, most_edits: int = 1, words_per_edit: int = 10, letters: bool = False) -> DataFrame:
    """docs with all its columns, text without repeated lines, and ld_removed: how many lines went.

    Rows stay, even if nothing is left of a text. Null and empty texts, and texts that lose nothing, stay
    exactly as they are. The bounds are those of `removals`. Rows that are equal in id and text count as one document and are treated alike; rows
    with null ids come after all others. An empty table stays empty. If docs has a column ld_removed, it stays and the
    count is ld_removed_.
    """
    keyed = docs.select(F.struct("*").alias("row"), *row_keys(docs["doc_id"], docs["text"]))
    gone = small(stage(removals(docs, min_words, near_words, most_edits, words_per_edit, letters), "removals"))
    rows, text = keyed.join(gone, KEYS, "left"), F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text")
    names = [text if n == "text" else F.col(f"row.`{n}`") for n in docs.columns]
    return rows.select(*names, F.coalesce(F.size("gone"), F.lit(0)).alias(free_name(docs, "ld_removed")))
