"""Near-duplicates by MinHash with sequential Bayesian verification.

1. A document is the set of hashes of its word shingles; equal sets are one class, whose smallest id is its
   node. Only nodes go on, so copies cost nothing more.
2. Each node has `bands` * `rows` minimum hashes. Nodes that agree in all rows of a band meet in its bucket. At
   the similarity 0.8, 42 bands of 6 rows miss a pair with a probability of 3e-6.
3. In each bucket, every node is paired with one leader, the one that meets most others in all buckets, as what
   others are copies of does. This makes pairs linear in the bucket's size. After
   the links of a round are known, only nodes of different components are paired again: with another leader
   while that still joins many, and then with all of them, so a bucket leaves no pair untested that could
   still join two components. A large bucket is then paired in blocks of its nodes, each a key of its own, so no task
   gets all of its pairs.
4. A pair's signatures are compared batch by batch. It is pruned when the posterior probability that its
   similarity reaches the threshold, given the agreements so far and a uniform prior, falls below `miss`. The
   first batch is one bit of each minimum hash, packed in a few numbers that the pairing join itself
   compares, along with set sizes that rule a pair out. Where all nodes of a bucket meet, the join also compares
   bitmaps of the sets: a bit that only one has stands for a shingle that only one has, which bounds the
   similarity from above without any miss. So only likely pairs leave the join.
5. Survivors are verified on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released, small, stage
from tessera.llm.graphs import stars


#: Nodes of a bucket that are paired with all of the bucket in one group.
BLOCK = 2_000


class Sets:
    """Sets of shingle hashes; remembers the hashes of a bounded number of words."""

    def __init__(self, shingle: int, memory: int = 60_000):
        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > memory:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.shingle, self.words = shingle, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingles of a text in ascending order. Words are what ASCII white space separates, A-Z in lower case."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.shingle, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of len(a) permutations of 32-bit hashes."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(a), np.uint32(0xFFFFFFFF))
    for lo in range(0, len(x), 1024):
        np.minimum(least, (a * x[None, lo : lo + 1024] + b).min(axis=1), out=least)
    return least


def bits(signs: np.ndarray) -> np.ndarray:
    """One bit of each of up to 256 minimum hashes, as four numbers."""
    own = np.zeros(256, np.uint8)
    own[: min(256, len(signs))] = (signs[:256] >> np.uint32(13)) & np.uint32(1)
    return np.packbits(own).view("<i8")


def bitmap(own: np.ndarray, size: int = 2048) -> np.ndarray:
    """A set's shingles as bits of `size`, in numbers of 64 bits."""
    out = np.zeros(size, np.uint8)
    out[(own % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(out).view("<i8")


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return (random.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1)), random.integers(0, 1 << 32, (n, 1), np.uint32)


def least_agreements(n: int, batch: int, threshold: float, miss: float, chance: float = 0.0) -> list[int]:
    """For each number of hashes compared, the fewest agreements at which a pair goes on.

    chance: how often hashes of different shingles agree.
    """
    s = chance + (1 - chance) * (np.arange(20_000) + 0.5) / 20_000
    threshold = chance + (1 - chance) * threshold
    out = []
    for k in range(batch, n + 1, batch):
        for m in range(k + 1):
            density = m * np.log(s) + (k - m) * np.log1p(-s)
            density = np.exp(density - density.max())
            if density[s >= threshold].sum() / density.sum() >= miss:
                break
        out.append(m)
    return out


def links(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, batch: int = 42, miss: float = 1e-5, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, roots). members: doc_id, n_shingles, node for each row of docs; roots: node, root for linked nodes.

    Texts without words have no node. Rows that share an id are one node, as ids are what results name.
    """
    n = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, (a, b) = Sets(shingle), permutations(n)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                part = whole.slice(lo, 1000)
                keys, sizes, signs, packs, maps = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    own = sets(text)
                    sizes.append(len(own))
                    keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                    least = signature(own, a, b) if len(own) else None
                    signs.append(None if least is None else least.astype("<u4").tobytes())
                    packs.append(None if least is None else bits(least).tolist())
                    maps.append(None if least is None else bitmap(own).tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast("int64"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(packs, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], names=["doc_id", "set_key", "n_shingles", "signs", "pack", "bitmap"])

    signed = stage(docs.select("doc_id", "text").mapInArrow(released(sign), "doc_id long, set_key string, n_shingles long, signs binary, pack array<bigint>, bitmap array<bigint>"), "signatures")
    has = signed.where("set_key is not null and doc_id is not null")
    classes = has.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = stage(classes, "classes")
    nodes = stage(has.join(classes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "set_key", "n_shingles", "signs", "bitmap", *(F.col("pack")[k].alias(f"p{k}") for k in range(4))).dropDuplicates(["node", "set_key"]), "nodes")
    band = lambda i: F.xxhash64(i, F.substring("signs", i * (4 * rows) + 1, F.lit(4 * rows)))
    met = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("bucket"))
    met = met.distinct()
    shared = met.groupBy("bucket").agg(F.count("*").alias("others")).where("others > 1")
    met = stage(met.join(shared, "bucket"), "buckets")
    # how often a node meets others: a text that many are copies of meets them more often than they each other
    central = met.groupBy("node").agg(F.sum("others").alias("met"))
    met = met.drop("others")

    fewest = least_agreements(n, batch, percent / 100, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4").reshape(-1, n) for c in ("x", "y"))
            alive, agreed = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, least in enumerate(fewest):
                own = slice(k * batch, (k + 1) * batch)
                agreed[alive] += (x[alive, own] == y[alive, own]).sum(axis=1)
                alive = alive[agreed[alive] >= least]
            yield part.select(["a", "b"]).take(pa.array(alive))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(shingle)
        for part in batches:
            kept, last, y = [], None, None
            for i, (s, t) in enumerate(zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)):
                x = sets(s)
                if t != last:
                    last, y = t, sets(t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            yield part.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    def test(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked."""
        signs = nodes.select("node", "signs")
        alive = pairs.join(signs.toDF("a", "x"), "a").join(signs.toDF("b", "y"), "b").select("a", "b", "x", "y")
        alive = stage(alive.mapInArrow(released(prune), "a long, b long").distinct(), "survivors")
        named = small(stage(alive.select(F.col("a").alias("doc_id")).union(alive.select("b")).distinct(), "named"))
        texts = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, "doc_id", "left_semi"), "texts")
        both = alive.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return stage(both.mapInArrow(released(confirm), "a long, b long").distinct(), "links")

    sketch = ["n_shingles", *(f"p{k}" for k in range(4))]
    most = min(n, 256) - least_agreements(min(n, 256), min(n, 256), percent / 100, miss, chance=0.5)[0]

    def likely(x: str, y: str) -> Column:
        """Whether two rows' sizes and bits leave a chance that they are linked."""
        m, k = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
        differ = sum(F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(4))
        return (100 * F.least(m, k) >= percent * F.greatest(m, k)) & (differ <= most)

    def possible(x: str, y: str) -> Column:
        """Whether the bitmaps of two rows' sets leave room for the similarity asked for."""
        only = lambda a, b: F.aggregate(F.zip_with(f"{a}.bitmap", f"{b}.bitmap", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
        m = F.col(f"{x}.n_shingles")
        return 100 * (m - only(x, y)) >= percent * (m + only(y, x))

    edges, tested, roots, last = None, None, None, float("inf")
    for turn in range(rounds + 1):
        if roots is None:
            own, every = met.withColumn("root", F.col("node")), False
        else:  # only buckets that still hold more than one component
            own = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            sizes = own.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("parts"))
            sizes = stage(sizes.where("parts > 1"), "split-buckets")
            pairs, members = sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).head()
            if not members:
                break
            own = own.join(sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket")
            every = pairs <= 64 * members or pairs > 0.7 * last or turn == rounds
            last = pairs
        own = own.join(nodes.select("node", *sketch, *(["bitmap"] if every else [])), "node")
        if turn == 0:
            own = own.join(central, "node")
        if every:
            x = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
            y = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("y")
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & likely("x", "y") & possible("x", "y"))
        else:
            order = -F.col("met") if turn == 0 else F.xxhash64("node", F.lit(turn))
            first = F.struct(order.alias("h"), "node", "root", *sketch)
            y = own.groupBy("bucket").agg(F.min(first).alias("l")).select("bucket", "l.*").alias("y")
            x = own.alias("x")
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & likely("x", "y"))
        pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = test(pairs)
        # links found before count as their stars
        edges = new if roots is None else roots.toDF("a", "b").unionByName(new)
        roots = stars(edges)
        if every:
            break
    own = classes.select("set_key", "node")
    members = signed.select("doc_id", "n_shingles", "set_key").join(small(stage(own.join(classes.where("copies > 1").select("set_key"), "set_key", "left_semi"), "copied")), "set_key", "left")
    members = members.select("doc_id", "n_shingles", F.when(F.col("set_key").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    return members, roots


def clustered(docs: DataFrame, shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents are linked if 100 * shared shingles >= percent * all shingles of both; component_id is the
    smallest id that can be reached. Texts without words (null, empty) have no shingles and are linked with
    nothing. Rows with a null id are linked with nothing, have a null component and are kept. Repeated rows are one
    node and each stays a row; an empty table stays empty.
    """
    members, roots = links(docs, shingle, percent, **options)
    roots = small(roots)
    own = members.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """docs, all columns, with the smallest id of each component alone."""
    names = docs.columns
    gone = clustered(docs, shingle, percent, **options).where("not kept").select(F.col("doc_id").alias("nd_gone")).distinct()
    gone = small(stage(gone, "near-copies"))
    return docs.join(gone, docs["doc_id"] == gone["nd_gone"], "left_anti").select(*(F.col(f"`{n}`") for n in names))
