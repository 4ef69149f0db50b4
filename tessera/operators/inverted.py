"""A stored inverted index with positions: added to and deleted from by document, and read by a search in place of the texts.

`add` writes the postings of some documents as a segment: for each term and block of documents one row, or a few, with its postings (document, occurrences, length,
positions) and two bounds, the most occurrences and the least length. Rows lie in a folder for each bucket of terms, so a search reads the buckets of
the terms it asks for. A document that comes again, or is deleted, leaves a tombstone, after which its postings in earlier segments do not count;
`compact` writes one segment of what counts.

A search (`clauses`: query, clause, kind, op, terms, distance) takes documents that meet all `must` clauses and no `not` clause, and at least one `should`
clause if there is no `must`. A clause is met by a document that holds all its terms anywhere (`all`), any of them (`any`), all in a row (`phrase`), or
all within `distance` places of each other (`near`). Documents are ranked by BM25 over the terms of the clauses that are not `not`.

Blocks are the same documents for each term, so a query's bounds on a block add up to more than any of its documents can score. The k-th best score among
the documents of each query's best blocks is a bound from below, and only blocks that can reach it are opened: results are those of a full scan.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms as words_of
from tessera.operators.staging import rounds, staged

BUCKETS = 64
FILES = 4  # files for each bucket of a segment, at most
WORDS = 1_000_000  # words that a task gathers at once, but for a longer document
K1, B = 1.2, 0.75


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def one_each(docs: DataFrame, stage: Callable) -> DataFrame:
    """docs with one row, the least text, for each id; only texts of ids that repeat are shuffled."""
    own = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = stage(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return own
    return own.join(again, "doc_id", "left_anti").unionByName(own.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def hashes(terms: pa.Array) -> np.ndarray:
    """What Spark's xxhash64 gives for texts, as unsigned."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    mixed = lambda lane, word: turned(lane + word * p2, 31) * p1
    seed, lens = np.uint64(42), pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(lens), np.uint64)
    data = np.frombuffer(b"".join(x.as_buffer() for x in terms.cast(pa.binary())) + b"\0" * 8, np.uint8)
    starts = np.cumsum(lens) - lens
    with np.errstate(over="ignore"):
        for n in np.unique(lens).tolist():  # all texts of a length at once
            own = np.flatnonzero(lens == n)
            byte = data[starts[own][:, None] + np.arange(n)].astype(np.uint64) if n else np.zeros((len(own), 0), np.uint64)
            word = lambda at, size: sum((byte[:, at + i] << np.uint64(8 * i) for i in range(size)), np.zeros(len(byte), np.uint64))  # noqa: E731, B023
            at, h = 0, np.full(len(own), seed + p5)
            if n >= 32:
                lanes = [np.full(len(own), seed + x) for x in (p1 + p2, p2, np.uint64(0), np.uint64(0) - p1)]
                while at + 32 <= n:
                    lanes = [mixed(lane, word(at + 8 * i, 8)) for i, lane in enumerate(lanes)]
                    at += 32
                h = sum((turned(lane, r) for lane, r in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(len(own), np.uint64))
                for lane in lanes:
                    h = (h ^ mixed(np.uint64(0), lane)) * p1 + p4
            h = h + np.uint64(n)
            while at + 8 <= n:
                h, at = turned(h ^ mixed(np.uint64(0), word(at, 8)), 27) * p1 + p4, at + 8
            if at + 4 <= n:
                h, at = turned(h ^ (word(at, 4) * p1), 23) * p2 + p3, at + 4
            while at < n:
                h, at = turned(h ^ (byte[:, at] * p5), 11) * p1, at + 1
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            out[own] = h ^ (h >> np.uint64(32))
    return out


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, block, words to place, postings: for each run of documents and each place of the index, the postings of all terms there, as compressed flat arrays."""
    for batch in batches:
        lens = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(lens), 0
        while lo < len(lens):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
            n, words = lens[lo:hi], pc.list_flatten(batch.column("words").slice(lo, hi - lo)).dictionary_encode()
            ids, block = batch.column("doc_id").slice(lo, hi - lo), batch.column("block").to_numpy()[lo:hi].astype(np.int64)
            lo = hi
            if not len(words):
                continue
            terms = words.dictionary
            own_bucket = hashes(terms).astype(np.int64) % BUCKETS
            by_bucket = np.lexsort((pc.rank(terms).to_numpy(), own_bucket))  # codes in order of buckets and terms
            rank = np.empty_like(by_bucket)
            rank[by_bucket] = np.arange(len(rank))
            blocks = int(block.max()) + 1
            code, doc = rank[words.indices.to_numpy()], np.repeat(np.arange(len(n)), n)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            place = own_bucket[by_bucket][code] * FILES + block[doc] % FILES
            order = np.argsort((place * len(rank) + code) * blocks + block[doc], kind="stable")
            place, code, doc, at = place[order], code[order], doc[order], at[order]
            new = (np.diff(code, prepend=-1) != 0) | (np.diff(block[doc], prepend=-1) != 0)
            row = np.flatnonzero(new)  # first word of each term and block
            post = np.flatnonzero(new | (np.diff(doc, prepend=-1) != 0))  # and of each document in them
            times, n_posts = np.diff(np.append(post, len(doc))), np.diff(np.searchsorted(post, np.append(row, len(doc))))
            step = np.diff(at, prepend=0)
            step[post] = at[post]  # places but the first as steps from the one before, which compresses better
            cut = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
            at_row, at_post = np.searchsorted(row, cut), np.searchsorted(post, cut)
            columns = [terms.take(pa.array(by_bucket[code[row]])), pa.array(block[doc[row]], pa.int32()), pa.array(n_posts, pa.int32())]
            posts = [ids.take(pa.array(doc[post])), pa.array(n[doc[post]], pa.int32()), pa.array(times, pa.int32())]
            step, packed = pa.array(step, pa.int32()), []
            for k in range(len(cut) - 1):
                r, p, w = slice(at_row[k], at_row[k + 1]), slice(at_post[k], at_post[k + 1]), slice(cut[k], cut[k + 1])
                packed.append(pack([c[r] for c in columns], [c[p] for c in posts], [step[w]]))
            yield pa.RecordBatch.from_arrays([pa.array(place[cut[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["place", "postings"])


def pack(*groups: list[pa.Array]) -> bytes:
    """Groups of arrays, each of one length, as compressed record batches."""
    sink = pa.BufferOutputStream()
    for group in groups:
        rows = pa.RecordBatch.from_arrays(group, names=[str(i) for i in range(len(group))])
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[pa.Array]:
    source, out = pa.BufferReader(data), []
    for _ in range(3):
        (rows,) = pa.ipc.open_stream(source)
        out += rows.columns
    return out


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, postings (by place) to term, block, postings, most, least, bucket: runs of what `found` gave become one row for each term and block."""
    run, words, at = [], 0, None
    for batch in batches:
        for place, data in zip(batch.column("place").to_pylist(), batch.column("postings"), strict=True):
            if run and (place != at or words > 4 * WORDS):
                yield merged(run, at)
                run, words = [], 0
            run.append(unpacked(data.as_py()))
            words, at = words + len(run[-1][-1]), place
    if run:
        yield merged(run, at)


def merged(run: list[list[pa.Array]], place: int) -> pa.RecordBatch:
    """What some packed postings of a place hold, in order of terms and blocks."""
    term, block, n_posts, ids, lens, times, steps = (pa.concat_arrays([x[c] for x in run]) for c in range(7))
    n_posts, times, block = n_posts.to_numpy(), times.to_numpy().astype(np.int64), block.to_numpy()
    order = np.lexsort((block, pc.rank(term, tiebreaker="dense").to_numpy()))
    # postings and places in order of their rows
    spans = lambda first, n: np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    post = spans((np.cumsum(n_posts) - n_posts)[order], n_posts[order])
    word = spans((np.cumsum(times) - times)[post], times[post])
    term, block, n_posts, times, lens = term.take(pa.array(order)), block[order], n_posts[order], times[post], lens.to_numpy()[post]
    first = np.cumsum(times) - times
    sums = np.cumsum(steps.to_numpy()[word].astype(np.int64))
    places = sums - np.repeat(sums[first] - steps.to_numpy()[word][first], times)
    code = term.dictionary_encode().indices.to_numpy()
    row = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    ends = np.append(0, np.cumsum(n_posts))[np.append(row, len(code))]
    posting = pa.StructArray.from_arrays([ids.take(pa.array(post)), pa.array(lens, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(first, len(places)), pa.int32()), pa.array(places, pa.int32()))], names=["doc_id", "len", "places"])
    return pa.RecordBatch.from_arrays([
        term.take(pa.array(row)), pa.array(block[row], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), posting), pa.array(np.maximum.reduceat(times, ends[:-1]), pa.int32()),
        pa.array(np.minimum.reduceat(lens, ends[:-1]), pa.int32()), pa.array(np.full(len(row), place // FILES), pa.int32()),
    ], names=["term", "block", "postings", "most", "least", "bucket"])


def posted(own: DataFrame) -> DataFrame:
    """term, block, postings, most, least, bucket of documents (doc_id, block, words).

    Tasks gather the words of their documents before the only shuffle, which deals each bucket's blocks to FILES places; a term and block may have a few rows.
    """
    kind = own.schema["doc_id"].dataType.simpleString()
    parts = own.select("doc_id", "block", "words").mapInArrow(found, "place int, postings binary").repartition("place").sortWithinPartitions("place")
    return parts.mapInArrow(joined, f"term string, block int, postings array<struct<doc_id:{kind},len:int,places:array<int>>>, most int, least int, bucket int")


def add(docs: DataFrame, path: str, blocks: int = 64) -> None:
    """Index docs (doc_id, text), each as a whole; a document that is in the index is replaced. Null and empty texts are documents of length 0.

    blocks is the number of blocks that documents are dealt to, and stays that of the first call. docs is read more than once.
    """
    with rounds(docs.sparkSession) as stage:
        own = one_each(docs, stage)
        if exists(docs.sparkSession, f"{path}/documents"):
            delete(docs.sparkSession, own.select("doc_id"), path)
        segment = time.time_ns()  # behind the tombstones of what it replaces
        own = own.select("doc_id", words_of(F.col("text")).alias("words"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
        posted(own).withColumn("segment", F.lit(segment)).write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        own.select(F.lit(segment).alias("segment"), "doc_id", F.size("words").alias("len")).write.mode("append").parquet(f"{path}/documents")


def delete(spark: SparkSession, ids: DataFrame, path: str) -> None:
    ids.select("doc_id", F.lit(time.time_ns()).alias("until")).distinct().write.mode("append").parquet(f"{path}/tombstones")


def tombstones(spark: SparkSession, path: str) -> DataFrame | None:
    """doc_id, until: segments of a document up to here do not count."""
    return spark.read.parquet(f"{path}/tombstones").groupBy("doc_id").agg(F.max("until").alias("until")) if exists(spark, f"{path}/tombstones") else None


def living(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, segment) that no tombstone covers."""
    gone = tombstones(rows.sparkSession, path)
    if gone is None:
        return rows
    return rows.join(gone, "doc_id", "left").where(F.col("until").isNull() | (F.col("until") < F.col("segment"))).drop("until")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """One segment of all that counts, as a new index; its bounds are exact again."""
    segment = time.time_ns()
    rows = spark.read.parquet(f"{path}/postings").select("segment", "term", "block", F.inline("postings"))
    posting = living(rows, path).groupBy("term", "block").agg(F.collect_list(F.struct("doc_id", "len", "places")).alias("postings"), F.max(F.size("places")).alias("most"), F.min("len").alias("least"))
    posting = posting.select(F.lit(segment).alias("segment"), "*", bucket(F.col("term")).alias("bucket"))
    posting.repartition(BUCKETS, "bucket", "block").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings")
    living(spark.read.parquet(f"{path}/documents"), path).select(F.lit(segment).alias("segment"), "doc_id", "len").write.parquet(f"{to}/documents")


def read_terms(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """Rows of postings of some terms; only their buckets' folders are read."""
    own = spark.createDataFrame([(t,) for t in asked], "term string")
    buckets = sorted(r[0] for r in own.select(bucket(F.col("term"))).distinct().collect())  # BUCKETS at most
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets)).join(F.broadcast(own), "term", "left_semi")


def search(spark: SparkSession, path: str, clauses: DataFrame, k: int, first_blocks: int = 2) -> DataFrame:
    """query, doc_id, bm25, rank: the k best documents of each query; clauses is a stated, small set of rows."""
    given = [r.asDict() for r in clauses.select("query", "clause", "kind", "op", "terms", "distance").collect()]
    asked = sorted({t for c in given for t in c["terms"]})
    documents = living(spark.read.parquet(f"{path}/documents"), path)
    totals = documents.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    rows = staged(read_terms(spark, path, asked).drop("bucket"))
    df = living(rows.select("term", "segment", F.inline("postings")).select("term", "segment", "doc_id"), path).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = staged(df.join(F.broadcast(totals)).select("term", idf.alias("idf"), "avg_len"))
    gain = lambda tf, length: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))
    ranked = F.broadcast(clauses.where("kind <> 'not'").select("query", F.explode("terms").alias("term")).distinct())
    bounds = rows.join(F.broadcast(weights), "term").join(ranked, "term").groupBy("query", "block", "term").agg(F.max(gain(F.col("most"), F.col("least"))).alias("bound"))
    bounds = staged(bounds.groupBy("query", "block").agg(F.sum("bound").alias("bound")))
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    best = bounds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= first_blocks).select("query", "block")

    def scored(wanted: DataFrame) -> DataFrame:
        """query, doc_id, bm25 of the documents that meet their query's clauses, in the blocks (query, block) wanted."""
        every = F.broadcast(clauses.select("query", F.explode("terms").alias("term")).distinct())
        own = rows.join(every, "term").join(F.broadcast(wanted), ["query", "block"]).select("query", "term", "segment", F.inline("postings"))
        own = living(own, path).join(F.broadcast(weights), "term")
        score = F.when(F.col("counts"), gain(F.size("places"), F.col("len"))).otherwise(0.0)
        own = own.join(ranked.withColumn("counts", F.lit(True)), ["query", "term"], "left").withColumn("counts", F.coalesce("counts", F.lit(False)))
        doc = own.groupBy("query", "doc_id").agg(F.round(F.sum(score), 6).alias("bm25"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        kept = None
        for query in sorted({c["query"] for c in given}):
            mine = [c for c in given if c["query"] == query]
            of = lambda kind: [met(c, F.col("at")) for c in mine if c["kind"] == kind]  # noqa: E731, B023
            must, should, without = of("must"), of("should"), of("not")
            rule = F.lit(True)
            for c in must:
                rule &= c
            for c in without:
                rule &= ~c
            if should and not must:
                rule &= F.exists(F.array(*should), lambda x: x)
            own_rule = F.when(F.col("query") == query, rule)
            kept = own_rule if kept is None else F.coalesce(kept, own_rule)
        return doc.where(kept & (F.col("bm25") > 0)).select("query", "doc_id", "bm25")

    place = Window.partitionBy("query").orderBy(F.desc("bm25"), "doc_id")
    ranked_docs = lambda x: x.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    least = staged(ranked_docs(scored(best)).where(F.col("rank") == k).select("query", F.col("bm25").alias("least")))
    reach = bounds.join(F.broadcast(least), "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("query", "block")
    return ranked_docs(scored(reach))


def met(clause: dict, at: Column) -> Column:
    """Whether a document's terms and places (a map) meet a clause."""
    own = clause["terms"]
    has = [F.map_contains_key(at, F.lit(t)) for t in own]
    every = has[0]
    for h in has[1:]:
        every &= h
    if clause["op"] == "any":
        return F.exists(F.array(*has), lambda x: x)
    if clause["op"] == "phrase":
        back = lambda t, n: F.transform(at[F.lit(t)], lambda p: p - n)
        starts = [back(t, n) for n, t in enumerate(own)]
        common = starts[0]
        for s in starts[1:]:
            common = F.array_intersect(common, s)
        return every & F.coalesce(F.size(common) > 0, F.lit(False))
    if clause["op"] == "near":
        # some first place of the window: all terms within `distance` of it, one of them at it
        near = lambda t, p: F.exists(at[F.lit(t)], lambda q: (q >= p) & (q <= p + clause["distance"]))

        def holds(p: Column) -> Column:
            out = near(own[0], p)
            for t in own[1:]:
                out &= near(t, p)
            return out

        return every & F.coalesce(F.exists(F.flatten(F.array(*(at[F.lit(t)] for t in own))), holds), F.lit(False))
    return every
