"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of a benchmark item (the whole item if it is shorter). Its shingles
are its runs of `shingle` words. A document can hold a window only if it holds every shingle of it, so one
necessary shingle is enough as the prefix: the one that is rarest among all documents. The steps:

1. Documents become rows of (position, hash of shingle); only hashes of the benchmark's shingles are kept, and only those become
   text. This one pass over the texts leaves a table as small as the contamination itself, plus one row per document. A benchmark
   of more than WANTED shingles is met in blocks of so many, each in a pass of its own; documents are never shuffled for it.
2. Shingles are counted over all documents, and each window takes its rarest as the prefix. A window with
   a shingle that occurs nowhere is dropped.
3. Prefix hits give the start a window would have; it must lie within the document (positional and length
   bounds).
4. A start is confirmed when shingles that together cover the whole window are found at their places. Shingles
   are compared as text, so this proves equality word for word.

Skew: a passage in a third of all documents is a hot shingle, but each of its rows is only matched with
the few windows that hold it, from a table of the benchmark's size; all other joins are on document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEYS, few_files, lower_ascii, row_keys, small, stage, staged_bytes

#: Hashes of shingles that are broadcast at once, 16 bytes each.
WANTED = 2_000_000

#: What separates words once A-Z are in lower case: ASCII other than digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text in order; null and wordless texts have none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def run_hash(words: Column, i: Column, k: Column | int) -> Column:
    return F.xxhash64(F.slice(words, i, k))


def runs(words: Column, n: Column, k: int) -> Column:
    """struct(pos, k, h) for each run of k words; positions start at 1."""
    run = lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), run_hash(words, i, k).alias("h"))
    none = F.array().cast("array<struct<pos:int,k:int,h:bigint>>")
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), run)).otherwise(none)


def windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, win (words joined by a space), len: the distinct windows of each item.

    Items without id or words have none.
    """
    words = items.where(F.col("item_id").isNotNull()).select("item_id", word_array(F.col("text")).alias("words"))
    words = words.withColumn("n", F.size("words")).where("n > 0").withColumn("len", F.least("n", F.lit(window)))
    starts = words.select("item_id", "words", "len", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)).alias("i"))
    return starts.select("item_id", F.array_join(F.slice("words", F.col("i"), F.col("len")), " ").alias("win"), "len").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, item_ids (sorted as strings).

    docs needs doc_id and text, items needs item_id and text; other columns are ignored. Null or empty texts
    have no words and no hits; items without id or words are ignored; repeated rows and items give each row
    its own result and each item id once; with no items nothing is hit.
    """
    size = window * items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]  # of the windows, at most
    own = stage(few_files(windows(items, window), size), "windows")
    wins = own.select("win", "len").distinct()
    lengths = sorted({min(shingle, r[0]) for r in own.select("len").distinct().collect()} | {shingle})
    words = F.split("win", " ")
    parts = wins.select("win", "len", words.alias("words"), F.least(F.lit(shingle), "len").alias("k"))
    parts = parts.select("win", "len", "k", "words", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off"))
    parts = parts.withColumns({"s": F.array_join(F.slice("words", F.col("off") + 1, F.col("k")), " "), "h": run_hash(F.col("words"), F.col("off") + 1, F.col("k"))})
    # every k-th shingle and the last one cover the window
    parts = parts.withColumn("cover", (F.col("off") % F.col("k") == 0) | (F.col("off") == F.col("len") - F.col("k")))
    parts = stage(few_files(parts.select("win", "len", "off", "s", "h", "cover"), size), "parts")
    wanted = stage(few_files(parts.select("h").distinct().withColumn("wanted", F.lit(True)), size), "wanted")
    parts = parts.drop("h")

    texts = docs.select(F.col("doc_id"), *row_keys(F.col("doc_id"), F.col("text")), word_array(F.col("text")).alias("words"))
    texts = texts.withColumn("n_words", F.size("words"))
    # position 0 stands for the document
    itself = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("h")))
    rows = lambda *more: texts.select("doc_id", *KEYS, "n_words", "words", F.inline(F.concat(*more, *(runs(F.col("words"), F.col("n_words"), k) for k in lengths))))
    blocks = max(1, -(-wanted.count() // WANTED))
    block = lambda b: F.broadcast(wanted.where(F.pmod("h", F.lit(blocks)) == b))
    kept = rows(itself).join(block(0), "h", "left").where("pos = 0 or wanted").drop("wanted")
    for b in range(1, blocks):
        kept = kept.unionByName(rows().join(block(b), "h").drop("wanted"))
    # text decides from here on; equal hashes of different shingles find no partner
    kept = stage(kept.select("doc_id", *KEYS, "n_words", "pos", F.array_join(F.slice("words", F.greatest("pos", F.lit(1)), F.col("k")), " ").alias("s")), "hits")

    hits = kept.where("pos > 0").select(*KEYS, "n_words", "pos", "s").distinct()
    counts = hits.groupBy("s").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, "s", "left").groupBy("win", "len").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "s", "off")).alias("first"),
        F.array_distinct(F.collect_list(F.when(F.col("cover"), F.struct("off", "s")))).alias("cover"),
    )
    prefix = ranked.where("first.n > 0").select("win", "len", "cover", F.col("first.s").alias("s"), F.col("first.off").alias("off"))
    prefix = small(stage(few_files(prefix, size), "prefixes"))
    found = hits.join(prefix, "s").withColumn("start", F.col("pos") - F.col("off"))
    found = found.where("start >= 1 and start + len - 1 <= n_words")
    checks = found.select(*KEYS, "win", "len", "start", F.size("cover").alias("need"), F.inline("cover"))
    checks = checks.select(*KEYS, "win", "len", "start", "need", (F.col("start") + F.col("off")).alias("pos"), "s")
    proven = checks.join(hits.select(*KEYS, "pos", "s"), [*KEYS, "pos", "s"]).groupBy(*KEYS, "win", "len", "start").agg(F.count("*").alias("got"), F.first("need").alias("need"))
    size = staged_bytes(kept)
    proven = stage(few_files(proven.where("got = need").drop("got", "need"), size), "proven")

    spans = F.collect_set(F.struct("start", "len"))
    places = F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    hit = proven.groupBy(*KEYS).agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    named = proven.select(*KEYS, "win").distinct().join(own.select("win", "item_id"), "win")
    named = named.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    result = kept.where("pos = 0").select("doc_id", *KEYS, "n_words").join(hit.join(named, KEYS), KEYS, "left")
    return few_files(result, size).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), *KEYS,
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """docs, all columns, without the documents that hold any benchmark window; clean ones stay as they are."""
    bad = find_leaks(docs, items, window, shingle).where("n_hit > 0").select(*KEYS).distinct()
    keyed = docs.select(F.struct("*").alias("row"), *row_keys(docs["doc_id"], docs["text"]))
    return keyed.join(small(stage(bad, "contaminated")), KEYS, "left_anti").select("row.*")
