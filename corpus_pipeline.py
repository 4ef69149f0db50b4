"""From documents to packed sequences: each stage works on all that the one before it kept.

Every stage takes documents (doc_id, text, n_chars and any other columns, whatever their names) and, but for the last, returns the
same columns. Null and empty texts are kept by all stages: they are not toxic, have no lines, no shingles and no benchmark
passage, and are packed as an end id alone; so are documents of which line dedup leaves nothing. Rows without id are kept unless
they are toxic or hold a benchmark passage; their lines count as coming after all others. Rows that are equal in id and text
are treated alike and stay separate rows, near dedup included, which takes ids that are equal for one document. Empty tables stay empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from tessera.llm.common import fold, free_name, remove, shared_dir, small_batches, staging


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; learned from the labels of four folds of five."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    score = free_name(docs, "toxicity")
    scored = toxicity.scored(docs, toxicity.learn(docs, labels), score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, all of them, without lines that an earlier document or line has; n_chars follows the text."""
    small_batches(spark)
    removed = free_name(docs, "ld_removed")
    clean = line_dedup.deduplicated(docs, min_words=1, most_edits=3, letters=True)
    changed = F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).drop(removed)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group that shares four fifths of its word pairs."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs, shingle=2, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of any benchmark item."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens, all of which bear loss."""
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, tokens=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores, tokens and shuffled places have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what is not needed any more is removed."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
