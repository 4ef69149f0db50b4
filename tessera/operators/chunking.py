"""Cutting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_contents_page


def fixed_windows(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index (dense), start, chunk for each window of a text that is not blank."""
    starts = docs.where("char_length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(size - overlap))).alias("start"))
    chunks = starts.select("doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("chunk")).where(F.trim(F.regexp_replace("chunk", r"[\t\n\r]", " ")) != "")
    from pyspark.sql import Window

    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1)


def without_contents(chunks: DataFrame, column: str = "text") -> DataFrame:
    """chunks that do not look like a table of contents."""
    return chunks.where(~is_contents_page(F.col(column)))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, title, body: texts cut at lines that are #-headings or numbered titles; headings leave the body."""
    from pyspark.sql import Window

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = F.col("line").rlike(r"^(#{1,6} +\S.*|[0-9]+([.][0-9]+)* +[A-Z].*)$")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("is_title", heading).withColumn("section_no", F.sum(F.col("is_title").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_title"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    title = F.max(F.when(F.col("is_title"), F.regexp_replace("line", r"^(#{1,6}|[0-9]+([.][0-9]+)*) +", "")))
    return marked.groupBy("doc_id", "section_no").agg(F.coalesce(title, F.lit("")).alias("title"), body.alias("body"))


def pack(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Sentences put together up to a size; each next chunk starts with the sentences of the last one's tail."""
    out, held, n = [], [], 0
    for s in sentences:
        if held and n + len(s) > size:
            out.append("".join(held))
            tail, k = [], 0
            for t in reversed(held):
                if k + len(t) > overlap:
                    break
                tail.insert(0, t)
                k += len(t)
            held, n = tail, k
        held.append(s)
        n += len(s)
    return [*out, "".join(held)] if held else out


def packed_sentences(docs: DataFrame, size: int = 1000, overlap: int = 100, schema_id: str = "long") -> DataFrame:
    """doc_id, chunk_index, chunk: sentences packed with a carried tail; sequential within a text only."""
    import re

    ends = re.compile(r"(?<=[.!?。！？])|\n+")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for i, c in enumerate(pack([x.strip() for x in ends.split(t or "") if x.strip()], size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {schema_id}, chunk_index long, chunk string")


# What begins a line of model code; kinds stand alone or with `def`, others need it or a brace, colon or semicolon on their line.
CODE_LINE = (
    r"(?i)\s*(?:(?:abstract|public|private|protected)\s+)*(?:"
    r"(?:standard\s+)?(?:library\s+)?package\b|import\s+[\w']+\s*::|enum\s+def\b|(?:part|action|item|port|attribute|requirement|state|interface|connection|constraint|view|viewpoint|"
    r"use\s+case|calc|analysis|verification|allocation|occurrence|flow|concern)\s+(?:def\b|[\w'<]+[^.!?]*[{;:]))"
)


def code_blocks(docs: DataFrame, begins: str = CODE_LINE, schema_id: str = "long") -> DataFrame:
    """doc_id, segment_no (from 0), kind (text or code), segment: a text's parts in order; blank ones are left out.

    Braces are added up along a text, and a block is found by its sum alone: it begins at a line of code, and ends at the first line from there with no more braces
    open than before it that closes with } or ; and has a blank line, a heading or nothing behind it; without such a line it
    takes the rest of the text.
    """
    import re

    import numpy as np

    code, heading = re.compile(begins), re.compile(r"#{1,6}\s+\S|\d+(?:\.\d+)*\s+\S")

    def cut(text: str) -> list[tuple[str, str]]:
        lines = text.splitlines()
        if not lines:
            return []
        braces = np.cumsum([0] + [x.count("{") - x.count("}") for x in lines])
        free = np.array([not x.strip() or bool(heading.match(x)) for x in [*lines[1:], ""]])
        may_end = np.flatnonzero(free & np.array([x.rstrip()[-1:] in ("}", ";") and x.strip() != "" for x in lines]))
        first = np.array([k for k, x in enumerate(lines) if code.match(x)], int)
        edges, at = [], 0
        while (k := np.searchsorted(first, at)) < len(first):
            start = first[k]
            behind = may_end[np.searchsorted(may_end, start) :]
            ends = behind[braces[behind + 1] <= braces[start]]
            at = int(ends[0]) + 1 if len(ends) else len(lines)
            edges += [int(start), at]
        bounds = [0, *edges, len(lines)]
        parts = (("code" if i % 2 else "text", "\n".join(lines[x:y]).strip()) for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)))
        return [(kind, part) for kind, part in parts if part]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, kind, part) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for i, (kind, part) in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "kind", "segment"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {schema_id}, segment_no long, kind string, segment string")


def model_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """doc_id, section_no, title, segment_no, part_no, kind, chunk: sections cut into text and code; code stays whole, text is packed by sentences."""
    keyed = sections(docs)
    blocks = code_blocks(keyed.select(F.struct("doc_id", "section_no").alias("k"), "body").select(F.to_json("k").alias("doc_id"), F.col("body").alias("text")), schema_id="string")
    texts = packed_sentences(blocks.where("kind = 'text'").select(F.to_json(F.struct("doc_id", "segment_no")).alias("doc_id"), F.col("segment").alias("text")), size, overlap, schema_id="string")
    id_of = lambda c: F.from_json(c, "doc_id string, segment_no long")
    packed = texts.select(id_of(F.col("doc_id")).alias("s"), F.col("chunk_index").alias("part_no"), "chunk").select("s.doc_id", "s.segment_no", "part_no", F.lit("text").alias("kind"), "chunk")
    whole = blocks.where("kind = 'code'").select("doc_id", "segment_no", F.lit(0).cast("long").alias("part_no"), "kind", F.col("segment").alias("chunk"))
    both = packed.unionByName(whole).withColumn("k", F.from_json("doc_id", "doc_id long, section_no int")).select("k.*", "segment_no", "part_no", "kind", "chunk")
    return both.join(keyed.select("doc_id", "section_no", "title"), ["doc_id", "section_no"]).select("doc_id", "section_no", "title", "segment_no", "part_no", "kind", "chunk")
