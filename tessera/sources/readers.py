"""Readers of documents, graphs, logs and evaluation files. All listing and reading is Spark's own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_type
from tessera.operators.graph import first_per_pair

UNITS = "path string, unit_no int, text string"


def texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, text of each file, read whole as UTF-8; glob such as *.md keeps some."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def runs(node: ElementTree.Element) -> str:
    """Text of all runs below an XML node."""
    return "".join(x.text or "" for x in node.iter() if local_name(x.tag) == "t")


def paragraphs(data: bytes) -> list[str]:
    """Paragraphs of a word-processor file that are not blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [t for p in root.iter() if local_name(p.tag) == "p" and (t := runs(p).strip())]


def sheets(data: bytes) -> list[str]:
    """Sheets of a spreadsheet file: cells joined by ' | ', rows by line ends."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [runs(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if local_name(r.tag) == "row"):
                cells = []
                for c in row:
                    value = next((x.text for x in c if local_name(x.tag) == "v"), None)
                    value = shared[int(value)] if c.get("t") == "s" and value is not None else runs(c) if c.get("t") == "inlineStr" else value
                    if value not in (None, ""):
                        cells.append(value)
                if cells:
                    rows.append(" | ".join(cells))
            out.append("\n".join(rows))
    return out


def slides(data: bytes) -> list[str]:
    """Slides of a presentation file: their paragraphs that are not blank, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        pages = [ElementTree.fromstring(z.read(n)) for n in names]
    return ["\n".join(t for p in page.iter() if local_name(p.tag) == "p" and (t := runs(p).strip())) for page in pages]


def pdf_pages(data: bytes) -> list[str]:
    """Pages of a PDF file; needs the pypdf library on the executors."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs pypdf on the executors") from missing
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


PARSERS = {"docx": paragraphs, "xlsx": sheets, "pptx": slides, "pdf": pdf_pages, "md": lambda b: [b.decode("utf-8", "replace")], "txt": lambda b: [b.decode("utf-8", "replace")], "sysml": lambda b: [b.decode("utf-8", "replace")]}


def units(spark: SparkSession, path: str, largest: int = 100 << 20) -> DataFrame:
    """path, unit_no (from 1), text for the paragraphs, sheets, slides or pages of all files.

    A file that cannot be read, or has more than `largest` bytes, gives one row with unit_no 0 and the reason.
    """
    every = spark.read.format("binaryFile").load(path)
    files = every.where(F.col("length") <= largest).select("path", file_type(F.col("path")).alias("kind"), "content")
    left = every.where(F.col("length") > largest).select("path", F.lit(0).alias("unit_no"), F.concat(F.lit("error: file of "), F.col("length"), F.lit(f" bytes; {largest} are read at most")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, kind, content in zip(frame["path"], frame["kind"], frame["content"], strict=True):
                try:
                    rows = [(p, i, t) for i, t in enumerate(PARSERS[kind](bytes(content)), 1) if t.strip()]
                except Exception as broken:  # noqa: BLE001  one broken file must not end the job
                    rows = [(p, 0, f"error: {broken}")]
                yield pd.DataFrame(rows, columns=["path", "unit_no", "text"])

    return files.mapInPandas(run, UNITS).unionByName(left)


def node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, type), edges (src, dst, relation)) of node-link JSON files; of an id or a pair, the first type or relation."""
    schema = "nodes array<struct<id:string,type:string>>, links array<struct<source:string,target:string,relation:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    nodes = raw.select(F.explode("nodes").alias("n")).groupBy("n.id").agg(F.min("n.type").alias("type"))
    edges = raw.select(F.explode("links").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.relation").alias("relation"))
    return nodes, first_per_pair(edges, ["relation"])


def tool_log(spark: SparkSession, path: str, servers: dict[str, str]) -> DataFrame:
    """server, tool of each call in chat logs: lines `server__tool(` or, in the older form, `tool(` with a known server."""
    lines = spark.read.text(path)
    new = F.regexp_extract("value", r"`([a-z0-9-]+)__([a-z_0-9]+)\(", 1)
    tool = F.coalesce(F.nullif(F.regexp_extract("value", r"`(?:[a-z0-9-]+__)?([a-z_0-9]+)\(", 1), F.lit("")), F.lit(""))
    known = spark.createDataFrame(list(servers.items()), "tool string, known string")
    rows = lines.select(new.alias("server"), tool.alias("tool")).where("tool <> ''").join(known, "tool", "left")
    return rows.select(F.when(F.col("server") != "", F.col("server")).otherwise(F.coalesce("known", F.lit("unknown"))).alias("server"), "tool")


def cases(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Evaluation cases of JSON files {cases: [{id, category, query, relevant_chunk_ids}]}, or those with the ids asked for."""
    schema = "cases array<struct<id:string,category:string,query:string,answerable:boolean,relevant_chunk_ids:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("cases"))
    return rows.where(F.col("id").isin(only)) if only else rows
