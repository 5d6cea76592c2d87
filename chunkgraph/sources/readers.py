"""Scans of files and tables."""

from __future__ import annotations

import re

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import parse_embedding

FILE_TYPES = (".txt", ".pdf")


def text_files(spark: SparkSession, path: str | list[str], pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file, text): one row for each file."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def markdown_files(spark: SparkSession, path: str | list[str], pattern: str = "*.md", recursive: bool = True) -> DataFrame:
    """(file_path, dir_name, text) of the files that are not blank; unreadable ones are skipped."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    found = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")).filter(F.col("text").rlike(r"\S"))
    return found.withColumn("dir_name", F.element_at(F.split("file_path", "/"), -2))


def list_files(spark: SparkSession, directory: str, types: tuple[str, ...] = FILE_TYPES, max_mb: float = 50) -> DataFrame:
    """(file, length, modified, accepted) of the supported files; content is not read. Too large ones aren't accepted."""
    rows = spark.read.format("binaryFile").load(directory).select("path", "length", "modificationTime")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.filter(suffix.isin(*types)).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), (F.col("length") <= max_mb * 1024**2).alias("accepted"))


def binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """(file, page_no, text) by a page extractor, which is an argument as no PDF library comes with the engine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, i, t) for f, raw in zip(batch["path"], batch["content"]) for i, t in enumerate(extract(raw))]
            yield pd.DataFrame(rows, columns=["file", "page_no", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "file string, page_no int, text string")


def binary_images(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[int, str, bytes]]], pattern: str = "*.pdf") -> DataFrame:
    """(file, page, img_no, ext, bytes) by an image extractor that gives (page, extension, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, p, i, e, b) for f, raw in zip(batch["path"], batch["content"]) for i, (p, e, b) in enumerate(extract(raw))]
            yield pd.DataFrame(rows, columns=["file", "page", "img_no", "ext", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "file string, page int, img_no int, ext string, bytes binary")


def extract_text(images: DataFrame, engines: dict[str, Callable[[bytes], tuple[str, float]]], primary: str, prepare: Callable[[bytes], bytes] | None = None, first: float = 30.0, other: float = 20.0) -> DataFrame:
    """(file, page, img_no, engine, text, confidence, accepted, error) of images (file, page, img_no, bytes).

    Engines are arguments, as none comes with this one. The primary engine is asked first, the others in order until a
    confidence (of 100) is above ``first`` for the primary one or ``other``; else the last answer stands. An engine that
    fails passes on to the next; an image that none reads has the last error."""
    order = [primary, *[e for e in engines if e != primary]]
    if primary not in engines:
        raise ValueError(f"no engine {primary!r}")

    def read(raw: bytes) -> tuple:
        answer, error = None, None
        for name in order:
            try:
                text, confidence = engines[name](prepare(raw) if prepare else raw)
            except Exception as e:  # an engine's failure is its answer
                error = f"{name}: {e}"
                continue
            answer = (name, text, float(confidence), confidence > (first if name == primary else other))
            if answer[3]:
                break
        return (*(answer or (None, None, None, False)), error if answer is None else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([read(bytes(b)) for b in batch["bytes"]], columns=["engine", "text", "confidence", "accepted", "error"])
            yield pd.concat([batch[["file", "page", "img_no"]].reset_index(drop=True), found], axis=1)

    schema = "file string, page int, img_no int, engine string, text string, confidence double, accepted boolean, error string"
    return images.select("file", "page", "img_no", "bytes").mapInPandas(run, schema)


#: A node-link document; links are also found under the name edges.
NODE_LINK = "nodes array<struct<id:bigint,text:string,emb:array<double>>>, links array<struct<source:bigint,target:bigint,weight:double>>, edges array<struct<source:bigint,target:bigint,weight:double>>"


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link documents (plain or .gz): (node_id, text, emb) and (src, dst, weight, nbr_rank), where
    nbr_rank is the order of a node's links in the document. A document is read by one task."""
    whole = spark.read.schema(NODE_LINK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = whole.select(F.inline("nodes")).select(F.col("id").alias("node_id"), "text", "emb")
    links = whole.select(F.posexplode(F.coalesce("links", "edges")).alias("at", "e"))
    rank = F.row_number().over(Window.partitionBy("e.source").orderBy("at"))
    return nodes, links.select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.weight").alias("weight"), rank.alias("nbr_rank"))


def spread(rows: DataFrame, least: int = 4 << 20) -> DataFrame:
    """A scan of few large files dealt to all cores, for work that costs more than the exchange; one that has a task
    for each core, or that is small, stays as it is."""
    plan = rows._jdf.queryExecution()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < least or plan.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no table name")
    return name


def pull(spark: SparkSession, name: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A table's columns and, if asked, its first rows."""
    rows = spark.table(identifier(name))
    rows = rows.select(*fields) if fields else rows
    return rows.limit(limit) if limit is not None else rows


def embedding_rows(rows: DataFrame) -> DataFrame:
    """Vectors from JSON text, rows that can't be read left out; chunk texts on one line."""
    return rows.withColumn("embedding", parse_embedding(F.col("embedding"))).filter(F.col("embedding").isNotNull()).withColumn("chunk", F.translate(F.trim("chunk"), "\n", " "))


def documents_and_ocr(docs: DataFrame, ocr: DataFrame, mode: str) -> DataFrame:
    """Document chunks, chunks of OCR of the PDF files, or both."""
    pdf = ocr.filter(F.lower("file").endswith(".pdf"))
    if mode == "no_ocr":
        return docs
    if mode == "ocr_only":
        return pdf
    if mode == "all":
        return docs.unionByName(pdf, allowMissingColumns=True)
    raise ValueError("mode must be all, ocr_only or no_ocr")
