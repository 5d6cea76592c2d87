"""Documents to token ids in five stages; each works on all that the one before it kept.

  toxicity       rejects the documents that multiple-instance learning predicts as toxic
  near_copies    keeps the least doc_id of each group of near copies
  passages       cuts passages that an earlier document has
  decontaminate  rejects the documents that hold a window of a benchmark item
  encode         gives the token ids of what is left

A stage's result is written as Parquet and read again as the next one's documents, so a lost executor costs the
stage that runs. All stages but the last return the columns of documents, whatever their names; n_chars, if there is
such a column, follows a text that is cut.

Defined cases, for every stage: a null text is kept as it is (it is not toxic, alike, repeated or contaminated), and
so is a text without words; encode gives it no ids. Rows with a null doc_id are judged by their text alone: toxic and
contaminated ones go, they are no copies and nothing is cut from them. Rows that share a doc_id are one document:
they are no copies of each other, and stay or go together as copies; where several texts share an id, the passages
found in any of them are cut by word position from each. Copies of equal rank, passages and windows are settled by
the least doc_id. Texts of any length are read whole. Empty documents, labels or benchmark tables give what is left
without them: no model means no document is rejected as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm import op03_substring_dedup, op04_jaccard_join, op07_bpe_codec, op08_decontaminate, op10_toxicity_mil
from chunkgraph.llm.registry import table, tokenizer
from chunkgraph.llm.storage import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_toxicity_mil.reject(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_jaccard_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = op03_substring_dedup.remove_passages(docs)
    if "n_chars" not in docs.columns:
        return cut
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(size < F.col("n_chars"), size).otherwise(F.col("n_chars")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_bpe_codec.encode(docs, tokenizer()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("passages", passages), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL can't express the training, the verification of passages or the merges; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
