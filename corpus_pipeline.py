"""The corpus pipeline: classify, drop repeated lines, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiscope.llm import line_dedup, mixing, simhash_dedup
from lexiscope.llm.quality import accepted
from lexiscope.llm.runtime import discard, materialize
from lexiscope.llm.sentencepiece_ids import encode_decode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat or nearly repeat an earlier one."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows with one id or none whose
    texts don't link are groups of their own."""
    return simhash_dedup.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row for each pass over its source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's SentencePiece ids and of the text that they decode to."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash_dedup", near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: SQL can't express the learned classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
