"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir) that works on all rows the stage before it kept; its result is
written as Parquet and read again as the next stage's docs. Quality rules drop what they reject, line dedup removes
repeated chunks from texts, near-dedup keeps one document of each class, decontamination drops documents that hold a
benchmark window, and the last stage encodes what is left and decodes it again.

Defined results: null texts fail the base quality rules and go in the first stage; empty tables pass through; extra
columns of documents are kept by all stages but the last, which returns doc_id, n_tokens and the two digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.shared import new_path
from tidemark.llm import byte_bpe, decontaminate, line_chunks, order_minhash, quality_rules
from tidemark.llm.tables import ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return order_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", encode),
]

#: Certified cutoffs, sampled k-mers and merges by rank are beyond SQL; tests/llm compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
