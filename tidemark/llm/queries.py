"""The dealt operators as registered queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import line_chunks, merkle
from .byte_bpe import round_trip
from .byte_conv import quality
from .decontaminate import decontaminate
from .order_minhash import near_duplicates
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .tables import table
from .token_counts import token_counts
from .token_files import through_files
from .toxicity import toxicity
from .turn_repair import repaired_conversations
from .warc_bundles import through_archives


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_byte_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_chunks.dedup_lines(table(spark, sf_dir, "documents"), n_lines_col="n_lines", n_removed_col="n_removed_lines")
    return made.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_byte_conv": op5_byte_conv,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_line_chunks": op8_line_chunks,
    "op9_secrets": op9_secrets,
    "op10_order_minhash": op10_order_minhash,
    "op11_warc_bundles": op11_warc_bundles,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES: dict[str, str] = {"op8_line_chunks": line_chunks.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
