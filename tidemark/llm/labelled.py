"""Labels to learn from, and the folds that are kept out of learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def teaching_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row per id: id and label. Ids with contradicting or missing labels are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    return known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").select("id", "label")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.expr(f"pmod(crc32(CAST(`{id_col}` AS STRING)), {folds}) = {fold}"), F.lit(False))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, out: Callable[[str], Column], sample: int, features: Callable[[Column], Column], most_bytes: int | None = None) -> list:
    """At most ``sample`` labelled rows outside the held-out fold, those with the least hash of their id: (label, x).

    With ``most_bytes`` only as many of them, in that order, as hold so many bytes of text together; one at least.
    Only ids, labels and lengths are ranked; the chosen ones, whose number the sample bounds, are broadcast to the texts, and
    only their features come to the driver. Rows that repeat an id count once.
    """
    known = teaching_labels(labels, id_col, label_col)
    chosen = known.where(~out("id")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    all_texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if most_bytes is not None:
        sizes = all_texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
        held = F.sum("bytes").over(Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id"))  # of the sample: a bounded number of rows
        chosen = sizes.withColumn("held", held).where((F.col("held") <= most_bytes) | (F.col("held") == F.col("bytes"))).select("id", "label")
    texts = all_texts.join(F.broadcast(chosen), "id")
    made = texts.select("id", F.col("label").cast("int").alias("label"), F.octet_length("text").alias("size"), F.col("text")).select("id", "label", "size", features(F.col("text")).alias("x"))
    # Of rows that repeat an id the longest, so that the sizes above bound what comes here.
    return made.groupBy("id").agg(F.max_by(F.struct("label", "x"), F.struct(F.coalesce("size", F.lit(-1)), "x")).alias("best")).orderBy("id").select("best.label", "best.x").collect()
