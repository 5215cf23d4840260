"""Ordered work on keys that may hold a large share of all rows.

A plain window sorts each key in one task. These helpers split a key by an order-preserving
bucket (an hour, a range of ids), work inside each bucket, and carry a small per-bucket summary across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def _part(keys: list[str], bucket: Column) -> Column:
    """Key and bucket as one struct: nulls inside compare as equal, so a plain join on it needs no new shuffle."""
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("bucket")).alias("_part")


def _across(keys: list[str]) -> WindowSpec:
    """Buckets of one key in order."""
    return W.partitionBy(*[F.col(f"_part.k{i}") for i in range(len(keys))]).orderBy("_part.bucket")


def number_rows(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add ``name`` = 1..n within each key. ``bucket`` must not decrease along ``order``."""
    staged = df.withColumn("_part", _part(keys, bucket))
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    numbered = staged.withColumn("_rn", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    number = (F.col("_before") + F.col("_rn")).cast("bigint").alias(name)
    return numbered.join(offsets, "_part").select(*[F.col(f"`{c}`") for c in df.columns], number)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, name: str
) -> DataFrame:
    """Add ``name`` = ``value`` of the row before within each key, like ``lag``."""
    staged = df.withColumn("_part", _part(keys, bucket))
    last = F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_last")
    ends = staged.groupBy("_part").agg(last)
    carried = ends.select("_part", F.lag("_last").over(_across(keys)).alias("_carried"))
    inside = W.partitionBy("_part").orderBy(*order)
    local = staged.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag(value).over(inside))
    found = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")).alias(name)
    return local.join(carried, "_part").select(*[F.col(f"`{c}`") for c in df.columns], found)


def pick_by(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``; remaining columns settle ties.

    An aggregate, so each task keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])
    best = (F.max if last else F.min)(packed).alias("_best")
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return out.select(
        *[F.col(f"`{c}`") if c in keys else F.col("_best").getField(c).alias(c) for c in df.columns]
    )
