"""Append-only registry tables on parquet. One writer at a time is assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.ordered import pick_by


def append(df: DataFrame, root: str, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """Add rows to a table; an update is a new row with a later order value."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root.rstrip('/')}/{table}")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}")


def current(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key."""
    return pick_by(df, keys, order, last=True)
