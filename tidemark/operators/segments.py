"""Row differences by segments: a tree of hashes decides which key ranges are read at all.

A version is stored in segments, ranges of ``width`` of its leading key (whole numbers, dates and times; other keys in
ranges of their hash), one folder each, and beside it a tree of hashes: a leaf is the count and the order-free sum of
the row hashes of a segment, a node those of 16 nodes below it, up to a level of at most 16 nodes. Two versions are compared from
the highest level both have: only children of nodes that differ are looked at, and only segments whose leaves
differ are read. Versions of equal content end at the top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import row_hash
from ..functions.shared import settle
from .diff import row_diff

FANOUT, BITS = 16, 4
HASHED_RANGES = 4096
SEGMENT = "_segment"


def segment_of(df: DataFrame, key: str, width: int) -> Column:
    """Number of the range that a key lies in. Nulls are a range of their own."""
    c, kind = F.col(f"`{key}`"), df.schema[key].dataType
    if isinstance(kind, T.DateType):
        place = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        place = F.unix_seconds(c)
    elif isinstance(kind, T.IntegralType):
        place = c.cast("bigint")
    else:
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(c), F.lit(HASHED_RANGES))).cast("bigint")
    return F.coalesce(F.floor(place / width) if width != 1 else place, F.lit(-(1 << 62))).cast("bigint")


def write_segments(df: DataFrame, key: str, path: str, width: int) -> None:
    """Store a version in segments, with its tree. An existing path is an error."""
    placed = df.withColumn(SEGMENT, segment_of(df, key, width))
    placed.repartition(SEGMENT).write.mode("errorifexists").partitionBy(SEGMENT).parquet(f"{path}/rows")
    hashed = read_segments(df.sparkSession, path, df.schema)
    nodes = hashed.select(F.col(SEGMENT).alias("node"), row_hash(df).cast("decimal(38,0)").alias("h"))
    nodes = settle(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h").alias("hash"), F.lit(0).alias("level")))
    out, level = nodes, 0
    while nodes.count() > FANOUT:
        level += 1
        # An arithmetic shift, so ranges below zero keep their order.
        nodes = settle(nodes.groupBy(F.shiftright("node", BITS).alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sum("hash").alias("hash"), F.lit(level).alias("level")))
        out = out.unionByName(nodes)
    out.write.partitionBy("level").parquet(f"{path}/tree")


def read_segments(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a stored version, with the column ``_segment``, by which whole folders can be left unread."""
    if schema is None:
        return spark.read.parquet(f"{path}/rows")
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(SEGMENT, T.LongType())])).parquet(f"{path}/rows")


def differing_segments(spark: SparkSession, previous: str, current: str) -> DataFrame:
    """Numbers of the segments whose leaves differ, found from the roots down."""
    a, b = (spark.read.schema("node bigint, n_rows bigint, hash decimal(38,0), level int").parquet(f"{p}/tree") for p in (previous, current))
    open_: DataFrame | None = None
    top = min(t.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for t in (a, b))
    for level in range(top, -1, -1):
        mine, other = (t.where(F.col("level") == level) for t in (a, b))
        if open_ is not None:
            up = F.shiftright("node", BITS) == F.col("_up")
            mine, other = (t.join(open_, up, "left_semi") for t in (mine, other))
        left, right = (t.select("node", F.struct("n_rows", "hash").alias(n)) for t, n in ((mine, "x"), (other, "y")))
        nodes = left.join(right, "node", "full").where("NOT x <=> y").select("node")
        open_ = settle(nodes.withColumnRenamed("node", "_up"))
    return open_.withColumnRenamed("_up", SEGMENT)


def row_diff_segments(spark: SparkSession, previous: str, current: str, keys: Sequence[str]) -> DataFrame:
    """Added, removed, modified and ambiguous rows by key, as ``row_diff`` finds them, reading only segments that differ.

    The numbers of differing segments become the partition filter of both scans.
    """
    segments = [r[0] for r in differing_segments(spark, previous, current).collect()]
    sides = [read_segments(spark, p).where(F.col(SEGMENT).isin(segments)).drop(SEGMENT) for p in (previous, current)]
    return row_diff(*sides, keys).where("row_status <> 'same'")
