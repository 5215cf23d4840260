"""Recall from an index: past investigations that can't be among the best matches are not read.

The past is stored in blocks, newest first, each in a folder of its own. A small table says of every block which datasets, metrics and
columns occur in it, the most of them one investigation has, and its newest date. From that follows the best score
any of its members can have against a request. Every request first reads its most promising block; its k-th match so far
then rules out all blocks whose best possible score is lower, or equal with no newer member, and of what is left four times as many
blocks are read, until nothing is. The result is that of ``memory.similar``: bounds are never below a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.shared import settle
from . import memory

ROWS_PER_BLOCK = 2000
#: The most matches that can be asked of an index.
MOST = 10
_SUMMARY = "block int, n bigint, newest timestamp, datasets array<string>, metrics array<string>, columns array<string>, most_metrics int, most_columns int"


def build(resolved: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Store resolved investigations (as for ``memory.similar``) in blocks, with the table of blocks.

    Of investigations with equal signatures the newest ``MOST`` + 1 are kept; no other can be among ``MOST`` matches.
    """
    past = settle(memory._newest_members(memory._signature(resolved), MOST + 1).drop("_nth", "_sig"))
    n = max(1, -(-past.count() // rows_per_block))
    dealt = past.repartitionByRange(n, F.desc("created_at"), F.desc("investigation_id"))
    dealt.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/rows")
    rows = _rows(resolved.sparkSession, path, past.schema)
    sets = [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("metrics", "columns")]
    most = [F.max(F.size(c)).alias(f"most_{c}") for c in ("metrics", "columns")]
    summary = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").cast("timestamp").alias("newest"), F.collect_set(memory._named("dataset_name")).alias("datasets"), *sets, *most)
    summary.write.parquet(f"{path}/blocks")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("block", T.IntegerType())])).parquet(f"{path}/rows")


def _bounds(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Best possible score of each request (_now) in each block that can hold any match.

    The stated requests go to the small table of blocks, ``memory.BLOCK`` at a time.
    """
    parts, out = max(1, -(-requests.count() // memory.BLOCK)), None
    for i in range(parts):
        some = requests.filter(F.pmod(F.xxhash64("_now"), F.lit(parts)) == i)
        asked = some.agg(F.collect_list(F.struct("_now", memory._named("dataset_name").alias("d"), "metrics", "columns"))).scalar()
        each = blocks.select("block", "n", "newest", "datasets", F.col("metrics").alias("_m"), F.col("columns").alias("_c"), "most_metrics", "most_columns", F.explode(asked).alias("_r"))
        bound = each.select(
            F.col("_r._now").alias("_now"), "block", "n", "newest",
            (F.array_contains("datasets", F.col("_r.d")) & (F.col("_r.d") != "")).cast("int").alias("same_dataset"),
            F.least(F.size(F.array_intersect("_m", F.col("_r.metrics"))), "most_metrics").alias("n_metrics"),
            F.least(F.size(F.array_intersect("_c", F.col("_r.columns"))), "most_columns").alias("n_columns"),
        ).filter("same_dataset + n_metrics + n_columns > 0")
        rows = bound.select("_now", "block", "n", "newest", memory.score().alias("bound"))
        out = rows if out is None else out.union(rows)
    return settle(out)


def _matches(pairs: DataFrame, requests: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The best k + 1 members of the given blocks for each request; other blocks are not read."""
    numbers = [r[0] for r in pairs.select("block").distinct().collect()]  # at most one a block
    asked = pairs.join(requests.select("_now", memory._named("dataset_name").alias("_d"), F.col("metrics").alias("_cm"), F.col("columns").alias("_cc")), "_now")
    both = rows.where(F.col("block").isin(numbers)).join(asked.select("_now", "block", "_d", "_cm", "_cc"), "block")
    scored = both.select(
        "_now", *[c for c in rows.columns if c != "block"],
        ((F.col("_d") != "") & (F.col("_d") == memory._named("dataset_name"))).cast("int").alias("same_dataset"),
        F.size(F.array_intersect("metrics", "_cm")).alias("n_metrics"), F.size(F.array_intersect("columns", "_cc")).alias("n_columns"),
    ).filter("same_dataset + n_metrics + n_columns > 0")
    best = W.partitionBy("_now").orderBy(F.desc("similarity_score"), F.desc("created_at"), F.desc("investigation_id"))
    return scored.withColumn("similarity_score", memory.score()).withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k + 1)


def similar(current: DataFrame, path: str, schema: T.StructType, k: int = 3) -> DataFrame:
    """The ``k`` best past matches of each current investigation, as ``memory.similar`` gives them.

    ``schema`` is that of the resolved investigations the index was built from.
    """
    if k > MOST:
        raise ValueError(f"the index holds {MOST} matches")
    spark = current.sparkSession
    rows = _rows(spark, path, schema)
    now = settle(memory._signature(current.select("investigation_id", "dataset_name", "metrics", "columns")))
    requests = settle(now.groupBy("_sig").agg(F.min("investigation_id").alias("_now"), *[F.any_value(c).alias(c) for c in ("dataset_name", "metrics", "columns")]))
    bounds = _bounds(requests, spark.read.schema(_SUMMARY).parquet(f"{path}/blocks"))
    promising = W.partitionBy("_now").orderBy(F.desc("bound"), F.desc("newest"), "block")
    left, take, found = bounds, 1, None
    while found is None or not left.isEmpty():
        ranked = settle(left.withColumn("_place", F.row_number().over(promising)))
        more = _matches(ranked.filter(F.col("_place") <= take).select("_now", "block"), requests, rows, k)
        best = W.partitionBy("_now").orderBy(F.desc("similarity_score"), F.desc("created_at"), F.desc("investigation_id"))
        both = more if found is None else found.unionByName(more)
        found = settle(both.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k + 1))
        least = found.filter(F.col("_at") == k + 1).select("_now", F.col("similarity_score").alias("_s"), F.col("created_at").cast("timestamp").alias("_t"))
        may_beat = F.col("_s").isNull() | (F.col("bound") > F.col("_s")) | ((F.col("bound") == F.col("_s")) & (F.col("newest") >= F.col("_t")))
        left = settle(ranked.filter(F.col("_place") > take).drop("_place").join(least, "_now", "left").filter(may_beat).drop("_s", "_t"))
        take *= 4
    wanted = now.join(requests.select("_sig", "_now"), "_sig").select(
        F.col("investigation_id").alias("current_id"), "_now", F.col("dataset_name").alias("current_dataset"), F.col("metrics").alias("_cm"), F.col("columns").alias("_cc")
    )
    order = W.partitionBy("current_id").orderBy(F.desc("similarity_score"), F.desc("created_at"), F.desc("investigation_id"))
    pairs = found.drop("_at").join(wanted, "_now").filter(F.col("current_id") != F.col("investigation_id"))
    top = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.withColumn("matched_factors", memory.factors()).drop("_now", "_cm", "_cc", "metrics", "columns")
