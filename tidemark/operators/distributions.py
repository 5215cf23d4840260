"""Shift of continuous distributions: the two-sample Kolmogorov-Smirnov distance.

The distance is the largest gap between the shares of values at or below x in both versions. Values of all columns are counted
once per (column, value) and version; the counts are range-partitioned by value, each partition sums up in order, and the
totals of the partitions before it are added from a small table. No window ever holds a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.shared import settle

#: Terms of the series of the limit distribution; it alternates and falls like exp(-2 k k x x).
TERMS = 50


def _sample(df: DataFrame, columns: Sequence[str], side: int) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("_e")).where("_e.value IS NOT NULL").select("_e.*", F.lit(side).alias("_side"))


def ks_distance(previous: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_previous, n_current, distance, at_value (the least value with that gap), p_value.

    Nulls are no values; NaN is one, above all others, and -0.0 is 0.0. A column without values on one side has no
    distance. p_value is that of the limit distribution with Stephens' correction.
    """
    both = _sample(previous, columns, 1).unionByName(_sample(current, columns, 2))
    counts = both.groupBy("column", "value").agg(F.count_if(F.col("_side") == 1).alias("a"), F.count_if(F.col("_side") == 2).alias("b"))
    dealt = settle(settle(counts).repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("column", "part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    mine = W.partitionBy("column")
    before = mine.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        "column", "part", F.coalesce(F.sum("pa").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("b0"),
        F.sum("pa").over(mine).alias("n_previous"), F.sum("pb").over(mine).alias("n_current"),
    )
    inside = W.partitionBy("column", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    run = dealt.join(starts, ["column", "part"]).select(
        "column", "value", "n_previous", "n_current", (F.col("a0") + F.sum("a").over(inside)).alias("a"), (F.col("b0") + F.sum("b").over(inside)).alias("b")
    )
    some = "n_previous > 0 AND n_current > 0"
    gap = F.expr(f"CASE WHEN {some} THEN abs(a / n_previous - b / n_current) END")
    # Gaps that differ by rounding only are one gap, whose least value counts.
    best = run.withColumn("_gap", F.round(gap, 12)).groupBy("column").agg(
        F.max("n_previous").alias("n_previous"), F.max("n_current").alias("n_current"), F.max("_gap").alias("distance"), F.min_by("value", F.struct(-F.col("_gap"), "value")).alias("at_value")
    )
    effective = "sqrt(n_previous * n_current / (n_previous + n_current))"
    best = best.withColumn("_both", F.expr(some))
    scaled = best.withColumn("_x", F.expr(f"CASE WHEN _both THEN ({effective} + 0.12D + 0.11D / {effective}) * distance END"))
    series = f"aggregate(sequence(1, {TERMS}), 0.0D, (s, k) -> s + if(k % 2 = 1, 2.0D, -2.0D) * exp(-2.0D * k * k * _x * _x))"
    p = F.expr(f"CASE WHEN _x IS NULL THEN NULL WHEN _x < 0.2D THEN 1.0D ELSE greatest(0.0D, least(1.0D, {series})) END")
    return scaled.select("column", "n_previous", "n_current", "distance", F.when(F.col("distance").isNotNull(), F.col("at_value")).alias("at_value"), p.alias("p_value"))
