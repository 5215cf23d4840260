"""Profiles that can be merged: of days into months, of partitions into versions, without the data.

A mergeable profile holds, for each column, counts and moments, the typed extremes as text, an HLL sketch of its values
and for numbers a KLL sketch of their distribution. ``merge`` adds profiles of disjoint parts up: counts exactly, moments by
the parallel formula, distincts and quantiles within the error of the sketches, which doesn't grow with the number of
parts. ``read`` gives the profile that ``profile`` would, with approximate distinct counts.

Quantiles carry their rank error. ``quantile_drift`` compares two stored versions, reads no data, and raises a drift
only where the two values can't be of one rank, however the errors fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import name_sql, value_sql
from ..functions.types import is_countable, is_numeric, type_label
from .profile import COLUMNS_PER_PASS, _fields, _finish, value_text

#: Of the distinct sketch: its size is 2 ** LG_K bytes and its relative error 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Of the quantile sketch.
K = 400
#: z of the distinct error, for about 99.7 of 100 columns.
DISTINCT_Z = 3.0
RANKS = (0.05, 0.25, 0.5, 0.75, 0.95)


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative error that about 99.7 of 100 distinct counts keep to."""
    return DISTINCT_Z * 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = K) -> float:
    """Error of a rank that 99 of 100 quantiles keep to: the fit published with the sketch."""
    return 2.296 / k**0.9723


def mergeable(df: DataFrame, by: Sequence[str] = (), lg_k: int = LG_K, k: int = K) -> DataFrame:
    """One row per group of ``by`` and column, from one aggregation with partial results in every task."""
    out = None
    fields = _fields(df, by, None)
    for lo in range(0, len(fields), COLUMNS_PER_PASS):
        part = _one_pass(df, by, fields[lo : lo + COLUMNS_PER_PASS], lg_k, k)
        out = part if out is None else out.unionByName(part)
    return out


def _one_pass(df: DataFrame, by: Sequence[str], fields: list, lg_k: int, k: int) -> DataFrame:
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    rows = []
    for i, f in fields:
        c = F.col(f"`{f.name}`")
        stats: dict[str, Column] = {"n": F.count(c)}
        if is_countable(f.dataType):
            whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            stats["distincts"] = F.hll_sketch_agg(c.cast("bigint") if whole else value_text(df, f.name), F.lit(lg_k))
        if is_numeric(f.dataType):
            x = c.cast("double")
            stats |= {"lo": F.min(c).cast("string"), "hi": F.max(c).cast("string"), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "ranks": F.kll_sketch_agg_double(x, F.lit(k))}
        aggs += [a.alias(f"_{i}_{s}") for s, a in stats.items()]
        entry = {"ordinal": f"CAST({i} AS INT)", "column": value_sql(f.name), "type": value_sql(type_label(f.dataType)), "known": f"_{i}_n"}
        kinds = {"distincts": "BINARY", "lo": "STRING", "hi": "STRING", "mean": "DOUBLE", "m2": "DOUBLE", "ranks": "BINARY"}
        entry |= {s: f"CAST({f'_{i}_{s}' if s in stats else 'NULL'} AS {t})" for s, t in kinds.items()}
        rows.append("named_struct(" + ", ".join(f"'{s}', {v}" for s, v in entry.items()) + ")")
    keys = [name_sql(b) for b in by]
    wide = df.groupBy(*[F.col(b) for b in keys]).agg(*aggs)
    return wide.selectExpr(*keys, "_rows AS row_count", f"explode(array({', '.join(rows)})) AS _c").selectExpr(*keys, "row_count", "_c.*")


def merge(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mergeable profiles of disjoint parts added up, for each group of ``by`` and column. A column must keep its type."""
    keys = [*by, "column"]
    number = lambda c: F.struct(F.col(c).cast("double"), F.expr(f"try_cast({c} AS DECIMAL(38, 0))"))
    moments = F.collect_list(F.when(F.col("mean").isNotNull(), F.struct(F.col("known").cast("double").alias("n"), "mean", "m2")))
    types = F.collect_set("type")
    merged = parts.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(
        F.min("ordinal").alias("ordinal"), F.max("type").alias("type"), F.sum("row_count").alias("row_count"), F.sum("known").alias("known"),
        F.hll_union_agg("distincts").alias("distincts"), F.min_by("lo", number("lo")).alias("lo"), F.max_by("hi", number("hi")).alias("hi"),
        moments.alias("_m"), F.kll_merge_agg_double("ranks").alias("ranks"), types.alias("_types"),
    )
    # Two parts together: the mean moves by d * nb / n, the squares grow by those of both and d * d * na * nb / n.
    chan = """aggregate(_m, named_struct('n', 0.0D, 'mean', 0.0D, 'm2', 0.0D), (a, b) -> named_struct(
        'n', a.n + b.n, 'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n),
        'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n)))"""
    merged = merged.withColumn("_s", F.expr(chan))
    one_type = F.when(F.size("_types") > 1, F.raise_error(F.concat(F.lit("column of several types: "), F.col("column")))).otherwise(F.col("type"))
    has = F.size("_m") > 0
    names = [f"`{c}`" for c in by]
    return merged.select(
        *names, "row_count", "ordinal", "column", one_type.cast("string").alias("type"), "known", "distincts", "lo", "hi",
        F.when(has, F.col("_s.mean")).alias("mean"), F.when(has, F.col("_s.m2")).alias("m2"), F.when(has, F.col("ranks")).alias("ranks"),
    )


def read(stored: DataFrame, by: Sequence[str] = (), ranks: Sequence[float] = ()) -> DataFrame:
    """The profile of stored rows, as ``profile`` gives it, and on request quantiles (null where there are no values)."""
    cuts = F.array(*[F.lit(float(r)) for r in ranks])
    rows = stored.select(
        *[f"`{c}`" for c in by], "ordinal", "column", "type", "row_count", (F.col("row_count") - F.col("known")).alias("null_count"),
        F.hll_sketch_estimate("distincts").alias("unique_count"), F.lit(False).alias("unique_exact"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"), "mean",
        F.when(F.col("known") > 1, F.sqrt(F.col("m2") / (F.col("known") - 1))).alias("std_dev"),
        *([F.when((F.col("known") > 0) & F.col("ranks").isNotNull(), F.kll_sketch_get_quantile_double("ranks", cuts)).alias("quantiles")] if ranks else []),
    )
    return _finish(rows, by, bool(ranks))


def stored_quantiles(stored: DataFrame, keys: Sequence[str], ranks: Sequence[float] = RANKS, k: int = K) -> DataFrame:
    """Of each numeric column and rank: value, and the values a rank error below and above. Reads sketches only."""
    error = rank_error(k)

    def cut(at: float) -> Column:
        return F.kll_sketch_get_quantile_double("ranks", F.lit(min(1.0, max(0.0, at))))

    each = F.array(*[F.struct(F.lit(float(r)).alias("quantile"), F.lit(error).alias("rank_error"), cut(r).alias("value"), cut(r - error).alias("low"), cut(r + error).alias("high")) for r in ranks])
    known = stored.where("ranks IS NOT NULL AND known > 0")
    return known.select(*[f"`{c}`" for c in keys], "column", F.explode(each).alias("_q")).select(*[f"`{c}`" for c in keys], "column", "_q.*")


def quantile_drift(previous: DataFrame, current: DataFrame, ranks: Sequence[float] = RANKS, k: int = K) -> DataFrame:
    """Of each numeric column and rank: both values, and whether they differ by more than the rank errors of both."""
    a, b = (stored_quantiles(p, [], ranks, k) for p in (previous, current))
    old = a.selectExpr("column", "quantile", "rank_error", "value AS previous", "low AS previous_low", "high AS previous_high")
    new = b.selectExpr("column", "quantile", "value AS current", "low AS current_low", "high AS current_high")
    both = old.join(new, ["column", "quantile"])
    apart = (F.col("current_low") > F.col("previous_high")) | (F.col("current_high") < F.col("previous_low"))
    return both.withColumn("absolute_delta", F.col("current") - F.col("previous")).withColumn("drifted", apart)
