"""Differences between consecutive versions, for any number of version pairs at once.

Input is a long profile keyed by (dataset_id, version_number). Profiles are small next to the data,
so store the profile first and pass the stored table in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.shared import settle
from ..functions.text import stable_id
from ..functions.types import is_numeric
from .profile import value_counts

DATASET_COLUMN = "*dataset*"  # fixed value
NOISE_FLOOR = 0.0001  # fixed value
KEY = ["dataset_id", "version_number"]
SIDE = ["type", "row_count", "null_fraction", "unique_fraction", "unique_exact", "min_value", "max_value", "mean"]

CHANGE_COLUMNS = [
    *KEY, "change_id", "change_kind", "column", "metric", "change_type", "previous_type", "current_type",
    "previous_value", "current_value", "previous_num", "current_num", "absolute_delta", "relative_delta",
]


def version_pairs(p: DataFrame) -> DataFrame:
    """(dataset, version) with row counts of it and of the version numbered one less.

    A version whose predecessor is missing has no pair, even if an older one exists.
    """
    versions = p.groupBy(*KEY).agg(F.max("row_count").alias("row_count"))
    older = versions.select(
        "dataset_id", (F.col("version_number") + 1).alias("version_number"),
        F.col("row_count").alias("previous_row_count"),
    )
    return versions.join(older, KEY)


def paired(p: DataFrame) -> DataFrame:
    """One row per column of either side of each version pair, plus one dataset row per pair."""
    pairs = version_pairs(p)
    if "unique_exact" not in p.columns:
        p = p.withColumn("unique_exact", F.lit(True))
    cur = p.select(*KEY, "column", *[F.col(c).alias(f"cur_{c}") for c in SIDE])
    prev = p.select(
        "dataset_id", (F.col("version_number") + 1).alias("version_number"), "column",
        *[F.col(c).alias(f"prev_{c}") for c in SIDE],
    )
    both = cur.join(prev, [*KEY, "column"], "full").join(pairs.select(*KEY), KEY, "left_semi")
    total = pairs.select(
        *KEY,
        F.lit(DATASET_COLUMN).alias("column"),
        F.col("row_count").alias("cur_row_count"),
        F.col("previous_row_count").alias("prev_row_count"),
    )
    return both.unionByName(total, allowMissingColumns=True)


CHANGE_TYPES = {
    "metric": "STRING", "previous_type": "STRING", "current_type": "STRING", "previous_value": "STRING",
    "current_value": "STRING", "previous_num": "DOUBLE", "current_num": "DOUBLE",
    "absolute_delta": "DOUBLE", "relative_delta": "DOUBLE",
}


def _change(present: str, kind: str, change_type: str, **values: str) -> str:
    """SQL text of a change struct where ``present`` holds, else null."""
    parts = [f"'change_kind', '{kind}'", f"'change_type', {change_type}"]
    parts += [f"'{k}', CAST({values.get(k, 'NULL')} AS {t})" for k, t in CHANGE_TYPES.items()]
    return f"CASE WHEN {present} THEN named_struct({', '.join(parts)}) END"


def _relative(delta: str, base: str, positive_only: bool) -> str:
    """Delta over the old value, infinite if that is zero."""
    known, size = (f"{base} > 0", base) if positive_only else (f"{base} <> 0", f"abs({base})")
    return f"CASE WHEN {known} THEN ({delta}) / {size} ELSE double('Infinity') END"


def _shift(metric: str, change_type: str, positive_only: bool = True, only: str = "true") -> str:
    """Change of a fraction or a mean beyond the noise floor.

    No change can be told from a NaN, nor between two infinities; Spark alone would put NaN above the floor.
    """
    prev, cur = f"prev_{metric}", f"cur_{metric}"
    delta = f"{cur} - {prev}"
    return _change(
        f"NOT isnan({delta}) AND abs({prev} - {cur}) > {NOISE_FLOOR}D AND {only}", "column", f"'{change_type}'", metric=f"'{metric}'",
        previous_value=prev, current_value=cur, previous_num=prev, current_num=cur,
        absolute_delta=delta, relative_delta=_relative(delta, prev, positive_only),
    )


def _bound(metric: str, change_type: str) -> str:
    """Change of a minimum or maximum; values that are no numbers get zero deltas.

    Values of one type are compared by their exact text, as a double cannot tell large longs apart.
    Across types 5 equals 5.0.
    """
    prev, cur = f"prev_{metric}", f"cur_{metric}"
    a, b = f"try_cast({prev} AS DOUBLE)", f"try_cast({cur} AS DOUBLE)"
    numeric = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    differs = f"CASE WHEN {numeric} AND prev_type <> cur_type THEN {a} <> {b} ELSE {prev} <> {cur} END"
    delta = f"{b} - {a}"
    return _change(
        differs, "column", f"'{change_type}'", metric=f"'{metric}'",
        previous_value=prev, current_value=cur, previous_num=a, current_num=b,
        absolute_delta=f"CASE WHEN {numeric} THEN {delta} ELSE 0.0D END",
        relative_delta=f"CASE WHEN {numeric} THEN {_relative(delta, a, False)} ELSE 0.0D END",
    )


def changes(p: DataFrame) -> DataFrame:
    """Schema and column changes of every version pair, from one join of the profile with itself."""
    real = f"column <> '{DATASET_COLUMN}'"
    schema = _change(
        f"{real} AND (prev_type IS NULL OR cur_type IS NULL OR prev_type <> cur_type)", "schema",
        "CASE WHEN prev_type IS NULL THEN 'added' WHEN cur_type IS NULL THEN 'removed' ELSE 'type_changed' END",
        previous_type="prev_type", current_type="cur_type",
    )
    row_delta = "CAST(cur_row_count - prev_row_count AS DOUBLE)"
    count = _change(
        f"NOT ({real}) AND prev_row_count <> cur_row_count", "column", "'row_count_shift'", metric="'row_count'",
        previous_value="prev_row_count", current_value="cur_row_count",
        previous_num="prev_row_count", current_num="cur_row_count",
        absolute_delta=row_delta, relative_delta=_relative(row_delta, "prev_row_count", True),
    )
    kinds = [
        schema,
        count,
        _shift("null_fraction", "null_rate_shift"),
        # The sketch behind an approximate count moves by more than the noise floor by itself.
        _shift("unique_fraction", "cardinality_shift", only="prev_unique_exact AND cur_unique_exact"),
        _shift("mean", "distribution_shift", positive_only=False),
        _bound("min_value", "min_shift"),
        _bound("max_value", "max_shift"),
    ]
    found = paired(p).selectExpr(*KEY, "column", f"explode(array_compact(array({', '.join(kinds)}))) AS _c")
    ident = stable_id("chg", "dataset_id", "version_number", "column", "_c.change_type")
    return found.select(*KEY, "column", ident.alias("change_id"), "_c.*").select(*CHANGE_COLUMNS)


def schema_changes(found: DataFrame) -> DataFrame:
    return found.filter("change_kind = 'schema'").select(
        *KEY, "change_id", "column", "change_type", "previous_type", "current_type"
    )


def column_changes(found: DataFrame) -> DataFrame:
    return found.filter("change_kind = 'column'").drop("change_kind", "previous_type", "current_type")


def summary(p: DataFrame, found: DataFrame) -> DataFrame:
    """Change counts and one sentence per version pair; pairs without changes are listed too."""
    counts = found.groupBy(*KEY).agg(
        F.expr("count_if(change_kind = 'schema') AS n_schema"), F.expr("count_if(change_kind = 'column') AS n_column")
    )
    rows = version_pairs(p).select(*KEY).join(counts, KEY, "left").fillna(0, ["n_schema", "n_column"])
    text = F.expr(
        "CASE WHEN n_schema = 0 AND n_column = 0 THEN 'No changes detected.' ELSE 'Detected ' || n_schema || "
        "' schema changes and ' || n_column || ' column statistical changes.' END"
    )
    return rows.withColumn("summary", text)


def compare(previous: DataFrame, current: DataFrame, dataset_id: str = "dataset") -> DataFrame:
    """Changes between two unkeyed profiles."""
    def keyed(p: DataFrame, n: int) -> DataFrame:
        return p.withColumn("dataset_id", F.lit(dataset_id)).withColumn("version_number", F.lit(n))

    return changes(keyed(previous, 1).unionByName(keyed(current, 2)))


def row_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added, removed and modified rows by key, with the columns that differ.

    Both versions are stacked and grouped, so one shuffle of the key and per-column hashes is enough
    and a repeated key never multiplies rows. A key held twice on one side is ambiguous.
    """
    values = [c for c in previous.columns if c in current.columns and c not in keys]
    common = {c: _common_type(previous, current, c) for c in values}

    def side(df: DataFrame, n: int) -> DataFrame:
        hashes = [_value_hash(F.col(f"`{c}`").cast(common[c])).alias(f"_h{i}") for i, c in enumerate(values)]
        return df.select(*[F.col(f"`{k}`") for k in keys], *hashes, F.lit(n).alias("_side"))

    def on_side(c: Column, n: int) -> Column:
        return F.max(F.when(F.col("_side") == n, c))

    aggs = [
        F.count_if(F.col("_side") == 1).alias("n_previous"),
        F.count_if(F.col("_side") == 2).alias("n_current"),
    ]
    for i in range(len(values)):
        aggs += [on_side(F.col(f"_h{i}"), 1).alias(f"_a{i}"), on_side(F.col(f"_h{i}"), 2).alias(f"_b{i}")]
    grouped = side(previous, 1).unionByName(side(current, 2)).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)
    differing = [F.when(F.col(f"_a{i}") != F.col(f"_b{i}"), F.lit(c)) for i, c in enumerate(values)]
    changed = F.array_compact(F.array(*differing)) if differing else F.array().cast("array<string>")
    n1, n2 = F.col("n_previous"), F.col("n_current")
    verdict = (
        F.when((n1 > 1) | (n2 > 1), "ambiguous")
        .when(n1 == 0, "added")
        .when(n2 == 0, "removed")
        .when(F.size("changed_columns") > 0, "modified")
        .otherwise("same")
    )
    both_once = (n1 == 1) & (n2 == 1)
    return (
        grouped.withColumn("changed_columns", F.when(both_once, changed).otherwise(F.array().cast("array<string>")))
        .withColumn("row_status", verdict)
        .select(*[F.col(f"`{k}`") for k in keys], "n_previous", "n_current", "changed_columns", "row_status")
    )


def _common_type(previous: DataFrame, current: DataFrame, column: str) -> T.DataType:
    """The type that holds the values of both sides: the wider of two numbers or of two times, else text."""
    a, b = previous.schema[column].dataType, current.schema[column].dataType
    if a == b:
        return a
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if is_numeric(a) and is_numeric(b) or isinstance(a, times) and isinstance(b, times):
        one = [df.select(F.col(f"`{column}`").alias("v")).limit(0) for df in (previous, current)]
        return one[0].union(one[1]).schema["v"].dataType
    return T.StringType()


def _value_hash(c: Column) -> Column:
    """Hash of one value; null and values of another type never hash alike."""
    return F.xxhash64(c.isNull(), c)


def frequency_diff(previous: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of every value in both versions, with its change."""
    def side(df: DataFrame, n: int) -> DataFrame:
        return value_counts(df, [], columns).withColumn("_side", F.lit(n))

    stacked = side(previous, 1).unionByName(side(current, 2))
    per_value = settle(stacked.groupBy("column", "value").agg(
        F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("n_previous"),
        F.coalesce(F.sum(F.when(F.col("_side") == 2, F.col("n"))), F.lit(0)).cast("bigint").alias("n_current"),
    ))
    # Each column counts every row once, nulls too, so one column gives the totals.
    first = per_value.filter(F.col("column") == columns[0])
    totals = [first.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for c in ("n_previous", "n_current")]
    a = F.when(totals[0] > 0, F.col("n_previous") / totals[0]).otherwise(F.lit(0.0))
    b = F.when(totals[1] > 0, F.col("n_current") / totals[1]).otherwise(F.lit(0.0))
    return per_value.withColumn("share_previous", a).withColumn("share_current", b).withColumn(
        "share_delta", F.col("share_current") - F.col("share_previous")
    )


def quantile_shifts(previous: DataFrame, current: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Quantiles of each numeric column in two profiles that were made with the same ``quantiles``, and their change."""
    def side(p: DataFrame, name: str) -> DataFrame:
        return p.filter("quantiles IS NOT NULL").select("column", F.posexplode("quantiles").alias("_i", name))

    cut = F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("_i") + 1)
    both = side(previous, "previous").join(side(current, "current"), ["column", "_i"])
    return both.select("column", cut.alias("quantile"), "previous", "current", (F.col("current") - F.col("previous")).alias("absolute_delta"))


def distribution_distance(frequencies: DataFrame) -> DataFrame:
    """Per column: total variation distance, and population stability index with empty shares at 1e-6."""
    a, b = F.greatest("share_previous", F.lit(1e-6)), F.greatest("share_current", F.lit(1e-6))
    return frequencies.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"),
        (F.sum(F.abs("share_delta")) / 2).alias("total_variation"),
        F.sum((b - a) * F.ln(b / a)).alias("stability_index"),
    )


def history_outliers(p: DataFrame, metric: str, z_limit: float = 3.0, min_history: int = 3) -> DataFrame:
    """DistributionRule: versions whose metric lies far from the versions before it.

    Running sums over earlier versions come from one window per (dataset, column) of the small profile.
    """
    past = W.partitionBy("dataset_id", "column").orderBy("version_number").rowsBetween(W.unboundedPreceding, -1)
    x = F.col(metric)
    rows = p.filter(x.isNotNull()).select(
        *KEY, "column", x.alias("value"),
        F.count(x).over(past).alias("n_history"),
        F.avg(x).over(past).alias("history_mean"),
        F.stddev_samp(x).over(past).alias("history_sd"),
    )
    mean, sd = F.col("history_mean"), F.col("history_sd")
    gap = F.col("value") - mean
    steady = sd <= 1e-9 * F.abs(mean)  # the past values are one value up to rounding
    same = F.abs(gap) <= 1e-9 * F.abs(mean)
    verdict = (
        F.when((F.col("n_history") < min_history) | sd.isNull(), "unknown")
        .when(steady, F.when(same, "passed").otherwise("failed"))
        .when(F.abs(gap / F.nullif(sd, F.lit(0.0))) > z_limit, "failed")
        .otherwise("passed")
    )
    return rows.withColumn("z", F.when(~steady, gap / F.nullif(sd, F.lit(0.0)))).withColumn("status", verdict)
