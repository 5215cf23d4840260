"""Column profiles in long form: one row per (version, column)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import name_sql, percent_sql, value_sql
from ..functions.types import is_countable, is_numeric, type_label

COLUMNS_PER_PASS = 100  # keeps each aggregate within the size Spark compiles to one method
LONG_TEXT = 64


def _fields(df: DataFrame, by: Sequence[str], columns: Iterable[str] | None) -> list[tuple[int, T.StructField]]:
    chosen = None if columns is None else set(columns)
    data = [f for f in df.schema.fields if f.name not in by]
    return [(i, f) for i, f in enumerate(data) if chosen is None or f.name in chosen]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def profile(
    df: DataFrame,
    by: Sequence[str] = (),
    exact: bool | Iterable[str] = False,
    columns: Iterable[str] | None = None,
    rsd: float = 0.05,
    quantiles: Sequence[float] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Profile every column in one aggregation, for the whole table or for each group of ``by``.

    Distinct counts are approximate (``unique_exact`` false) unless ``exact`` is True or names the columns to count exactly;
    exact counts cost one more scan of just those columns. A quantile is a value whose rank is off by at most
    rows / ``accuracy``.
    """
    fields = _fields(df, by, columns)
    if exact is True:
        exact_names = [f.name for _, f in fields if is_countable(f.dataType)]
    else:
        exact_names = [] if exact is False else [n for n in exact if n in {f.name for _, f in fields}]
    parts = [
        _one_pass(df, by, fields[i : i + COLUMNS_PER_PASS], set(exact_names), rsd, quantiles, accuracy)
        for i in range(0, len(fields), COLUMNS_PER_PASS)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if exact_names:
        counts = distinct_counts(df, by, exact_names)
        if not by:
            counts = F.broadcast(counts)  # one row per column
        left, right = out.alias("p"), counts.alias("d")
        on = F.col("p.column") == F.col("d.column")
        for k in by:
            on = on & F.col(f"p.`{k}`").eqNullSafe(F.col(f"d.`{k}`"))
        others = [F.col(f"p.`{c}`") for c in out.columns if c != "unique_count"]
        missing = F.when(F.col("p.column").isin(exact_names), F.lit(0).cast("bigint"))  # empty groups
        out = left.join(right, on, "left").select(
            *others, F.coalesce(F.col("d.unique_count"), F.col("p.unique_count"), missing).alias("unique_count")
        )
    return _finish(out.withColumn("unique_exact", F.col("column").isin(exact_names)), by, bool(quantiles))


def _one_pass(df, by, fields, exact_names, rsd, quantiles, accuracy) -> DataFrame:
    aggs, rows = ["count(1) AS _rows"], []
    cuts = ", ".join(str(float(q)) for q in quantiles)
    for i, f in fields:
        c = name_sql(f.name)
        x = f"CAST({c} AS DOUBLE)"
        stats = {"n": f"count({c})"}
        if f.name not in exact_names and is_countable(f.dataType):
            stats["u"] = f"approx_count_distinct({c}, {rsd})"
        if is_numeric(f.dataType):
            stats |= {"lo": f"min({c})", "hi": f"max({c})", "avg": f"avg({x})", "sd": f"stddev_samp({x})"}
            if quantiles:
                stats["q"] = f"percentile_approx({x}, array({cuts}), {accuracy})"
        aggs += [f"{agg} AS _{i}_{k}" for k, agg in stats.items()]

        def stat(k: str, dtype: str) -> str:
            return f"CAST({f'_{i}_{k}' if k in stats else 'NULL'} AS {dtype})"

        entry = {
            "ordinal": f"CAST({i} AS INT)",
            "column": value_sql(f.name),
            "type": value_sql(type_label(f.dataType)),
            "null_count": f"_rows - _{i}_n",
            "unique_count": stat("u", "BIGINT"),
            "min_value": stat("lo", "STRING"),
            "max_value": stat("hi", "STRING"),
            "mean": stat("avg", "DOUBLE"),
            "std_dev": stat("sd", "DOUBLE"),
        }
        if quantiles:
            entry["quantiles"] = stat("q", "ARRAY<DOUBLE>")
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in entry.items()) + ")")
    keys = [name_sql(k) for k in by]
    wide = df.groupBy(*[F.col(k) for k in keys]).agg(*[F.expr(a) for a in aggs])
    long = wide.selectExpr(*keys, "_rows AS row_count", f"explode(array({', '.join(rows)})) AS _c")
    return long.selectExpr(*keys, "row_count", "_c.*")


def _finish(p: DataFrame, by: Sequence[str], with_quantiles: bool) -> DataFrame:
    def share(c: str) -> str:
        return f"CASE WHEN row_count > 0 THEN {c} / row_count ELSE 0.0D END"

    return p.selectExpr(
        *[name_sql(k) for k in by],
        "ordinal",
        "column",
        "type",
        "row_count",
        "null_count",
        f"{share('null_count')} AS null_fraction",
        "unique_count",
        f"CASE WHEN unique_count IS NOT NULL THEN {share('unique_count')} END AS unique_fraction",
        "unique_exact",
        "min_value",
        "max_value",
        "mean",
        "std_dev",
        *(["quantiles"] if with_quantiles else []),
    )


def value_text(df: DataFrame, name: str, short: bool = True) -> Column:
    """Text that is equal exactly when two values of the column are equal. ``short``: long text becomes a digest,
    which is enough to count distinct values."""
    dtype = df.schema[name].dataType
    c = _col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0).cast(dtype)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if not short and isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        # A null stays null; a digest keeps the shuffled rows short.
        return F.when(c.isNotNull(), F.concat(F.lit("#"), F.sha2(F.to_json(F.struct(c)), 256)))
    if short and isinstance(dtype, T.StringType):
        # A digest is one character longer than any text kept as it is, so the two never meet.
        return F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    return c.cast("string")


def _unpivot(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    texts = df.select(*[_col(k) for k in by], *[value_text(df, c, short=False).alias(c) for c in columns])
    return texts.unpivot([_col(k) for k in by], [_col(c) for c in columns], "column", "value")


def _plain_value(f: T.StructField, text: Column) -> tuple[str, Column]:
    """(kind, value): columns of one kind have values of one type, equal exactly when the originals are."""
    c = _col(f.name)
    if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
        return "bigint", c.cast("bigint")
    if isinstance(f.dataType, T.DateType):
        return "bigint", F.unix_date(c).cast("bigint")
    if isinstance(f.dataType, T.TimestampType):
        return "bigint", F.unix_micros(c)
    if isinstance(f.dataType, T.TimestampNTZType):
        return "timestamp_ntz", c
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return "double", c.cast("double") + F.lit(0.0)
    return "string", text


def distinct_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column.

    Columns of one kind are stacked as (column number, value) and counted together, so a columnar file is
    read once over all kinds and shuffled rows are narrow and typed. Equal values collapse before the
    shuffle: a frequent value costs one row per task. Store a CSV or a join result before counting it.
    """
    keys = [_col(k) for k in by]
    names = [name_sql(k) for k in by]
    kinds: dict[str, list[tuple[str, Column]]] = {}
    for c in columns:
        kind, value = _plain_value(df.schema[c], value_text(df, c))
        kinds.setdefault(kind, []).append((c, value))
    out = None
    for members in kinds.values():
        values = df.select(*[_col(k) for k in by], *[v.alias(f"_v{i}") for i, (_, v) in enumerate(members)])
        pairs = ", ".join(f"{i}, _v{i}" for i in range(len(members)))
        stacked = values.selectExpr(*names, f"stack({len(members)}, {pairs}) AS (_i, _v)")
        labels = ", ".join(value_sql(c) for c, _ in members)
        # Nulls stay until after the distinct: a column of nothing but nulls must still count 0 per group.
        rows = stacked.distinct().selectExpr(*names, f"array({labels})[_i] AS column", "_v IS NOT NULL AS _known")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*names, "column").agg(F.expr("count_if(_known) AS unique_count"))


def value_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value), with the whole value at any length; null is a value of its own."""
    values = _unpivot(df, by, columns)
    return values.groupBy(*[_col(k) for k in by], "column", "value").agg(F.count(F.lit(1)).alias("n"))


def report(p: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One line of text per column: ``name (type): n unique, p% nulls``."""
    line = f"column || ' (' || type || '): ' || unique_count || ' unique, ' || {percent_sql('null_fraction')} || ' nulls'"
    return p.selectExpr(*[name_sql(k) for k in by], "ordinal", f"{line} AS line")
