"""Segments that explain nulls: combinations of dimension values in which a column is null more often than elsewhere.

The rows are first summed up per combination of all dimensions, with partial sums in every task, so the table is read once. Then
the lattice of dimension sets is walked by levels. A set is only summed up if all its subsets one smaller have a
segment of at least ``support`` rows, and values that alone have too few rows are left out before the first pair:
no larger segment can have more rows than a smaller one that contains it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.shared import settle


def null_segments(df: DataFrame, column: str, dimensions: Sequence[str], support: int, most_dimensions: int | None = None) -> DataFrame:
    """dimensions (names, comma-joined), values (as texts, in the same order), n_rows, n_nulls, null_share, lift.

    Segments have at least ``support`` rows. lift is the share of nulls over that of the whole table, null if that has none. A
    null is a dimension value like others.
    """
    texts = [F.col(f"`{d}`").cast("string").alias(f"d{i}") for i, d in enumerate(dimensions)]
    base = df.select(*texts, F.col(f"`{column}`").isNull().cast("bigint").alias("gone"))
    names = [f"d{i}" for i in range(len(dimensions))]
    base = settle(base.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("gone").alias("n_nulls")))
    total = base.agg(F.sum("n_rows").alias("n"), F.sum("n_nulls").alias("g")).first()
    share = (total["g"] or 0) / total["n"] if total["n"] else 0.0
    live, out = [(i,) for i in range(len(dimensions))], None
    rows = base
    for level in range(1, (most_dimensions or len(dimensions)) + 1):
        if not live:
            break
        made = settle(_level(rows, live, names, support))
        out = made if out is None else out.unionByName(made)
        have = {tuple(r[0]) for r in made.select("at").distinct().collect()}  # dimension sets, not segments
        if level == 1:
            for i in range(len(dimensions)):
                rows = rows.join(made.where(f"at = array({i})").select(F.col("key")[0].alias("_v"), F.lit(True).alias(f"ok{i}")), F.col(names[i]).eqNullSafe(F.col("_v")), "left").drop("_v")
            rows = settle(rows)
        live = [c for c in combinations(range(len(dimensions)), level + 1) if all(s in have for s in combinations(c, level))]
    labels = F.array(*[F.lit(d) for d in dimensions])
    if out is None:
        out = _level(base.where("false"), [()], names, support)
    named = F.transform("at", lambda i: F.element_at(labels, i + 1))
    rate = F.col("n_nulls") / F.col("n_rows")
    lift = F.when(F.lit(share) > 0, rate / F.lit(share))
    return out.select(F.array_join(named, ",").alias("dimensions"), F.col("key").alias("values"), "n_rows", "n_nulls", rate.alias("null_share"), lift.alias("lift"))


def _level(rows: DataFrame, sets: list[tuple[int, ...]], names: list[str], support: int) -> DataFrame:
    """Segments of some dimension sets: at (numbers of the dimensions), key (their values), n_rows, n_nulls.

    A row goes to each set whose values all have enough rows; the sums collapse in every task before the shuffle.
    """
    def fits(s: tuple[int, ...]) -> str:
        tests = [f"ok{i}" for i in s if f"ok{i}" in rows.columns]
        return " AND ".join(f"coalesce({t}, false)" for t in tests) or "true"

    entries = [f"CASE WHEN {fits(s)} THEN named_struct('at', CAST(array({', '.join(map(str, s))}) AS ARRAY<INT>), 'key', CAST(array({', '.join(names[i] for i in s)}) AS ARRAY<STRING>)) END" for s in sets]
    each = rows.select("n_rows", "n_nulls", F.explode(F.array_compact(F.expr(f"array({', '.join(entries)})"))).alias("_s"))
    sums = each.groupBy("_s.at", "_s.key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"))
    return sums.where(F.col("n_rows") >= support)
