"""Repairs that write a new version and a lineage row."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import pick_by
from ..functions.shared import settle
from ..sources.fingerprints import table_fingerprint
from ..sources.readers import read_version, write_version
from .diff import compare, row_diff
from .profile import profile
from .rules import Rule, evaluate

LINEAGE = (
    "type_name string, parameters map<string,string>, input_fingerprint string, output_fingerprint string, "
    "created_at timestamp, affected_columns array<string>, generated_code string, path string"
)


def drop_duplicates(df: DataFrame, subset: Sequence[str], order_key: Sequence[str]) -> DataFrame:
    """First row of each ``subset`` by ``order_key``; null keys are one key."""
    return pick_by(df, list(subset), [k for k in order_key if k not in subset])


def fill_nulls(df: DataFrame, column: str, value) -> DataFrame:
    dtype = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.lit(value).cast(dtype)))


@dataclass(frozen=True)
class Step:
    """A repair as data: a function of this module, the arguments by name, and those arguments that name columns it changes."""

    function: Callable[..., DataFrame]
    arguments: dict[str, Any]
    changes: str

    def columns(self) -> list[str]:
        named = self.arguments[self.changes]
        return [named] if isinstance(named, str) else list(named)

    def code(self) -> str:
        return f"df = {self.function.__name__}(df, {', '.join(f'{k}={v!r}' for k, v in self.arguments.items())})"

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.function(df, **self.arguments)


def dropping(subset: Sequence[str], order_key: Sequence[str]) -> Step:
    return Step(drop_duplicates, {"subset": list(subset), "order_key": list(order_key)}, "subset")


def filling(column: str, value) -> Step:
    return Step(fill_nulls, {"column": column, "value": value}, "column")


def write_step(df: DataFrame, step: Step, path: str, input_fp: str) -> DataFrame:
    """Write the version that a step makes and return its lineage row: a chain of steps passes the fingerprints on."""
    spark: SparkSession = df.sparkSession
    made = step(df)
    write_version(made, path)
    record = (
        step.function.__name__,
        {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in step.arguments.items()},
        input_fp,
        table_fingerprint(read_version(spark, path, schema=made.schema)),
        None,
        step.columns(),
        step.code(),
        path,
    )
    return spark.createDataFrame([record], LINEAGE).withColumn("created_at", F.current_timestamp())


def ancestors(lineage: DataFrame) -> DataFrame:
    """version, ancestor, steps (least number) of every pair in a log of (input_fingerprint, output_fingerprint).

    Known paths are joined with known paths, so chains of n steps are closed in about log2(n) rounds, each stored. A version
    among its own ancestors is an error. Steps that change nothing, whose fingerprints are equal, are left out.
    """
    edges = lineage.where("input_fingerprint <> output_fingerprint").selectExpr("output_fingerprint AS version", "input_fingerprint AS ancestor", "1 AS steps").distinct()
    known = settle(edges)
    while True:
        on = known.selectExpr("version AS ancestor", "ancestor AS further", "steps AS more")
        longer = known.join(on, "ancestor").selectExpr("version", "further AS ancestor", "steps + more AS steps")
        closed = settle(known.union(longer).groupBy("version", "ancestor").agg(F.min("steps").alias("steps")))
        circular = closed.where("version = ancestor").select("version").take(1)
        if circular:
            raise ValueError(f"lineage runs in a circle through {circular[0][0]}")
        same = closed.exceptAll(known).isEmpty()
        known = closed
        if same:
            return known


def transform_check(before: DataFrame, after: DataFrame, affected: Sequence[str], exact: bool | Sequence[str] | None = None) -> DataFrame:
    """Profile changes a transformation made, with those on other columns marked unintended.

    Distinct values are counted exactly for the affected columns, unless others (or True, for all) are named.
    """
    counted = [c for c in affected if c in before.columns and c in after.columns] if exact is None else exact
    found = compare(profile(before, exact=counted), profile(after, exact=counted))
    intended = F.col("column").isin([*affected, "*dataset*"])
    return found.select(
        "column", "change_kind", "metric", "change_type", "absolute_delta", (~intended).alias("unintended")
    )


def rerun_rules(before: DataFrame, after: DataFrame, checks: Sequence[Rule], affected: Sequence[str]) -> DataFrame:
    """Rules on the affected columns evaluated on both versions: violations before and after, and rows that it repaired."""
    mine = [r for r in checks if r.column in affected]
    one, two = evaluate(before, mine), evaluate(after, mine)
    old = one.select("rule", "column", "check", F.col("violations").alias("violations_before"), F.col("row_count").alias("rows_before"))
    new = two.select("rule", "column", "check", F.col("violations").alias("violations_after"), F.col("row_count").alias("rows_after"), "status")
    return old.join(new, ["rule", "column", "check"]).withColumn("repaired", F.col("violations_before") - F.col("violations_after"))


def affected_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows, by key, that a transformation added, removed, changed or left."""
    return row_diff(before, after, keys).groupBy("row_status").agg(F.count(F.lit(1)).alias("n_rows"))
