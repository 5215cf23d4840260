"""Row hashes that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .types import is_countable


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64-bit hash of a row. Null positions are hashed too, as a null leaves xxhash64 unchanged."""
    names = columns if columns is not None else df.columns
    plain, nested = [], []
    for f in df.schema.fields:
        if f.name in names:
            (plain if is_countable(f.dataType) else nested).append(F.col(f"`{f.name}`"))
    values = plain + [F.to_json(c) for c in nested]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in plain + nested])
    return F.xxhash64(*values, nulls)


def table_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Aggregate: sum of the row hashes as an exact decimal, so any row order gives one result."""
    return F.sum(row_hash(df, columns).cast("decimal(20,0)"))
