"""Number, id and SQL-text helpers shared by the operators.

Long expressions are written as SQL text: one expression is then one call into Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def name_sql(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def value_sql(value) -> str:
    """A literal as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed_sql(value: str, digits: int) -> str:
    """Fixed-point text, half-even on the binary value like printf."""
    pattern = "0." + "0" * digits if digits else "0"
    return (
        f"CASE WHEN {value} = double('Infinity') THEN 'inf' WHEN {value} = double('-Infinity') THEN '-inf' "
        f"ELSE format_number(CAST({value} AS DOUBLE), '{pattern}') END"
    )


def percent_sql(fraction: str, digits: int = 1) -> str:
    return f"{fixed_sql(f'({fraction} * 100)', digits)} || '%'"


def stable_id(prefix: str, *parts: str) -> Column:
    """Id made from a natural key given as SQL texts, so that a rerun yields the same rows."""
    texts = ", ".join(f"coalesce(CAST({p} AS STRING), '')" for p in parts)
    return F.expr(f"'{prefix}_' || left(sha2(concat_ws('|', {texts}), 256), 32)")


def case_sql(value: str, cases: dict, default=None) -> str:
    """Look a value up in a small fixed table."""
    arms = " ".join(f"WHEN {value_sql(k)} THEN {value_sql(v)}" for k, v in cases.items())
    return f"(CASE {value} {arms} ELSE {value_sql(default)} END)"


def case_of(value: str, cases: dict, default=None) -> Column:
    return F.expr(case_sql(value, cases, default))
