"""The list of registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; ``sql`` runs on DuckDB over the same tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def select(body: str, *needed: str) -> str:
    """A statement with the named common tables in front of it."""
    from .oracle import TABLES

    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = TABLES[name]
        for d in deps:
            add(d)
        if name not in order:
            order.append(name)

    for n in needed:
        add(n)
    head = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order)
    return f"WITH {head}\n{body}" if head else body
