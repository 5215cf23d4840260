"""Checks of assistant responses against the facts of an investigation.

Responses: (response_id, investigation_id, answer, claims ARRAY<STRING>, queries ARRAY<STRING>, citations ARRAY<STRING>).
Facts carry the investigation_id they belong to, and count for responses of that investigation only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words refused in a query, and metrics that exist.
MUTATION_WORDS = ["insert", "update", "delete", "drop", "alter", "truncate", "grant", "revoke", "commit", "rollback"]
KNOWN_METRICS = [
    "row_count", "null_fraction", "null_count", "unique_fraction", "unique_count", "mean", "min", "max",
    "duplicate_fraction",
]


def _violation(rows: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return rows.select(
        "response_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail")
    )


def full_text() -> Column:
    return F.lower(F.concat_ws(" ", "answer", "claims"))


def citations(responses: DataFrame, valid_ids: DataFrame) -> DataFrame:
    """Cited ids that no evidence, attribution, finding or hypothesis of the investigation has. A warning, not an error.

    ``valid_ids``: (investigation_id, id).
    """
    cited = responses.select("response_id", "investigation_id", F.explode("citations").alias("id")).distinct()
    known = valid_ids.select("investigation_id", "id")
    return _violation(cited.join(known, ["investigation_id", "id"], "left_anti"), "citation", "WARN", F.col("id"))


def unsafe_sql(responses: DataFrame) -> DataFrame:
    """Queries that hold a mutation keyword as a whole word."""
    query = responses.select("response_id", F.explode("queries").alias("_sql"))
    words = F.regexp_extract_all(F.lower("_sql"), F.lit(r"\b(" + "|".join(MUTATION_WORDS) + r")\b"), F.lit(1))
    hit = query.select("response_id", F.explode(F.array_distinct(words)).alias("_w")).distinct()
    return _violation(hit, "sql", "ERROR", F.upper("_w"))


def _named(kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(full_text(), F.lit(kind + r"\s+'([a-z0-9_]+)'"), F.lit(1)))


def invented_columns(responses: DataFrame, schema: DataFrame) -> DataFrame:
    """Columns named in the text that the schema of the investigation's version lacks; both sides are lower-cased.

    ``schema``: (investigation_id, column).
    """
    named = responses.select("response_id", "investigation_id", F.explode(_named("column")).alias("_c"))
    known = schema.select("investigation_id", F.lower("column").alias("_c")).distinct()
    return _violation(named.join(known, ["investigation_id", "_c"], "left_anti"), "column", "ERROR", F.col("_c"))


def invented_metrics(responses: DataFrame) -> DataFrame:
    named = responses.select("response_id", F.explode(_named("metric")).alias("_m"))
    return _violation(named.filter(~F.col("_m").isin(KNOWN_METRICS)), "metric", "ERROR", F.col("_m"))


def overclaims(responses: DataFrame) -> DataFrame:
    """Claims beyond the evidence; rows also hold has_strong and has_supported of their investigation."""
    text = full_text()
    strong = text.contains("strong") & text.contains("root cause") & ~F.col("has_strong")
    sure = (
        (text.contains("confirmed") | text.contains("is the reason")) & text.contains("hypothesis") & ~F.col("has_supported")
    )
    claims = F.array_compact(F.array(F.when(strong, "strong root cause"), F.when(sure, "confirmed hypothesis")))
    return _violation(responses.select("response_id", F.explode(claims).alias("_c")), "overclaim", "ERROR", F.col("_c"))


def audit(responses: DataFrame, valid_ids: DataFrame, schema: DataFrame) -> DataFrame:
    """All violations of a batch of responses."""
    out = citations(responses, valid_ids)
    for rows in (unsafe_sql(responses), invented_columns(responses, schema), invented_metrics(responses), overclaims(responses)):
        out = out.unionByName(rows)
    return out
