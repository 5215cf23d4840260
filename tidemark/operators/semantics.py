"""Role and sensitivity of each profiled column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import physical_type

# Name parts that mark personal data.
PII_WORDS = [
    "email", "ssn", "phone", "address", "ip_address", "credit_card", "password", "first_name", "last_name",
]


# Fixed order: the first rule that holds wins. A missing null fraction counts as 1.
ROLE = """CASE
  WHEN physical_type = 'DATETIME' OR endswith(lower(column), '_at') OR endswith(lower(column), '_date') THEN 'DATETIME'
  WHEN lower(column) = 'id' OR endswith(lower(column), '_id') THEN 'IDENTIFIER'
  WHEN row_count > 0 AND coalesce(unique_count, 0) / nullif(row_count, 0) > 0.95
    AND physical_type IN ('INTEGER', 'STRING') AND coalesce(null_fraction, 1.0D) < 0.05 THEN 'IDENTIFIER'
  WHEN physical_type = 'BOOLEAN' OR startswith(lower(column), 'is_') OR startswith(lower(column), 'has_') THEN 'BOOLEAN'
  WHEN physical_type = 'DOUBLE' THEN 'MEASURE'
  WHEN physical_type = 'INTEGER' AND row_count > 100 AND coalesce(unique_count, 0) < 10 THEN 'CATEGORY'
  WHEN physical_type = 'INTEGER' THEN 'MEASURE'
  WHEN physical_type = 'STRING' AND row_count > 0
    AND (coalesce(unique_count, 0) / nullif(row_count, 0) < 0.05 OR coalesce(unique_count, 0) < 100) THEN 'CATEGORY'
  WHEN physical_type = 'STRING' THEN 'TEXT'
  ELSE 'UNKNOWN' END"""


def near_threshold(margin: float = 0.2) -> str:
    """SQL condition: an approximate count that lies so near a threshold of ``ROLE`` that its error could cross it.

    ``margin`` is four standard errors of the profile's sketch.
    """
    ratio = "coalesce(unique_count, 0) / nullif(row_count, 0)"
    near = lambda x, at: f"({x} BETWEEN {at * (1 - margin)}D AND {at * (1 + margin)}D)"
    return (
        f"NOT unique_exact AND row_count > 0 AND physical_type IN ('INTEGER', 'STRING') AND ({ratio} >= {0.95 * (1 - margin)}D OR {near(ratio, 0.05)} "
        f"OR {near('unique_count', 10.0)} OR {near('unique_count', 100.0)})"
    )


def sensitivity(name: Column) -> Column:
    return F.when(F.lower(name).rlike("|".join(PII_WORDS)), "PII").otherwise("NON_PII")


def classify(p: DataFrame) -> DataFrame:
    """Add physical_type, semantic_role and sensitivity to a long profile."""
    return (
        p.withColumn("physical_type", physical_type(F.col("type")))
        .withColumn("semantic_role", F.expr(ROLE))
        .withColumn("sensitivity", sensitivity(F.col("column")))
    )
