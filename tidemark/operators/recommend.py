"""Next steps for a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values: (category, priority, type, target, rationale).
ACTIONS = [
    ("UNIQUENESS", "P1", "COMPARE", "created_at",
     "Compare timestamp across duplicate groups to identify chronologically later duplicates."),
    ("UNIQUENESS", "P2", "INSPECT", "ingestion_batch_id",
     "Check if duplicate records originated from the same ingestion batch."),
    ("UNIQUENESS", "P3", "COMPARE", "source_file",
     "Compare source file lineage to detect duplicate processing."),
    ("COMPLETENESS", "P1", "CORRELATE", "null_distribution",
     "Check if nulls correlate with specific dates or upstream source systems."),
]


def recommend(findings: DataFrame) -> DataFrame:
    """Actions for each finding, one row per action; other categories get none."""
    rows = F.array(
        *[
            F.when(
                F.col("category") == category,
                F.struct(
                    F.lit(priority).alias("priority"), F.lit(kind).alias("action"), F.lit(target).alias("target"),
                    F.lit(why).alias("rationale"),
                ),
            )
            for category, priority, kind, target, why in ACTIONS
        ]
    )
    out = findings.withColumn("_a", F.explode(F.array_compact(rows)))
    return out.select("finding_id", "column", "category", "impact_score", "_a.*")


def ordered(actions: DataFrame) -> DataFrame:
    return actions.orderBy(F.desc("impact_score"), "column", "finding_id", "priority")
