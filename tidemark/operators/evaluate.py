"""Accuracy of the findings against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def detection_accuracy(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of metrics.

    ``labels``: (subject_id, n_expected, is_control); ``findings``: (subject_id, severity, has_evidence).
    Findings are counted per subject before the join. A subject counts if at least as many findings as expected are
    found, and scores nothing if fewer are.
    """
    high = F.col("severity").isin("HIGH", "CRITICAL")
    found = findings.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_found"),
        F.count_if(high).alias("n_high"),
        F.count_if("has_evidence").alias("n_evidence"),
    )
    rows = labels.join(found, "subject_id", "left").fillna(0, ["n_found", "n_high", "n_evidence"])
    control = F.col("is_control")
    hit = F.when(~control, F.when(F.col("n_found") >= F.col("n_expected"), F.col("n_expected")).otherwise(0))
    totals = rows.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("true_positives"),
        F.coalesce(F.sum(F.when(~control, F.col("n_expected") - F.least("n_found", "n_expected"))), F.lit(0)).alias("false_negatives"),
        F.coalesce(F.sum(F.when(control, F.col("n_found"))), F.lit(0)).alias("false_positives"),
        F.coalesce(F.sum(F.when(control, F.col("n_high"))), F.lit(0)).alias("high_severity_false_positives"),
        F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("n_evidence"),
    )
    positives = F.col("true_positives") + F.col("false_negatives")
    reported = F.col("true_positives") + F.col("false_positives")
    hundred = F.lit(100.0)
    return totals.select(
        "true_positives", "false_negatives", "false_positives", "high_severity_false_positives",
        F.when(positives > 0, F.col("true_positives") / positives * 100).otherwise(hundred).alias("detection_accuracy"),
        F.when(reported > 0, F.col("n_evidence") / reported * 100).otherwise(hundred).alias("evidence_completeness"),
    )
