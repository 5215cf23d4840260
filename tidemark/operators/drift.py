"""Findings raised by a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import case_sql, fixed_sql, percent_sql, stable_id
from .diff import KEY

# Rule, category, severity, confidence and impact of each change that raises a finding.
DRIFT_RULES = {
    "null_rate_shift": ("NullRateShiftRule", "COMPLETENESS", "HIGH", 0.9, 0.8),
    "cardinality_shift": ("UniquenessDropRule", "UNIQUENESS", "HIGH", 0.9, 0.8),
    "distribution_shift": ("DistributionShiftRule", "DISTRIBUTION", "MEDIUM", 0.8, 0.5),
    "type_changed": ("SchemaDriftRule", "SCHEMA", "CRITICAL", 1.0, 0.9),
    "removed": ("SchemaDropRule", "SCHEMA", "HIGH", 1.0, 0.8),
    "added": ("SchemaAddRule", "SCHEMA", "LOW", 1.0, 0.2),
}
NULL_RATE_RISE = 0.05
UNIQUE_FRACTION_DROP = -0.05
MEAN_RELATIVE_SHIFT = 0.1


RAISED = f"""CASE change_type
  WHEN 'null_rate_shift' THEN absolute_delta > {NULL_RATE_RISE}D
  WHEN 'cardinality_shift' THEN absolute_delta < {UNIQUE_FRACTION_DROP}D
  WHEN 'distribution_shift' THEN NOT isnan(relative_delta) AND abs(relative_delta) > {MEAN_RELATIVE_SHIFT}D
  ELSE change_type IN ('type_changed', 'removed', 'added') END"""

TITLE = """CASE change_type
  WHEN 'null_rate_shift' THEN 'Spike in null rate on ' || column
  WHEN 'cardinality_shift' THEN 'Uniqueness degradation on ' || column
  WHEN 'distribution_shift' THEN 'Data drift on ' || column
  WHEN 'type_changed' THEN 'Schema drift: ' || column || ' type changed'
  WHEN 'removed' THEN 'Schema drift: ' || column || ' removed'
  ELSE 'Schema change: ' || column || ' added' END"""

DESCRIPTION = f"""CASE change_type
  WHEN 'null_rate_shift' THEN
    'Null rate increased by ' || {percent_sql("absolute_delta")} || ' (now ' || {percent_sql("current_num")} || ')'
  WHEN 'cardinality_shift' THEN
    'Unique fraction dropped by ' || {percent_sql("(-absolute_delta)")} || ' (now ' || {percent_sql("current_num")} || ')'
  WHEN 'distribution_shift' THEN 'Mean shifted by ' || {percent_sql("relative_delta")}
    || ' (from ' || {fixed_sql("previous_num", 2)} || ' to ' || {fixed_sql("current_num", 2)} || ')'
  WHEN 'type_changed' THEN 'Column ' || column || ' type changed from ' || previous_type || ' to ' || current_type
  WHEN 'removed' THEN 'Column ' || column || ' was removed'
  ELSE 'New column ' || column || ' of type ' || current_type || ' was added' END"""


def findings(changes: DataFrame) -> DataFrame:
    """Findings of every version pair. Row-count and min/max changes raise none."""
    parts = ["rule", "category", "severity", "confidence", "impact_score"]
    looked_up = [
        f"{case_sql('change_type', {k: v[i] for k, v in DRIFT_RULES.items()})} AS {name}" for i, name in enumerate(parts)
    ]
    raised = changes.filter(RAISED).selectExpr(
        *KEY, "column", *looked_up, f"{TITLE} AS title", f"{DESCRIPTION} AS description",
        "change_id", "change_type", "metric", "absolute_delta",
    )
    ident = stable_id("fnd", "dataset_id", "version_number", "rule", "column")
    return raised.select(ident.alias("finding_id"), "*")


def drift_findings(changes: DataFrame) -> DataFrame:
    return findings(changes.filter("change_kind = 'column'"))


def schema_findings(changes: DataFrame) -> DataFrame:
    return findings(changes.filter("change_kind = 'schema'"))


def metric_evidence(found: DataFrame, constant_metric: bool = False) -> DataFrame:
    """One METRIC row per finding, named after the change's own metric unless ``constant_metric``."""
    metric = "'null_fraction'" if constant_metric else "coalesce(metric, 'schema')"
    return found.select(
        stable_id("ev", "finding_id", "'metric'").alias("evidence_id"),
        F.expr("finding_id"),
        F.expr("'METRIC' AS type"),
        F.expr("'DataQualityEngine' AS source"),
        F.expr(f"{metric} AS metric"),
        F.expr("description AS value"),
        F.expr("'Anomaly detected by baseline rules' AS description"),
    )


def open_investigations(found: DataFrame) -> DataFrame:
    """One OPEN investigation per (dataset, version) that has findings."""
    counts = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_findings"))
    return counts.select(
        stable_id("inv", *KEY).alias("investigation_id"),
        *KEY,
        F.expr("'OPEN' AS status"),
        "n_findings",
        F.expr("'Automated Investigation: ' || dataset_id || ' v' || version_number AS title"),
        F.expr("'System detected ' || n_findings || ' anomalies in the latest dataset version.' AS description"),
    )
