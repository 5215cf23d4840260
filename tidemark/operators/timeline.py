"""The event log of investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import number_rows
from ..functions.text import stable_id

# Event types and sources.
EVENT_TYPES = [
    "DATASET_VERSION_CREATED", "FINDING_DETECTED", "HISTORICAL_CHANGE_DISCOVERED", "ATTRIBUTION_GENERATED",
    "HYPOTHESIS_CREATED", "HYPOTHESIS_VALIDATED", "EVIDENCE_COLLECTED", "STATUS_CHANGED", "RESOLUTION_CREATED",
]
EVENT_SOURCES = ["SYSTEM", "ENGINEER"]


def append(log: DataFrame, arrivals: DataFrame, bucket: Column) -> DataFrame:
    """Arrivals (investigation_id, ts, event_id, ...) numbered on from the log's highest sequence number."""
    top = log.groupBy("investigation_id").agg(F.max("sequence_number").alias("_top"))
    order = [F.col("ts"), F.col("event_id")]
    numbered = number_rows(arrivals, ["investigation_id"], order, bucket, "_n")
    joined = numbered.join(top, "investigation_id", "left")
    number = (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint")
    return joined.withColumn("sequence_number", number).drop("_top", "_n")


def chronological(log: DataFrame) -> DataFrame:
    """Events by time, ties by sequence number. A range-partitioned sort, whatever the size of one log."""
    return log.orderBy("investigation_id", "ts", "sequence_number")


def _event(rows: DataFrame, step: int, event_type: str, entity: Column, text: Column, source: str = "SYSTEM") -> DataFrame:
    return rows.select(
        "investigation_id",
        F.lit(step).alias("step"),
        F.lit(event_type).alias("event_type"),
        F.lit(source).alias("source"),
        entity.cast("string").alias("entity_id"),
        text.alias("description"),
    )


def build(
    investigations: DataFrame,
    summaries: DataFrame,
    findings: DataFrame,
    evidence: DataFrame,
    attributions: DataFrame,
    hypotheses: DataFrame,
    validations: DataFrame | None = None,
    resolutions: DataFrame | None = None,
) -> DataFrame:
    """Events of investigations opened by a diff, in the order the work happened.

    ``step`` orders kinds of events; findings and what follows from one finding sort by finding and step.
    """
    key = ["dataset_id", "version_number"]
    ids = investigations.select("investigation_id", *key)
    version = F.col("version_number").cast("string")
    base = ids.join(summaries, key)
    of_finding = findings.select("finding_id", *key, "title").join(ids, key)
    link = of_finding.select("finding_id", "investigation_id")
    created = _event(
        investigations, 1, "STATUS_CHANGED", F.col("investigation_id"), F.lit("Investigation created with status OPEN")
    )
    uploaded = _event(
        base, 2, "DATASET_VERSION_CREATED", F.concat_ws("@", "dataset_id", version),
        F.concat(F.lit("Dataset version "), version, F.lit(" created.")),
    )
    diffed = _event(
        base, 3, "HISTORICAL_CHANGE_DISCOVERED", F.concat_ws("@", "dataset_id", version),
        F.concat(
            F.lit("Historical diff calculated (v"), (F.col("version_number") - 1).cast("string"), F.lit(" -> v"), version,
            F.lit("). Found "), F.col("n_schema").cast("string"), F.lit(" schema changes, "),
            F.col("n_column").cast("string"), F.lit(" column shifts."),
        ),
    )
    detected = _event(
        of_finding, 4, "FINDING_DETECTED", F.col("finding_id"), F.concat(F.lit("Finding detected: "), F.col("title"))
    )
    collected = _event(
        evidence.join(link, "finding_id"), 5, "EVIDENCE_COLLECTED", F.col("evidence_id"),
        F.concat(F.lit("Evidence generated: "), F.col("description")),
    )
    attributed = _event(
        attributions.join(link, "finding_id"), 6, "ATTRIBUTION_GENERATED", F.col("attribution_id"),
        F.concat(F.lit("Attribution completed: "), F.col("reason"), F.lit(" -> "), F.col("relevance")),
    )
    proposed = _event(
        hypotheses.join(link, "finding_id"), 7, "HYPOTHESIS_CREATED", F.col("hypothesis_id"),
        F.concat(F.lit("Hypothesis created: "), F.col("description")),
    )
    out = created
    for rows in (uploaded, diffed, detected, collected, attributed, proposed):
        out = out.unionByName(rows)
    if validations is not None:
        checked = validations.join(hypotheses.select("hypothesis_id", "finding_id"), "hypothesis_id")
        out = out.unionByName(
            _event(
                checked.join(link, "finding_id"), 8, "HYPOTHESIS_VALIDATED", F.col("hypothesis_id"),
                F.concat_ws(": ", "verdict", "note"),
            )
        )
    if resolutions is not None:
        text = F.concat(F.lit("Investigation resolved: "), F.col("root_cause"))
        out = out.unionByName(
            _event(resolutions, 9, "RESOLUTION_CREATED", F.col("investigation_id"), text, "ENGINEER")
        )
    return out.withColumn("event_id", stable_id("evt", "event_type", "entity_id"))
