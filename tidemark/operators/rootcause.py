"""Root-cause candidates of each finding, scored and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import case_sql, stable_id

# Score of each relevance; (score change, confidence) of each validation.
BASE_SCORE = {"HIGH": 0.6, "MEDIUM": 0.4, "LOW": 0.2}
VALIDATION_SCORE = {"SUPPORTED": 0.4, "REJECTED": -0.8, "INCONCLUSIVE": -0.1}
VALIDATION_CONFIDENCE = {"SUPPORTED": 0.9, "REJECTED": 0.9, "INCONCLUSIVE": 0.5}
VALIDATION_TEXT = {
    "SUPPORTED": "Hypothesis was supported: ",
    "REJECTED": "Hypothesis was rejected: ",
    "INCONCLUSIVE": "Validation was inconclusive: ",
}


STATUS = """CASE WHEN _rejected THEN 'DISQUALIFIED' WHEN round(score, 6) >= 0.8 AND confidence >= 0.8 THEN 'STRONG'
  WHEN round(score, 6) >= 0.4 THEN 'PLAUSIBLE' ELSE 'UNLIKELY' END"""


def from_hypotheses(attributions: DataFrame, hypotheses: DataFrame, validations: DataFrame) -> DataFrame:
    """Candidates of hypotheses; ``validations`` holds one (hypothesis_id, verdict, note, evidence_id) each."""
    attr = attributions.select(
        F.col("attribution_id"), "relevance", F.col("confidence").alias("_conf"), "reason"
    )
    rows = hypotheses.select("hypothesis_id", "finding_id", "attribution_id", F.col("status").alias("_hyp")).join(
        attr, "attribution_id", "left"
    )
    rows = rows.join(validations.select("hypothesis_id", "verdict", "note", "evidence_id"), "hypothesis_id", "left")
    moved = f"coalesce({case_sql('relevance', BASE_SCORE)}, 0.0D) + coalesce({case_sql('verdict', VALIDATION_SCORE)}, 0.0D)"
    outcome = (
        "CASE WHEN verdict IS NULL THEN 'Hypothesis is proposed but not yet validated.' "
        f"ELSE {case_sql('verdict', VALIDATION_TEXT)} || note END"
    )
    return rows.selectExpr(
        "finding_id", "hypothesis_id",
        "CASE WHEN relevance IS NOT NULL THEN attribution_id END AS attribution_id",
        f"greatest(0.0D, least(1.0D, {moved})) AS score",
        f"coalesce({case_sql('verdict', VALIDATION_CONFIDENCE)}, _conf, 0.5D) AS confidence",
        "CASE WHEN verdict = 'SUPPORTED' THEN evidence_id END AS supporting_evidence",
        "CASE WHEN verdict = 'REJECTED' THEN evidence_id END AS contradicting_evidence",
        f"concat_ws(' ', 'Based on historical change: ' || reason, {outcome}) AS explanation",
        "coalesce(verdict, _hyp) = 'REJECTED' AS _rejected",
    )


def from_attributions(attributions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Candidates of attributions no hypothesis refers to."""
    left = attributions.join(hypotheses.select("attribution_id", "finding_id"), ["attribution_id", "finding_id"], "left_anti")
    return left.selectExpr(
        "finding_id", "CAST(NULL AS STRING) AS hypothesis_id", "attribution_id",
        f"coalesce({case_sql('relevance', BASE_SCORE)}, 0.0D) AS score", "confidence",
        "CAST(NULL AS STRING) AS supporting_evidence", "CAST(NULL AS STRING) AS contradicting_evidence",
        "'System-proposed candidate based on historical change: ' || reason AS explanation", "false AS _rejected",
    )


def candidates(attributions: DataFrame, hypotheses: DataFrame, validations: DataFrame) -> DataFrame:
    """All candidates with status and rank within their finding, best first."""
    rows = from_hypotheses(attributions, hypotheses, validations).unionByName(
        from_attributions(attributions, hypotheses)
    )
    ident = stable_id("rcc", "finding_id", "coalesce(hypothesis_id, attribution_id)")
    order = W.partitionBy("finding_id").orderBy(
        F.desc(F.round("score", 6)), F.desc("confidence"), F.coalesce("hypothesis_id", "attribution_id")
    )
    return (
        rows.withColumn("candidate_id", ident)
        .withColumn("status", F.expr(STATUS))
        .withColumn("rank", F.row_number().over(order))
        .drop("_rejected")
    )


def strongest(ranked: DataFrame) -> DataFrame:
    """The top candidate of each finding, if it is STRONG or PLAUSIBLE."""
    return ranked.filter("rank = 1").filter(F.col("status").isin("STRONG", "PLAUSIBLE"))
