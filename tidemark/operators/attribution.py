"""Which change of a diff explains which finding.

A finding relates to the changes on its own column and to the row-count change of its version pair.
Every other change of the pair scores LOW with confidence 0.1, whatever it is, so those are carried as one
row per finding with their number. ``attribute_in_full`` lists them for chosen findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import case_of, stable_id, value_sql
from .diff import DATASET_COLUMN, KEY

# Rank of each relevance.
RELEVANCE_SCORE = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "NONE": 0}
UNRELATED = "unrelated"


# (condition, relevance, confidence, reason) in order; the first that holds wins.
CASES = [
    ("change_kind = 'schema' AND change_column = column AND change_type = 'type_changed'", "HIGH", 0.85,
     "'Physical type of column \\'' || change_column || '\\' changed.'"),
    ("change_kind = 'schema' AND change_column = column AND change_type = 'removed'", "HIGH", 0.95,
     "'Column \\'' || change_column || '\\' was removed.'"),
    ("change_kind = 'schema' AND change_column = column AND change_type = 'added'", "MEDIUM", 0.5,
     "'Column \\'' || change_column || '\\' was recently added.'"),
    ("change_kind = 'schema'", "LOW", 0.1, "'Unrelated schema change on \\'' || change_column || '\\'.'"),
    (f"change_column = '{DATASET_COLUMN}' AND change_type = 'row_count_shift'", "MEDIUM", 0.5,
     "'Dataset-level row count shifted, potentially affecting data distribution.'"),
    ("change_column = column AND _rule = 'UniqueRule' AND change_type = 'cardinality_shift'", "HIGH", 0.9,
     "'Cardinality shift directly associates with uniqueness violation.'"),
    ("change_column = column AND _rule = 'NotNullRule' AND change_type = 'null_rate_shift'", "HIGH", 0.9,
     "'Null rate shift directly associates with missing value finding.'"),
    ("change_column = column", "MEDIUM", 0.6,
     "'Related statistical shift (' || change_type || ') on the affected column.'"),
    ("true", "LOW", 0.1, "'Unrelated ' || change_type || ' on \\'' || change_column || '\\'.'"),
]


def _scored(pairs: DataFrame, rule_aliases: dict[str, str] | None) -> DataFrame:
    """Score pairs. ``rule_aliases`` maps other rule names to UniqueRule or NotNullRule; none by default."""
    aliased = pairs
    rule = "rule"
    for alias, known in (rule_aliases or {}).items():
        rule = f"CASE WHEN rule = {value_sql(alias)} THEN {value_sql(known)} ELSE {rule} END"
    aliased = aliased.withColumn("_rule", F.expr(rule))
    arms = " ".join(
        f"WHEN {cond} THEN named_struct('relevance', '{rel}', 'confidence', {value_sql(conf)}, 'reason', {reason})"
        for cond, rel, conf, reason in CASES
    )
    ident = stable_id("attr", "finding_id", "change_id")
    scored = aliased.withColumn("_s", F.expr(f"CASE {arms} END")).select(
        ident.alias("attribution_id"), "finding_id", *KEY, "column", "change_id", "change_kind", "change_column",
        "change_type", "_s.*",
    )
    return scored.withColumn("n_changes", F.expr("1L"))


def _change_side(changes: DataFrame) -> DataFrame:
    return changes.select(*KEY, F.col("column").alias("change_column"), "change_id", "change_kind", "change_type")


def _finding_side(findings: DataFrame) -> DataFrame:
    return findings.select(*KEY, "finding_id", "column", "rule")


def related(findings: DataFrame, changes: DataFrame, rule_aliases: dict[str, str] | None = None) -> DataFrame:
    """Attributions on the finding's own column and on the row count: one equi-join."""
    keys = F.explode(F.array_distinct(F.array(F.coalesce("column", F.lit(DATASET_COLUMN)), F.lit(DATASET_COLUMN))))
    wanted = _finding_side(findings).withColumn("change_column", keys)
    return _scored(wanted.join(_change_side(changes), [*KEY, "change_column"]), rule_aliases)


def attribute(findings: DataFrame, changes: DataFrame, rule_aliases: dict[str, str] | None = None) -> DataFrame:
    """Related attributions, and one row per finding that stands for all unrelated changes."""
    near = related(findings, changes, rule_aliases)
    totals = changes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_total"))
    matched = near.groupBy("finding_id").agg(F.count(F.lit(1)).alias("_near"))
    rest = (
        _finding_side(findings)
        .join(totals, KEY)
        .join(matched, "finding_id", "left")
        .withColumn("n_changes", (F.col("_total") - F.coalesce("_near", F.lit(0))).cast("bigint"))
        .filter("n_changes > 0")
    )
    ident = stable_id("attr", "finding_id", value_sql(UNRELATED)).alias("attribution_id")
    far = rest.select(ident, "*").selectExpr(
        "attribution_id", "finding_id", *KEY, "column", "CAST(NULL AS STRING) AS change_id",
        "CAST(NULL AS STRING) AS change_kind", "CAST(NULL AS STRING) AS change_column",
        f"{value_sql(UNRELATED)} AS change_type", "'LOW' AS relevance", "0.1D AS confidence",
        "n_changes || ' unrelated changes elsewhere in the dataset.' AS reason", "n_changes",
    )
    return with_score(near.unionByName(far))


def attribute_in_full(findings: DataFrame, changes: DataFrame, rule_aliases: dict[str, str] | None = None) -> DataFrame:
    """Every change of the version pair for each given finding; meant for one finding per investigation."""
    return with_score(_scored(_finding_side(findings).join(_change_side(changes), KEY), rule_aliases))


def with_score(attributions: DataFrame) -> DataFrame:
    return attributions.withColumn("relevance_score", case_of("relevance", RELEVANCE_SCORE, 0))


def ranked(attributions: DataFrame) -> DataFrame:
    """Add the position of each attribution among those of its finding, best first."""
    order = W.partitionBy("finding_id").orderBy(
        F.desc("relevance_score"), F.desc("confidence"), "change_column", "change_type"
    )
    return attributions.withColumn("rank", F.row_number().over(order))


def primary_findings(findings: DataFrame) -> DataFrame:
    """The finding with the highest impact of each (dataset, version)."""
    best = findings.groupBy(*KEY).agg(
        F.min(F.struct((-F.col("impact_score")).alias("i"), "column", "rule", "finding_id")).alias("_b")
    )
    return findings.join(best.select(F.col("_b.finding_id").alias("finding_id")), "finding_id", "left_semi")


def evidence(attributions: DataFrame) -> DataFrame:
    """One HISTORY row per attribution."""
    return attributions.select(stable_id("ev", "attribution_id").alias("evidence_id"), "*").selectExpr(
        "evidence_id", "finding_id", "attribution_id", "'HISTORY' AS type", "'HistoricalDiffEngine' AS source",
        "'attribution_match' AS metric", "relevance AS value", "'Attribution match: ' || reason AS description",
    )


def hypotheses(attributions: DataFrame) -> DataFrame:
    """One PROPOSED hypothesis per attribution."""
    return attributions.select(stable_id("hyp", "attribution_id").alias("hypothesis_id"), "*").selectExpr(
        "hypothesis_id", "finding_id", "attribution_id", *KEY,
        "'System generated hypothesis based on historical change: ' || reason AS description", "'PROPOSED' AS status",
    )
