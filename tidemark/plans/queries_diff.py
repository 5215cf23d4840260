"""Registered queries over version diffs and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.shared import new_path, settle
from ..operators import attribution, diff, distributions, drift, experiment, rootcause, segments, sketches, synthesis, timeline
from ..operators import audit as checks, null_segments as explain_nulls
from ..operators.profile import profile
from .catalog import query, select
from .derived import Case, daily_profiles, event_versions, order_versions, pair_changes, pair_profiles, read, responses
from .oracle import CHANGES, sid


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("diff_schema", select(
    "SELECT dataset_id, version_number, change_id, \"column\", change_type, previous_type, current_type FROM changes WHERE change_kind = 'schema'", "changes"))
def diff_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.schema_changes(pair_changes(spark, sf_dir))


def _shift_query(change_types: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = diff.column_changes(pair_changes(spark, sf_dir)).filter(F.col("change_type").isin(change_types))
        out = found.select(
            "dataset_id", "version_number", "column", "metric", "change_type", "previous_num", "current_num",
            "absolute_delta", "relative_delta",
        )
        return _rounded(out, "previous_num", "current_num", "absolute_delta", "relative_delta")

    return run


def _shift_oracle(change_types: list[str]) -> str:
    names = ", ".join(f"'{c}'" for c in change_types)
    return select(
        'SELECT dataset_id, version_number, "column", metric, change_type, round(previous_num, 6) AS previous_num, '
        "round(current_num, 6) AS current_num, round(absolute_delta, 6) AS absolute_delta, "
        f"round(relative_delta, 6) AS relative_delta FROM changes WHERE change_type IN ({names})",
        "changes",
    )


for _name, _types in {
    "diff_row_count": ["row_count_shift"],
    "diff_null_rate": ["null_rate_shift"],
    "diff_cardinality": ["cardinality_shift"],
    "diff_mean": ["distribution_shift"],
    "diff_min_max": ["min_shift", "max_shift"],
}.items():
    query(_name, _shift_oracle(_types))(_shift_query(_types))


CHANGE_COLUMNS = ["dataset_id", "version_number", "change_kind", "column", "metric", "change_type", "previous_type", "current_type", "absolute_delta", "relative_delta"]
CHANGE_SELECT = (
    'SELECT dataset_id, version_number, change_kind, "column", metric, change_type, previous_type, current_type, '
    "round(absolute_delta, 6) AS absolute_delta, round(relative_delta, 6) AS relative_delta FROM "
)


@query("diff_changes", select(CHANGE_SELECT + "changes", "changes"))
def diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pair_changes(spark, sf_dir).select(*CHANGE_COLUMNS), "absolute_delta", "relative_delta")


DAILY_CHANGES = CHANGES.replace("FROM joined", "FROM daily_joined").replace("FROM pairs", "FROM daily_pairs")


@query("diff_all_versions", select(CHANGE_SELECT + f"({DAILY_CHANGES})", "daily_joined"))
def diff_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All consecutive days of events diffed in one job."""
    found = diff.changes(daily_profiles(spark, sf_dir))
    return _rounded(found.select(*CHANGE_COLUMNS), "absolute_delta", "relative_delta")


@query("diff_summary", select("""
SELECT dataset_id, version_number, n_schema, n_column, CASE WHEN n_schema + n_column = 0 THEN 'No changes detected.'
  ELSE 'Detected ' || n_schema || ' schema changes and ' || n_column || ' column statistical changes.' END AS summary
FROM (SELECT p.dataset_id, p.version_number, count(c.change_id) FILTER (WHERE change_kind = 'schema') AS n_schema,
  count(c.change_id) FILTER (WHERE change_kind = 'column') AS n_column
  FROM pairs p LEFT JOIN changes c ON c.dataset_id = p.dataset_id AND c.version_number = p.version_number GROUP BY 1, 2)""", "changes"))
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_profiles(spark, sf_dir)
    return diff.summary(p, diff.changes(p))


FINDING_COLUMNS = ["finding_id", "dataset_id", "version_number", "column", "rule", "category", "severity", "confidence", "impact_score", "title", "description"]
FINDING_SELECT = 'SELECT finding_id, dataset_id, version_number, "column", rule, category, severity, confidence, impact_score, title, description FROM drift '


@query("drift_findings", select(FINDING_SELECT + "WHERE category <> 'SCHEMA'", "drift"))
def drift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_findings(pair_changes(spark, sf_dir)).select(*FINDING_COLUMNS)


@query("schema_findings", select(FINDING_SELECT + "WHERE category = 'SCHEMA'", "drift"))
def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_findings(pair_changes(spark, sf_dir)).select(*FINDING_COLUMNS)


@query("open_investigations", select("SELECT * FROM investigations", "investigations"))
def open_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Case(spark, sf_dir).investigations


@query("metric_evidence", select(f"""
SELECT {sid("ev", "finding_id", "'metric'")} AS evidence_id, finding_id, 'METRIC' AS type, 'DataQualityEngine' AS source,
  coalesce(metric, 'schema') AS metric, description AS value, 'Anomaly detected by baseline rules' AS description FROM drift""", "drift"))
def metric_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.metric_evidence(Case(spark, sf_dir).findings)


# Attribution

ATTRIBUTION_SELECT = (
    'SELECT attribution_id, finding_id, dataset_id, version_number, "column", change_id, change_kind, change_column, '
    "change_type, relevance, confidence, reason"
)


@query("attributions", select(ATTRIBUTION_SELECT + ", n_changes, relevance_score FROM attributions", "attributions"))
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Case(spark, sf_dir).attribute().attributions


@query("attribution_schema", select(
    ATTRIBUTION_SELECT + ", n_changes, relevance_score FROM attributions WHERE change_kind = 'schema'", "attributions"))
def attribution_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Case(spark, sf_dir).attribute().attributions.filter("change_kind = 'schema'")


@query("attribution_column", select(
    ATTRIBUTION_SELECT + ", n_changes, relevance_score FROM attributions WHERE change_kind = 'column'", "attributions"))
def attribution_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Case(spark, sf_dir).attribute().attributions.filter("change_kind = 'column'")


@query("attribution_in_full", select(
    ATTRIBUTION_SELECT + """ FROM full_attributions a WHERE finding_id IN (
  SELECT finding_id FROM (SELECT finding_id, row_number() OVER (PARTITION BY dataset_id, version_number ORDER BY impact_score DESC, "column", rule) AS rn FROM drift) WHERE rn = 1)""", "full_attributions"))
def attribution_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change, related or not, for the main finding of each investigation."""
    case = Case(spark, sf_dir)
    chosen = attribution.primary_findings(case.findings)
    return attribution.attribute_in_full(chosen, case.changes).drop("n_changes", "relevance_score")


@query("attribution_rank", select("""
SELECT finding_id, attribution_id, relevance, confidence, CAST(row_number() OVER (PARTITION BY finding_id
  ORDER BY relevance_score DESC, confidence DESC, change_column NULLS FIRST, change_type) AS INTEGER) AS rank FROM attributions""", "attributions"))
def attribution_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.ranked(Case(spark, sf_dir).attribute().attributions).select(
        "finding_id", "attribution_id", "relevance", "confidence", "rank"
    )


@query("attribution_evidence", select(f"""
SELECT {sid("ev", "attribution_id")} AS evidence_id, finding_id, attribution_id, 'HISTORY' AS type, 'HistoricalDiffEngine' AS source,
  'attribution_match' AS metric, relevance AS value, 'Attribution match: ' || reason AS description FROM attributions""", "attributions"))
def attribution_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.evidence(Case(spark, sf_dir).attribute().attributions)


@query("system_hypotheses", select("SELECT * FROM hypotheses", "hypotheses"))
def system_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Case(spark, sf_dir).attribute().hypotheses


# Root cause


def _case(spark: SparkSession, sf_dir: str) -> Case:
    return Case(spark, sf_dir).attribute().validate().rank()


@query("root_cause", select(
    "SELECT finding_id, candidate_id, hypothesis_id, attribution_id, round(score, 6) AS score, confidence, status, rank FROM candidates", "candidates"))
def root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case(spark, sf_dir).candidates.select(
        "finding_id", "candidate_id", "hypothesis_id", "attribution_id", F.round("score", 6).alias("score"),
        "confidence", "status", "rank",
    )


@query("root_cause_explained", select(
    "SELECT candidate_id, supporting_evidence, contradicting_evidence, explanation FROM candidates", "candidates"))
def root_cause_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case(spark, sf_dir).candidates.select(
        "candidate_id", "supporting_evidence", "contradicting_evidence", "explanation"
    )


@query("root_cause_residual", select("""
SELECT finding_id, attribution_id, CAST(CASE relevance WHEN 'HIGH' THEN 0.6 WHEN 'MEDIUM' THEN 0.4 ELSE 0.2 END AS DOUBLE) AS score, confidence,
  'System-proposed candidate based on historical change: ' || reason AS explanation FROM attributions WHERE change_type = 'unrelated'""", "attributions"))
def root_cause_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions left without a hypothesis, here those of unrelated changes."""
    case = Case(spark, sf_dir).attribute()
    near = attribution.hypotheses(case.attributions.filter("change_type <> 'unrelated'"))
    return rootcause.from_attributions(case.attributions, near).select(
        "finding_id", "attribution_id", "score", "confidence", "explanation"
    )


@query("strongest_candidate", select(
    "SELECT finding_id, candidate_id, status, round(score, 6) AS score, confidence FROM candidates WHERE rank = 1 AND status IN ('STRONG', 'PLAUSIBLE')", "candidates"))
def strongest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case(spark, sf_dir).strongest.select(
        "finding_id", "candidate_id", "status", F.round("score", 6).alias("score"), "confidence"
    )


# Synthesis

SUMMARY_SQL = """
SELECT i.investigation_id, i.dataset_id, i.version_number,
  '[' || i.status || '] ' || i.title || ': ' || i.description || '. Detected ' || i.n_findings || ' finding(s). Primary: ' || d.title || ' on ' || d."column" || '.' AS problem_summary
FROM investigations i JOIN (SELECT *, row_number() OVER (PARTITION BY dataset_id, version_number ORDER BY impact_score DESC, "column", rule) AS rn FROM drift) d
  ON d.dataset_id = i.dataset_id AND d.version_number = i.version_number AND d.rn = 1
"""


@query("synthesis", select(f"""
SELECT s.*, (SELECT count(*) FROM validations v JOIN hypotheses h USING (hypothesis_id) WHERE h.dataset_id = s.dataset_id AND h.version_number = s.version_number) AS n_validations,
  b.candidate_id AS strongest_candidate_id, b.explanation AS strongest_explanation, b.status AS strongest_status, b.score AS strongest_score, b.confidence AS strongest_confidence
FROM ({SUMMARY_SQL}) s LEFT JOIN best b ON b.dataset_id = s.dataset_id AND b.version_number = s.version_number AND b.rn = 1""", "investigations", "best"))
def synthesis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark, sf_dir)
    return synthesis.synthesize(case.investigations, case.findings, case.validations, case.hypotheses, case.strongest)


CHANGE_LINE = """CASE WHEN change_kind = 'schema' THEN '- Schema ' || change_type || ' on column ''' || "column" || ''''
  ELSE '- ' || metric || ' on ''' || "column" || ''' shifted (delta: ' || printf('%.4f', absolute_delta) || ')' END"""


@query("synthesis_changes", select(f"SELECT dataset_id, version_number, change_id, change_kind, {CHANGE_LINE} AS line FROM changes", "changes"))
def synthesis_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.change_lines(pair_changes(spark, sf_dir))


@query("synthesis_markdown", select(f"""
SELECT investigation_id, section, line FROM (
SELECT investigation_id, 0 AS section, '# Investigation Synthesis: ' || investigation_id AS line FROM investigations
UNION ALL SELECT investigation_id, 1, problem_summary FROM ({SUMMARY_SQL})
UNION ALL SELECT i.investigation_id, 2, c.line FROM (SELECT dataset_id, version_number, {CHANGE_LINE} AS line FROM changes) c JOIN investigations i USING (dataset_id, version_number)
UNION ALL SELECT i.investigation_id, 3, '- [' || relevance || '] ' || reason FROM attributions JOIN investigations i USING (dataset_id, version_number)
UNION ALL SELECT investigation_id, 4, unnest(lines) FROM (
  SELECT i.investigation_id, list_filter(['- Hypothesis: ' || h.description, '  Result: ' || coalesce(v.verdict, 'PROPOSED (Not yet validated)'), '  Evidence: ' || v.n || ' artifacts.'], lambda x: x IS NOT NULL) AS lines
  FROM hypotheses h JOIN investigations i USING (dataset_id, version_number) LEFT JOIN (SELECT hypothesis_id, max(verdict) AS verdict, count(evidence_id) AS n FROM validations GROUP BY hypothesis_id) v ON v.hypothesis_id = h.hypothesis_id)
UNION ALL SELECT investigation_id, 5, unnest(lines) FROM (
  SELECT i.investigation_id, CASE WHEN b.candidate_id IS NULL THEN ['- Multiple candidates exist, but none are strong enough.']
    ELSE ['- ' || b.explanation, '- Status: ' || b.status, '- Confidence: ' || printf('%.1f', b.confidence * 100) || '%'] END AS lines
  FROM investigations i LEFT JOIN best b ON b.dataset_id = i.dataset_id AND b.version_number = i.version_number AND b.rn = 1))""", "investigations", "best", "validations", "hypotheses"))
def synthesis_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark, sf_dir)
    lines = synthesis.report(
        case.investigations, case.findings, case.changes, case.attributions, case.hypotheses, case.validations,
        case.candidates, case.strongest,
    )
    return lines.select("investigation_id", "section", "line")


@query("evidence_catalog", select(f"""
SELECT {sid("ev", "finding_id", "'metric'")} AS evidence_id, 'Finding: ' || finding_id AS attached_to, 'METRIC' AS type,
  coalesce(metric, 'schema') AS metric, 'Anomaly detected by baseline rules' AS description FROM drift
UNION ALL SELECT {sid("ev", "attribution_id")}, 'Finding: ' || finding_id, 'HISTORY', 'attribution_match', 'Attribution match: ' || reason FROM attributions
UNION ALL SELECT evidence_id, 'ValidationResult: ' || hypothesis_id, type, metric, note FROM validations""", "drift", "attributions", "validations"))
def evidence_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = Case(spark, sf_dir).attribute().validate()
    keep = ["evidence_id", "finding_id", "type", "metric", "description"]
    of_findings = drift.metric_evidence(case.findings).select(*keep).unionByName(
        attribution.evidence(case.attributions).select(*keep)
    )
    return synthesis.evidence_catalog(of_findings, case.validations)


@query("active_hypotheses", select("""
SELECT h.hypothesis_id, h.finding_id, h.attribution_id, h.description, coalesce(v.verdict, 'PROPOSED') AS status, v.note AS validation_note
FROM hypotheses h LEFT JOIN validations v ON v.hypothesis_id = h.hypothesis_id""", "hypotheses", "validations"))
def active_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = Case(spark, sf_dir).attribute().validate()
    return synthesis.active_hypotheses(case.hypotheses, case.validations)


@query("schema_context", select('SELECT dataset_id, version_number, "column", type FROM prof', "prof"))
def schema_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.schema_context(pair_profiles(spark, sf_dir))


@query("timeline_build", select(f"""
SELECT *, {sid("evt", "event_type", "entity_id")} AS event_id FROM (
SELECT investigation_id, 1 AS step, 'STATUS_CHANGED' AS event_type, 'SYSTEM' AS source, investigation_id AS entity_id,
  'Investigation created with status OPEN' AS description FROM investigations
UNION ALL SELECT investigation_id, 2, 'DATASET_VERSION_CREATED', 'SYSTEM', dataset_id || '@' || version_number,
  'Dataset version ' || version_number || ' created.' FROM investigations
UNION ALL SELECT investigation_id, 3, 'HISTORICAL_CHANGE_DISCOVERED', 'SYSTEM', dataset_id || '@' || version_number,
  'Historical diff calculated (v' || (version_number - 1) || ' -> v' || version_number || '). Found ' ||
  (SELECT count(*) FROM changes c WHERE c.change_kind = 'schema' AND c.dataset_id = i.dataset_id AND c.version_number = i.version_number) || ' schema changes, ' ||
  (SELECT count(*) FROM changes c WHERE c.change_kind = 'column' AND c.dataset_id = i.dataset_id AND c.version_number = i.version_number) || ' column shifts.' FROM investigations i
UNION ALL SELECT investigation_id, 4, 'FINDING_DETECTED', 'SYSTEM', finding_id, 'Finding detected: ' || d.title FROM drift d JOIN investigations i USING (dataset_id, version_number)
UNION ALL SELECT investigation_id, 5, 'EVIDENCE_COLLECTED', 'SYSTEM', {sid("ev", "finding_id", "'metric'")}, 'Evidence generated: Anomaly detected by baseline rules'
  FROM drift d JOIN investigations i USING (dataset_id, version_number)
UNION ALL SELECT investigation_id, 6, 'ATTRIBUTION_GENERATED', 'SYSTEM', attribution_id, 'Attribution completed: ' || reason || ' -> ' || relevance
  FROM attributions JOIN investigations i USING (dataset_id, version_number)
UNION ALL SELECT investigation_id, 7, 'HYPOTHESIS_CREATED', 'SYSTEM', hypothesis_id, 'Hypothesis created: ' || h.description
  FROM hypotheses h JOIN investigations i USING (dataset_id, version_number)
UNION ALL SELECT investigation_id, 8, 'HYPOTHESIS_VALIDATED', 'SYSTEM', v.hypothesis_id, v.verdict || ': ' || v.note
  FROM validations v JOIN hypotheses h USING (hypothesis_id) JOIN investigations i USING (dataset_id, version_number))""", "investigations", "validations", "changes"))
def timeline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = Case(spark, sf_dir).attribute().validate()
    return timeline.build(
        case.investigations, diff.summary(case.profiles, case.changes), case.findings,
        drift.metric_evidence(case.findings), case.attributions, case.hypotheses, case.validations,
    )


# Row and value level


ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_CHANGED = ", ".join(
    f"CASE WHEN any_value(a.{c}) IS DISTINCT FROM any_value(b.{c}) THEN '{c}' END" for c in ORDER_VALUES
)


@query("row_diff", select(f"""
SELECT CASE WHEN n1 > 1 OR n2 > 1 THEN 'ambiguous' WHEN n1 = 0 THEN 'added' WHEN n2 = 0 THEN 'removed' WHEN changed <> '' THEN 'modified' ELSE 'same' END AS row_status,
  CASE WHEN n1 = 1 AND n2 = 1 THEN changed ELSE '' END AS changed_columns, count(*) AS n_keys
FROM (SELECT count(DISTINCT a.rowid_) AS n1, count(DISTINCT b.rowid_) AS n2, concat_ws(',', {ORDER_CHANGED}) AS changed
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM orders) a FULL JOIN (SELECT *, row_number() OVER () AS rowid_ FROM ord2) b USING (o_orderkey) GROUP BY o_orderkey)
GROUP BY 1, 2""", "ord2"))
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys per outcome between two versions of orders."""
    ord1, ord2 = order_versions(spark, sf_dir)
    out = diff.row_diff(ord1, ord2, ["o_orderkey"])
    return out.groupBy("row_status", F.array_join("changed_columns", ",").alias("changed_columns")).agg(
        F.count(F.lit(1)).alias("n_keys")
    )


FREQUENCY_SQL = """
SELECT value, n_previous, n_current, n_previous / (SELECT count(*) FROM events) AS share_previous, n_current / (SELECT count(*) FROM ev2) AS share_current
FROM (SELECT event_type AS value, sum(a)::BIGINT AS n_previous, sum(b)::BIGINT AS n_current FROM (
  SELECT event_type, 1 AS a, 0 AS b FROM events UNION ALL SELECT event_type, 0, 1 FROM ev2) GROUP BY event_type)
"""


@query("frequency_diff", select(
    f"SELECT 'event_type' AS \"column\", *, share_current - share_previous AS share_delta FROM ({FREQUENCY_SQL})", "ev2"))
def frequency_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.frequency_diff(*event_versions(spark, sf_dir), ["event_type"])


TEXT_SQL = """
SELECT text AS value, count(*) FILTER (WHERE doc_id % 9 <> 1) AS n_previous, count(*) FILTER (WHERE doc_id % 9 <> 0) AS n_current FROM documents GROUP BY text
"""


@query("frequency_texts", f"""
SELECT 'text' AS "column", *, n_previous / (SELECT count(*) FROM documents WHERE doc_id % 9 <> 1) AS share_previous, n_current / (SELECT count(*) FROM documents WHERE doc_id % 9 <> 0) AS share_current,
  n_current / (SELECT count(*) FROM documents WHERE doc_id % 9 <> 0) - n_previous / (SELECT count(*) FROM documents WHERE doc_id % 9 <> 1) AS share_delta
FROM ({TEXT_SQL}) WHERE n_previous + n_current > 0""")
def frequency_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as values; one version lacks some documents and the next lacks others."""
    documents = read(spark, sf_dir, "documents")
    return diff.frequency_diff(documents.filter("doc_id % 9 <> 1"), documents.filter("doc_id % 9 <> 0"), ["text"])


@query("quantile_shift", select("""
SELECT 'value' AS "column", q AS quantile, p AS previous, c AS current, round(c - p, 6) AS absolute_delta FROM (
  SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q, unnest((SELECT quantile_disc(value, [0.25, 0.5, 0.75]) FROM events)) AS p, unnest((SELECT quantile_disc(value, [0.25, 0.5, 0.75]) FROM ev2)) AS c)""", "ev2"))
def quantile_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of both versions of events, and how far they moved."""
    cuts = (0.25, 0.5, 0.75)
    p1, p2 = (profile(df, columns=["value"], quantiles=cuts, accuracy=10_000_000) for df in event_versions(spark, sf_dir))
    out = diff.quantile_shifts(p1, p2, cuts)
    return out.withColumn("absolute_delta", F.round("absolute_delta", 6))


@query("row_diff_widened", """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'modified' ELSE 'same' END AS row_status, count(*) AS n_keys FROM orders GROUP BY 1""")
def row_diff_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key column read as INTEGER before and BIGINT after, and a number that became text, change no row; other values do."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice")
    later = orders.select(
        "o_orderkey", (F.col("o_custkey").cast("bigint") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
    )
    return diff.row_diff(orders, later, ["o_orderkey"]).groupBy("row_status").agg(F.count("*").alias("n_keys"))


@query("distribution_distance", select(f"""
SELECT 'event_type' AS "column", count(*) AS n_values, round(sum(abs(share_current - share_previous)) / 2, 9) AS total_variation,
  round(sum((greatest(share_current, 1e-6) - greatest(share_previous, 1e-6)) * ln(greatest(share_current, 1e-6) / greatest(share_previous, 1e-6))), 9) AS stability_index
FROM ({FREQUENCY_SQL})""", "ev2"))
def distribution_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff.distribution_distance(diff.frequency_diff(*event_versions(spark, sf_dir), ["event_type"]))
    return out.withColumn("total_variation", F.round("total_variation", 9)).withColumn(
        "stability_index", F.round("stability_index", 9)
    )


@query("quantile_drift", select(f"""
WITH x AS (SELECT 'value' AS "column", value::DOUBLE AS a FROM events UNION ALL SELECT 'event_id', event_id FROM events),
y AS (SELECT 'value' AS "column", value::DOUBLE AS b FROM ev2 UNION ALL SELECT 'event_id', event_id FROM ev2),
cuts AS (SELECT "column", unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS quantile, unnest(quantile_disc(b, [0.25, 0.5, 0.75])) AS c FROM y WHERE b IS NOT NULL GROUP BY "column")
SELECT x."column", quantile, round({sketches.rank_error()}::DOUBLE, 9) AS rank_error, abs(count(*) FILTER (a <= c) / count(*) - quantile) > {4 * sketches.rank_error()} AS drifted
FROM x JOIN cuts ON cuts."column" = x."column" WHERE a IS NOT NULL GROUP BY x."column", quantile""", "ev2").replace("\nWITH x AS", ", x AS", 1))
def quantile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of two stored versions, compared without reading their data; the SQL compares exact ranks."""
    stored = [settle(sketches.mergeable(df)) for df in event_versions(spark, sf_dir)]
    out = sketches.quantile_drift(*stored, ranks=(0.25, 0.5, 0.75)).filter("column IN ('value', 'event_id')")
    return out.select("column", "quantile", F.round("rank_error", 9).alias("rank_error"), "drifted")


LATER_PRICE = "l_extendedprice * CASE WHEN l_linenumber = 1 THEN 1.25 ELSE 1.0 END"


@query("ks_distance", f"""
WITH s AS (SELECT 'l_extendedprice' AS "column", CAST(l_extendedprice AS DOUBLE) AS v, 1 AS a, 0 AS b FROM lineitem
  UNION ALL SELECT 'l_extendedprice', CAST({LATER_PRICE} AS DOUBLE), 0, 1 FROM lineitem WHERE l_orderkey % 5 <> 0
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE), 1, 0 FROM lineitem UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE), 0, 1 FROM lineitem WHERE l_orderkey % 5 <> 0),
c AS (SELECT "column", v, sum(a) AS a, sum(b) AS b FROM s GROUP BY 1, 2),
r AS (SELECT "column", v, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a) OVER (PARTITION BY "column") AS na, sum(b) OVER (PARTITION BY "column") AS nb FROM c WINDOW w AS (PARTITION BY "column" ORDER BY v))
SELECT "column", CAST(max(na) AS BIGINT) AS n_previous, CAST(max(nb) AS BIGINT) AS n_current, round(max(abs(a / na - b / nb)), 9) AS distance FROM r GROUP BY "column\"""")
def ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of prices of two versions, one without a fifth of the orders and with a dearer first line, and of quantities."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    later = items.filter("l_orderkey % 5 <> 0").withColumn("l_extendedprice", F.col("l_extendedprice") * F.when(F.col("l_linenumber") == 1, 1.25).otherwise(1.0))
    out = distributions.ks_distance(items, later, ["l_extendedprice", "l_quantity"])
    return out.select("column", "n_previous", "n_current", F.round("distance", 9).alias("distance"))


@query("row_diff_segments", """
SELECT o_orderkey, CAST(1 AS BIGINT) AS n_previous, CAST(CASE WHEN o_orderkey % 10000 BETWEEN 1200 AND 1205 THEN 0 ELSE 1 END AS BIGINT) AS n_current,
  CASE WHEN o_orderkey % 10000 BETWEEN 1200 AND 1205 THEN '' ELSE 'o_totalprice' END AS changed, CASE WHEN o_orderkey % 10000 BETWEEN 1200 AND 1205 THEN 'removed' ELSE 'modified' END AS row_status
FROM orders WHERE o_orderkey % 10000 BETWEEN 1200 AND 1205 OR o_orderkey % 10000 BETWEEN 1020 AND 1026
UNION ALL SELECT -1 - o_orderkey, 0, 1, '', 'added' FROM orders WHERE o_orderkey < 30""")
def row_diff_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions stored in segments of 1,000 keys, of which only those that differ are read."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    place = F.col("o_orderkey") % 10000
    later = orders.filter(~place.between(1200, 1205)).withColumn("o_totalprice", F.col("o_totalprice") + F.when(place.between(1020, 1026), 1.0).otherwise(0.0))
    later = later.unionByName(orders.filter("o_orderkey < 30").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    paths = [new_path(spark, "segments") for _ in range(2)]
    for df, path in zip((orders, later), paths):
        segments.write_segments(df, "o_orderkey", path, 1000)
    out = segments.row_diff_segments(spark, *paths, ["o_orderkey"])
    return out.select("o_orderkey", "n_previous", "n_current", F.array_join("changed_columns", ",").alias("changed"), "row_status")


@query("null_segments", """
SELECT list_aggregate(list_filter([CASE WHEN GROUPING(l_returnflag) = 0 THEN 'l_returnflag' END, CASE WHEN GROUPING(l_linestatus) = 0 THEN 'l_linestatus' END, CASE WHEN GROUPING(l_linenumber) = 0 THEN 'l_linenumber' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS dimensions,
  list_aggregate(list_filter([CASE WHEN GROUPING(l_returnflag) = 0 THEN coalesce(l_returnflag, '~') END, CASE WHEN GROUPING(l_linestatus) = 0 THEN coalesce(l_linestatus, '~') END, CASE WHEN GROUPING(l_linenumber) = 0 THEN coalesce(l_linenumber::VARCHAR, '~') END], lambda x: x IS NOT NULL), 'string_agg', '|') AS segment,
  count(*) AS n_rows, count(*) - count(price) AS n_nulls, round((count(*) - count(price)) / count(*) / (SELECT (count(*) - count(price)) / count(*) FROM
    (SELECT CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber = 2) AND l_partkey % 50 <> 0 THEN l_extendedprice END AS price FROM lineitem)), 6) AS lift
FROM (SELECT l_returnflag, CASE WHEN l_suppkey % 4 <> 0 THEN l_linestatus END AS l_linestatus, l_linenumber, CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber = 2) AND l_partkey % 50 <> 0 THEN l_extendedprice END AS price FROM lineitem)
GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)
HAVING count(*) >= 400 AND GROUPING(l_returnflag, l_linestatus, l_linenumber) < 7""")
def null_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of line items of 400 rows or more, and how much more often than elsewhere their price is null."""
    items = read(spark, sf_dir, "lineitem")
    gone = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2) | (F.col("l_partkey") % 50 == 0)
    df = items.select(
        "l_returnflag", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linestatus")).alias("l_linestatus"), "l_linenumber", F.when(~gone, F.col("l_extendedprice")).alias("price")
    )
    out = explain_nulls.null_segments(df, "price", ["l_returnflag", "l_linestatus", "l_linenumber"], support=400)
    shown = F.array_join("values", "|", "~")
    return out.select("dimensions", shown.alias("segment"), "n_rows", "n_nulls", F.round("lift", 6).alias("lift"))


@query("rule_distribution", select("""
SELECT dataset_id, version_number, "column", round(mean, 6) AS value, n AS n_history, CASE WHEN n < 3 OR sd IS NULL THEN 'unknown' WHEN abs((mean - m) / sd) > 1.5 THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT *, count(mean) OVER w AS n, avg(mean) OVER w AS m, stddev_samp(mean) OVER w AS sd FROM daily WHERE mean IS NOT NULL
  WINDOW w AS (PARTITION BY "column" ORDER BY version_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "daily"))
def rule_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose mean lies far from the days before."""
    out = diff.history_outliers(daily_profiles(spark, sf_dir), "mean", z_limit=1.5)
    return out.select("dataset_id", "version_number", "column", F.round("value", 6).alias("value"), "n_history", "status")


# Experiments


def _load(sf_dir: str, table: str):
    return lambda session: session.read.parquet(f"{sf_dir}/{table}.parquet")


SELECT_SQL = """
WITH busy AS (SELECT user_id, count(*) AS n FROM dataset GROUP BY user_id HAVING count(*) > 3)
SELECT d.event_type, count(*) AS n_events, count(DISTINCT d.user_id) AS n_users, max(b.n) AS busiest,
  rank() OVER (ORDER BY count(*) DESC, d.event_type) AS place
FROM dataset d JOIN busy b ON d.user_id = b.user_id
WHERE d.value > 10 AND d.event_type IN (SELECT event_type FROM dataset WHERE value > 50)
GROUP BY d.event_type
"""


@query("experiment_select", SELECT_SQL.replace("dataset", "events").replace("rank() OVER", "CAST(rank() OVER").replace(") AS place", ") AS INTEGER) AS place"))
def experiment_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = experiment.experiment_session(spark, _load(sf_dir, "events"))
    return experiment.select(session, SELECT_SQL)


EXPERIMENTS = {
    "null values": "SELECT * FROM dataset WHERE value IS NULL",
    "large values": "SELECT event_id, value FROM dataset WHERE value > 90;",
    "drop": "DROP TABLE dataset",
    "no such column": "SELECT missing FROM dataset",
}


@query("experiment_result", """
SELECT 'null values' AS name, count(*) AS row_count, 'event_id,ts,user_id,event_type,value,props' AS columns, least(count(*), 50) AS n_sample, 'COMPLETED' AS status FROM events WHERE value IS NULL
UNION ALL SELECT 'large values', count(*), 'event_id,value', least(count(*), 50), 'COMPLETED' FROM events WHERE value > 90
UNION ALL SELECT 'drop', 0, '', 0, 'FAILED' FROM events HAVING count(*) > 0
UNION ALL SELECT 'no such column', 0, '', 0, 'FAILED' FROM events HAVING count(*) > 0""")
def experiment_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-table experiments; the refused and the broken one end as failed results."""
    rows = []
    for name, sql in EXPERIMENTS.items():
        r = experiment.run(spark, _load(sf_dir, "events"), sql)
        rows.append((name, r.row_count, ",".join(r.columns), len(r.sample_rows), r.status))
    return spark.createDataFrame(rows, "name string, row_count bigint, columns string, n_sample bigint, status string")


GUARDED = {
    "plain": "SELECT * FROM dataset",
    "with": "WITH e AS (SELECT * FROM dataset WHERE event_type = 'error') SELECT user_id FROM e",
    "delete": "DELETE FROM dataset WHERE value > 0",
    "insert": "INSERT INTO dataset SELECT * FROM dataset",
    "create": "CREATE TABLE copy AS SELECT * FROM dataset",
    "two statements": "SELECT 1; DROP VIEW dataset",
    "setting": "SET spark.sql.runSQLOnFiles = true",
    "another table": "SELECT * FROM other",
    "jvm call": "SELECT reflect('java.lang.System', 'nanoTime') FROM dataset",
    "jvm call by identifier": "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM dataset",
    "jvm call behind comments": "SELECT java_method /* a /* b */ c */ ('java.lang.System', 'nanoTime') FROM dataset",
    "another session": "SELECT * FROM global_temp.secret",
    "catalog table": "SELECT * FROM default.secret",
    "relation by identifier": "SELECT * FROM IDENTIFIER('dataset')",
    "text literal": "SELECT 'see reflect (docs)' AS note FROM dataset",
    "afterwards": "SELECT event_id FROM dataset",
}


@query("experiment_guard", "\nUNION ALL ".join(
    f"SELECT '{name}' AS name, '{'COMPLETED' if kept else 'FAILED'}' AS status, count(*) FILTER (WHERE {kept or 'false'}) AS row_count FROM events"
    for name, kept in {**dict.fromkeys(GUARDED), "plain": "true", "text literal": "true", "with": "event_type = 'error'", "afterwards": "true"}.items()))
def experiment_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries run over the whole table; any other statement fails and leaves the table as it is."""
    rows = []
    for name, sql in GUARDED.items():
        r = experiment.run(spark, _load(sf_dir, "events"), sql, sample_limit=1)
        rows.append((name, r.status, r.row_count))
    return spark.createDataFrame(rows, "name string, status string, row_count bigint")


# Audit of responses

VIOLATION = "SELECT response_id, '{0}' AS \"check\", '{1}' AS severity, {2} AS detail FROM "
COLUMN_SQL = VIOLATION.format("column", "ERROR", "c") + r"(SELECT response_id, conv_id, unnest(list_distinct(regexp_extract_all(full_text, 'column\s+''([a-z0-9_]+)''', 1))) AS c FROM answers) WHERE CASE conv_id % 2 WHEN 0 THEN c NOT IN ('conv_id', 'turn', 'role', 'text') ELSE c NOT IN ('doc_id', 'text', 'lang', 'source', 'n_chars') END"
METRIC_SQL = VIOLATION.format("metric", "ERROR", "c") + r"(SELECT response_id, unnest(list_distinct(regexp_extract_all(full_text, 'metric\s+''([a-z0-9_]+)''', 1))) AS c FROM answers) WHERE c NOT IN ('row_count', 'null_fraction', 'null_count', 'unique_fraction', 'unique_count', 'mean', 'min', 'max', 'duplicate_fraction')"
SQL_SQL = VIOLATION.format("sql", "ERROR", "upper(w)") + r"(SELECT response_id, unnest(list_distinct(regexp_extract_all(lower(query), '\b(insert|update|delete|drop|alter|truncate|grant|revoke|commit|rollback)\b', 1))) AS w FROM answers)"
CITATION_SQL = VIOLATION.format("citation", "WARN", "id") + "(SELECT DISTINCT response_id, conv_id, unnest(['ev_' || conv_id, 'ev_' || (conv_id * 20)]) AS id FROM answers) WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE 'ev_' || d.doc_id = id AND d.doc_id % 2 = conv_id % 2)"
OVERCLAIM_SQL = (
    VIOLATION.format("overclaim", "ERROR", "'strong root cause'") + "answers WHERE contains(full_text, 'strong') AND contains(full_text, 'root cause') AND NOT has_strong"
    "\nUNION ALL " + VIOLATION.format("overclaim", "ERROR", "'confirmed hypothesis'") + "answers WHERE (contains(full_text, 'confirmed') OR contains(full_text, 'is the reason')) AND contains(full_text, 'hypothesis') AND NOT has_supported"
)


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two investigations whose versions have different columns."""
    names: list[Column] = [
        F.struct(F.lit(n).cast("bigint").alias("investigation_id"), F.lit(c).alias("column"))
        for n, t in enumerate(("conversations", "documents")) for c in read(spark, sf_dir, t).columns
    ]
    return spark.range(1).select(F.inline(F.array(*names)))


def _evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is evidence of one of two investigations."""
    doc = F.col("doc_id")
    return read(spark, sf_dir, "documents").select((doc % 2).alias("investigation_id"), F.concat(F.lit("ev_"), doc.cast("string")).alias("id"))


@query("audit_citations", select(CITATION_SQL, "answers"))
def audit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.citations(responses(spark, sf_dir), _evidence_ids(spark, sf_dir))


@query("audit_sql", select(SQL_SQL, "answers"))
def audit_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unsafe_sql(responses(spark, sf_dir))


@query("audit_columns", select(COLUMN_SQL, "answers"))
def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.invented_columns(responses(spark, sf_dir), _schema(spark, sf_dir))


@query("audit_metrics", select(METRIC_SQL, "answers"))
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.invented_metrics(responses(spark, sf_dir))


@query("audit_overclaim", select(OVERCLAIM_SQL, "answers"))
def audit_overclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.overclaims(responses(spark, sf_dir))


@query("audit_all", select("\nUNION ALL ".join([CITATION_SQL, SQL_SQL, COLUMN_SQL, METRIC_SQL, OVERCLAIM_SQL]), "answers"))
def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.audit(responses(spark, sf_dir), _evidence_ids(spark, sf_dir), _schema(spark, sf_dir))
