"""Registered queries over semantics, rules and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluate, profile as prof, recommend, rules, semantics
from .catalog import query, select
from .derived import event_versions, read, target_profiles


@query("physical_type", select('SELECT dataset_id, "column", type, physical_type FROM roles', "roles"))
def physical_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.classify(target_profiles(spark, sf_dir)).select("dataset_id", "column", "type", "physical_type")


@query("semantic_roles", select('SELECT dataset_id, "column", semantic_role FROM roles', "roles"))
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.classify(target_profiles(spark, sf_dir)).select("dataset_id", "column", "semantic_role")


CONTACTS_SQL = """SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS Email_Domain, c_acctbal AS revenue FROM customer"""


@query("pii_columns", """
SELECT * FROM (
SELECT 'customer_id' AS "column", 'NON_PII' AS sensitivity, count(c_custkey) AS n_values FROM customer
UNION ALL SELECT 'first_name', 'PII', count(c_name) FROM customer
UNION ALL SELECT 'Email_Domain', 'PII', count(c_mktsegment) FROM customer
UNION ALL SELECT 'revenue', 'NON_PII', count(c_acctbal) FROM customer)""")
def pii_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold personal data by name, with how many values each exposes."""
    contacts = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("Email_Domain"), F.col("c_acctbal").alias("revenue"),
    )
    p = semantics.classify(prof.profile(contacts))
    return p.select("column", "sensitivity", (F.col("row_count") - F.col("null_count")).alias("n_values"))


@query("column_semantics", select(
    'SELECT dataset_id, "column", physical_type, semantic_role, sensitivity FROM roles', "roles"))
def column_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.classify(target_profiles(spark, sf_dir)).select(
        "dataset_id", "column", "physical_type", "semantic_role", "sensitivity"
    )


RESULT_COLUMNS = ["rule", "column", "row_count", "violations", "status"]


def _result_sql(rule: str, column: str, bad: str, table: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", count(*) AS row_count, CAST({bad} AS BIGINT) AS violations, "
        f"CASE WHEN {bad} = 0 THEN 'passed' ELSE 'failed' END AS status FROM {table}"
    )


def _count_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


EV2_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "channel"]


@query("rule_not_null", select("\nUNION ALL ".join(
    _result_sql("NotNullRule", c, f"(count(*) - count({c}))", "ev2") for c in EV2_COLUMNS), "ev2"))
def rule_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev2 = event_versions(spark, sf_dir)[1]
    return rules.evaluate(ev2, [rules.not_null(c) for c in ev2.columns]).select(*RESULT_COLUMNS)


@query("rule_unique", select("\nUNION ALL ".join(
    _result_sql("UniqueRule", c, f"(count(*) - count(DISTINCT {c}))", "ev2") for c in ("event_id", "user_id", "value")), "ev2"))
def rule_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev2 = event_versions(spark, sf_dir)[1]
    return rules.evaluate(ev2, [rules.unique(c) for c in ("event_id", "user_id", "value")]).select(*RESULT_COLUMNS)


@query("rule_status", select(
    _result_sql("NotNullRule", "value", "(count(*) - count(value))", "ev2")
    + "\nUNION ALL " + _result_sql("UniqueRule", "ts", "(count(*) - count(DISTINCT ts))", "ev2")
    + "".join(f"\nUNION ALL SELECT '{r}', '{c}', count(*), NULL, 'unknown' FROM ev2" for r, c in (
        ("NotNullRule", "props"), ("RangeRule", "event_type"), ("FreshnessRule", "event_id"), ("RegexRule", "channel"), ("TypeRule", "user_id"))), "ev2"))
def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed, passed, and unknown: a column that is gone, one of a type that does not fit, a pattern and a type that are none."""
    ev2 = event_versions(spark, sf_dir)[1]
    checks = [
        rules.not_null("value"), rules.unique("ts"), rules.not_null("props"), rules.in_range("event_type", 1, 5),
        rules.fresh("event_id", F.current_timestamp(), 24), rules.matches("channel", "(unclosed"), rules.castable("user_id", "no_type"),
    ]
    return rules.evaluate(ev2, checks).select(*RESULT_COLUMNS)


@query("applicability", select(
    'SELECT dataset_id, "column", rule, semantic_role, applicable, confidence, reason FROM applicable', "applicable"))
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.applicability(semantics.classify(target_profiles(spark, sf_dir)))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = target_profiles(spark, sf_dir)
    return rules.findings(rules.results_from_profile(p), semantics.classify(p))


@query("quality_findings", select("SELECT * FROM quality", "quality"))
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ranked(_found(spark, sf_dir)).drop("parameters")


@query("investigate_table", select("SELECT * EXCLUDE (dataset_id, finding_id) FROM quality WHERE dataset_id = 'events'", "quality"))
def investigate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one table from an approximate profile, with exact counts for its identifiers only."""
    return rules.ranked(rules.quality_findings(event_versions(spark, sf_dir)[1])).drop("finding_id", "parameters")


@query("impact_scores", select(
    'SELECT dataset_id, rule, "column", semantic_role, violations, affected_fraction, confidence, impact_score FROM impacts', "impacts"))
def impact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of both rules on every column, applicable or not."""
    return _impacts(spark, sf_dir).select(
        "dataset_id", "rule", "column", "semantic_role", "violations", "affected_fraction", "confidence", "impact_score"
    )


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = target_profiles(spark, sf_dir)
    roles = semantics.classify(p).select("dataset_id", "column", "semantic_role")
    results = rules.results_from_profile(p).join(roles, ["dataset_id", "column"])
    return rules.with_impact(rules.with_applicability(results))


@query("severity_buckets", select("SELECT severity, count(*) AS n FROM impacts GROUP BY severity", "impacts"))
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impacts(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("observations", select(
    "SELECT 'obs_' || left(sha256(finding_id), 32) AS observation_id, finding_id, "
    "CASE rule WHEN 'UniqueRule' THEN 'unique_violation' ELSE 'notnull_violation' END AS metric, violations AS value, \"column\" FROM quality", "quality"))
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.observations(_found(spark, sf_dir))


@query("finding_evidence", select("""
SELECT 'ev_' || left(sha256(finding_id || '|violation_count'), 32) AS evidence_id, finding_id, rule AS source, 'METRIC' AS type,
  'violation_count' AS metric, CAST(violations AS VARCHAR) AS value, 'Observed ' || violations || ' violations' AS description FROM quality
UNION ALL SELECT 'ev_' || left(sha256(finding_id || '|evaluation_query'), 32), finding_id, rule, 'QUERY', 'evaluation_query', "check",
  'SQL query used to detect the violation' FROM quality""", "quality"))
def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.finding_evidence(_found(spark, sf_dir))


@query("findings_report", select("""
SELECT finding_id, impact_score, CAST(i - 1 AS INTEGER) AS place, lines[i] AS line FROM (
  SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (
    SELECT finding_id, impact_score, list_concat([
      '[' || CASE severity WHEN 'CRITICAL' THEN '!' WHEN 'HIGH' THEN 'X' WHEN 'MEDIUM' THEN '-' WHEN 'LOW' THEN '.' ELSE 'i' END || '] ' || severity,
      title, 'Affected: ' || printf('%.1f', affected_fraction * 100) || '%', 'Confidence: ' || printf('%.0f', confidence * 100) || '%',
      'Explanation:', '  ' || description, 'Evidence:', '  - [METRIC] Observed ' || violations || ' violations',
      '  - [QUERY] SQL query used to detect the violation', '    SQL: ' || "check", 'Suggested next steps:'],
      CASE category WHEN 'UNIQUENESS' THEN ['  1. [COMPARE] Compare timestamp across duplicate groups to identify chronologically later duplicates.',
        '  2. [INSPECT] Check if duplicate records originated from the same ingestion batch.', '  3. [COMPARE] Compare source file lineage to detect duplicate processing.']
      ELSE ['  1. [CORRELATE] Check if nulls correlate with specific dates or upstream source systems.'] END) AS lines
    FROM quality))""", "quality"))
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings_report(_found(spark, sf_dir))


@query("recommendations", select("""
SELECT finding_id, "column", category, impact_score, priority, action, target, rationale FROM quality JOIN (VALUES
 ('UNIQUENESS', 'P1', 'COMPARE', 'created_at', 'Compare timestamp across duplicate groups to identify chronologically later duplicates.'),
 ('UNIQUENESS', 'P2', 'INSPECT', 'ingestion_batch_id', 'Check if duplicate records originated from the same ingestion batch.'),
 ('UNIQUENESS', 'P3', 'COMPARE', 'source_file', 'Compare source file lineage to detect duplicate processing.'),
 ('COMPLETENESS', 'P1', 'CORRELATE', 'null_distribution', 'Check if nulls correlate with specific dates or upstream source systems.')
) a(category, priority, action, target, rationale) USING (category)""", "quality"))
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.ordered(recommend.recommend(_found(spark, sf_dir)))


@query("export_rules", select("""
SELECT dataset_id, rule, "column", '{"rule":"' || rule || '","column":"' || "column" || '","confidence":' || confidence || '}' AS rule_json FROM quality""", "quality"))
def export_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.export_rules(_found(spark, sf_dir))


# Documented rule types


@query("rule_range", "\nUNION ALL ".join([
    _result_sql("RangeRule", "l_quantity", _count_if("l_quantity < 5 OR l_quantity > 45"), "lineitem"),
    _result_sql("RangeRule", "l_discount", _count_if("l_discount > 0.08::DOUBLE"), "lineitem"),
    _result_sql("RangeRule", "l_tax", _count_if("l_tax < 0"), "lineitem")]))
def rule_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [rules.in_range("l_quantity", 5, 45), rules.in_range("l_discount", high=0.08), rules.in_range("l_tax", low=0)]
    return rules.evaluate(read(spark, sf_dir, "lineitem"), checks).select(*RESULT_COLUMNS)


@query("rule_regex", "\nUNION ALL ".join([
    _result_sql("RegexRule", "url", _count_if("NOT regexp_matches(url, '^https://')"), "pages"),
    _result_sql("RegexRule", "html", _count_if("NOT regexp_matches(html, 'lang=\"(en|de)\"')"), "pages")]))
def rule_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [rules.matches("url", "^https://"), rules.matches("html", 'lang="(en|de)"')]
    return rules.evaluate(read(spark, sf_dir, "pages"), checks).select(*RESULT_COLUMNS)


@query("rule_membership", "\nUNION ALL ".join([
    _result_sql("SetMembershipRule", "o_orderpriority", _count_if("o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"), "orders"),
    _result_sql("SetMembershipRule", "o_orderstatus", _count_if("o_orderstatus NOT IN ('F', 'O', 'P')"), "orders")]))
def rule_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        rules.member_of("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
        rules.member_of("o_orderstatus", ["F", "O", "P"]),
    ]
    return rules.evaluate(read(spark, sf_dir, "orders"), checks).select(*RESULT_COLUMNS)


CODES = "(SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE left(o_orderpriority, 1) END AS code FROM orders)"


@query("rule_type", _result_sql("TypeRule", "code", _count_if("code IS NOT NULL AND try_cast(code AS INTEGER) IS NULL"), CODES))
def rule_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.left("o_orderpriority", F.lit(1)))
    return rules.evaluate(orders.select(code.alias("code")), [rules.castable("code", "int")]).select(*RESULT_COLUMNS)


@query("rule_freshness", """
SELECT o_orderpriority, 'FreshnessRule' AS rule, 'o_orderdate' AS "column", count(*) AS row_count,
  CAST(CASE WHEN epoch(TIMESTAMP '2001-01-01 00:00:00') - epoch(max(o_orderdate)) > 24 * 3600 THEN 1 ELSE 0 END AS BIGINT) AS violations,
  CASE WHEN epoch(TIMESTAMP '2001-01-01 00:00:00') - epoch(max(o_orderdate)) > 24 * 3600 THEN 'failed' ELSE 'passed' END AS status
FROM orders GROUP BY o_orderpriority""")
def rule_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = rules.fresh("o_orderdate", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"), 24)
    return rules.evaluate(read(spark, sf_dir, "orders"), [check], by=["o_orderpriority"]).select("o_orderpriority", *RESULT_COLUMNS)


@query("rule_schema", """
SELECT 'props' AS "column", 'missing' AS problem, 'VARCHAR' AS expected_type, NULL AS actual_type FROM events HAVING count(*) > 0
UNION ALL SELECT 'user_id', 'type', 'BIGINT', 'VARCHAR' FROM events HAVING count(*) > 0
UNION ALL SELECT 'channel', 'unexpected', NULL, 'VARCHAR' FROM events HAVING count(*) > 0""")
def rule_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev1, ev2 = event_versions(spark, sf_dir)
    return rules.schema_rule(prof.profile(ev2), prof.profile(ev1).select("column", "type"))


FOUND = ["rule", '"column"', "category", "violations", "affected_fraction", "parameters"]
FOUND_SQL = """SELECT '{0}' AS rule, '{1}' AS "column", '{2}' AS category, CAST({3} AS BIGINT) AS violations, {3} / {4} AS affected_fraction, '{5}' AS parameters FROM {6}"""


def _all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every kind of rule over the later version of events, and over orders where another table is needed."""
    ev1, ev2 = event_versions(spark, sf_dir)
    checks = [
        rules.not_null("value"), rules.unique("event_id"), rules.in_range("value", 0, 50), rules.matches("event_type", "^(view|click)$"),
        rules.member_of("event_type", ["view", "click"]), rules.castable("user_id", "tinyint"), rules.fresh("ts", F.lit("2100-01-01").cast("timestamp_ntz"), 24),
    ]
    out = rules.evaluate(ev2, checks)
    out = out.unionByName(rules.schema_results(prof.profile(ev2), prof.profile(ev1).select("column", "type")))
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    out = out.unionByName(rules.referential(orders, "o_custkey", customers, "c_custkey", "o_custkey"))
    return out.unionByName(rules.member_of_table(orders, "o_orderkey", orders.filter("o_orderstatus = 'F'"), "o_orderkey"))


def _rows_of(table: str) -> str:
    return f"(SELECT count(*) FROM {table})"


SCHEMA_PROBLEM = '{{"problem":"{0}"{1}}}'


@query("rule_findings", select("SELECT * FROM (" + "\nUNION ALL ".join([
    FOUND_SQL.format("NotNullRule", "value", "COMPLETENESS", "count(*) FILTER (WHERE value IS NULL)", "count(*)", "{}", "ev2"),
    FOUND_SQL.format("UniqueRule", "event_id", "UNIQUENESS", "(count(*) - count(DISTINCT event_id))", "count(*)", "{}", "ev2"),
    FOUND_SQL.format("RangeRule", "value", "VALIDITY", "count(*) FILTER (WHERE value < 0 OR value > 50)", "count(*)", '{"high": 50, "low": 0}', "ev2"),
    FOUND_SQL.format("RegexRule", "event_type", "VALIDITY", "count(*) FILTER (WHERE NOT regexp_matches(event_type, '^(view|click)$'))", "count(*)", '{"pattern": "^(view|click)$"}', "ev2"),
    FOUND_SQL.format("SetMembershipRule", "event_type", "VALIDITY", "count(*) FILTER (WHERE event_type NOT IN ('view', 'click'))", "count(*)", '{"values": ["view", "click"]}', "ev2"),
    FOUND_SQL.format("TypeRule", "user_id", "VALIDITY", "count(*) FILTER (WHERE user_id IS NOT NULL AND TRY_CAST(user_id AS TINYINT) IS NULL)", "count(*)", '{"type": "tinyint"}', "ev2"),
    FOUND_SQL.format("FreshnessRule", "ts", "FRESHNESS", "least(count(*), 1)", "count(*)", '{"max_age_hours": 24}', "ev2"),
    FOUND_SQL.format("SchemaRule", "props", "SCHEMA", "least(count(*), 1)", "count(*)", SCHEMA_PROBLEM.format("missing", ',"expected_type":"VARCHAR"'), "ev2"),
    FOUND_SQL.format("SchemaRule", "channel", "SCHEMA", "least(count(*), 1)", "count(*)", SCHEMA_PROBLEM.format("unexpected", ',"actual_type":"VARCHAR"'), "ev2"),
    FOUND_SQL.format("SchemaRule", "user_id", "SCHEMA", "least(count(*), 1)", "count(*)", SCHEMA_PROBLEM.format("type", ',"expected_type":"BIGINT","actual_type":"VARCHAR"'), "ev2"),
    FOUND_SQL.format("ReferentialRule", "o_custkey", "REFERENTIAL_INTEGRITY", "count(*) FILTER (WHERE o_custkey % 2 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer))", "count(*)", '{"parent_key": "c_custkey"}', "orders"),
    FOUND_SQL.format("SetMembershipRule", "o_orderkey", "VALIDITY", "count(*) FILTER (WHERE o_orderstatus <> ''F'')".replace("''", "'"), "count(*)", '{"allowed": "o_orderkey"}', "orders"),
]) + ") WHERE violations > 0", "ev2"))
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all kinds of rules, with their parameters."""
    roles = semantics.classify(prof.profile(event_versions(spark, sf_dir)[1], exact=True))
    found = rules.findings(_all_kinds(spark, sf_dir), roles)
    return found.select("rule", "column", "category", "violations", "affected_fraction", "parameters")


ROUND_TRIP = [
    ("NotNullRule", "event_type", "event_type IS NULL"), ("RangeRule", "value", "value < 0 OR value > 50"), ("RegexRule", "event_type", "NOT regexp_matches(event_type, 'c')"),
    ("SetMembershipRule", "event_type", "event_type NOT IN ('view', 'it''s')"), ("TypeRule", "user_id", "user_id IS NOT NULL AND TRY_CAST(user_id AS TINYINT) IS NULL"),
]


@query("rule_round_trip", select("\nUNION ALL ".join(
    _result_sql(r, c, f"count(*) FILTER (WHERE {bad})", "ev2") for r, c, bad in ROUND_TRIP), "ev2"))
def rule_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that were found to fail, exported, made from their texts again, and evaluated once more."""
    ev2 = event_versions(spark, sf_dir)[1]
    checks = [
        rules.not_null("event_type"), rules.in_range("value", 0, 50), rules.matches("event_type", "c"),
        rules.member_of("event_type", ["view", "it's"]), rules.castable("user_id", "tinyint"),
    ]
    found = rules.findings(rules.evaluate(ev2, checks), semantics.classify(prof.profile(ev2)))
    texts = [r["rule_json"] for r in rules.export_rules(found).collect()]  # one for each rule
    return rules.evaluate(ev2, rules.rules_from_json(texts)).select(*RESULT_COLUMNS)


def _ref_sql(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    bad = f"count(*) FILTER (WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM {parent}))"
    return _result_sql("ReferentialRule", name, bad, child)


@query("rule_referential", "\nUNION ALL ".join([
    _ref_sql("o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    _ref_sql("doc_id", "labels", "doc_id", "documents", "doc_id"),
    _ref_sql("l_orderkey", "lineitem", "l_orderkey", "(SELECT * FROM orders WHERE o_orderstatus <> 'P') o", "o_orderkey")]))
def rule_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    out = rules.referential(orders, "o_custkey", read(spark, sf_dir, "customer"), "c_custkey", "o_custkey")
    labels = read(spark, sf_dir, "labels")
    out = out.unionByName(rules.referential(labels, "doc_id", read(spark, sf_dir, "documents"), "doc_id", "doc_id"))
    kept = orders.filter("o_orderstatus <> 'P'")
    lines = read(spark, sf_dir, "lineitem")
    return out.unionByName(rules.referential(lines, "l_orderkey", kept, "o_orderkey", "l_orderkey")).select(*RESULT_COLUMNS)


@query("duplicate_groups", """
SELECT sha256(text) AS text_key, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among the documents; texts are compared whole, by digest."""
    documents = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_key"))
    return rules.duplicate_groups(documents, ["text_key"])


@query("duplicate_share", """
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_repeated, count(*) FILTER (WHERE n > 1) / count(*) AS repeated_share
FROM (SELECT source, count(*) OVER (PARTITION BY text) AS n FROM documents) GROUP BY source""")
def duplicate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("text_key"))
    return rules.duplicate_share(documents, ["text_key"], "source")


@query("null_correlation", select("""
SELECT day, n_rows, n_null, n_null / n_rows AS null_rate, round(n_null / n_rows - (SELECT (count(*) - count(value)) / count(*) FROM ev2), 9) AS lift
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, count(*) - count(value) AS n_null FROM ev2 GROUP BY 1)""", "ev2"))
def null_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.null_correlation(event_versions(spark, sf_dir)[1], "value", F.to_date("ts"), "day")
    return out.withColumn("lift", F.round("lift", 9))


@query("detection_accuracy", """
WITH f AS (SELECT doc_id, sum(least(n - 1, 2)) AS n_found, sum(CASE WHEN n > 2 THEN 2 ELSE 0 END) AS n_high, sum(least(n - 1, 2)) AS n_evidence
    FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1 GROUP BY doc_id),
t AS (SELECT coalesce(sum(CASE WHEN quality = 0 AND n_found >= 2 THEN 2 WHEN quality = 0 THEN 0 END), 0) AS tp, coalesce(sum(CASE WHEN quality = 0 THEN 2 - least(n_found, 2) END), 0) AS fn,
    coalesce(sum(CASE WHEN quality = 1 THEN n_found END), 0) AS fp, coalesce(sum(CASE WHEN quality = 1 THEN n_high END), 0) AS hfp, coalesce(sum(n_evidence), 0) AS ev
    FROM (SELECT quality, coalesce(n_found, 0) AS n_found, coalesce(n_high, 0) AS n_high, coalesce(n_evidence, 0) AS n_evidence FROM labels LEFT JOIN f USING (doc_id)))
SELECT CAST(tp AS BIGINT) AS true_positives, CAST(fn AS BIGINT) AS false_negatives, CAST(fp AS BIGINT) AS false_positives,
  CAST(hfp AS BIGINT) AS high_severity_false_positives,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS BIGINT) / CAST(tp + fn AS BIGINT) * 100 ELSE 100.0 END AS detection_accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(ev AS BIGINT) / CAST(tp + fp AS BIGINT) * 100 ELSE 100.0 END AS evidence_completeness FROM t""")
def detection_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well exact copies predict the low-quality label. Two findings are expected of a bad document, one for each other copy
    up to two, so a document with a single copy is found only in part."""
    documents = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"))
    groups = rules.duplicate_groups(documents, ["text_key"])
    found = documents.join(groups, "text_key").select(
        F.col("doc_id").alias("subject_id"),
        F.when(F.col("n_rows") > 2, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit(True).alias("has_evidence"), F.explode(F.expr("sequence(1L, least(n_rows - 1, 2L))")).alias("other"),
    ).drop("other")
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("subject_id"), (2 * (1 - F.col("quality"))).alias("n_expected"),
        (F.col("quality") == 1).alias("is_control"),
    )
    return evaluate.detection_accuracy(labels, found)
