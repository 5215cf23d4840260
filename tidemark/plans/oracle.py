"""SQL for DuckDB that states the derived inputs and the main chain of results independently of Spark."""

from __future__ import annotations

NUMERIC = {"BIGINT", "INTEGER", "DOUBLE", "FLOAT", "DECIMAL", "SMALLINT", "TINYINT"}

# Columns of the given tables.
SCHEMAS = {
    "benchmark": "item_id BIGINT, text VARCHAR",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INTEGER",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, "
        "l_shipdate TIMESTAMP"
    ),
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
        "o_orderpriority VARCHAR"
    ),
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "part": (
        "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE"
    ),
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "ev2": (
        "event_id BIGINT, ts TIMESTAMP, user_id VARCHAR, event_type VARCHAR, value DOUBLE, channel VARCHAR"
    ),
}
SCHEMAS["ord2"] = SCHEMAS["orders"]


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in SCHEMAS[table].split(", ")]


def sid(prefix: str, *parts: str) -> str:
    texts = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"'{prefix}_' || left(sha256(concat_ws('|', {texts})), 32)"


def profile_sql(rel: str, table: str, keys: str, group: str = "", only: tuple[str, ...] = ()) -> str:
    """One SELECT per column, each with the full set of statistics."""
    out = []
    for i, (c, t) in enumerate(columns(table)):
        if only and c not in only:
            continue
        num = t in NUMERIC
        n = "count(*)"

        def stat(expr: str) -> str:
            return f"CAST({expr if num else 'NULL'} AS DOUBLE)"

        out.append(
            f"SELECT {keys}CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", '{t}' AS type, "
            f"{n} AS row_count, {n} - count({c}) AS null_count, "
            f"CASE WHEN {n} > 0 THEN ({n} - count({c})) / {n} ELSE 0.0 END AS null_fraction, "
            f"count(DISTINCT {c}) AS unique_count, "
            f"CASE WHEN {n} > 0 THEN count(DISTINCT {c}) / {n} ELSE 0.0 END AS unique_fraction, "
            f"{stat(f'min({c})')} AS min_num, {stat(f'max({c})')} AS max_num, "
            f"{stat(f'avg(CAST({c} AS DOUBLE))')} AS mean, {stat(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std_dev "
            f"FROM {rel} {group}"
        )
    return "\nUNION ALL ".join(out)


def version_keys(dataset: str, number: str) -> str:
    return f"'{dataset}' AS dataset_id, CAST({number} AS INTEGER) AS version_number, "


def shift_sql(metric: str, change_type: str, positive_only: bool) -> str:
    p, c = f"p_{metric}", f"c_{metric}"
    rel = f"CASE WHEN {p} > 0 THEN ({c} - {p}) / {p}" if positive_only else f"CASE WHEN {p} <> 0 THEN ({c} - {p}) / abs({p})"
    return (
        f"SELECT dataset_id, version_number, \"column\", 'column' AS change_kind, '{metric}' AS metric, "
        f"'{change_type}' AS change_type, NULL AS previous_type, NULL AS current_type, {p} AS previous_num, "
        f"{c} AS current_num, {c} - {p} AS absolute_delta, {rel} ELSE 'Infinity'::DOUBLE END AS relative_delta "
        f"FROM joined WHERE abs({p} - {c}) > 0.0001"
    )


def bound_sql(side: str) -> str:
    p, c = f"p_{side}_num", f"c_{side}_num"
    return (
        f"SELECT dataset_id, version_number, \"column\", 'column', '{side}_value', '{side}_shift', NULL, NULL, {p}, {c}, "
        f"{c} - {p}, CASE WHEN {p} <> 0 THEN ({c} - {p}) / abs({p}) ELSE 'Infinity'::DOUBLE END "
        f"FROM joined WHERE {p} <> {c}"
    )


SIDES = ["type", "row_count", "null_fraction", "unique_fraction", "min_num", "max_num", "mean"]


def joined_sql(rel: str, pairs: str) -> str:
    p = ", ".join(f"p.{s} AS p_{s}" for s in SIDES)
    c = ", ".join(f"c.{s} AS c_{s}" for s in SIDES)
    return (
        f"SELECT coalesce(c.dataset_id, p.dataset_id) AS dataset_id, coalesce(c.version_number, p.version_number) AS version_number, "
        f"coalesce(c.\"column\", p.\"column\") AS \"column\", {p}, {c} "
        f"FROM (SELECT x.* FROM {rel} x WHERE EXISTS (SELECT 1 FROM {pairs} q WHERE q.dataset_id = x.dataset_id AND q.version_number = x.version_number)) c "
        f"FULL JOIN (SELECT x.* REPLACE (x.version_number + 1 AS version_number) FROM {rel} x WHERE EXISTS "
        f"(SELECT 1 FROM {pairs} q WHERE q.dataset_id = x.dataset_id AND q.version_number = x.version_number + 1)) p "
        f"ON p.dataset_id = c.dataset_id AND p.version_number = c.version_number AND p.\"column\" = c.\"column\""
    )


PAIRS = """
SELECT c.dataset_id, c.version_number, c.n AS cur_rows, p.n AS prev_rows
FROM (SELECT dataset_id, version_number, max(row_count) AS n FROM {0} GROUP BY 1, 2) c
JOIN (SELECT dataset_id, version_number, max(row_count) AS n FROM {0} GROUP BY 1, 2) p
  ON p.dataset_id = c.dataset_id AND p.version_number = c.version_number - 1
"""

CHANGE_ID = sid("chg", "dataset_id", "version_number", '"column"', "change_type")

CHANGES = (
    f"SELECT *, {CHANGE_ID} AS change_id FROM (\n"
    + "\nUNION ALL ".join(
        [
            shift_sql("null_fraction", "null_rate_shift", True),
            shift_sql("unique_fraction", "cardinality_shift", True),
            shift_sql("mean", "distribution_shift", False),
            bound_sql("min"),
            bound_sql("max"),
            "SELECT dataset_id, version_number, \"column\", 'schema', NULL, "
            "CASE WHEN p_type IS NULL THEN 'added' WHEN c_type IS NULL THEN 'removed' ELSE 'type_changed' END, "
            "p_type, c_type, NULL, NULL, NULL, NULL FROM joined "
            "WHERE p_type IS NULL OR c_type IS NULL OR p_type <> c_type",
            "SELECT dataset_id, version_number, '*dataset*', 'column', 'row_count', 'row_count_shift', NULL, NULL, "
            "CAST(prev_rows AS DOUBLE), CAST(cur_rows AS DOUBLE), CAST(cur_rows - prev_rows AS DOUBLE), "
            "CASE WHEN prev_rows > 0 THEN (cur_rows - prev_rows) / prev_rows ELSE 'Infinity'::DOUBLE END "
            "FROM pairs WHERE cur_rows <> prev_rows",
        ]
    )
    + "\n)"
)

FINDINGS = f"""
SELECT {sid("fnd", "dataset_id", "version_number", "rule", '"column"')} AS finding_id, * FROM (
SELECT dataset_id, version_number, "column",
  CASE change_type WHEN 'null_rate_shift' THEN 'NullRateShiftRule' WHEN 'cardinality_shift' THEN 'UniquenessDropRule'
    WHEN 'distribution_shift' THEN 'DistributionShiftRule' WHEN 'type_changed' THEN 'SchemaDriftRule'
    WHEN 'removed' THEN 'SchemaDropRule' ELSE 'SchemaAddRule' END AS rule,
  CASE change_type WHEN 'null_rate_shift' THEN 'COMPLETENESS' WHEN 'cardinality_shift' THEN 'UNIQUENESS'
    WHEN 'distribution_shift' THEN 'DISTRIBUTION' ELSE 'SCHEMA' END AS category,
  CASE change_type WHEN 'distribution_shift' THEN 'MEDIUM' WHEN 'type_changed' THEN 'CRITICAL' WHEN 'added' THEN 'LOW'
    ELSE 'HIGH' END AS severity,
  CAST(CASE change_type WHEN 'null_rate_shift' THEN 0.9 WHEN 'cardinality_shift' THEN 0.9
    WHEN 'distribution_shift' THEN 0.8 ELSE 1.0 END AS DOUBLE) AS confidence,
  CAST(CASE change_type WHEN 'distribution_shift' THEN 0.5 WHEN 'type_changed' THEN 0.9 WHEN 'added' THEN 0.2
    ELSE 0.8 END AS DOUBLE) AS impact_score,
  CASE change_type WHEN 'null_rate_shift' THEN 'Spike in null rate on ' || "column"
    WHEN 'cardinality_shift' THEN 'Uniqueness degradation on ' || "column"
    WHEN 'distribution_shift' THEN 'Data drift on ' || "column"
    WHEN 'type_changed' THEN 'Schema drift: ' || "column" || ' type changed'
    WHEN 'removed' THEN 'Schema drift: ' || "column" || ' removed'
    ELSE 'Schema change: ' || "column" || ' added' END AS title,
  CASE change_type
    WHEN 'null_rate_shift' THEN printf('Null rate increased by %.1f%% (now %.1f%%)', absolute_delta * 100, current_num * 100)
    WHEN 'cardinality_shift' THEN printf('Unique fraction dropped by %.1f%% (now %.1f%%)', -absolute_delta * 100, current_num * 100)
    WHEN 'distribution_shift' THEN printf('Mean shifted by %.1f%% (from %.2f to %.2f)', relative_delta * 100, previous_num, current_num)
    WHEN 'type_changed' THEN 'Column ' || "column" || ' type changed from ' || previous_type || ' to ' || current_type
    WHEN 'removed' THEN 'Column ' || "column" || ' was removed'
    ELSE 'New column ' || "column" || ' of type ' || current_type || ' was added' END AS description,
  change_id, change_type, metric, absolute_delta
FROM changes
WHERE (change_type = 'null_rate_shift' AND absolute_delta > 0.05)
   OR (change_type = 'cardinality_shift' AND absolute_delta < -0.05)
   OR (change_type = 'distribution_shift' AND abs(relative_delta) > 0.1)
   OR change_kind = 'schema')
"""

REASON = """CASE
  WHEN c.change_kind = 'schema' AND c."column" = f."column" AND c.change_type = 'type_changed' THEN 'Physical type of column ''' || c."column" || ''' changed.'
  WHEN c.change_kind = 'schema' AND c."column" = f."column" AND c.change_type = 'removed' THEN 'Column ''' || c."column" || ''' was removed.'
  WHEN c.change_kind = 'schema' AND c."column" = f."column" THEN 'Column ''' || c."column" || ''' was recently added.'
  WHEN c.change_kind = 'schema' THEN 'Unrelated schema change on ''' || c."column" || '''.'
  WHEN c."column" = '*dataset*' THEN 'Dataset-level row count shifted, potentially affecting data distribution.'
  WHEN c."column" = f."column" THEN 'Related statistical shift (' || c.change_type || ') on the affected column.'
  ELSE 'Unrelated ' || c.change_type || ' on ''' || c."column" || '''.' END"""
RELEVANCE = """CASE
  WHEN c.change_kind = 'schema' AND c."column" = f."column" AND c.change_type IN ('type_changed', 'removed') THEN 'HIGH'
  WHEN c.change_kind = 'schema' AND c."column" = f."column" THEN 'MEDIUM'
  WHEN c.change_kind = 'schema' THEN 'LOW'
  WHEN c."column" IN ('*dataset*', f."column") THEN 'MEDIUM' ELSE 'LOW' END"""
CONFIDENCE = """CAST(CASE
  WHEN c.change_kind = 'schema' AND c."column" = f."column" AND c.change_type = 'type_changed' THEN 0.85
  WHEN c.change_kind = 'schema' AND c."column" = f."column" AND c.change_type = 'removed' THEN 0.95
  WHEN c.change_kind = 'schema' AND c."column" = f."column" THEN 0.5
  WHEN c.change_kind = 'schema' THEN 0.1
  WHEN c."column" = '*dataset*' THEN 0.5
  WHEN c."column" = f."column" THEN 0.6 ELSE 0.1 END AS DOUBLE)"""

FULL_ATTRIBUTIONS = f"""
SELECT {sid("attr", "f.finding_id", "c.change_id")} AS attribution_id, f.finding_id, f.dataset_id, f.version_number,
  f."column", c.change_id, c.change_kind, c."column" AS change_column, c.change_type,
  {RELEVANCE} AS relevance, {CONFIDENCE} AS confidence, {REASON} AS reason
FROM drift f JOIN changes c ON c.dataset_id = f.dataset_id AND c.version_number = f.version_number
"""

ATTRIBUTIONS = f"""
SELECT *, CASE relevance WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS relevance_score FROM (
SELECT *, CAST(1 AS BIGINT) AS n_changes FROM full_attributions WHERE change_column IN ("column", '*dataset*')
UNION ALL
SELECT {sid("attr", "finding_id", "'unrelated'")}, finding_id, dataset_id, version_number, "column", NULL, NULL, NULL, 'unrelated',
  'LOW', CAST(0.1 AS DOUBLE), CAST(count(*) AS VARCHAR) || ' unrelated changes elsewhere in the dataset.', count(*)
FROM full_attributions WHERE change_column NOT IN ("column", '*dataset*')
GROUP BY finding_id, dataset_id, version_number, "column")
"""

HYPOTHESES = f"""
SELECT {sid("hyp", "attribution_id")} AS hypothesis_id, finding_id, attribution_id, dataset_id, version_number,
  'System generated hypothesis based on historical change: ' || reason AS description, 'PROPOSED' AS status
FROM attributions
"""

VALIDATIONS = f"""
SELECT 'exp_' || h.hypothesis_id AS experiment_id, h.hypothesis_id,
  CASE WHEN p.null_count > 0 THEN 'SUPPORTED' ELSE 'REJECTED' END AS verdict,
  CASE WHEN p.null_count > 0 THEN 'Experiment found ' || p.null_count || ' rows supporting the hypothesis.'
    ELSE 'Experiment executed successfully but returned 0 rows, contradicting the hypothesis.' END AS note,
  {sid("ev", "'exp_' || h.hypothesis_id")} AS evidence_id, 'QUERY' AS type, 'sql_experiment_result' AS metric
FROM attributions a JOIN hypotheses h USING (attribution_id)
JOIN prof p ON p.dataset_id = a.dataset_id AND p.version_number = a.version_number AND p."column" = a.change_column
WHERE a.change_kind = 'column'
"""

CANDIDATES = f"""
SELECT *, {sid("rcc", "finding_id", "hypothesis_id")} AS candidate_id,
  CASE WHEN verdict = 'REJECTED' THEN 'DISQUALIFIED' WHEN round(score, 6) >= 0.8 AND confidence >= 0.8 THEN 'STRONG'
    WHEN round(score, 6) >= 0.4 THEN 'PLAUSIBLE' ELSE 'UNLIKELY' END AS status,
  CAST(row_number() OVER (PARTITION BY finding_id ORDER BY round(score, 6) DESC, confidence DESC, hypothesis_id) AS INTEGER) AS rank
FROM (
SELECT h.finding_id, h.hypothesis_id, h.attribution_id, v.verdict,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(CASE a.relevance WHEN 'HIGH' THEN 0.6 WHEN 'MEDIUM' THEN 0.4 ELSE 0.2 END AS DOUBLE)
    + CAST(CASE v.verdict WHEN 'SUPPORTED' THEN 0.4 WHEN 'REJECTED' THEN -0.8 ELSE 0 END AS DOUBLE))) AS score,
  CASE WHEN v.verdict IS NOT NULL THEN 0.9::DOUBLE ELSE a.confidence END AS confidence,
  CASE WHEN v.verdict = 'SUPPORTED' THEN v.evidence_id END AS supporting_evidence,
  CASE WHEN v.verdict = 'REJECTED' THEN v.evidence_id END AS contradicting_evidence,
  'Based on historical change: ' || a.reason || ' ' || CASE v.verdict WHEN 'SUPPORTED' THEN 'Hypothesis was supported: ' || v.note
    WHEN 'REJECTED' THEN 'Hypothesis was rejected: ' || v.note ELSE 'Hypothesis is proposed but not yet validated.' END AS explanation
FROM hypotheses h JOIN attributions a USING (attribution_id) LEFT JOIN validations v ON v.hypothesis_id = h.hypothesis_id)
"""

INVESTIGATIONS = f"""
SELECT {sid("inv", "dataset_id", "version_number")} AS investigation_id, dataset_id, version_number, 'OPEN' AS status,
  count(*) AS n_findings, 'Automated Investigation: ' || dataset_id || ' v' || version_number AS title,
  'System detected ' || count(*) || ' anomalies in the latest dataset version.' AS description
FROM drift GROUP BY dataset_id, version_number
"""

BEST = """
SELECT f.dataset_id, f.version_number, c.candidate_id, c.explanation, c.status, round(c.score, 6) AS score, c.confidence,
  row_number() OVER (PARTITION BY f.dataset_id, f.version_number ORDER BY round(c.score, 6) DESC, c.confidence DESC, c.candidate_id) AS rn
FROM candidates c JOIN drift f USING (finding_id) WHERE c.rank = 1 AND c.status IN ('STRONG', 'PLAUSIBLE')
"""

PHYSICAL = """CASE WHEN type IN ('BIGINT', 'INTEGER', 'TINYINT', 'SMALLINT') THEN 'INTEGER'
  WHEN type IN ('DOUBLE', 'FLOAT', 'DECIMAL') THEN 'DOUBLE' WHEN type = 'VARCHAR' THEN 'STRING'
  WHEN type = 'BOOLEAN' THEN 'BOOLEAN' WHEN type LIKE '%DATE%' OR type LIKE '%TIME%' THEN 'DATETIME' ELSE 'UNKNOWN' END"""

ROLES = f"""
SELECT *, CASE
  WHEN physical_type = 'DATETIME' OR lower("column") LIKE '%\\_at' ESCAPE '\\' OR lower("column") LIKE '%\\_date' ESCAPE '\\' THEN 'DATETIME'
  WHEN lower("column") = 'id' OR lower("column") LIKE '%\\_id' ESCAPE '\\' THEN 'IDENTIFIER'
  WHEN row_count > 0 AND unique_count / row_count > 0.95 AND physical_type IN ('INTEGER', 'STRING') AND null_fraction < 0.05 THEN 'IDENTIFIER'
  WHEN physical_type = 'BOOLEAN' OR starts_with(lower("column"), 'is_') OR starts_with(lower("column"), 'has_') THEN 'BOOLEAN'
  WHEN physical_type = 'DOUBLE' THEN 'MEASURE'
  WHEN physical_type = 'INTEGER' AND row_count > 100 AND unique_count < 10 THEN 'CATEGORY'
  WHEN physical_type = 'INTEGER' THEN 'MEASURE'
  WHEN physical_type = 'STRING' AND row_count > 0 AND (unique_count / row_count < 0.05 OR unique_count < 100) THEN 'CATEGORY'
  WHEN physical_type = 'STRING' THEN 'TEXT' ELSE 'UNKNOWN' END AS semantic_role,
  CASE WHEN regexp_matches(lower("column"), 'email|ssn|phone|address|credit_card|password|first_name|last_name') THEN 'PII' ELSE 'NON_PII' END AS sensitivity
FROM (SELECT *, {PHYSICAL} AS physical_type FROM targets)
"""

RESULTS = """
SELECT dataset_id, 'NotNullRule' AS rule, "column", row_count, null_count AS violations FROM targets
UNION ALL SELECT dataset_id, 'UniqueRule', "column", row_count, row_count - unique_count FROM targets
"""

APPLICABLE = """
SELECT dataset_id, "column", semantic_role, rule,
  CASE rule WHEN 'UniqueRule' THEN semantic_role = 'IDENTIFIER' ELSE semantic_role IN ('IDENTIFIER', 'MEASURE', 'CATEGORY', 'DATETIME') END AS applicable,
  CAST(CASE WHEN rule = 'UniqueRule' THEN CASE WHEN semantic_role = 'IDENTIFIER' THEN 0.98 WHEN semantic_role IN ('MEASURE', 'CATEGORY') THEN 0.99 ELSE 0.80 END
    ELSE CASE WHEN semantic_role = 'IDENTIFIER' THEN 0.95 WHEN semantic_role = 'TEXT' THEN 0.90 ELSE 0.50 END END AS DOUBLE) AS confidence,
  CASE WHEN rule = 'UniqueRule' THEN CASE WHEN semantic_role IN ('IDENTIFIER', 'MEASURE', 'CATEGORY') THEN 'Column is classified as ' || semantic_role
      ELSE 'Uniqueness generally not expected for ' || semantic_role END
    ELSE CASE WHEN semantic_role = 'IDENTIFIER' THEN 'Identifiers usually should not be null' WHEN semantic_role = 'TEXT' THEN 'Free text columns often contain nulls'
      WHEN semantic_role IN ('MEASURE', 'CATEGORY', 'DATETIME') THEN semantic_role || ' applicability depends on domain' ELSE 'Unknown applicability' END END AS reason
FROM roles CROSS JOIN (VALUES ('NotNullRule'), ('UniqueRule')) r(rule)
"""

IMPACTS = """
SELECT *, CAST(printf('%.4f', score) AS DOUBLE) AS impact_score,
  CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'INFO' END AS severity
FROM (SELECT *, CASE WHEN rule = 'UniqueRule' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
  * greatest(0.65::DOUBLE, least(1.0::DOUBLE, affected_fraction))
  * CAST(CASE semantic_role WHEN 'IDENTIFIER' THEN 1.0 WHEN 'DATETIME' THEN 0.8 WHEN 'MEASURE' THEN 0.7 WHEN 'CATEGORY' THEN 0.5
      WHEN 'BOOLEAN' THEN 0.5 WHEN 'TEXT' THEN 0.3 ELSE 0.1 END AS DOUBLE)
  * confidence AS score
FROM (SELECT r.dataset_id, r.rule, r."column", r.row_count, r.violations, a.semantic_role, a.applicable, a.confidence, a.reason,
    CASE WHEN r.row_count > 0 THEN r.violations / r.row_count ELSE 0.0 END AS affected_fraction
  FROM results r JOIN applicable a ON a.dataset_id = r.dataset_id AND a."column" = r."column" AND a.rule = r.rule))
"""

QUALITY = f"""
SELECT dataset_id, {sid("fnd", "dataset_id", "rule", '"column"')} AS finding_id, "column", rule,
  CASE rule WHEN 'UniqueRule' THEN 'UNIQUENESS' ELSE 'COMPLETENESS' END AS category, severity, confidence, impact_score,
  affected_fraction, violations,
  'Column ''' || "column" || ''' failed ' || CASE rule WHEN 'UniqueRule' THEN 'Unique' ELSE 'NotNull' END || ' rule' AS title,
  'Found ' || violations || CASE rule WHEN 'UniqueRule' THEN ' duplicate records/groups' ELSE ' null values' END || '. Context: ' || reason AS description,
  CASE rule WHEN 'UniqueRule' THEN 'SELECT COUNT(*) as total, COUNT(DISTINCT ' || "column" || ') as unique_count FROM dataset'
    ELSE 'SELECT COUNT(*) FROM dataset WHERE ' || "column" || ' IS NULL' END AS "check"
FROM impacts WHERE applicable AND violations > 0
"""

# Common tables: name -> (tables it needs, body).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev2": (
        (),
        "SELECT event_id - event_id % 2 AS event_id, ts, CAST(user_id AS VARCHAR) AS user_id, "
        "CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, "
        "CASE WHEN event_id % 10 <> 0 THEN value * 2 END AS value, 'web' AS channel FROM events",
    ),
    "ord2": ((), "SELECT * REPLACE (o_orderkey - o_orderkey % 2 AS o_orderkey) FROM orders WHERE o_orderkey % 9 <> 0"),
    "prof": (
        ("ev2", "ord2"),
        "\nUNION ALL ".join(
            [
                profile_sql("events", "events", version_keys("events", "1")),
                profile_sql("ev2", "ev2", version_keys("events", "2")),
                profile_sql("orders", "orders", version_keys("orders", "1")),
                profile_sql("ord2", "ord2", version_keys("orders", "2")),
            ]
        ),
    ),
    "pairs": (("prof",), PAIRS.format("prof")),
    "joined": (("prof", "pairs"), joined_sql("prof", "pairs")),
    "changes": (("joined", "pairs"), CHANGES),
    "drift": (("changes",), FINDINGS),
    "investigations": (("drift",), INVESTIGATIONS),
    "full_attributions": (("drift", "changes"), FULL_ATTRIBUTIONS),
    "attributions": (("full_attributions",), ATTRIBUTIONS),
    "hypotheses": (("attributions",), HYPOTHESES),
    "validations": (("attributions", "hypotheses", "prof"), VALIDATIONS),
    "candidates": (("hypotheses", "attributions", "validations"), CANDIDATES),
    "best": (("candidates", "drift"), BEST),
    "targets": (
        ("ev2",),
        "\nUNION ALL ".join(
            [
                profile_sql("customer", "customer", "'customer' AS dataset_id, "),
                profile_sql("documents", "documents", "'documents' AS dataset_id, "),
                profile_sql("ev2", "ev2", "'events' AS dataset_id, "),
                profile_sql("part", "part", "'part' AS dataset_id, "),
            ]
        ),
    ),
    "roles": (("targets",), ROLES),
    "results": (("targets",), RESULTS),
    "applicable": (("roles",), APPLICABLE),
    "impacts": (("results", "applicable"), IMPACTS),
    "quality": (("impacts",), QUALITY),
    "daily": (
        (),
        profile_sql(
            "events", "events", version_keys("events", "dayofmonth(ts)"), "GROUP BY dayofmonth(ts)",
        ),
    ),
    "daily_pairs": (("daily",), PAIRS.format("daily")),
    "daily_joined": (("daily", "daily_pairs"), joined_sql("daily", "daily_pairs")),
    "weekly": (
        (),
        profile_sql(
            "events", "events", version_keys("events", "1 + floor((dayofmonth(ts) - 1) / 7)"),
            "GROUP BY floor((dayofmonth(ts) - 1) / 7)",
        ),
    ),
    "weekly_pairs": (("weekly",), PAIRS.format("weekly")),
    "weekly_joined": (("weekly", "weekly_pairs"), joined_sql("weekly", "weekly_pairs")),
    "datasets": (
        (),
        "SELECT n_nationkey AS dataset_id, n_name AS name, 'ws_' || n_regionkey AS workspace_id FROM nation",
    ),
    "versions": (
        (),
        "SELECT c_custkey AS version_id, c_nationkey AS dataset_id, c_custkey + 1 AS version_number, "
        "c_mktsegment || '-' || CAST(floor(c_acctbal / 1000) AS BIGINT) AS file_hash FROM customer",
    ),
    "arrivals": (
        (),
        "SELECT s_suppkey AS arrival, s_nationkey AS dataset_id, "
        "'HOUSEHOLD-' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS file_hash FROM supplier",
    ),
    "incidents": (
        (),
        "SELECT o_orderkey AS investigation_id, o_custkey AS version_id, CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' "
        "WHEN 'O' THEN 'OPEN' ELSE 'INVESTIGATING' END AS status, o_orderdate AS created_at, "
        "'Incident ' || o_orderkey AS title, 'Priority ' || o_orderpriority AS description FROM orders",
    ),
    "issue": (
        (),
        "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS finding_id, l_orderkey AS investigation_id, "
        "CASE WHEN l_quantity >= 46 THEN 'CRITICAL' WHEN l_quantity >= 31 THEN 'HIGH' WHEN l_quantity >= 16 THEN 'MEDIUM' "
        "WHEN l_quantity >= 6 THEN 'LOW' ELSE 'INFO' END AS severity, "
        "CASE l_linenumber WHEN 1 THEN 'null_fraction' WHEN 2 THEN 'unique_fraction' WHEN 3 THEN 'mean' WHEN 4 THEN 'row_count' "
        "WHEN 5 THEN 'min_value' WHEN 6 THEN 'max_value' ELSE 'type' END AS metric, 'col_' || (l_partkey % 20) AS \"column\", "
        "CASE l_returnflag WHEN 'A' THEN 'SUPPORTED' WHEN 'R' THEN 'REJECTED' ELSE 'PROPOSED' END AS hypothesis_status FROM lineitem",
    ),
    "runs": (
        (),
        "SELECT o_orderkey AS experiment_id, o_custkey AS hypothesis_id, o_orderdate AS completed_at, "
        "CAST(floor(o_totalprice / 100000) AS BIGINT) AS row_count, "
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'TABLE_OR_VIEW_NOT_FOUND' END AS error_message FROM orders",
    ),
    "answers": (
        (),
        "SELECT conv_id || '-' || turn AS response_id, lower(text || ' ' || CASE conv_id % 6 "
        "WHEN 0 THEN 'The column ''conv_id'' shows metric ''null_fraction''.' "
        "WHEN 1 THEN 'The column ''ghost_' || turn || ''' drifted.' WHEN 2 THEN 'Look at metric ''vibes'' first.' "
        "WHEN 3 THEN 'This is a STRONG root cause.' WHEN 4 THEN 'The hypothesis is confirmed.' ELSE 'The column ''conv_id'' is fine.' END) AS full_text, "
        "CASE conv_id % 5 WHEN 0 THEN 'DROP TABLE dataset; delete from dataset' WHEN 1 THEN 'SELECT drop_count FROM dataset' "
        "ELSE 'SELECT count(*) FROM dataset WHERE turn = ' || turn END AS query, conv_id, turn, "
        "conv_id % 2 = 0 AS has_strong, turn > 2 AS has_supported FROM conversations WHERE role = 'assistant'",
    ),
}
