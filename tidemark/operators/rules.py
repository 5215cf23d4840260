"""Quality rules and the findings they raise.

A rule is an aggregate that counts violating rows, so all rules of a table share one scan.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.shared import settle
from ..functions.text import case_sql, fixed_sql, percent_sql, stable_id, value_sql
from .profile import distinct_counts, profile
from .recommend import ACTIONS
from .semantics import classify, near_threshold

# Weight of each role and criticality of each rule.
ROLE_WEIGHT = {
    "IDENTIFIER": 1.00,
    "DATETIME": 0.80,
    "MEASURE": 0.70,
    "CATEGORY": 0.50,
    "BOOLEAN": 0.50,
    "TEXT": 0.30,
    "UNKNOWN": 0.10,
}
RULE_CRITICALITY = {"UniqueRule": 1.00, "NotNullRule": 0.70}
IMPACT_FLOOR = 0.65
SEVERITY_CUTS = [(0.80, "CRITICAL"), (0.60, "HIGH"), (0.40, "MEDIUM"), (0.20, "LOW")]

# Fixed values: (rule, role) -> (applicable, confidence); the None row holds for every other role.
APPLICABILITY = {
    ("UniqueRule", "IDENTIFIER"): (True, 0.98),
    ("UniqueRule", "MEASURE"): (False, 0.99),
    ("UniqueRule", "CATEGORY"): (False, 0.99),
    ("UniqueRule", None): (False, 0.80),
    ("NotNullRule", "IDENTIFIER"): (True, 0.95),
    ("NotNullRule", "TEXT"): (False, 0.90),
    ("NotNullRule", "MEASURE"): (True, 0.50),
    ("NotNullRule", "CATEGORY"): (True, 0.50),
    ("NotNullRule", "DATETIME"): (True, 0.50),
    ("NotNullRule", None): (False, 0.50),
}
# A rule with no rows above was asked for by name, so it always applies.
CATEGORY_OF_RULE = {
    "UniqueRule": "UNIQUENESS",
    "NotNullRule": "COMPLETENESS",
    "RangeRule": "VALIDITY",
    "RegexRule": "VALIDITY",
    "SetMembershipRule": "VALIDITY",
    "TypeRule": "VALIDITY",
    "SchemaRule": "SCHEMA",
    "FreshnessRule": "FRESHNESS",
    "DistributionRule": "DISTRIBUTION",
    "ReferentialRule": "REFERENTIAL_INTEGRITY",
}


@dataclass(frozen=True)
class Rule:
    """A named check of one column. ``violations`` counts the violating rows of a group.

    ``fits`` says whether a column of some type can be checked at all; if not, the result is unknown.
    """

    rule: str
    column: str
    violations: Column | None
    check: str
    parameters: dict = field(default_factory=dict)
    fits: Callable[[T.DataType], bool] = lambda dtype: True


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _comparable(dtype: T.DataType, values: Sequence) -> bool:
    """Whether all values can be compared with a column without a cast that may fail on some row."""
    def one(v) -> bool:
        if isinstance(v, bool) or isinstance(dtype, T.BooleanType):
            return isinstance(v, bool) and isinstance(dtype, T.BooleanType)
        if isinstance(dtype, T.NumericType):
            return isinstance(v, (int, float)) or type(v).__name__ == "Decimal"
        if isinstance(dtype, _TIMES):
            if isinstance(v, str):
                try:
                    datetime.datetime.fromisoformat(v)
                except ValueError:
                    return False
            return isinstance(v, (str, datetime.date))
        return isinstance(dtype, T.StringType) and isinstance(v, str)

    return all(one(v) for v in values if v is not None)


def _parameters(rule: Rule) -> str:
    return json.dumps(rule.parameters, default=str, ensure_ascii=False, sort_keys=True)


def not_null(column: str) -> Rule:
    check = f"SELECT COUNT(*) FROM dataset WHERE {column} IS NULL"
    return Rule("NotNullRule", column, F.count_if(_c(column).isNull()), check)


def unique(column: str) -> Rule:
    """Rows minus distinct values; each null row counts as a duplicate. Counted apart from the other rules."""
    check = f"SELECT COUNT(*) as total, COUNT(DISTINCT {column}) as unique_count FROM dataset"
    return Rule("UniqueRule", column, None, check)


def in_range(column: str, low=None, high=None) -> Rule:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (_c(column) < low)
    if high is not None:
        bad = bad | (_c(column) > high)
    check = f"{column} BETWEEN {low} AND {high}"
    return Rule("RangeRule", column, F.count_if(bad), check, {"low": low, "high": high}, lambda t: _comparable(t, [low, high]))


def matches(column: str, pattern: str) -> Rule:
    check = f"{column} RLIKE '{pattern}'"
    return Rule("RegexRule", column, F.count_if(~_c(column).rlike(pattern)), check, {"pattern": pattern}, lambda t: isinstance(t, T.StringType))


def member_of(column: str, values: Sequence) -> Rule:
    check = f"{column} IN {tuple(values)}"
    bad = F.count_if(~_c(column).isin(list(values)))
    return Rule("SetMembershipRule", column, bad, check, {"values": list(values)}, lambda t: _comparable(t, list(values)))


def castable(column: str, dtype: str) -> Rule:
    check, parameters = f"TRY_CAST({column} AS {dtype})", {"type": dtype}
    try:
        bad = _c(column).isNotNull() & _c(column).try_cast(dtype).isNull()
    except ParseException:  # no type of that name
        return Rule("TypeRule", column, F.lit(0), check, parameters, lambda t: False)
    return Rule("TypeRule", column, F.count_if(bad), check, parameters)


def fresh(column: str, now: Column, max_age_hours: float) -> Rule:
    """One violation if the newest value is older than ``max_age_hours`` at ``now``, or if there is none."""
    newest = F.max(_c(column)).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", newest, now.cast("timestamp_ntz")) / 3600.0
    stale = F.when(age.isNull() | (age > max_age_hours), 1).otherwise(0)
    check = f"MAX({column}) within {max_age_hours} h"
    return Rule("FreshnessRule", column, stale, check, {"max_age_hours": max_age_hours}, lambda t: isinstance(t, _TIMES))


def standard_rules(columns: Sequence[str]) -> list[Rule]:
    return [r for c in columns for r in (not_null(c), unique(c))]


def evaluate(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """(rule, column, check, parameters, row_count, violations, status) of each rule, per group of ``by``.

    A rule that cannot be evaluated has status unknown and leaves the others alone: its column is absent or of a type
    that it does not fit, or its pattern or type name is none.
    """
    keys = [_c(k) for k in by]
    usable = [_usable(df, r) for r in rules]
    known = [r for r, ok in zip(rules, usable, strict=True) if ok]
    plain = [r for r in known if r.violations is not None]
    uniques = [r for r in known if r.violations is None]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [r.violations.cast("bigint").alias(f"_v{i}") for i, r in enumerate(plain)]
    counted = df.groupBy(*keys).agg(*aggs)

    def entry(r: Rule, v: Column, row_count: Column = F.col("_rows")) -> Column:
        return F.struct(
            F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.check).alias("check"),
            F.lit(_parameters(r)).alias("parameters"), row_count.alias("row_count"), v.cast("bigint").alias("violations"),
        )

    entries = [entry(r, F.col(f"_v{i}")) for i, r in enumerate(plain)]
    entries += [entry(r, F.lit(None)) for r, ok in zip(rules, usable, strict=True) if not ok]
    out = []
    if entries:
        out.append(counted.select(*keys, F.explode(F.array(*entries)).alias("_r")).select(*keys, "_r.*"))
    if uniques:
        out.append(_unique_results(df, by, uniques))
    results = out[0]
    for o in out[1:]:
        results = results.unionByName(o)
    return results.withColumn("status", status(F.col("violations")))


def _usable(df: DataFrame, rule: Rule) -> bool:
    if rule.column not in df.columns or not rule.fits(df.schema[rule.column].dataType):
        return False
    try:
        if "pattern" in rule.parameters:
            df.sparkSession._jvm.java.util.regex.Pattern.compile(rule.parameters["pattern"])
        if rule.violations is not None:
            df.agg(rule.violations)  # analysis only
    except (AnalysisException, IllegalArgumentException):
        return False
    return True


def _unique_results(df: DataFrame, by: Sequence[str], uniques: Sequence[Rule]) -> DataFrame:
    keys = [_c(k) for k in by]
    names = list(dict.fromkeys(r.column for r in uniques))
    counts = distinct_counts(df, by, names).withColumnRenamed("unique_count", "_u")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    checks = F.explode(
        F.array(*[F.struct(F.lit(r.column).alias("column"), F.lit(r.check).alias("check")) for r in uniques])
    )
    wanted = totals.select(*keys, "row_count", checks.alias("_r")).select(*keys, "row_count", "_r.*")
    on = F.col("w.column") == F.col("d.column")
    for k in by:
        on = on & F.col(f"w.`{k}`").eqNullSafe(F.col(f"d.`{k}`"))
    return wanted.alias("w").join(counts.alias("d"), on, "left").select(
        *[F.col(f"w.`{k}`") for k in by],
        F.lit("UniqueRule").alias("rule"), F.col("w.column"), F.col("w.check"), F.lit("{}").alias("parameters"), F.col("w.row_count"),
        (F.col("w.row_count") - F.coalesce(F.col("d._u"), F.lit(0))).cast("bigint").alias("violations"),
    )


def status(violations: Column) -> Column:
    return F.when(violations.isNull(), "unknown").when(violations == 0, "passed").otherwise("failed")


def results_from_profile(p: DataFrame) -> DataFrame:
    """Results of NotNull and Unique on every column, read off a profile with exact distinct counts.

    No further scan of the data is needed: the profile already holds both counts.
    """
    keys = [c for c in ("dataset_id", "version_number") if c in p.columns]
    entries = """explode(array(
      named_struct('rule', 'NotNullRule', 'check', 'SELECT COUNT(*) FROM dataset WHERE ' || column || ' IS NULL',
        'violations', null_count),
      named_struct('rule', 'UniqueRule',
        'check', 'SELECT COUNT(*) as total, COUNT(DISTINCT ' || column || ') as unique_count FROM dataset',
        'violations', row_count - unique_count))) AS _r"""
    rows = p.selectExpr(*keys, "column", "row_count", entries)
    return rows.select(*keys, "_r.rule", "column", "_r.check", F.lit("{}").alias("parameters"), "row_count", "_r.violations").withColumn(
        "status", status(F.col("violations"))
    )


def _applicability_sql(part: int, fallback) -> str:
    arms = []
    for (rule, role), value in APPLICABILITY.items():
        cond = f"rule = '{rule}'" + (f" AND semantic_role = '{role}'" if role else "")
        arms.append(f"WHEN {cond} THEN {value_sql(value[part])}")
    return f"CASE {' '.join(arms)} ELSE {value_sql(fallback)} END"


REASON = """CASE
  WHEN rule = 'UniqueRule' AND semantic_role IN ('IDENTIFIER', 'MEASURE', 'CATEGORY') THEN 'Column is classified as ' || semantic_role
  WHEN rule = 'UniqueRule' THEN 'Uniqueness generally not expected for ' || semantic_role
  WHEN rule <> 'NotNullRule' THEN 'Rule was requested for this column'
  WHEN semantic_role = 'IDENTIFIER' THEN 'Identifiers usually should not be null'
  WHEN semantic_role = 'TEXT' THEN 'Free text columns often contain nulls'
  WHEN semantic_role IN ('MEASURE', 'CATEGORY', 'DATETIME') THEN semantic_role || ' applicability depends on domain'
  ELSE 'Unknown applicability' END"""


def with_applicability(rows: DataFrame) -> DataFrame:
    """Add applicable, confidence and reason to rows holding rule and semantic_role."""
    return rows.selectExpr(
        "*", f"{_applicability_sql(0, True)} AS applicable", f"{_applicability_sql(1, 0.9)} AS confidence",
        f"{REASON} AS reason",
    )


def applicability(semantics: DataFrame) -> DataFrame:
    """Whether the two standard rules apply to each classified column."""
    keys = [c for c in ("dataset_id", "version_number") if c in semantics.columns]
    both = F.explode(F.array(F.lit("NotNullRule"), F.lit("UniqueRule"))).alias("rule")
    return with_applicability(semantics.select(*keys, "column", "semantic_role", both))


def with_impact(rows: DataFrame) -> DataFrame:
    """Add affected_fraction, impact_score and severity to rows with rule, role, counts and confidence."""
    affected = "CASE WHEN row_count > 0 THEN violations / row_count ELSE 0.0D END AS affected_fraction"
    score = (
        f"{case_sql('rule', RULE_CRITICALITY, 0.5)} * greatest({IMPACT_FLOOR}D, least(1.0D, affected_fraction)) "
        f"* coalesce({case_sql('semantic_role', ROLE_WEIGHT)}, 0.1D) * greatest(0.0D, least(1.0D, confidence))"
    )
    cuts = " ".join(f"WHEN _score >= {cut}D THEN '{name}'" for cut, name in SEVERITY_CUTS)
    return (
        rows.selectExpr("*", affected)
        .selectExpr("*", f"{score} AS _score")
        .selectExpr("*", f"CAST({fixed_sql('_score', 4)} AS DOUBLE) AS impact_score", f"CASE {cuts} ELSE 'INFO' END AS severity")
        .drop("_score")
    )


def findings(results: DataFrame, semantics: DataFrame) -> DataFrame:
    """Failed, applicable results of any rule as findings, scored by impact.

    A result about something that was not classified, such as a missing column, has the role UNKNOWN.
    """
    keys = [c for c in ("dataset_id", "version_number") if c in results.columns and c in semantics.columns]
    roles = semantics.select(*keys, "column", "semantic_role")
    failed = results.filter(F.col("status") == "failed").join(roles, [*keys, "column"], "left").fillna("UNKNOWN", ["semantic_role"])
    scored = with_impact(with_applicability(failed).filter("applicable"))
    ident = stable_id("fnd", *keys, "rule", "column").alias("finding_id")
    return scored.select(ident, "*").selectExpr(
        *keys,
        "finding_id",
        "column",
        "rule",
        f"{case_sql('rule', CATEGORY_OF_RULE, 'UNKNOWN')} AS category",
        "severity",
        "confidence",
        "impact_score",
        "affected_fraction",
        "violations",
        "'Column \\'' || column || '\\' failed ' || regexp_replace(rule, 'Rule$', '') || ' rule' AS title",
        """'Found ' || violations || CASE rule WHEN 'NotNullRule' THEN ' null values'
             WHEN 'UniqueRule' THEN ' duplicate records/groups' ELSE ' violating values' END
           || '. Context: ' || reason AS description""",
        "check",
        "parameters",
    )


def quality_findings(df: DataFrame, extra: Sequence[Rule] = ()) -> DataFrame:
    """Findings of a table by NotNull and Unique on every column they apply to, and by any extra rules.

    One approximate profile gives the exact null counts, and roles where the counts are far from a threshold. Columns
    near one are counted exactly before they are classified, and so are the identifiers for Unique, which applies
    to no other role; only those columns are read again.
    """
    p = settle(profile(df))
    doubtful = [r[0] for r in classify(p).filter(near_threshold()).select("column").collect()]  # at most all columns
    if doubtful:
        exact = distinct_counts(df, [], doubtful).withColumnRenamed("unique_count", "_exact")
        share = "CASE WHEN row_count > 0 THEN _exact / row_count ELSE 0.0D END"
        p = settle(p.join(exact, "column", "left").withColumns({
            "unique_fraction": F.expr(f"CASE WHEN _exact IS NULL THEN unique_fraction ELSE {share} END"),
            "unique_exact": F.expr("unique_exact OR _exact IS NOT NULL"),
            "unique_count": F.expr("coalesce(_exact, unique_count)"),
        }).drop("_exact"))
    semantics = classify(p)
    ids = semantics.filter("semantic_role = 'IDENTIFIER'").select("column").collect()
    results = results_from_profile(p).filter("rule = 'NotNullRule'")
    checks = [unique(r[0]) for r in ids] + list(extra)
    if checks:
        results = results.unionByName(evaluate(df, checks))
    return findings(results, semantics)


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("impact_score"), "column", "rule")


def observations(found: DataFrame) -> DataFrame:
    """The measured fact behind each finding."""
    return found.select(stable_id("obs", "finding_id").alias("observation_id"), "*").selectExpr(
        "observation_id", "finding_id", "lower(regexp_replace(rule, 'Rule$', '')) || '_violation' AS metric",
        "violations AS value", "column",
    )


def finding_evidence(found: DataFrame) -> DataFrame:
    """Two evidence rows per finding: the count, and the text of the check."""
    rows = """explode(array(
      named_struct('type', 'METRIC', 'metric', 'violation_count', 'value', CAST(violations AS STRING),
        'description', 'Observed ' || violations || ' violations'),
      named_struct('type', 'QUERY', 'metric', 'evaluation_query', 'value', check,
        'description', 'SQL query used to detect the violation'))) AS _e"""
    out = found.selectExpr("finding_id", "rule AS source", rows)
    return out.select(stable_id("ev", "finding_id", "_e.metric").alias("evidence_id"), "finding_id", "source", "_e.*")


# Mark of each severity in the text report.
SEVERITY_ICONS = {"CRITICAL": "!", "HIGH": "X", "MEDIUM": "-", "LOW": ".", "INFO": "i"}


def findings_report(found: DataFrame, explain: bool = True) -> DataFrame:
    """The text report as ordered lines: (finding_id, impact_score, place, line), without the blank lines.

    ``explain`` adds the explanation and the SQL of query evidence. Everything follows from the finding's own row.
    """
    lines = [
        f"'[' || {case_sql('severity', SEVERITY_ICONS, ' ')} || '] ' || severity",
        "title",
        f"'Affected: ' || {percent_sql('affected_fraction')}",
        f"'Confidence: ' || {percent_sql('confidence', 0)}",
        *(["'Explanation:'", "'  ' || description"] if explain else []),
        "'Evidence:'",
        "'  - [METRIC] Observed ' || violations || ' violations'",
        "'  - [QUERY] SQL query used to detect the violation'",
        *(["'    SQL: ' || check"] if explain else []),
    ]
    actions = [f"CASE WHEN category = {value_sql(c)} THEN {value_sql(f'  {place[1:]}. [{kind}] {why}')} END" for c, place, kind, _, why in ACTIONS]
    with_actions = " OR ".join(f"category = {value_sql(c)}" for c in dict.fromkeys(a[0] for a in ACTIONS))
    lines += [f"CASE WHEN {with_actions} THEN 'Suggested next steps:' END", *actions]
    all_lines = F.array_compact(F.expr(f"array({', '.join(lines)})"))
    return found.select("finding_id", "impact_score", F.posexplode(all_lines).alias("place", "line"))


def export_rules(found: DataFrame) -> DataFrame:
    """Accepted findings as reusable rules, one JSON text per (rule, column, parameters). Without a dataset_id the
    findings are of one table."""
    if "dataset_id" not in found.columns:
        found = found.withColumn("dataset_id", F.lit("dataset"))
    kept = found.groupBy("dataset_id", "rule", "column", "parameters").agg(F.max("confidence").alias("confidence"))
    plain = F.to_json(F.struct("rule", "column", "confidence"))
    full = F.concat(F.expr("left({0}, length({0}) - 1)".format("_j")), F.lit(', "parameters": '), "parameters", F.lit("}"))
    body = F.when(F.col("parameters") == "{}", F.col("_j")).otherwise(full)
    return kept.withColumn("_j", plain).select("dataset_id", "rule", "column", body.alias("rule_json"))


def rules_from_json(texts: Sequence[str], now: Column | None = None) -> list[Rule]:
    """Rules from exported JSON texts, with the parameters they had. ``now`` is the time of freshness rules.

    Rules that compare with another table cannot come back from a text alone; they raise ValueError.
    """
    makers = {
        "NotNullRule": lambda c: not_null(c),
        "UniqueRule": lambda c: unique(c),
        "RangeRule": lambda c, low, high: in_range(c, low, high),
        "RegexRule": lambda c, pattern: matches(c, pattern),
        "SetMembershipRule": lambda c, values: member_of(c, values),
        "TypeRule": lambda c, type: castable(c, type),
        "FreshnessRule": lambda c, max_age_hours: fresh(c, now if now is not None else F.current_timestamp(), max_age_hours),
    }
    out = []
    for r in map(json.loads, texts):
        if r["rule"] not in makers:
            raise ValueError(f"{r['rule']} on {r['column']} needs its other table and cannot be made from JSON")
        out.append(makers[r["rule"]](r["column"], **r.get("parameters", {})))
    return out


def _one_result(rows: DataFrame, rule: str, column: str, check: str, parameters: dict) -> DataFrame:
    """Counts (row_count, violations) as a rule result of the common shape."""
    return rows.select(
        F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.lit(check).alias("check"),
        F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), "row_count", "violations",
    ).withColumn("status", status(F.col("violations")))


def referential(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows of ``child`` whose non-null key has no parent, counted as one rule result."""
    check = f"{name} REFERENCES {parent_key}"
    return _one_result(_unmatched(child, key, parent, parent_key), "ReferentialRule", name, check, {"parent_key": parent_key})


def member_of_table(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    """SetMembershipRule against a table of values, for sets too large to be named in a query."""
    check = f"{column} IN (SELECT {allowed_column})"
    return _one_result(_unmatched(df, column, allowed, allowed_column), "SetMembershipRule", column, check, {"allowed": allowed_column})


def _unmatched(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows, and rows whose non-null key the parent lacks.

    Keys are counted before the join, so a frequent key crosses the shuffle as one row per task.
    """
    keys = child.groupBy(_c(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    parents = parent.select(_c(parent_key).alias("_p")).filter("_p is not null").distinct()
    joined = keys.join(parents, F.col("_k") == F.col("_p"), "left")
    orphan = F.col("_k").isNotNull() & F.col("_p").isNull()
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).cast("bigint").alias("violations"),
    )


def schema_rule(p: DataFrame, expected: DataFrame) -> DataFrame:
    """Columns that are missing, unexpected or of another type than ``expected`` (column, type)."""
    e = expected.select(F.col("column").alias("_ec"), F.col("type").alias("_et"))
    joined = p.select("column", "type").join(e, F.col("column") == F.col("_ec"), "full")
    problem = (
        F.when(F.col("column").isNull(), "missing")
        .when(F.col("_ec").isNull(), "unexpected")
        .when(F.col("type") != F.col("_et"), "type")
    )
    return joined.select(
        F.coalesce("column", "_ec").alias("column"), problem.alias("problem"),
        F.col("_et").alias("expected_type"), F.col("type").alias("actual_type"),
    ).filter(F.col("problem").isNotNull())


def schema_results(p: DataFrame, expected: DataFrame) -> DataFrame:
    """Each problem of ``schema_rule`` as a failed result; one passed result if there is none."""
    rows = p.agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"))
    problems = schema_rule(p, expected).select(
        "column", F.concat_ws(" ", F.lit("schema:"), "problem", F.concat(F.lit("expected "), "expected_type"), F.concat(F.lit("found "), "actual_type")).alias("check"),
        F.to_json(F.struct("problem", "expected_type", "actual_type")).alias("parameters"), F.lit(1).cast("bigint").alias("violations"),
    )
    none = problems.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(
        F.lit("*dataset*").alias("column"), F.lit("schema:").alias("check"), F.lit("{}").alias("parameters"), F.lit(0).cast("bigint").alias("violations")
    )
    out = problems.unionByName(none).withColumn("row_count", rows.scalar())
    return out.select(F.lit("SchemaRule").alias("rule"), "column", "check", "parameters", "row_count", "violations").withColumn(
        "status", status(F.col("violations"))
    )


def distribution_results(outliers: DataFrame, metric: str, z_limit: float) -> DataFrame:
    """Rows of ``diff.history_outliers`` as rule results by version; unknown where the history is too short."""
    violations = F.when(F.col("status") != "unknown", (F.col("status") == "failed").cast("bigint"))
    return outliers.select(
        "dataset_id", "version_number", F.lit("DistributionRule").alias("rule"), "column",
        F.lit(f"{metric} within {z_limit} standard deviations of its history").alias("check"),
        F.lit(json.dumps({"metric": metric, "z_limit": z_limit}, sort_keys=True)).alias("parameters"),
        F.lit(1).cast("bigint").alias("row_count"), violations.alias("violations"),
    ).withColumn("status", status(F.col("violations")))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts."""
    return df.groupBy(*[_c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def duplicate_share(df: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    """Per batch: rows, rows whose key occurs more than once in the table, and their share.

    The join is on (key), whose repeats were first counted per batch.
    """
    per_batch = df.groupBy(*[_c(k) for k in keys], _c(batch)).agg(F.count(F.lit(1)).alias("_n"))
    per_key = per_batch.groupBy(*[_c(k) for k in keys]).agg(F.sum("_n").alias("_total")).filter("_total > 1")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    joined = per_batch.alias("a").join(per_key.alias("b"), on, "left")
    repeated = F.coalesce(F.sum(F.when(F.col("_total").isNotNull(), F.col("_n"))), F.lit(0))
    out = joined.groupBy(F.col(f"a.`{batch}`").alias(batch)).agg(
        F.sum("_n").cast("bigint").alias("n_rows"), repeated.cast("bigint").alias("n_repeated")
    )
    return out.withColumn("repeated_share", F.col("n_repeated") / F.col("n_rows"))


def null_correlation(df: DataFrame, column: str, dimension: Column, name: str) -> DataFrame:
    """Null rate of a column per value of a dimension, against the overall rate."""
    per = df.groupBy(dimension.alias(name)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_c(column).isNull()).alias("n_null")
    )
    overall = per.agg((F.sum("n_null") / F.sum("n_rows")).alias("_r"))
    rate = F.col("n_null") / F.col("n_rows")
    return per.select(
        name, "n_rows", "n_null", rate.alias("null_rate"), (rate - overall.scalar()).alias("lift")
    )
