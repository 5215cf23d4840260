"""Summaries of investigations, and the evidence a reader may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fixed_sql

KEY = ["dataset_id", "version_number"]
MAX_CONTEXT_CHARS = 100_000  # fixed value

# Headings of the report, in order.
SECTIONS = [
    "What happened?", "What changed?", "What is most likely related?", "What did we test?",
    "Current root-cause candidate:",
]


def summaries(investigations: DataFrame, findings: DataFrame) -> DataFrame:
    """Problem summary: status, title, number of findings and the first one by impact, column and rule."""
    first = F.min(
        F.struct((-F.col("impact_score")).alias("i"), "column", "rule", F.col("title").alias("first_title"))
    )
    stats = findings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), first.alias("_f"))
    rows = investigations.join(stats, KEY, "left")
    head = F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("title"), F.lit(": "), F.col("description"), F.lit("."))
    tail = F.when(
        F.col("_n") > 0,
        F.concat(
            F.lit(" Detected "), F.col("_n").cast("string"), F.lit(" finding(s). Primary: "), F.col("_f.first_title"),
            F.lit(" on "), F.coalesce(F.col("_f.column"), F.lit("dataset")), F.lit("."),
        ),
    ).otherwise("")
    return rows.select("investigation_id", *KEY, F.concat(head, tail).alias("problem_summary"))


def synthesize(investigations: DataFrame, findings: DataFrame, validations: DataFrame, hypotheses: DataFrame, strongest: DataFrame) -> DataFrame:
    """One row per investigation: summary, number of validations and its strongest candidate."""
    checked = (
        validations.join(hypotheses.select("hypothesis_id", *KEY), "hypothesis_id")
        .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_validations"))
    )
    best = strongest_of_investigation(findings, strongest)
    return (
        summaries(investigations, findings)
        .join(checked, KEY, "left")
        .fillna(0, ["n_validations"])
        .join(best, KEY, "left")
    )


def strongest_of_investigation(findings: DataFrame, strongest: DataFrame) -> DataFrame:
    """Best candidate over all findings of a version pair."""
    owners = findings.select("finding_id", *KEY)
    packed = F.min(
        F.struct(
            (-F.round("score", 6)).alias("s"), (-F.col("confidence")).alias("c"), "candidate_id", "explanation", "status",
        )
    )
    best = strongest.join(owners, "finding_id").groupBy(*KEY).agg(packed.alias("_b"))
    return best.select(
        *KEY,
        F.col("_b.candidate_id").alias("strongest_candidate_id"),
        F.col("_b.explanation").alias("strongest_explanation"),
        F.col("_b.status").alias("strongest_status"),
        (-F.col("_b.s")).alias("strongest_score"),
        (-F.col("_b.c")).alias("strongest_confidence"),
    )


def change_lines(changes: DataFrame) -> DataFrame:
    """Text of each schema and column change."""
    line = f"""CASE WHEN change_kind = 'schema' THEN '- Schema ' || change_type || ' on column \\'' || column || '\\''
      ELSE '- ' || metric || ' on \\'' || column || '\\' shifted (delta: ' || {fixed_sql('absolute_delta', 4)} || ')' END AS line"""
    return changes.selectExpr(*KEY, "change_id", "change_kind", line)


def report(
    investigations: DataFrame,
    findings: DataFrame,
    changes: DataFrame,
    attributions: DataFrame,
    hypotheses: DataFrame,
    validations: DataFrame,
    candidates: DataFrame,
    strongest: DataFrame,
) -> DataFrame:
    """The report as ordered lines: (investigation_id, section, item, line).

    Lines stay rows, so a long report is never gathered in one value; ``render`` joins one report.
    """
    ids = investigations.select("investigation_id", *KEY)

    def lines(rows: DataFrame, section: int, item: Column, text: Column) -> DataFrame:
        return rows.select(
            "investigation_id", F.lit(section).alias("section"), item.cast("string").alias("item"), text.alias("line")
        )

    out = lines(
        investigations, 0, F.lit(""), F.concat(F.lit("# Investigation Synthesis: "), F.col("investigation_id"))
    )
    out = out.unionByName(
        lines(summaries(investigations, findings), 1, F.lit("1"), F.col("problem_summary"))
    )
    changed = change_lines(changes).join(ids, KEY)
    order = F.concat(F.when(F.col("change_kind") == "schema", "1").otherwise("2"), F.col("line"))
    out = out.unionByName(lines(changed, 2, order, F.col("line")))
    quiet = ids.join(changes.select(*KEY), KEY, "left_anti")
    out = out.unionByName(lines(quiet, 2, F.lit("1"), F.lit("- No historical changes detected.")))
    best_first = (
        "concat_ws('|', 9 - relevance_score, format_string('%.3f', 1 - confidence), change_column, change_type, finding_id)"
    )
    out = out.unionByName(
        lines(attributions.join(ids, KEY), 3, F.expr(best_first),
              F.concat(F.lit("- ["), F.col("relevance"), F.lit("] "), F.col("reason")))
    )
    shown = validations.groupBy("hypothesis_id").agg(F.max("verdict").alias("verdict"), F.count("evidence_id").alias("_evidence"))
    tested = hypotheses.join(ids, KEY).join(shown, "hypothesis_id", "left")
    texts = F.array_compact(F.array(
        F.concat(F.lit("- Hypothesis: "), F.col("description")),
        F.when(F.col("verdict").isNull(), "  Result: PROPOSED (Not yet validated)").otherwise(F.concat(F.lit("  Result: "), F.col("verdict"))),
        F.when(F.col("verdict").isNotNull(), F.concat(F.lit("  Evidence: "), F.col("_evidence").cast("string"), F.lit(" artifacts."))),
    ))
    tested = tested.select("investigation_id", "hypothesis_id", F.posexplode(texts).alias("_n", "_line"))
    out = out.unionByName(lines(tested, 4, F.concat_ws("|", "hypothesis_id", F.col("_n").cast("string")), F.col("_line")))
    best = strongest_of_investigation(findings, strongest)
    have = candidates.join(findings.select("finding_id", *KEY), "finding_id").select(*KEY, F.lit(True).alias("_have")).distinct()
    verdict = ids.join(best, KEY, "left").join(have, KEY, "left")
    named = F.array(
        F.concat(F.lit("- "), F.col("strongest_explanation")),
        F.concat(F.lit("- Status: "), F.col("strongest_status")),
        F.concat(F.lit("- Confidence: "), F.expr(fixed_sql("(strongest_confidence * 100)", 1)), F.lit("%")),
    )
    last = (
        F.when(F.col("strongest_candidate_id").isNotNull(), named)
        .when(F.col("_have"), F.array(F.lit("- Multiple candidates exist, but none are strong enough.")))
        .otherwise(F.array(F.lit("- No root cause candidates identified yet.")))
    )
    verdict = verdict.select("investigation_id", F.posexplode(last).alias("_n", "_line"))
    return out.unionByName(lines(verdict, 5, F.col("_n"), F.col("_line")))


def render(lines: DataFrame, investigation_id: str) -> str:
    """Markdown of one investigation."""
    rows = lines.filter(F.col("investigation_id") == investigation_id).orderBy("section", "item").collect()
    out, section = [], 0
    for r in rows:
        if r["section"] != section:
            section = r["section"]
            out.append(f"\n## {SECTIONS[section - 1]}")
        out.append(r["line"])
    return "\n".join(out)


def evidence_catalog(findings_evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Evidence of findings and of validations, tagged by owner."""
    of_findings = findings_evidence.select(
        "evidence_id", F.concat(F.lit("Finding: "), F.col("finding_id")).alias("attached_to"), "type", "metric", "description"
    )
    of_checks = verdicts.select(
        "evidence_id", F.concat(F.lit("ValidationResult: "), F.col("hypothesis_id")).alias("attached_to"),
        "type", "metric", F.col("note").alias("description"),
    )
    return of_findings.unionByName(of_checks)


def active_hypotheses(hypotheses: DataFrame, validations: DataFrame) -> DataFrame:
    """Hypotheses with their verdict, PROPOSED if none."""
    known = validations.select("hypothesis_id", "verdict", F.col("note").alias("validation_note"))
    return hypotheses.drop("status").join(known, "hypothesis_id", "left").select(
        "hypothesis_id", "finding_id", "attribution_id", "description",
        F.coalesce("verdict", F.lit("PROPOSED")).alias("status"), "validation_note",
    )


def schema_context(p: DataFrame) -> DataFrame:
    return p.select(*KEY, "column", "type")


def context_mismatches(contexts: DataFrame, investigations: DataFrame) -> DataFrame:
    """Contexts (context_id, investigation_id, version_id) whose version is not their investigation's."""
    own = investigations.select("investigation_id", "version_id")
    return contexts.join(own, ["investigation_id", "version_id"], "left_anti")


def context_errors(contexts: DataFrame, investigations: DataFrame, syntheses: DataFrame) -> DataFrame:
    """context_id and error of contexts (context_id, investigation_id, version_id, synthesis_id) that would leak.

    A synthesis must be of the context's investigation, and the version the one it targets; the first is checked first. One that
    is unknown, or null, belongs to no investigation.
    """
    owner = syntheses.select("synthesis_id", F.col("investigation_id").alias("_owner"))
    target = investigations.select("investigation_id", F.col("version_id").alias("_target"))
    both = contexts.join(owner, "synthesis_id", "left").join(target, "investigation_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    foreign = F.concat(F.lit("Synthesis mismatch: Expected "), text("investigation_id"), F.lit(", got "), text("_owner"))
    other = F.concat(F.lit("Dataset mismatch: Investigation targets "), text("_target"), F.lit(", but provided version is "), text("version_id"))
    error = F.when(~F.col("_owner").eqNullSafe(F.col("investigation_id")), foreign).when(~F.col("_target").eqNullSafe(F.col("version_id")), other)
    return both.select("context_id", error.alias("error")).where("error IS NOT NULL")


def oversize_contexts(contexts: DataFrame, text: str, cap: int = MAX_CONTEXT_CHARS) -> DataFrame:
    return contexts.filter(F.length(text) > cap)
