"""Queries over the registry of datasets, versions, investigations and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import number_rows, pick_by, previous_value
from ..functions.text import case_of

# Rank of each severity; INFO has none.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
# Allowed status moves of an investigation.
ALLOWED_MOVES = ["OPEN>INVESTIGATING", "OPEN>REJECTED", "INVESTIGATING>RESOLVED", "INVESTIGATING>REJECTED"]


def new_arrivals(versions: DataFrame, arrivals: DataFrame, order: list[str]) -> DataFrame:
    """Arrivals whose (dataset_id, file_hash) is unknown, one per hash; the first arrival stays."""
    known = versions.select("dataset_id", "file_hash").distinct()
    order = [*order, *[c for c in ("path",) if c in arrivals.columns and c not in order]]
    fresh = arrivals.join(known, ["dataset_id", "file_hash"], "left_anti")
    return pick_by(fresh, ["dataset_id", "file_hash"], order)


def next_versions(versions: DataFrame, arrivals: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Arrivals numbered on from the highest version of their dataset; 1 for the first."""
    top = versions.groupBy("dataset_id").agg(F.max("version_number").alias("_top"))
    settled = [*order, *[c for c in ("file_hash",) if c not in order]]  # two files may arrive at one time
    numbered = number_rows(arrivals, ["dataset_id"], [F.col(c) for c in settled], bucket, "_n")
    joined = numbered.join(top, "dataset_id", "left")
    number = (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint")
    return joined.withColumn("version_number", number).drop("_top", "_n")


def latest_versions(versions: DataFrame) -> DataFrame:
    return pick_by(versions, ["dataset_id"], ["version_number"], last=True)


def list_datasets(datasets: DataFrame, versions: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Datasets with their latest version; datasets without a version are left out."""
    chosen = datasets if workspace_id is None else datasets.filter(F.col("workspace_id") == workspace_id)
    top = versions.groupBy("dataset_id").agg(
        F.max("version_number").alias("latest_version"), F.count(F.lit(1)).alias("n_versions")
    )
    return chosen.join(top, "dataset_id")


def version_history(versions: DataFrame, dataset_id) -> DataFrame:
    return versions.filter(F.col("dataset_id") == dataset_id).orderBy("version_number")


def workspace_versions(datasets: DataFrame, versions: DataFrame, workspace_id: str) -> DataFrame:
    """Versions whose dataset belongs to the workspace."""
    owned = datasets.filter(F.col("workspace_id") == workspace_id).select("dataset_id")
    return versions.join(owned, "dataset_id", "left_semi")


def search(
    investigations: DataFrame,
    findings: DataFrame | None = None,
    workspace_id: str | None = None,
    status: str | None = None,
    dataset_id=None,
    severity: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Investigations that pass every given filter. ``text`` is matched literally, ignoring case."""
    out = investigations
    if workspace_id is not None:
        out = out.filter(F.col("workspace_id") == workspace_id)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if dataset_id is not None:
        out = out.filter(F.col("dataset_id") == dataset_id)
    if text:
        literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        out = out.filter(F.col("title").ilike(f"%{literal}%") | F.col("description").ilike(f"%{literal}%"))
    if severity is not None:
        matching = findings.filter(F.col("severity") == severity).select("investigation_id")
        # Distinct first: an investigation with very many findings joins as one row.
        out = out.join(matching.distinct(), "investigation_id", "left_semi")
    return out


def page_after(investigations: DataFrame, created_at=None, investigation_id=None, size: int = 10) -> DataFrame:
    """The page behind the row with the given key, newest first; without a key the first page.

    Each task sends at most ``size`` rows however deep the page lies, as the rows before it are filtered by the key.
    """
    if not 1 <= size <= 100:
        raise ValueError("page size must be 1 to 100")
    rest = investigations
    if created_at is not None:
        at, last = F.lit(created_at), F.lit(investigation_id)
        rest = rest.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("investigation_id") > last)))
    return rest.orderBy(F.desc("created_at"), "investigation_id").limit(size)


def page(investigations: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """One page by number, newest first, with the total number of investigations.

    A number has to be counted to: the rows before the page go through one task. ``page_after`` has no such cost.
    """
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("page size must be 1 to 100 and page number at least 1")
    total = investigations.agg(F.count(F.lit(1))).scalar()
    ordered = investigations.orderBy(F.desc("created_at"), "investigation_id")
    return ordered.offset((number - 1) * size).limit(size).withColumn("total", total)


def highest_severity(investigations: DataFrame, findings: DataFrame) -> DataFrame:
    """Highest severity per investigation, null if it has only INFO findings or none."""
    rank = case_of("severity", SEVERITY_RANK, 0)
    top = findings.groupBy("investigation_id").agg(F.max(rank).alias("_rank"))
    name = case_of("_rank", {v: k for k, v in SEVERITY_RANK.items()})
    return investigations.select("investigation_id").join(top, "investigation_id", "left").select(
        "investigation_id", name.alias("highest_severity")
    )


def strong_candidates(investigations: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Number of SUPPORTED hypotheses per investigation."""
    counts = hypotheses.filter("status = 'SUPPORTED'").groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("strong_candidates_count")
    )
    return investigations.select("investigation_id").join(counts, "investigation_id", "left").fillna(
        0, ["strong_candidates_count"]
    )


def enriched(investigations: DataFrame, versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Add dataset name and version number; an unknown version shows as Unknown Dataset, 0."""
    known = versions.select("version_id", F.col("dataset_id").alias("_ds"), "version_number")
    names = datasets.select(F.col("dataset_id").alias("_ds"), F.col("name").alias("_name"))
    joined = investigations.join(known, "version_id", "left").join(names, "_ds", "left")
    return joined.select(
        *[F.col(c) for c in investigations.columns],
        F.coalesce("_name", F.lit("Unknown Dataset")).alias("dataset_name"),
        F.coalesce("version_number", F.lit(0)).alias("dataset_version_number"),
    )


def finding_counts(findings: DataFrame, evidence: DataFrame, hypotheses: DataFrame, experiments: DataFrame) -> DataFrame:
    """Evidence, hypotheses and experiments per finding, each counted before it is joined."""
    def count(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    per_hyp = hypotheses.join(count(experiments, "hypothesis_id", "_n"), "hypothesis_id", "left")
    hyp = per_hyp.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("n_hypotheses"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_experiments")
    )
    out = findings.select("finding_id").join(count(evidence, "finding_id", "n_evidence"), "finding_id", "left")
    return out.join(hyp, "finding_id", "left").fillna(0, ["n_evidence", "n_hypotheses", "n_experiments"])


def hypothesis_relevance(hypotheses: DataFrame, attributions: DataFrame) -> DataFrame:
    """Relevance of each hypothesis from its attribution, LOW if it has none."""
    known = attributions.select("attribution_id", F.col("relevance").alias("_r"))
    return hypotheses.join(known, "attribution_id", "left").select(
        "hypothesis_id", F.coalesce("_r", F.lit("LOW")).alias("relevance")
    )


def illegal_transitions(events: DataFrame, bucket: Column) -> DataFrame:
    """Status events (investigation_id, ts, event_id, status, has_resolution) that break the status machine.

    The first event of an investigation sets its status. RESOLVED also needs a resolution.
    """
    moves = previous_value(events, ["investigation_id"], ["ts", "event_id"], "status", bucket, "previous_status")
    moved = moves.filter("previous_status is not null")
    step = F.concat_ws(">", "previous_status", "status")
    bare = (F.col("status") == "RESOLVED") & ~F.col("has_resolution")
    reason = F.when(~step.isin(ALLOWED_MOVES), "transition").when(bare, "resolution missing")
    return moved.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def delete_dataset(datasets: DataFrame, versions: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets and versions without the doomed dataset ids, to be written as new snapshots."""
    ids = doomed.select("dataset_id")
    return datasets.join(ids, "dataset_id", "left_anti"), versions.join(ids, "dataset_id", "left_anti")


def document(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All parts of each investigation as one long table: (investigation_id, part, part_id, body).

    ``parts`` maps a part name to (rows, id column). Rows stay separate, so an investigation with very many
    children is never gathered into one value; sort by part and part_id to read one document.
    """
    out = None
    for name, (rows, ident) in parts.items():
        body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("investigation_id", ident)]))
        part = rows.select(
            "investigation_id", F.lit(name).alias("part"), F.col(ident).cast("string").alias("part_id"), body.alias("body")
        )
        out = part if out is None else out.unionByName(part)
    return out
