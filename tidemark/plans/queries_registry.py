"""Registered queries over the registry of datasets, versions, investigations and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.shared import new_path, settle
from ..operators import experiment, memory, recall_index, registry, synthesis, timeline
from . import derived
from .catalog import query, select
from .derived import read
from .oracle import sid


@query("dedupe_versions", select("""
SELECT arrival, dataset_id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, file_hash ORDER BY arrival) AS rn FROM arrivals a
  WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.dataset_id = a.dataset_id AND v.file_hash = a.file_hash)) WHERE rn = 1""", "arrivals", "versions"))
def dedupe_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.new_arrivals(derived.versions(spark, sf_dir), derived.arrivals(spark, sf_dir), ["arrival"])


@query("next_version", select("""
SELECT arrival, dataset_id, file_hash, CAST(coalesce((SELECT max(version_number) FROM versions v WHERE v.dataset_id = a.dataset_id), 0)
  + row_number() OVER (PARTITION BY dataset_id ORDER BY arrival) AS BIGINT) AS version_number FROM arrivals a""", "arrivals", "versions"))
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.next_versions(
        derived.versions(spark, sf_dir), derived.arrivals(spark, sf_dir), ["arrival"], F.floor(F.col("arrival") / 1000)
    )


@query("latest_version", select(
    "SELECT * FROM versions v WHERE version_number = (SELECT max(version_number) FROM versions w WHERE w.dataset_id = v.dataset_id)", "versions"))
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_versions(derived.versions(spark, sf_dir))


@query("list_datasets", select("""
SELECT d.*, max(version_number) AS latest_version, count(*) AS n_versions FROM datasets d JOIN versions v USING (dataset_id) GROUP BY ALL""", "datasets", "versions"))
def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.list_datasets(derived.datasets(spark, sf_dir), derived.versions(spark, sf_dir))


@query("version_history", select("SELECT * FROM versions WHERE dataset_id = 7", "versions"))
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.version_history(derived.versions(spark, sf_dir), 7)


@query("workspace_versions", select(
    "SELECT v.* FROM versions v JOIN datasets d USING (dataset_id) WHERE d.workspace_id = 'ws_2'", "versions", "datasets"))
def workspace_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.workspace_versions(derived.datasets(spark, sf_dir), derived.versions(spark, sf_dir), "ws_2")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigations with the dataset of their version."""
    versions = derived.versions(spark, sf_dir).select("version_id", "dataset_id")
    return derived.investigations(spark, sf_dir).join(versions, "version_id")


@query("inbox_search", select("""
SELECT i.*, v.dataset_id FROM incidents i JOIN versions v USING (version_id) WHERE status = 'OPEN' AND v.dataset_id = 3
  AND (title ILIKE '%urgent%' OR description ILIKE '%urgent%')
  AND EXISTS (SELECT 1 FROM issue f WHERE f.investigation_id = i.investigation_id AND f.severity = 'CRITICAL')""", "incidents", "versions", "issue"))
def inbox_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(
        _placed(spark, sf_dir), derived.findings(spark, sf_dir), status="OPEN", dataset_id=3, severity="CRITICAL", text="urgent"
    )


@query("inbox_page", select("""
SELECT *, (SELECT count(*) FROM incidents WHERE status = 'OPEN') AS total FROM incidents WHERE status = 'OPEN'
ORDER BY created_at DESC, investigation_id LIMIT 10 OFFSET 20""", "incidents"))
def inbox_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.page(registry.search(derived.investigations(spark, sf_dir), status="OPEN"), number=3)


@query("inbox_page_after", select("""
SELECT * FROM incidents WHERE status = 'OPEN' ORDER BY created_at DESC, investigation_id LIMIT 10 OFFSET 20""", "incidents"))
def inbox_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, reached from the last row of each page before it."""
    found = registry.search(derived.investigations(spark, sf_dir), status="OPEN")
    key = (None, None)
    for _ in range(2):
        last = registry.page_after(found, *key).collect()[-1]  # ten rows
        key = (last["created_at"], last["investigation_id"])
    return registry.page_after(found, *key)


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


@query("highest_severity", select(f"""
SELECT i.investigation_id, CASE max({RANK}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS highest_severity
FROM incidents i LEFT JOIN issue f USING (investigation_id) GROUP BY 1""", "incidents", "issue"))
def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.highest_severity(derived.investigations(spark, sf_dir), derived.findings(spark, sf_dir))


@query("strong_candidates", select("""
SELECT i.investigation_id, count(*) FILTER (WHERE f.hypothesis_status = 'SUPPORTED') AS strong_candidates_count
FROM incidents i LEFT JOIN issue f USING (investigation_id) GROUP BY 1""", "incidents", "issue"))
def strong_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hypotheses = derived.findings(spark, sf_dir).withColumnRenamed("hypothesis_status", "status")
    return registry.strong_candidates(derived.investigations(spark, sf_dir), hypotheses)


@query("inbox_enriched", select("""
SELECT i.*, coalesce(d.name, 'Unknown Dataset') AS dataset_name, coalesce(v.version_number, 0) AS dataset_version_number
FROM incidents i LEFT JOIN (SELECT * FROM versions WHERE dataset_id <> 4) v USING (version_id) LEFT JOIN datasets d ON d.dataset_id = v.dataset_id""", "incidents", "versions", "datasets"))
def inbox_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of dataset 4 count as deleted, so their investigations show as unknown."""
    versions = derived.versions(spark, sf_dir).filter("dataset_id <> 4")
    return registry.enriched(derived.investigations(spark, sf_dir), versions, derived.datasets(spark, sf_dir))


@query("finding_counts", """
SELECT c_custkey AS finding_id, (SELECT count(*) FROM events e WHERE e.user_id = c.c_custkey) AS n_evidence,
  (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_hypotheses,
  (SELECT count(*) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey) AS n_experiments
FROM customer c""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as findings, events as evidence, orders as hypotheses and line items as experiments."""
    return registry.finding_counts(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id")),
        read(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id")),
        read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hypothesis_id"), F.col("o_custkey").alias("finding_id")),
        read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hypothesis_id")),
    )


@query("hypothesis_relevance", """
SELECT o_orderkey AS hypothesis_id, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'HIGH' WHEN c.c_mktsegment = 'MACHINERY' THEN 'MEDIUM' ELSE 'LOW' END AS relevance
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def hypothesis_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hypotheses, customers of two segments as attributions."""
    segment = F.col("c_mktsegment")
    attributions = read(spark, sf_dir, "customer").filter(segment.isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").alias("attribution_id"), F.when(segment == "BUILDING", "HIGH").otherwise("MEDIUM").alias("relevance")
    )
    hypotheses = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hypothesis_id"), F.col("o_custkey").alias("attribution_id")
    )
    return registry.hypothesis_relevance(hypotheses, attributions)


STATUS_SQL = "CASE event_type WHEN 'click' THEN 'INVESTIGATING' WHEN 'purchase' THEN 'RESOLVED' WHEN 'error' THEN 'REJECTED' ELSE 'OPEN' END"


def _status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "click", "INVESTIGATING").when(kind == "purchase", "RESOLVED").when(kind == "error", "REJECTED").otherwise("OPEN")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("investigation_id"), "ts", "event_id", status.alias("status"), (F.col("value") > 50).alias("has_resolution")
    )


@query("illegal_transitions", f"""
SELECT * FROM (SELECT *, CASE WHEN previous_status || '>' || status NOT IN ('OPEN>INVESTIGATING', 'OPEN>REJECTED', 'INVESTIGATING>RESOLVED', 'INVESTIGATING>REJECTED') THEN 'transition'
    WHEN status = 'RESOLVED' AND NOT has_resolution THEN 'resolution missing' END AS reason
  FROM (SELECT user_id AS investigation_id, ts, event_id, {STATUS_SQL} AS status, value > 50 AS has_resolution,
    lag({STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events) WHERE previous_status IS NOT NULL) WHERE reason IS NOT NULL""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.illegal_transitions(_status_events(spark, sf_dir), F.date_trunc("hour", "ts"))


MOVE_SQL = "CASE event_type WHEN 'purchase' THEN 'SUPPORTED' WHEN 'error' THEN 'REJECTED' WHEN 'signup' THEN 'INCONCLUSIVE' ELSE 'PROPOSED' END"


@query("illegal_hypothesis_moves", f"""
SELECT * FROM (SELECT user_id AS hypothesis_id, ts, event_id, {MOVE_SQL} AS status, lag({MOVE_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events)
WHERE coalesce(previous_status, 'PROPOSED') <> 'PROPOSED' OR (status = 'PROPOSED' AND previous_status IS NOT NULL)""")
def illegal_hypothesis_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "SUPPORTED").when(kind == "error", "REJECTED").when(kind == "signup", "INCONCLUSIVE").otherwise("PROPOSED")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("hypothesis_id"), "ts", "event_id", status.alias("status"))
    return experiment.illegal_moves(events, F.date_trunc("hour", "ts"))


@query("timeline_append", """
SELECT user_id AS investigation_id, ts, event_id, event_type,
  CAST(coalesce(c.c_nationkey + 1, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence_number
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def timeline_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to logs that already hold some entries."""
    log = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("investigation_id"), (F.col("c_nationkey") + 1).alias("sequence_number")
    )
    arrivals = read(spark, sf_dir, "events").select(F.col("user_id").alias("investigation_id"), "ts", "event_id", "event_type")
    return timeline.append(log, arrivals, F.date_trunc("hour", "ts"))


@query("timeline", "SELECT user_id AS investigation_id, ts, event_id AS sequence_number, event_type FROM events ORDER BY 1, 2, 3")
def timeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("investigation_id"), "ts", F.col("event_id").alias("sequence_number"), "event_type"
    )
    return timeline.chronological(log)


@query("delete_dataset", select("""
SELECT 'dataset' AS kind, dataset_id, CAST(NULL AS BIGINT) AS version_id FROM datasets WHERE workspace_id <> 'ws_1'
UNION ALL SELECT 'version', v.dataset_id, v.version_id FROM versions v JOIN datasets d USING (dataset_id) WHERE d.workspace_id <> 'ws_1'""", "datasets", "versions"))
def delete_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = derived.datasets(spark, sf_dir)
    kept, versions = registry.delete_dataset(
        datasets, derived.versions(spark, sf_dir), datasets.filter("workspace_id = 'ws_1'")
    )
    none = F.lit(None).cast("bigint").alias("version_id")
    return kept.select(F.lit("dataset").alias("kind"), "dataset_id", none).unionByName(
        versions.select(F.lit("version").alias("kind"), "dataset_id", "version_id")
    )


@query("investigation_document", select("""
SELECT investigation_id, 'investigation' AS part, CAST(investigation_id AS VARCHAR) AS part_id,
  '{"version_id":' || version_id || ',"status":"' || status || '","title":"' || title || '","description":"' || description || '"}' AS body FROM incidents
UNION ALL SELECT investigation_id, 'finding', finding_id, '{"severity":"' || severity || '","metric":"' || metric || '","column":"' || "column" || '"}' FROM issue
UNION ALL SELECT investigation_id, 'hypothesis', finding_id, '{"hypothesis_status":"' || hypothesis_status || '"}' FROM issue""", "incidents", "issue"))
def investigation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived.findings(spark, sf_dir)
    head = derived.investigations(spark, sf_dir).drop("created_at").withColumn("part_id", F.col("investigation_id"))
    return registry.document(
        {
            "investigation": (head, "part_id"),
            "finding": (found.drop("hypothesis_status"), "finding_id"),
            "hypothesis": (found.select("investigation_id", "finding_id", "hypothesis_status"), "finding_id"),
        }
    )


# Experiments


@query("experiment_status", select(
    "SELECT experiment_id, CASE WHEN error_message IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, completed_at FROM runs", "runs"))
def experiment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.experiments(spark, sf_dir)
    return runs.select("experiment_id", experiment.status(F.col("error_message")).alias("status"), "completed_at")


@query("hypothesis_verdict", select(f"""
SELECT experiment_id, hypothesis_id, CASE WHEN error_message IS NOT NULL THEN 'REJECTED' WHEN row_count > 0 THEN 'SUPPORTED' ELSE 'REJECTED' END AS verdict,
  CASE WHEN error_message IS NOT NULL THEN 'Experiment failed to execute: ' || error_message
    WHEN row_count > 0 THEN 'Experiment found ' || row_count || ' rows supporting the hypothesis.'
    ELSE 'Experiment executed successfully but returned 0 rows, contradicting the hypothesis.' END AS note,
  {sid("ev", "experiment_id")} AS evidence_id, 'QUERY' AS type, 'sql_experiment_result' AS metric,
  '{{"rows":' || row_count || ',"error":' || coalesce('"' || error_message || '"', 'null') || '}}' AS value FROM runs""", "runs"))
def hypothesis_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.verdicts(derived.experiments(spark, sf_dir))


@query("latest_experiment", select("""
SELECT experiment_id, hypothesis_id, completed_at, row_count, error_message FROM (
  SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY completed_at DESC, experiment_id DESC) AS rn FROM runs) WHERE rn = 1""", "runs"))
def latest_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.latest(derived.experiments(spark, sf_dir))


# Memory

SIGNATURE_SQL = """
SELECT i.investigation_id, i.status, i.created_at, i.title, d.name AS dataset_name,
  coalesce(list_sort(list(DISTINCT f.metric) FILTER (WHERE f.metric IS NOT NULL)), []) AS metrics,
  coalesce(list_sort(list(DISTINCT f."column") FILTER (WHERE f."column" IS NOT NULL)), []) AS columns
FROM incidents i JOIN versions v USING (version_id) JOIN datasets d USING (dataset_id) LEFT JOIN issue f USING (investigation_id)
GROUP BY ALL
"""
SIGNATURE_TABLES = ("incidents", "versions", "datasets", "issue")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.enriched(
        derived.investigations(spark, sf_dir), derived.versions(spark, sf_dir), derived.datasets(spark, sf_dir)
    ).drop("dataset_version_number", "version_id", "description")


def _traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.findings(spark, sf_dir).select("investigation_id", "metric", "column")


@query("memory_signature", select(f"""
SELECT investigation_id, dataset_name, array_to_string(metrics, ',') AS metrics, array_to_string(columns, ',') AS columns FROM ({SIGNATURE_SQL})""", *SIGNATURE_TABLES))
def memory_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.signatures(_named(spark, sf_dir), _traits(spark, sf_dir)).select(
        "investigation_id", "dataset_name", F.array_join("metrics", ",").alias("metrics"), F.array_join("columns", ",").alias("columns")
    )


def _recall(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Matches of the newest investigation under way in each dataset."""
    named = _named(spark, sf_dir)
    newest = named.filter("status = 'INVESTIGATING'").groupBy("dataset_name").agg(
        F.max(F.struct("created_at", "investigation_id"))["investigation_id"].alias("investigation_id")
    )
    current = named.join(newest.select("investigation_id"), "investigation_id", "left_semi")
    wanted = current.unionByName(named.filter("status = 'RESOLVED'"))
    traits = _traits(spark, sf_dir).join(wanted.select("investigation_id"), "investigation_id", "left_semi")
    rows = settle(memory.signatures(wanted, traits))
    return memory.similar(rows.filter("status = 'INVESTIGATING'"), rows.filter("status = 'RESOLVED'"), k)


RECALL_SQL = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY current_id ORDER BY similarity_score DESC, created_at DESC, investigation_id DESC) AS INTEGER) AS rank FROM (
SELECT c.investigation_id AS current_id, c.dataset_name AS current_dataset, p.investigation_id, p.title, p.dataset_name, p.created_at,
  list_sort(list_intersect(c.metrics, p.metrics)) AS shared_metrics, list_sort(list_intersect(c.columns, p.columns)) AS shared_columns,
  c.dataset_name = p.dataset_name AS same_dataset,
  round(least(1.0::DOUBLE, CASE WHEN c.dataset_name = p.dataset_name THEN 0.5::DOUBLE ELSE 0::DOUBLE END + 0.3::DOUBLE * len(list_intersect(c.metrics, p.metrics))
    + 0.3::DOUBLE * len(list_intersect(c.columns, p.columns))), 6) AS similarity_score
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY created_at DESC, investigation_id DESC) AS rn FROM sigs WHERE status = 'INVESTIGATING') WHERE rn = 1) c
JOIN sigs p ON p.status = 'RESOLVED') WHERE similarity_score > 0
"""


def _recall_oracle(body: str) -> str:
    return select(body, *SIGNATURE_TABLES).replace("FROM sigs", f"FROM ({SIGNATURE_SQL}) sigs").replace("JOIN sigs p", f"JOIN ({SIGNATURE_SQL}) p")


@query("memory", _recall_oracle(f"SELECT current_id, investigation_id, title, dataset_name, similarity_score, rank FROM ({RECALL_SQL}) WHERE rank <= 3"))
def memory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, 3).select("current_id", "investigation_id", "title", "dataset_name", "similarity_score", "rank")


@query("memory_topk", _recall_oracle(f"SELECT current_id, investigation_id, similarity_score, rank FROM ({RECALL_SQL}) WHERE rank <= 5"))
def memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, 5).select("current_id", "investigation_id", "similarity_score", "rank")


@query("memory_indexed", _recall_oracle(f"SELECT current_id, investigation_id, similarity_score, rank FROM ({RECALL_SQL}) WHERE rank <= 5").replace("WHERE rn = 1)", "WHERE rn <= 40)"))
def memory_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the newest 40 investigations under way in each dataset, from an index in blocks."""
    named = _named(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("dataset_name").orderBy(F.desc("created_at"), F.desc("investigation_id")))
    current = named.filter("status = 'INVESTIGATING'").withColumn("_place", place).filter("_place <= 40").drop("_place")
    wanted = current.unionByName(named.filter("status = 'RESOLVED'"))
    traits = _traits(spark, sf_dir).join(wanted.select("investigation_id"), "investigation_id", "left_semi")
    rows = settle(memory.signatures(wanted, traits))
    path = new_path(spark, "recall")
    past = rows.filter("status = 'RESOLVED'")
    recall_index.build(past, path)
    out = recall_index.similar(rows.filter("status = 'INVESTIGATING'"), path, past.schema, 5)
    return out.select("current_id", "investigation_id", "similarity_score", "rank")


@query("memory_factors", _recall_oracle(f"""
SELECT current_id, investigation_id, concat_ws(' | ', CASE WHEN same_dataset THEN 'Same dataset (' || current_dataset || ')' END,
  CASE WHEN len(shared_metrics) > 0 THEN 'Similar metrics: ' || array_to_string(shared_metrics, ', ') END,
  CASE WHEN len(shared_columns) > 0 THEN 'Affected columns: ' || array_to_string(shared_columns, ', ') END) AS matched_factors
FROM ({RECALL_SQL}) WHERE rank <= 3"""))
def memory_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, 3).select(
        "current_id", "investigation_id", F.array_join("matched_factors", " | ").alias("matched_factors")
    )


# Context checks


@query("context_mismatches", """
SELECT o_orderkey AS context_id, o_orderkey AS investigation_id, o_custkey + 1 AS version_id FROM orders WHERE o_orderpriority = '5-LOW'""")
def context_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of low-priority investigations were built with the next version by mistake."""
    wrong = F.col("o_orderpriority") == "5-LOW"
    contexts = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("context_id"), F.col("o_orderkey").alias("investigation_id"),
        F.when(wrong, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("version_id"),
    )
    return synthesis.context_mismatches(contexts, derived.investigations(spark, sf_dir)).select(
        "context_id", "investigation_id", "version_id"
    )


@query("context_errors", """
SELECT o_orderkey AS context_id, CASE WHEN o_orderkey % 11 = 0 THEN 'Synthesis mismatch: Expected ' || o_orderkey || ', got ' || coalesce(CAST((SELECT min(x.o_orderkey) FROM orders x WHERE x.o_orderkey = o.o_orderkey - 1) AS VARCHAR), 'None')
  ELSE 'Dataset mismatch: Investigation targets ' || o_custkey || ', but provided version is ' || (o_custkey + 1) END AS error
FROM orders o WHERE o_orderkey % 11 = 0 OR o_orderpriority = '5-LOW'""")
def context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh context was built with the synthesis of the investigation before, and low-priority ones with the next version."""
    orders = read(spark, sf_dir, "orders")
    syntheses = orders.select(F.concat(F.lit("syn_"), F.col("o_orderkey").cast("string")).alias("synthesis_id"), F.col("o_orderkey").alias("investigation_id"))
    wrong, foreign = F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 11 == 0
    contexts = orders.select(
        F.col("o_orderkey").alias("context_id"), F.col("o_orderkey").alias("investigation_id"), F.when(wrong, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("version_id"),
        F.concat(F.lit("syn_"), (F.col("o_orderkey") - foreign.cast("int")).cast("string")).alias("synthesis_id"),
    )
    return synthesis.context_errors(contexts, derived.investigations(spark, sf_dir), syntheses)


@query("oversize_contexts", "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 20000")
def oversize_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return synthesis.oversize_contexts(documents, "text", 20_000).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
