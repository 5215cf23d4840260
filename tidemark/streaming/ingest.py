"""Arriving versions: a stream of manifests, each naming one new file of a dataset.

Every micro-batch drops known content, numbers the rest, profiles the new versions, diffs them with their predecessors,
and opens an investigation for each version with findings, with its evidence, attributions, hypotheses and timeline.
A version whose file is malformed, or missing, is set aside and does not stop the others; a missing one may be sent again. Other
errors (a lost executor, a full disk) fail the batch, which can be run again. All writes of a batch go to its own folder,
partitioned by workspace, and overwrite it, so a batch that is run again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import attribution, diff, drift, registry, timeline
from ..operators.profile import profile
from ..sources.readers import read_version

MANIFEST = "workspace_id string, dataset_id string, path string, format string, file_hash string, arrival bigint"
VERSION = (
    "workspace_id string, dataset_id string, file_hash string, version_number bigint, path string, format string, "
    "arrival bigint, batch_id bigint"
)
REJECTED = "workspace_id string, dataset_id string, version_number bigint, path string, error string, retry boolean"
#: Error conditions that lie in a version's own bytes or name. Others may pass, so they fail the batch.
IN_THE_FILE = (
    "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD", "MALFORMED_CHARACTER_CODING", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA",
    "CANNOT_INFER_EMPTY_SCHEMA", "EMPTY_SCHEMA_NOT_SUPPORTED", "PARQUET_COLUMN_DATA_TYPE_MISMATCH", "CANNOT_PARSE_JSON_FIELD", "AMBIGUOUS_REFERENCE", "COLUMN_ALREADY_EXISTS",
    "Unsupported format", "is not a Parquet file",
)
MISSING = ("PATH_NOT_FOUND", "FILE_NOT_EXIST")
KEY = ["dataset_id", "version_number"]
#: Versions that one plan profiles, and whose manifest rows the driver holds, at a time.
VERSIONS_PER_PLAN = 50


def watch(spark: SparkSession, manifests: str, root: str, checkpoint: str, per_batch: int = 100, exact: Sequence[str] = ()) -> StreamingQuery:
    """Ingest all manifests that have arrived, at most ``per_batch`` files of them at a time.

    ``exact`` names the columns whose distinct values are counted exactly, so that a change in their number counts.
    """
    stream = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", per_batch).json(manifests)
    return (
        stream.writeStream.foreachBatch(lambda batch, n: ingest(batch, n, root, exact))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored(spark: SparkSession, root: str, table: str, schema: str, before: int) -> DataFrame:
    """Rows of earlier batches; none before the first write."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}").filter(F.col("batch_id") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _put(df: DataFrame, root: str, table: str, batch_id: int) -> DataFrame:
    """Write the rows of a batch and read them back. Rows without a workspace get that of their version."""
    spark = df.sparkSession
    if "workspace_id" not in df.columns:
        owners = spark.read.schema(VERSION).parquet(f"{root}/versions").filter(F.col("batch_id") == batch_id)
        df = df.join(owners.select("workspace_id", *KEY).distinct(), KEY, "left")
    path = f"{root}/{table}/batch_id={batch_id}"
    df = df.select(*[c for c in df.columns if c != "batch_id"])
    df.write.mode("overwrite").partitionBy("workspace_id").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _in_groups(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    while group := list(islice(rows, size)):
        yield group


def _profile_of(spark: SparkSession, v: Row, exact: Sequence[str]) -> DataFrame:
    p = profile(read_version(spark, v["path"], v["format"]), exact=list(exact))
    keys = [F.lit(v[c]).cast(t).alias(c) for c, t in (("workspace_id", "string"), ("dataset_id", "string"), ("version_number", "bigint"))]
    return p.select(*keys, "*")


def _profiles(spark: SparkSession, versions: list[Row], exact: Sequence[str], path: str) -> list[tuple]:
    """Profile some versions in one plan; if that fails, each by itself, and return those that cannot be read."""
    def write(some: list[Row], mode: str) -> None:
        out = None
        for v in some:
            p = _profile_of(spark, v, exact)
            out = p if out is None else out.unionByName(p)
        out.write.mode(mode).parquet(path)

    try:
        write(versions, "overwrite")
        return []
    except Exception:
        bad, first = [], True
        for v in versions:
            try:
                write([v], "overwrite" if first else "append")
                first = False
            except Exception as e:
                said = str(e)
                missing = any(c in said for c in MISSING)
                if not missing and not any(c in said for c in IN_THE_FILE):
                    raise
                bad.append((v["workspace_id"], v["dataset_id"], v["version_number"], v["path"], said[:1000], missing))
        if first:  # nothing readable: no rows of an earlier run may stay
            empty = profile(spark.range(0)).selectExpr("'' AS workspace_id", "'' AS dataset_id", "0L AS version_number", "*")
            empty.filter("false").write.mode("overwrite").parquet(path)
        return bad


def ingest(batch: DataFrame, batch_id: int, root: str, exact: Sequence[str] = ()) -> None:
    """One micro-batch of manifests."""
    spark = batch.sparkSession
    known = stored(spark, root, "versions", VERSION, batch_id)
    # What is known of a dataset is looked up for the datasets of this batch only.
    known = known.join(batch.select("dataset_id").distinct(), "dataset_id", "left_semi")
    # A version whose file was missing is no known content: it gets a new number when it comes again.
    missing = stored(spark, root, "rejected_versions", REJECTED + ", batch_id bigint", batch_id).filter("retry").select(*KEY)
    arrivals = registry.new_arrivals(known.join(missing, KEY, "left_anti"), batch, ["arrival"])
    numbered = registry.next_versions(known, arrivals, ["arrival"], F.floor(F.col("arrival") / 1000))
    columns = ["workspace_id", "dataset_id", "file_hash", "version_number", "path", "format", "arrival"]
    new = _put(numbered.select(*columns), root, "versions", batch_id)
    if new.isEmpty():
        return
    rejected: list[tuple] = []
    parts = f"{root}/profile_parts/batch_id={batch_id}"
    n = 0
    for n, group in enumerate(_in_groups(new.orderBy(*KEY).toLocalIterator(), VERSIONS_PER_PLAN), start=1):
        rejected += _profiles(spark, group, exact, f"{parts}/part={n}")
    _put(spark.createDataFrame(rejected, REJECTED), root, "rejected_versions", batch_id)
    made = spark.read.parquet(*[f"{parts}/part={i}" for i in range(1, n + 1)])
    fresh = _put(made, root, "column_profiles", batch_id)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields) + ", batch_id bigint"
    older = stored(spark, root, "column_profiles", schema, batch_id).drop("batch_id")
    previous = fresh.select("dataset_id", (F.col("version_number") - 1).alias("version_number")).distinct()
    needed = fresh.unionByName(older.join(previous, KEY, "left_semi"))
    # A predecessor is needed to compare with, but belongs to an earlier batch: changes are those of new versions.
    changes = _put(diff.changes(needed), root, "changes", batch_id)
    findings = _put(drift.findings(changes), root, "findings", batch_id)
    _investigate(needed, changes, findings, root, batch_id)


def _investigate(profiles: DataFrame, changes: DataFrame, findings: DataFrame, root: str, batch_id: int) -> None:
    """Everything that follows from the findings of a batch; ids are hashes of natural keys, so a rerun gives the same."""
    put = lambda df, table: _put(df.drop("workspace_id"), root, table, batch_id)
    found, changed = findings.drop("workspace_id"), changes.drop("workspace_id")
    investigations = put(drift.open_investigations(found), "investigations")
    attributions = put(attribution.attribute(found, changed), "attributions")
    hypotheses = put(attribution.hypotheses(attributions), "hypotheses")
    evidence = drift.metric_evidence(found)
    of = found.select("finding_id", *KEY)
    put(attribution.evidence(attributions).join(of, "finding_id"), "attribution_evidence")
    put(evidence.join(of, "finding_id") if not set(KEY) <= set(evidence.columns) else evidence, "evidence")
    events = timeline.build(
        investigations.drop("workspace_id"), diff.summary(profiles, changed), found, evidence, attributions.drop("workspace_id"), hypotheses.drop("workspace_id")
    )
    put(events.join(investigations.select("investigation_id", *KEY), "investigation_id"), "timeline")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all batches. Workspace ids are texts, whatever they look like."""
    kinds = {"workspace_id": T.StringType(), "batch_id": T.LongType()}
    found = spark.read.parquet(f"{root}/{name}").schema
    return spark.read.schema(T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found.fields])).parquet(f"{root}/{name}")
