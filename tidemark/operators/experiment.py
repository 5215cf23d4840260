"""Read-only SQL experiments on one version, and the verdicts they give."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordered import pick_by, previous_value
from ..functions.text import stable_id

SAMPLE_LIMIT = 50
VIEW = "dataset"

# What a query may be made of. Anything that is not named here is refused, also what later versions of Spark add.
_PLANS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation",
    "Offset", "OneRowRelation", "PipeOperator", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition",
}
_NAMES = {
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedNamedLambdaVariable",
    "UnresolvedOrdinal", "UnresolvedStar", "UnresolvedSubqueryColumnAliases", "UnresolvedWindowExpression",
}
#: Built-in functions are allowed by their group; functions of other groups read files, settings or JVM classes.
_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs",
    "url_funcs", "window_funcs",
}
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Resolved expressions that run code of the caller's choice.
_CODE = {"CallMethodViaReflection", "Invoke", "StaticInvoke", "NewInstance", "PythonUDF", "ScalaUDF", "ScalaAggregator", "HiveGenericUDF"}


class Refused(ValueError):
    """The text is not a query over the one view, or holds something that is not allowed in it."""


@dataclass
class ExperimentResult:
    row_count: int = 0
    columns: list[str] = field(default_factory=list)
    sample_rows: list[dict] = field(default_factory=list)
    execution_time_ms: float = 0.0
    error_message: str | None = None

    @property
    def status(self) -> str:
        return "FAILED" if self.error_message else "COMPLETED"


def experiment_session(spark: SparkSession, load: Callable[[SparkSession], DataFrame]) -> SparkSession:
    """A session of its own whose only view is ``dataset``, and which cannot query files by path."""
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    load(session).createOrReplaceTempView(VIEW)
    return session


def _nodes(tree) -> Iterator[dict]:
    """All nodes of a plan written as JSON: plans, expressions, and those of subqueries."""
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        for value in tree.values():
            yield from _nodes(value)
    elif isinstance(tree, list):
        for value in tree:
            yield from _nodes(value)


def _parts(name) -> list[str]:
    return [x.strip().lower() for x in str(name).strip("[]").split(",")]


def _require_function(session: SparkSession, name: list[str]) -> None:
    """A function must be a built-in one, by its resolved name, of a group that only computes values."""
    if len(name) > 1 and name[:-1] not in (["builtin"], ["system", "builtin"]):
        raise Refused(f"Refused: function {'.'.join(name)}")
    ident = session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[-1])
    found = session._jsparkSession.sessionState().functionRegistry().lookupFunction(ident)
    if not found.isDefined() or found.get().getGroup() not in _GROUPS:
        raise Refused(f"Refused: function {name[-1]}")


def require_readonly(session: SparkSession, sql: str) -> None:
    """Raise unless the parsed text is one query that reads nothing but the view and its own common tables.

    Parsing runs nothing. The whole tree is walked, with subqueries: each node must be of a listed kind, each function
    a listed built-in, each relation ``dataset`` or a common table whose name no catalog table has.
    """
    tree = json.loads(session._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    nodes = list(_nodes(tree))
    common = {str(c["_1"]).lower() for n in nodes if n["class"].endswith(".UnresolvedWith") for c in n["cteRelations"]}
    for name in common:
        if name == VIEW or session.catalog.tableExists(f"`{name}`"):
            raise Refused(f"Refused: common table {name} has the name of a table")
    for n in nodes:
        path, kind = n["class"], n["class"].rsplit(".", 1)[1].rstrip("$")
        if kind == "UnresolvedRelation":
            parts = _parts(n["multipartIdentifier"])
            if len(parts) != 1 or parts[0] not in common | {VIEW}:
                raise Refused(f"Refused: relation {'.'.join(parts)}")
        elif kind == "UnresolvedFunction":
            _require_function(session, _parts(n["nameParts"]))
        elif kind == "UnresolvedGenerator":
            _require_function(session, [str(n["name"]["funcName"]).lower()])
        elif kind in _CODE or not (kind in _PLANS or kind in _NAMES or path.startswith(_EXPRESSIONS)):
            raise Refused(f"Refused: {kind}")


def _code(df: DataFrame) -> set[str]:
    tree = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    return {n["class"].rsplit(".", 1)[1] for n in _nodes(tree)} & _CODE


def select(session: SparkSession, sql: str) -> DataFrame:
    """The result of a query, refused unless it is a read-only query over ``dataset``."""
    body = sql.strip().rstrip(";")
    require_readonly(session, body)
    result = session.sql(body)
    code = _code(result) - _code(session.table(VIEW))  # what the view itself runs is not the query's doing
    if code:
        raise Refused(f"Refused: {', '.join(sorted(code))}")
    return result


def run(
    spark: SparkSession, load: Callable[[SparkSession], DataFrame], sql: str, sample_limit: int = SAMPLE_LIMIT
) -> ExperimentResult:
    """Count the full result and keep its first rows. Errors are reported, never raised.

    The query runs once: its result stays on the executors' disks until both are taken.
    """
    start = time.monotonic()
    out = ExperimentResult()
    try:
        result = select(experiment_session(spark, load), sql).persist(StorageLevel.DISK_ONLY)
        try:
            out.row_count = result.count()
            out.columns = result.columns
            out.sample_rows = [r.asDict(recursive=True) for r in result.limit(sample_limit).collect()]
        finally:
            result.unpersist()
    except Exception as e:
        out = ExperimentResult(error_message=str(e))
    out.execution_time_ms = (time.monotonic() - start) * 1000
    return out


def status(error: Column) -> Column:
    return F.when(error.isNotNull(), "FAILED").otherwise("COMPLETED")


def verdicts(experiments: DataFrame) -> DataFrame:
    """Verdict and QUERY evidence of each (experiment_id, hypothesis_id, row_count, error_message)."""
    ident = stable_id("ev", "experiment_id").alias("evidence_id")
    return experiments.select(ident, "*").selectExpr(
        "experiment_id", "hypothesis_id",
        "CASE WHEN error_message IS NULL AND row_count > 0 THEN 'SUPPORTED' ELSE 'REJECTED' END AS verdict",
        """CASE WHEN error_message IS NOT NULL THEN 'Experiment failed to execute: ' || error_message
             WHEN row_count > 0 THEN 'Experiment found ' || row_count || ' rows supporting the hypothesis.'
             ELSE 'Experiment executed successfully but returned 0 rows, contradicting the hypothesis.' END AS note""",
        "evidence_id", "'QUERY' AS type", "'sql_experiment_result' AS metric",
        "to_json(named_struct('rows', row_count, 'error', error_message), map('ignoreNullFields', 'false')) AS value",
    )


def latest(experiments: DataFrame) -> DataFrame:
    """The experiment of each hypothesis that completed last."""
    return pick_by(experiments, ["hypothesis_id"], ["completed_at", "experiment_id"], last=True)


def illegal_moves(events: DataFrame, bucket: Column) -> DataFrame:
    """Hypothesis events (hypothesis_id, ts, event_id, status) that leave a validated state or return to PROPOSED."""
    moves = previous_value(events, ["hypothesis_id"], ["ts", "event_id"], "status", bucket, "previous_status")
    before, now = F.coalesce("previous_status", F.lit("PROPOSED")), F.col("status")
    first = F.col("previous_status").isNull()
    return moves.filter((before != "PROPOSED") | ((now == "PROPOSED") & ~first))
