"""Inputs derived from the given tables: versions with known defects, and registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shared import settle
from ..operators import attribution, diff, drift, experiment, rootcause
from ..operators.profile import profile


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``events``, and a later version with nulls, doubled values, repeated ids and a changed schema."""
    ev1 = read(spark, sf_dir, "events")
    key = F.col("event_id")
    ev2 = ev1.select(
        (key - key % 2).alias("event_id"),
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.when(key % 7 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 10 != 0, F.col("value") * 2).alias("value"),
        F.lit("web").alias("channel"),
    )
    return ev1, ev2


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``orders``, and a later version with rows lost and keys repeated."""
    ord1 = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return ord1, ord1.filter(key % 9 != 0).withColumn("o_orderkey", key - key % 2)


def keyed(p: DataFrame, dataset_id: str, version_number: int) -> DataFrame:
    return p.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(version_number).cast("int").alias("version_number"), "*"
    )


def pair_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact profiles of both versions of events and orders, stored so that the data is read once."""
    ev1, ev2 = event_versions(spark, sf_dir)
    ord1, ord2 = order_versions(spark, sf_dir)
    parts = [("events", 1, ev1), ("events", 2, ev2), ("orders", 1, ord1), ("orders", 2, ord2)]
    out = None
    for dataset_id, number, df in parts:
        p = keyed(profile(df, exact=True), dataset_id, number)
        out = p if out is None else out.unionByName(p)
    return settle(out)


def daily_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version of ``events`` per day, all profiled in one job."""
    daily = read(spark, sf_dir, "events").withColumn("version_number", F.dayofmonth("ts"))
    p = profile(daily, by=["version_number"], exact=True)
    return settle(p.select(F.lit("events").alias("dataset_id"), "*"))


def target_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact profiles of the tables the rules run on."""
    tables = {
        "customer": read(spark, sf_dir, "customer"),
        "documents": read(spark, sf_dir, "documents"),
        "events": event_versions(spark, sf_dir)[1],
        "part": read(spark, sf_dir, "part"),
    }
    out = None
    for name, df in tables.items():
        p = profile(df, exact=True).select(F.lit(name).alias("dataset_id"), "*")
        out = p if out is None else out.unionByName(p)
    return settle(out)


def pair_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(diff.changes(pair_profiles(spark, sf_dir)))


class Case:
    """Everything derived from the version pairs, each step stored once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.profiles = pair_profiles(spark, sf_dir)
        self.changes = settle(diff.changes(self.profiles))
        self.findings = drift.findings(self.changes)
        self.investigations = drift.open_investigations(self.findings)

    def attribute(self) -> Case:
        self.attributions = settle(attribution.attribute(self.findings, self.changes))
        self.hypotheses = attribution.hypotheses(self.attributions)
        return self

    def validate(self) -> Case:
        """Test each hypothesis with the nulls its change's column now holds; unrelated ones stay open."""
        nulls = self.profiles.select("dataset_id", "version_number", F.col("column").alias("change_column"), "null_count")
        tested = self.attributions.filter("change_kind = 'column'").join(
            nulls, ["dataset_id", "version_number", "change_column"]
        )
        hyp = self.hypotheses.select("attribution_id", "hypothesis_id")
        runs = tested.join(hyp, "attribution_id").select(
            F.concat(F.lit("exp_"), "hypothesis_id").alias("experiment_id"), "hypothesis_id",
            F.col("null_count").alias("row_count"), F.lit(None).cast("string").alias("error_message"),
        )
        self.validations = experiment.verdicts(runs)
        return self

    def rank(self) -> Case:
        self.candidates = settle(rootcause.candidates(self.attributions, self.hypotheses, self.validations))
        self.strongest = rootcause.strongest(self.candidates)
        return self


# Registry tables: nations as datasets, customers as versions, orders as investigations, line items as findings.


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("ws_"), F.col("n_regionkey").cast("string")).alias("workspace_id"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.floor(F.col("c_acctbal") / 1000).cast("string")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("version_id"), F.col("c_nationkey").alias("dataset_id"),
        (F.col("c_custkey") + 1).alias("version_number"),
        F.concat_ws("-", "c_mktsegment", level).alias("file_hash"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.floor(F.col("s_acctbal") / 1000).cast("string")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("arrival"), F.col("s_nationkey").alias("dataset_id"),
        F.concat_ws("-", F.lit("HOUSEHOLD"), level).alias("file_hash"),
    )


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("investigation_id"), F.col("o_custkey").alias("version_id"),
        F.when(status == "F", "RESOLVED").when(status == "O", "OPEN").otherwise("INVESTIGATING").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("Incident "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("description"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    severity = F.when(q >= 46, "CRITICAL").when(q >= 31, "HIGH").when(q >= 16, "MEDIUM").when(q >= 6, "LOW").otherwise("INFO")
    metric = (
        F.when(n == 1, "null_fraction").when(n == 2, "unique_fraction").when(n == 3, "mean").when(n == 4, "row_count")
        .when(n == 5, "min_value").when(n == 6, "max_value").otherwise("type")
    )
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("finding_id"),
        F.col("l_orderkey").alias("investigation_id"), severity.alias("severity"), metric.alias("metric"),
        F.concat(F.lit("col_"), (F.col("l_partkey") % 20).cast("string")).alias("column"),
        F.when(flag == "A", "SUPPORTED").when(flag == "R", "REJECTED").otherwise("PROPOSED").alias("hypothesis_status"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("experiment_id"), F.col("o_custkey").alias("hypothesis_id"),
        F.col("o_orderdate").alias("completed_at"),
        F.floor(F.col("o_totalprice") / 100000).alias("row_count"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "TABLE_OR_VIEW_NOT_FOUND").alias("error_message"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as responses in two investigations, each with a claim added by conversation."""
    conv, turn = F.col("conv_id"), F.col("turn").cast("string")
    claim = (
        F.when(conv % 6 == 0, F.lit("The column 'conv_id' shows metric 'null_fraction'."))
        .when(conv % 6 == 1, F.concat(F.lit("The column 'ghost_"), turn, F.lit("' drifted.")))
        .when(conv % 6 == 2, F.lit("Look at metric 'vibes' first."))
        .when(conv % 6 == 3, F.lit("This is a STRONG root cause."))
        .when(conv % 6 == 4, F.lit("The hypothesis is confirmed."))
        .otherwise(F.lit("The column 'conv_id' is fine."))
    )
    sql = (
        F.when(conv % 5 == 0, F.lit("DROP TABLE dataset; delete from dataset"))
        .when(conv % 5 == 1, F.lit("SELECT drop_count FROM dataset"))
        .otherwise(F.concat(F.lit("SELECT count(*) FROM dataset WHERE turn = "), turn))
    )
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        F.concat_ws("-", conv.cast("string"), turn).alias("response_id"),
        (conv % 2).alias("investigation_id"),
        F.col("text").alias("answer"),
        F.array(claim).alias("claims"),
        F.array(sql).alias("queries"),
        F.array(
            F.concat(F.lit("ev_"), conv.cast("string")), F.concat(F.lit("ev_"), (conv * 20).cast("string"))
        ).alias("citations"),
        (conv % 2 == 0).alias("has_strong"),
        (F.col("turn") > 2).alias("has_supported"),
    )
