"""Registered queries over sources, sinks and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shared import new_path, settle
from ..operators import profile as prof, rules, sketches, transform
from ..sources import fingerprints, readers, split_files, store
from ..streaming import ingest
from .catalog import query, select
from .derived import daily_profiles, event_versions, keyed, order_versions, read
from .oracle import CHANGES, SCHEMAS, columns, profile_sql

GIVEN = [t for t in SCHEMAS if t not in ("ev2", "ord2")]
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _as(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns in the types of another table, for formats whose types are inferred."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in like.schema.fields])


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_version(spark, f"{sf_dir}/orders.parquet")


@query("scan_csv", CUSTOMER)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    path = readers.write_version(customer, new_path(spark, "customer") + ".csv")
    return _as(readers.read_version(spark, path), customer)


@query("scan_ndjson", CUSTOMER)
def scan_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    path = readers.write_version(customer, new_path(spark, "customer") + ".ndjson")
    return _as(readers.read_version(spark, path), customer)


@query("scan_json", CUSTOMER)
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each hold one JSON array of up to 500 records."""
    customer = read(spark, sf_dir, "customer")
    part = F.floor(F.col("c_custkey") / 500).alias("part")
    arrays = customer.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*customer.columns))).alias("value"))
    path = new_path(spark, "customer") + ".json"
    arrays.write.partitionBy("part").text(path)
    return _as(readers.read_version(spark, path).drop("part"), customer)


@query("malformed_rows", "SELECT c_custkey, c_custkey || ',' || c_name || ',extra' AS raw FROM customer WHERE c_mktsegment = 'MACHINERY'")
def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a field too many, set aside with their raw text."""
    customer = read(spark, sf_dir, "customer")
    extra = F.when(F.col("c_mktsegment") == "MACHINERY", ",extra").otherwise("")
    text = customer.select(F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", extra).alias("value"))
    path = new_path(spark, "customer") + ".csv"
    text.write.text(path)
    bad = readers.split_malformed(spark, path, "csv", spark.createDataFrame([], "c_custkey bigint, c_name string").schema)[1]
    return bad.select("c_custkey", F.col(readers.CORRUPT).alias("raw"))


NOTED = "SELECT c_custkey, c_name || chr(10) || 'of \"' || c_mktsegment || '\"' AS note, c_acctbal FROM customer"


@query("scan_csv_split", NOTED)
def scan_csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with quoted newlines, read by as many tasks as the files have blocks."""
    noted = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit('\nof "'), "c_mktsegment", F.lit('"')).alias("note"), "c_acctbal"
    )
    path = readers.write_version(noted, new_path(spark, "customer") + ".csv")
    return _as(split_files.read_csv_split(spark, path), noted)


@query("malformed_rows_split", "SELECT c_custkey, c_custkey || ',\"' || c_name || chr(10) || '\",extra' AS raw FROM customer WHERE c_mktsegment = 'MACHINERY'")
def malformed_rows_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a field too many, found by the split reader, newlines inside."""
    customer = read(spark, sf_dir, "customer")
    extra = F.when(F.col("c_mktsegment") == "MACHINERY", ",extra").otherwise("")
    row = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('\n"'), extra)
    part = F.floor(F.col("c_custkey") / 500).alias("part")
    text = customer.groupBy(part).agg(F.concat(F.lit("id,name\n"), F.array_join(F.collect_list(row), "\n")).alias("value"))
    path = new_path(spark, "customer") + ".csv"
    text.write.partitionBy("part").text(path)
    schema = spark.createDataFrame([], "c_custkey bigint, c_name string").schema
    return split_files.split_malformed_csv(spark, path, schema)[1].select("c_custkey", F.col(readers.CORRUPT).alias("raw"))


@query("scan_json_split", "SELECT c_custkey, c_name, c_mktsegment AS segment, '}{\"][' || c_nationkey AS note FROM customer")
def scan_json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of records that hold objects, braces and quotes, read by as many tasks as the files have blocks."""
    note = F.concat(F.lit('}{"]['), F.col("c_nationkey").cast("string")).alias("note")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment"), note).alias("more"))
    part = F.floor(F.col("c_custkey") / 500).alias("part")
    arrays = customer.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*customer.columns))).alias("value"))
    path = new_path(spark, "customer") + ".json"
    arrays.write.partitionBy("part").text(path)
    return split_files.read_json_split(spark, path, customer.schema).select("c_custkey", "c_name", "more.*")


SCHEMA_SQL = "\nUNION ALL ".join(
    f"SELECT '{t}' AS dataset_id, CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", '{kind}' AS type, "
    f"(SELECT count(*) FROM {t}) AS row_count"
    for t in GIVEN
    for i, (c, kind) in enumerate(columns(t))
)


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in GIVEN:
        rows = fingerprints.schema_rows(read(spark, sf_dir, t), t)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("schema_of", SCHEMA_SQL)
def schema_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schemas(spark, sf_dir)


@query(
    "schema_fingerprint",
    "SELECT dataset_id, left(sha256(string_agg(\"column\" || ':' || type, '' ORDER BY \"column\" || ':' || type)), 16) "
    f"AS schema_fingerprint FROM ({SCHEMA_SQL}) GROUP BY dataset_id",
)
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.schema_fingerprint(_schemas(spark, sf_dir))


FILES_SQL = """
SELECT CAST(floor(c_custkey / 500) AS BIGINT) AS part, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS body
FROM customer GROUP BY 1
"""


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Customer names written as text files of up to 500 lines in key order, one file per part."""
    customer = read(spark, sf_dir, "customer").withColumn("part", F.floor(F.col("c_custkey") / 500))
    path = new_path(spark, "names")
    placed = customer.repartition("part").sortWithinPartitions("part", "c_custkey")
    placed.select("part", F.col("c_name").alias("value")).write.partitionBy("part").text(path)
    return path


@query("file_hash", f"SELECT part, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256 FROM ({FILES_SQL})")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_part(fingerprints.file_hashes(spark, _files(spark, sf_dir))).select("part", "length", "sha256")


@query("file_hash_long", f"SELECT part, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256 FROM ({FILES_SQL})")
def file_hash_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same digests when files over 1 kB are read in pieces."""
    return _with_part(fingerprints.file_hashes(spark, _files(spark, sf_dir), whole_bytes=1000)).select("part", "length", "sha256")


@query("file_fingerprint", f"SELECT part, CAST(strlen(body) AS BIGINT) AS length, true AS stable, true AS schema_matters FROM ({FILES_SQL})")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints stay the same when listed again, and change with the schema fingerprint."""
    path = _files(spark, sf_dir)
    one = fingerprints.file_fingerprints(spark, path, "a").alias("one")
    two = fingerprints.file_fingerprints(spark, path, "a").alias("two")
    other = fingerprints.file_fingerprints(spark, path, "b").alias("other")
    joined = one.join(two, F.col("one.path") == F.col("two.path")).join(other, F.col("one.path") == F.col("other.path"))
    out = joined.select(
        F.col("one.path").alias("path"), F.col("one.length").alias("length"),
        (F.col("one.fingerprint") == F.col("two.fingerprint")).alias("stable"),
        (F.col("one.fingerprint") != F.col("other.fingerprint")).alias("schema_matters"),
    )
    return _with_part(out).select("part", "length", "stable", "schema_matters")


@query("oversize_files", f"SELECT part, CAST(strlen(body) AS BIGINT) AS length FROM ({FILES_SQL}) WHERE strlen(body) > 1500")
def oversize_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_part(readers.oversize_files(spark, _files(spark, sf_dir), max_bytes=1500)).select("part", "length")


def _with_part(files: DataFrame) -> DataFrame:
    return files.withColumn("part", F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint"))


@query(
    "content_hash",
    "SELECT l_returnflag, count(*) AS row_count, true AS same_in_any_order FROM lineitem GROUP BY l_returnflag",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash per group of the table, next to that of the same rows in another order and layout."""
    lineitem = read(spark, sf_dir, "lineitem")
    a = fingerprints.content_hash(lineitem, by=("l_returnflag",))
    moved = lineitem.repartition("l_partkey").sortWithinPartitions("l_extendedprice")
    b = fingerprints.content_hash(moved, by=("l_returnflag",)).withColumnRenamed("content_hash", "_other")
    same = (F.col("content_hash") == F.col("_other")).alias("same_in_any_order")
    return a.join(b.drop("row_count"), "l_returnflag").select("l_returnflag", "row_count", same)


CSV_SQL = """
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || text || ' ' WHEN 3 THEN 'a "b", c' || chr(10) || text WHEN 4 THEN chr(9) || 'x' || chr(13) || chr(10) ELSE text END AS text, lang
FROM documents
"""


@query("csv_round_trip", CSV_SQL)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with newlines, blanks and quotes, empty texts and nulls, written as CSV and read again."""
    n, text = F.col("doc_id") % 10, F.col("text")
    shown = (
        F.when(n == 0, None).when(n == 1, "").when(n == 2, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(n == 3, F.concat(F.lit('a "b", c\n'), text)).when(n == 4, F.lit("\tx\r\n")).otherwise(text)
    )
    documents = read(spark, sf_dir, "documents").select("doc_id", shown.alias("text"), "lang")
    path = readers.write_version(documents, new_path(spark, "documents") + ".csv")
    return readers.read_version(spark, path, schema=documents.schema)


@query("write_version", "SELECT * FROM orders")
def write_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = readers.write_version(read(spark, sf_dir, "orders"), new_path(spark, "orders") + ".parquet")
    return readers.read_version(spark, path)


@query(
    "registry_upsert",
    "SELECT o_orderkey AS investigation_id, CASE WHEN o_orderstatus = 'O' THEN 'INVESTIGATING' ELSE o_orderstatus END AS status, "
    "CAST(CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS INTEGER) AS revision FROM orders",
)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry table written once, updated by an append, and read back at its newest state."""
    orders = read(spark, sf_dir, "orders")
    first = orders.select(
        F.col("o_orderkey").alias("investigation_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("revision")
    )
    root = new_path(spark, "registry")
    store.append(first, root, "investigations")
    moved = first.filter("status = 'O'").withColumn("status", F.lit("INVESTIGATING")).withColumn("revision", F.lit(2))
    store.append(moved, root, "investigations")
    return store.current(store.read_table(spark, root, "investigations"), ["investigation_id"], ["revision"])


# Profiles


def _profile_of(table: str, keep: str) -> str:
    return f"SELECT {keep} FROM ({profile_sql(table, table, '')})"


@query("profile_counts", _profile_of("lineitem", '"column", type, row_count'))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile(read(spark, sf_dir, "lineitem")).select("column", "type", "row_count")


@query("profile_nulls", select(
    f"SELECT \"column\", null_count, null_fraction FROM ({profile_sql('ev2', 'ev2', '')})", "ev2"))
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile(event_versions(spark, sf_dir)[1]).select("column", "null_count", "null_fraction")


@query("profile_distinct_exact", _profile_of("lineitem", '"column", unique_count, unique_fraction'))
def profile_distinct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prof.profile(read(spark, sf_dir, "lineitem"), exact=True)
    return p.select("column", "unique_count", "unique_fraction")


@query("profile_distinct_approx", _profile_of("lineitem", '"column", unique_count, true AS within_15_percent'))
def profile_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts checked against exact ones."""
    lineitem = read(spark, sf_dir, "lineitem")
    approx = prof.profile(lineitem).select("column", F.col("unique_count").alias("_a"))
    exact = prof.distinct_counts(lineitem, [], lineitem.columns)
    near = F.abs(F.col("_a") - F.col("unique_count")) <= 0.15 * F.col("unique_count")
    return exact.join(approx, "column").select("column", "unique_count", near.alias("within_15_percent"))


@query("profile_numeric", _profile_of("lineitem", '"column", min_num, max_num, round(mean, 4) AS mean') + " WHERE mean IS NOT NULL")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prof.profile(read(spark, sf_dir, "lineitem")).filter("mean is not null")
    return p.select(
        "column", F.col("min_value").cast("double").alias("min_num"), F.col("max_value").cast("double").alias("max_num"),
        F.round("mean", 4).alias("mean"),
    )


LONG = '"column", ordinal, type, row_count, null_count, null_fraction, min_num, max_num, round(mean, 4) AS mean'


def _long(p: DataFrame, *extra: str) -> DataFrame:
    return p.select(
        *extra, "column", "ordinal", "type", "row_count", "null_count", "null_fraction",
        F.col("min_value").cast("double").alias("min_num"), F.col("max_value").cast("double").alias("max_num"),
        F.round("mean", 4).alias("mean"),
    )


@query("profile_long", _profile_of("lineitem", LONG))
def profile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole profile with approximate distinct counts, which the comparison leaves out."""
    return _long(prof.profile(read(spark, sf_dir, "lineitem")))


@query("profile_by_version", select(f"SELECT version_number, {LONG}, unique_count FROM daily", "daily"))
def profile_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(daily_profiles(spark, sf_dir), "version_number", "unique_count")


# Means of few values with two digits can lie halfway between two fourth digits, where the last bit decides; not so the seventh.
@query("profile_merged", select(f"SELECT version_number, {LONG.replace('round(mean, 4)', 'round(mean, 7)')}, round(std_dev, 4) AS std_dev, CASE WHEN unique_count IS NULL THEN NULL ELSE true END AS distinct_within_error FROM daily", "daily"))
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of hours merged into days from stored sketches, next to those made from the data of whole days."""
    hourly = read(spark, sf_dir, "events").withColumns({"version_number": F.dayofmonth("ts"), "_hour": F.hour("ts")})
    parts = settle(sketches.mergeable(hourly, by=["version_number", "_hour"]))
    merged = settle(sketches.merge(parts.drop("_hour"), by=["version_number"]))
    exact = daily_profiles(spark, sf_dir).select("version_number", "column", F.col("unique_count").alias("_exact"))
    rows = sketches.read(merged, ["version_number"]).join(exact, ["version_number", "column"])
    near = F.abs(F.col("unique_count") - F.col("_exact")) <= sketches.distinct_error() * F.col("_exact") + 1
    rows = rows.withColumn("distinct_within_error", near).withColumn("_mean", F.round("mean", 7))
    out = _long(rows, "version_number", F.round("std_dev", 4).alias("std_dev"), "distinct_within_error", "_mean")
    return out.withColumn("mean", F.col("_mean")).drop("_mean")


@query("profile_full", _profile_of("customer", f"{LONG}, unique_count, unique_fraction, round(std_dev, 4) AS std_dev"))
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prof.profile(read(spark, sf_dir, "customer"), exact=True)
    return _long(p, "unique_count", "unique_fraction", F.round("std_dev", 4).alias("std_dev"))


@query("profile_store", select(
    'SELECT dataset_id, version_number, "column", row_count, null_count, unique_count FROM prof WHERE dataset_id = \'orders\'', "prof"))
def profile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of two versions appended to a store partitioned by dataset, then read for one dataset."""
    root = new_path(spark, "profiles")
    for n, df in enumerate(order_versions(spark, sf_dir), start=1):
        store.append(keyed(prof.profile(df, exact=True), "orders", n), root, "column_profiles", ("dataset_id",))
    stored = store.read_table(spark, root, "column_profiles").filter("dataset_id = 'orders'")
    return stored.select("dataset_id", "version_number", "column", "row_count", "null_count", "unique_count")


@query("profile_report", select(
    "SELECT ordinal, \"column\" || ' (' || type || '): ' || unique_count || ' unique, ' || printf('%.1f', null_fraction * 100) || '% nulls' AS line "
    f"FROM ({profile_sql('ev2', 'ev2', '')})", "ev2"))
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.report(prof.profile(event_versions(spark, sf_dir)[1], exact=True))


QUANTILES = (0.25, 0.5, 0.75)


@query("profile_quantiles", "\nUNION ALL ".join(
    f"SELECT CAST({v} AS INTEGER) AS version_number, '{c}' AS \"column\", {q} AS quantile, true AS within_2_percent FROM {rel} HAVING count(*) > 0"
    for v, rel in ((1, "events"), (2, "events")) for c in ("value",) for q in ("0.25::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE")))
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate quantiles of both versions, checked by the share of values at or below each."""
    out = None
    for n, df in enumerate(event_versions(spark, sf_dir), start=1):
        p = prof.profile(df, columns=["value"], quantiles=QUANTILES)
        q = p.select("column", F.posexplode("quantiles").alias("_i", "_q")).withColumn(
            "quantile", F.element_at(F.array(*[F.lit(x) for x in QUANTILES]), F.col("_i") + 1)
        )
        cuts = {i: q.filter(F.col("_i") == i).select("_q").scalar() for i in range(len(QUANTILES))}
        shares = df.filter("value is not null").agg(
            *[F.avg((F.col("value") <= cuts[i]).cast("double")).alias(f"s{i}") for i in cuts]
        )
        near = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(x).alias("quantile"), (F.abs(F.col(f"s{i}") - x) <= 0.02).alias("within_2_percent")
                    )
                    for i, x in enumerate(QUANTILES)
                ]
            )
        )
        rows = shares.select(near.alias("_r")).select(
            F.lit(n).alias("version_number"), F.lit("value").alias("column"), "_r.*"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# Transformations


@query("drop_duplicates", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.drop_duplicates(
        read(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]
    )


@query("fill_nulls", select(
    "SELECT event_id, ts, user_id, event_type, coalesce(value, -1.0::DOUBLE) AS value, channel FROM ev2", "ev2"))
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.fill_nulls(event_versions(spark, sf_dir)[1], "value", -1.0)


@query("transform_rules", select("""
SELECT 'NotNullRule' AS rule, 'value' AS "column", count(*) FILTER (WHERE value IS NULL) AS violations_before, 0::BIGINT AS violations_after, 'passed' AS status, count(*) FILTER (WHERE value IS NULL) AS repaired FROM ev2
UNION ALL SELECT 'RangeRule', 'value', count(*) FILTER (WHERE value < 0), count(*) FILTER (WHERE value < 0 OR value IS NULL),
  CASE WHEN count(*) FILTER (WHERE value < 0 OR value IS NULL) = 0 THEN 'passed' ELSE 'failed' END, -count(*) FILTER (WHERE value IS NULL) FROM ev2""", "ev2"))
def transform_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the filled column before and after nulls became -1: one is repaired, one is broken."""
    ev2 = event_versions(spark, sf_dir)[1]
    checks = [rules.not_null("value"), rules.in_range("value", 0), rules.not_null("channel")]
    out = transform.rerun_rules(ev2, transform.filling("value", -1.0)(ev2), checks, ["value"])
    return out.select("rule", "column", "violations_before", "violations_after", "status", "repaired")


@query("transform_rows", """
SELECT CASE WHEN o_totalprice IS NULL OR o_orderkey % 5 = 0 THEN 'modified' ELSE 'same' END AS row_status, count(*) AS n_rows FROM orders GROUP BY 1""")
def transform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that filling nulls changes, by key."""
    orders = read(spark, sf_dir, "orders")
    gaps = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    return transform.affected_rows(gaps, transform.filling("o_totalprice", -1.0)(gaps), ["o_orderkey"])


_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_ROW_DIGEST = "('0x' || left(sha256(" + " || ".join(_VALUE.format(c) for c in ("c_custkey", "c_name", "c_mktsegment")) + "), 15))::BIGINT"


@query("content_digest", f"""
SELECT c_nationkey, count(*) AS row_count, CAST(sum({_ROW_DIGEST}) AS VARCHAR) AS content_digest
FROM (SELECT c_nationkey, c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer) GROUP BY c_nationkey""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of the customers of each nation, made of SHA-256, compared by value."""
    customer = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    out = fingerprints.content_digest(customer, by=("c_nationkey",))
    return out.withColumn("content_digest", F.col("content_digest").cast("string"))


LINEAGE_EDGES = "SELECT 'v' || (c_custkey // 3) AS input_fingerprint, 'v' || c_custkey AS output_fingerprint FROM customer WHERE c_custkey > 0"


@query("lineage_ancestors", f"""
WITH RECURSIVE edges AS ({LINEAGE_EDGES} UNION ALL SELECT 'v' || (c_custkey // 5), 'v' || c_custkey FROM customer WHERE c_custkey % 50 = 49),
up AS (SELECT output_fingerprint AS version, input_fingerprint AS ancestor, 1 AS steps FROM edges
  UNION SELECT up.version, edges.input_fingerprint, up.steps + 1 FROM up JOIN edges ON edges.output_fingerprint = up.ancestor)
SELECT version, ancestor, CAST(min(steps) AS INTEGER) AS steps FROM up GROUP BY version, ancestor""")
def lineage_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every version in a log of steps, some of which had two inputs."""
    key = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("v"), c.cast("bigint").cast("string"))
    customer = read(spark, sf_dir, "customer")
    steps = customer.filter("c_custkey > 0").select(name(F.floor(key / 3)).alias("input_fingerprint"), name(key).alias("output_fingerprint"))
    more = customer.filter("c_custkey % 50 = 49").select(name(F.floor(key / 5)).alias("input_fingerprint"), name(key).alias("output_fingerprint"))
    return transform.ancestors(steps.unionByName(more))


@query("transform_log", select("""
SELECT CAST(1 AS INTEGER) AS step, 'drop_duplicates' AS type_name, 'event_id' AS affected, count(DISTINCT event_id) AS n_rows, true AS chained,
  'df = drop_duplicates(df, subset=[''event_id''], order_key=[''ts''])' AS generated_code FROM ev2
UNION ALL SELECT 2, 'fill_nulls', 'value', count(DISTINCT event_id), true, 'df = fill_nulls(df, column=''value'', value=0.0)' FROM ev2""", "ev2"))
def transform_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repairs in a row, each a new version; the second starts from the fingerprint of the first."""
    ev2 = event_versions(spark, sf_dir)[1]
    paths = [new_path(spark, f"step{i}") + ".parquet" for i in (1, 2)]
    start = fingerprints.table_fingerprint(ev2)
    one = transform.write_step(ev2, transform.dropping(["event_id"], ["ts"]), paths[0], start)
    clean = readers.read_version(spark, paths[0])
    middle = fingerprints.table_fingerprint(clean)
    two = transform.write_step(clean, transform.filling("value", 0.0), paths[1], middle)
    end = fingerprints.table_fingerprint(readers.read_version(spark, paths[1]))
    out = None
    for step, (row, path) in enumerate(zip((one, two), paths), start=1):
        rows = readers.read_version(spark, path).agg(F.count(F.lit(1))).scalar()
        expected = F.col("input_fingerprint") == (start if step == 1 else middle)
        chained = expected & (F.col("output_fingerprint") == (middle if step == 1 else end)) & (F.lit(middle != end))
        line = row.select(
            F.lit(step).alias("step"), "type_name", F.array_join("affected_columns", ",").alias("affected"),
            rows.alias("n_rows"), chained.alias("chained"), "generated_code",
        )
        out = line if out is None else out.unionByName(line)
    return out


@query("transform_check", select("""
SELECT "column", 'column' AS change_kind, metric, change_type, round(absolute_delta, 6) AS absolute_delta, false AS unintended FROM (
  SELECT 'value' AS "column", 'null_fraction' AS metric, 'null_rate_shift' AS change_type,
    CAST(0 AS DOUBLE) - (count(*) - count(value)) / count(*) AS absolute_delta FROM ev2
  UNION ALL SELECT 'value', 'mean', 'distribution_shift', avg(coalesce(value, 0)) - avg(value) FROM ev2
  UNION ALL SELECT 'value', 'min_value', 'min_shift', least(min(value), 0) - min(value) FROM ev2
  UNION ALL SELECT 'value', 'unique_fraction', 'cardinality_shift',
    (count(DISTINCT coalesce(value, 0)) / count(*)) - (count(DISTINCT value) / count(*)) FROM ev2)
WHERE abs(absolute_delta) > CASE WHEN metric = 'min_value' THEN 0 ELSE 0.0001 END""", "ev2"))
def transform_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile before and after filling nulls; only the filled column may change."""
    ev2 = event_versions(spark, sf_dir)[1]
    out = transform.transform_check(ev2, transform.fill_nulls(ev2, "value", 0.0), ["value"])
    return out.withColumn("absolute_delta", F.round("absolute_delta", 6))


# Ingestion


EXACT = ("event_id", "user_id")
WEEKLY_CHANGES = (
    f"SELECT * FROM ({CHANGES.replace('FROM joined', 'FROM weekly_joined').replace('FROM pairs', 'FROM weekly_pairs')}) "
    f"WHERE change_type <> 'cardinality_shift' OR \"column\" IN {EXACT}"
)


@query("ingest_stream", select(
    'SELECT dataset_id, CAST(version_number AS BIGINT) AS version_number, "column", change_kind, metric, change_type, '
    f"round(absolute_delta, 6) AS absolute_delta FROM ({WEEKLY_CHANGES})",
    "weekly_joined"))
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between weeks of events that arrive as versions, one of them twice, through the streaming ingest."""
    found = ingest.table(spark, _ingested(spark, sf_dir), "changes")
    return found.select(
        "dataset_id", "version_number", "column", "change_kind", "metric", "change_type",
        F.round("absolute_delta", 6).alias("absolute_delta"),
    )


def _changed(where: str) -> str:
    return f"(SELECT count(*) FROM c a WHERE a.version_number = f.version_number AND {where})"


@query("ingest_investigations", select(f"""
SELECT 'ws' AS workspace_id, dataset_id, CAST(version_number AS BIGINT) AS version_number, 'OPEN' AS status, count(*) AS n_findings, count(*) AS n_evidence,
  CAST(sum(near + CASE WHEN far > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_attributions FROM (
  SELECT f.*, {_changed("a.column IN (f.column, '*dataset*')").replace('.column', '."column"')} AS near, {_changed("a.column NOT IN (f.column, '*dataset*')").replace('.column', '."column"')} AS far
  FROM (SELECT * FROM c WHERE CASE change_type WHEN 'null_rate_shift' THEN absolute_delta > 0.05 WHEN 'cardinality_shift' THEN absolute_delta < -0.05
    WHEN 'distribution_shift' THEN abs(relative_delta) > 0.1 ELSE change_type IN ('type_changed', 'removed', 'added') END) f) GROUP BY 1, 2, 3, 4""".replace("FROM c", f"FROM ({WEEKLY_CHANGES})"), "weekly_joined"))
def ingest_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigations that the ingest opened, with their findings, evidence and attributions."""
    root = _ingested(spark, sf_dir)
    keys = ["workspace_id", "dataset_id", "version_number"]
    counts = [ingest.table(spark, root, t).groupBy(*keys).agg(F.count("*").alias(f"n_{n}")) for t, n in (("evidence", "evidence"), ("attributions", "attributions"))]
    opened = ingest.table(spark, root, "investigations").select(*keys, "status", "n_findings")
    return opened.join(counts[0], keys).join(counts[1], keys)


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Root of the tables that an ingest of six arrivals leaves."""
    root = new_path(spark, "ingest")
    events = read(spark, sf_dir, "events")
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int") + 1
    events.withColumn("week", week).write.partitionBy("week").parquet(f"{root}/events")
    for arrival, w in enumerate([1, 2, 2, 3, 4, 5], start=1):
        row = spark.range(1).select(
            F.lit("ws").alias("workspace_id"), F.lit("events").alias("dataset_id"), F.lit(f"{root}/events/week={w}").alias("path"),
            F.lit("parquet").alias("format"),
            F.lit(f"hash{w}").alias("file_hash"), F.lit(arrival).cast("bigint").alias("arrival"),
        )
        row.coalesce(1).write.mode("append").json(f"{root}/manifests")
    ingest.watch(spark, f"{root}/manifests", f"{root}/registry", f"{root}/checkpoint", per_batch=3, exact=EXACT).awaitTermination()
    return f"{root}/registry"
