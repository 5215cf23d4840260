import datetime
import math
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, profile as prof, recommend, rules, semantics

T2 = [(1, "a", 10), (2, "b", 20), (3, None, 30), (4, "d", 40), (5, "e", 50), (1, "f", 60)]
T5 = [(1, 10.0), (2, 20.0), (3, 30.0), (3, 40.0), (4, 50.0), (5, 60.0)]
T6 = [(1, 10.0), (2, None), (3, None), (4, None), (5, 50.0)]
T7 = [(1, 9.99), (2, 9.99), (3, 9.99), (4, 19.99)]


def by_column(p):
    return {r["column"]: r for r in p.collect()}


@pytest.mark.parametrize("exact", [True, False])
def test_profile_of_users(spark, exact):
    p = by_column(prof.profile(spark.createDataFrame(T2, "id bigint, name string, age bigint"), exact=exact))
    assert p["name"]["row_count"] == 6 and p["name"]["null_fraction"] == 1 / 6
    assert (p["id"]["min_value"], p["id"]["max_value"]) == ("1", "5")
    assert p["id"]["unique_count"] == 5 and p["id"]["unique_fraction"] == 5 / 6
    assert p["age"]["mean"] == 35.0 and math.isclose(p["age"]["std_dev"], statistics.stdev([10, 20, 30, 40, 50, 60]))
    assert p["name"]["min_value"] is None and p["name"]["mean"] is None


def test_empty_table_has_zero_fractions(spark):
    p = by_column(prof.profile(spark.createDataFrame([], "a int, b string"), exact=True))
    assert p["a"]["row_count"] == 0 and p["a"]["null_fraction"] == 0.0 and p["a"]["unique_fraction"] == 0.0


def test_exact_counts_of_every_type(spark):
    day, moment = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, 5)
    schema = "g int, d double, s string, b boolean, dt date, ts timestamp, n timestamp_ntz, dec decimal(9,2), arr array<int>, bin binary"
    long = "x" * 100
    data = [
        (1, 0.0, "a", True, day, moment, moment, Decimal(1), [1], b"a"),
        (1, -0.0, "a", False, day, moment, moment, Decimal(1), [1], b"b"),
        (1, float("nan"), long + "1", None, None, None, None, None, None, None),
        (2, float("nan"), long + "2", None, day, moment, moment, Decimal(2), [2], b"a"),
        (2, None, None, None, None, None, None, None, [], None),
    ]
    df = spark.createDataFrame(data, schema)
    p = by_column(prof.profile(df, exact=True))
    got = {c: p[c]["unique_count"] for c in p}
    assert got == {"g": 2, "d": 2, "s": 3, "b": 2, "dt": 1, "ts": 1, "n": 1, "dec": 2, "arr": 3, "bin": 2}
    grouped = {(r["g"], r["column"]): r["unique_count"] for r in prof.profile(df, by=["g"], exact=True).collect()}
    assert grouped[(1, "s")] == 2 and grouped[(2, "s")] == 1 and grouped[(2, "b")] == 0


def test_profile_by_null_version_and_repartitioning(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("v"), (F.col("id") % 7).alias("x")
    )
    def run(d):
        p = prof.profile(d, by=["v"], exact=True).withColumn("std_dev", F.round("std_dev", 9))
        return sorted(map(repr, p.withColumn("mean", F.round("mean", 9)).collect()))

    assert run(df) == run(df.repartition(13, "x"))
    assert {r["row_count"] for r in prof.profile(df, by=["v"], exact=True).collect()} == {334, 333}


def test_wide_table_goes_in_several_passes(spark):
    df = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(230)])
    p = by_column(prof.profile(df))
    assert len(p) == 230 and p["c229"]["max_value"] == "233"


def test_column_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "`odd name` int, `it's.x` string")
    p = by_column(prof.profile(df, exact=True))
    assert p["odd name"]["unique_count"] == 2 and p["it's.x"]["unique_count"] == 1


def test_quantiles(spark):
    p = by_column(prof.profile(spark.range(101), quantiles=[0.25, 0.5]))
    assert p["id"]["quantiles"] == [25.0, 50.0]


def test_report(spark):
    p = prof.profile(spark.createDataFrame(T2, "id bigint, name string, age bigint"), exact=True)
    assert {r["line"] for r in prof.report(p).collect()} >= {"name (VARCHAR): 5 unique, 16.7% nulls"}


CASES = [  # name, type, rows, unique, null fraction -> class, role, sensitivity
    (("email", "VARCHAR", 1000, 990, 0.0), ("STRING", "IDENTIFIER", "PII")),
    (("revenue", "DOUBLE", 1000, 800, 0.1), ("DOUBLE", "MEASURE", "NON_PII")),
    (("customer_id", "BIGINT", 1000, 10, 0.5), ("INTEGER", "IDENTIFIER", "NON_PII")),
    (("country", "VARCHAR", 1000, 20, 0.0), ("STRING", "CATEGORY", "NON_PII")),
    (("created_at", "VARCHAR", 1000, 1000, 0.0), ("STRING", "DATETIME", "NON_PII")),
    (("ts", "TIMESTAMP", 10, 10, 0.0), ("DATETIME", "DATETIME", "NON_PII")),
    (("is_new", "INTEGER", 1000, 2, 0.0), ("INTEGER", "BOOLEAN", "NON_PII")),
    (("grade", "INTEGER", 1000, 9, 0.0), ("INTEGER", "CATEGORY", "NON_PII")),
    (("grade", "INTEGER", 100, 9, 0.0), ("INTEGER", "MEASURE", "NON_PII")),
    (("notes", "VARCHAR", 1000, 500, 0.2), ("STRING", "TEXT", "NON_PII")),
    (("notes", "VARCHAR", 1000, 960, 0.2), ("STRING", "TEXT", "NON_PII")),
    (("tags", "ARRAY<DATE>", 10, 5, 0.0), ("UNKNOWN", "UNKNOWN", "NON_PII")),
    (("price", "DECIMAL", 10, 10, 0.0), ("DOUBLE", "MEASURE", "NON_PII")),
    (("Home_Phone", "VARCHAR", 0, 0, 0.0), ("STRING", "TEXT", "PII")),
]


@pytest.mark.parametrize("given,expected", CASES)
def test_semantics(spark, given, expected):
    p = spark.createDataFrame([given], "column string, type string, row_count long, unique_count long, null_fraction double")
    r = semantics.classify(p).first()
    assert (r["physical_type"], r["semantic_role"], r["sensitivity"]) == expected


def find(spark, data, schema="customer_id bigint, revenue double"):
    return rules.quality_findings(spark.createDataFrame(data, schema)).collect()


def test_duplicate_key_is_found(spark):
    (f,) = find(spark, T5)
    assert (f["column"], f["category"], f["severity"], f["impact_score"], f["violations"]) == (
        "customer_id", "UNIQUENESS", "HIGH", 0.637, 1)
    assert f["title"] == "Column 'customer_id' failed Unique rule"
    assert f["description"] == "Found 1 duplicate records/groups. Context: Column is classified as IDENTIFIER"


def test_null_explosion_is_at_most_medium(spark):
    (f,) = find(spark, T6)
    assert f["category"] == "COMPLETENESS" and f["severity"] in ("MEDIUM", "LOW", "INFO")


def test_negative_control_has_no_finding(spark):
    assert find(spark, T7) == []


def test_null_rows_count_as_duplicates(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "k int")
    (r,) = rules.evaluate(df, [rules.unique("k")]).collect()
    assert (r["violations"], r["status"]) == (2, "failed")


def test_absent_column_is_unknown_and_raises_no_finding(spark):
    df = spark.createDataFrame([(1,)], "k int")
    results = rules.evaluate(df, [rules.not_null("gone"), rules.not_null("k")])
    assert {(r["column"], r["status"]) for r in results.collect()} == {("gone", "unknown"), ("k", "passed")}
    assert rules.findings(results, semantics.classify(prof.profile(df))).count() == 0


def test_findings_from_profile_equal_those_from_rules(spark):
    df = spark.createDataFrame(T5 + [(None, None)], "customer_id bigint, revenue double")
    p = prof.profile(df, exact=True)
    a = rules.findings(rules.results_from_profile(p), semantics.classify(p))
    b = rules.findings(rules.evaluate(df, rules.standard_rules(df.columns)), semantics.classify(p))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("rule,role,share,conf,score,sev", [
    ("UniqueRule", "IDENTIFIER", 1.0, 1.0, 1.0, "CRITICAL"),
    ("UniqueRule", "IDENTIFIER", 0.0001, 0.98, 0.637, "HIGH"),
    ("NotNullRule", "IDENTIFIER", 0.1, 0.95, 0.4322, "MEDIUM"),
    ("NotNullRule", "MEASURE", 0.1, 0.5, 0.1592, "INFO"),
    ("NotNullRule", "CATEGORY", 0.1, 0.5, 0.1137, "INFO"),
    ("NotNullRule", "DATETIME", 0.1, 0.5, 0.182, "INFO"),
    ("RangeRule", "MEASURE", 1.0, 2.0, 0.35, "LOW"),
])
def test_impact(spark, rule, role, share, conf, score, sev):
    row = spark.createDataFrame(
        [(rule, role, int(share * 10000), 10000, conf)], "rule string, semantic_role string, violations long, row_count long, confidence double"
    )
    r = rules.with_impact(row).first()
    assert (r["impact_score"], r["severity"]) == (score, sev)


def test_other_rules(spark):
    df = spark.createDataFrame(
        [("a@x.com", 5, "3"), ("invalid-email", -400, "x"), (None, None, None)], "email string, revenue int, code string"
    )
    checks = [
        rules.matches("email", "^[^@]+@[^@]+$"), rules.in_range("revenue", 0, 100), rules.castable("code", "int"),
        rules.member_of("code", ["3"]),
    ]
    assert [r["violations"] for r in rules.evaluate(df, checks).collect()] == [1, 1, 1, 1]


def test_freshness(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "ts timestamp_ntz")
    now = F.lit("2024-01-02 01:00:00").cast("timestamp_ntz")
    assert rules.evaluate(df, [rules.fresh("ts", now, 24)]).first()["status"] == "failed"
    assert rules.evaluate(df, [rules.fresh("ts", now, 26)]).first()["status"] == "passed"
    assert rules.evaluate(df.limit(0), [rules.fresh("ts", now, 26)]).first()["status"] == "failed"


def test_referential(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    r = rules.referential(child, "k", parent, "id", "k").first()
    assert (r["row_count"], r["violations"]) == (5, 2)


def test_one_bad_rule_leaves_the_others_alone(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "s string, n int, t string")
    checks = [
        rules.not_null("t"), rules.in_range("s", 1, 5), rules.in_range("n", "low", "high"), rules.fresh("n", F.current_timestamp(), 1),
        rules.matches("s", "(open"), rules.matches("n", "x"), rules.castable("s", "no_type"), rules.member_of("n", ["a"]), rules.in_range("n", 0, 1),
    ]
    got = [(r["rule"], r["violations"], r["status"]) for r in rules.evaluate(df, checks).collect()]
    assert sorted((n, v, s) for n, v, s in got if s != "unknown") == [("NotNullRule", 1, "failed"), ("RangeRule", 1, "failed")]
    assert len(got) == len(checks)


def test_parameters_survive_the_round_trip(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 20, "2024-01-02")], "s string, n int, d string").withColumn("d", F.to_date("d"))
    checks = [
        rules.in_range("n", 0, 9), rules.in_range("d", datetime.date(2024, 1, 2)), rules.matches("s", "^a"), rules.member_of("s", ["a", "it's"]),
        rules.castable("s", "int"), rules.fresh("d", F.lit("2024-02-01"), 24),
    ]
    semantics_of = semantics.classify(prof.profile(df))
    found = rules.findings(rules.evaluate(df, checks), semantics_of)
    again = rules.rules_from_json([r["rule_json"] for r in rules.export_rules(found).collect()], now=F.lit("2024-02-01"))

    def results(rs):
        return sorted((r["rule"], r["column"], r["violations"], r["status"]) for r in rules.evaluate(df, rs).collect())

    assert results(again) == results(checks) and all(s == "failed" for *_, s in results(again))
    ref = rules.referential(df, "n", df.filter("n = 1"), "n", "n")
    (text,) = [r["rule_json"] for r in rules.export_rules(rules.findings(ref, semantics_of)).collect()]
    with pytest.raises(ValueError):
        rules.rules_from_json([text])


def test_unique_columns_are_found_without_a_name(spark):
    for n in (3000, 5000, 7000):
        df = spark.range(n).select(F.col("id").alias("serial"), (F.col("id") % 7).alias("kind")).union(spark.createDataFrame([(0, 0)], "serial long, kind long"))
        found = {(r["rule"], r["column"], r["violations"]) for r in rules.quality_findings(df).collect()}
        assert ("UniqueRule", "serial", 1) in found


def test_schema_and_distribution_findings(spark):
    before, after = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("1", 2.0)], "a string, c double")
    p = prof.profile(after)
    results = rules.schema_results(p, prof.profile(before).select("column", "type"))
    found = rules.findings(results, semantics.classify(p)).collect()
    assert sorted((r["column"], r["category"], r["violations"]) for r in found) == [("a", "SCHEMA", 1), ("b", "SCHEMA", 1), ("c", "SCHEMA", 1)]
    same = rules.schema_results(p, p.select("column", "type")).collect()
    assert [(r["status"], r["violations"]) for r in same] == [("passed", 0)]
    allowed = spark.createDataFrame([("1",), (None,)], "v string")
    r = rules.member_of_table(spark.createDataFrame([("1",), ("2",), (None,)], "a string"), "a", allowed, "v").first()
    assert (r["rule"], r["row_count"], r["violations"], r["status"]) == ("SetMembershipRule", 3, 1, "failed")


def test_a_subject_found_in_part_scores_nothing(spark):
    labels = spark.createDataFrame([("A", 2, False), ("B", 1, False)], "subject_id string, n_expected int, is_control boolean")
    found = spark.createDataFrame([("A", "LOW", True), ("B", "LOW", True), ("B", "LOW", True)], "subject_id string, severity string, has_evidence boolean")
    r = evaluate.detection_accuracy(labels, found).first()
    assert (r["true_positives"], r["false_negatives"], r["detection_accuracy"]) == (1, 1, 50.0)


def test_export_and_import(spark):
    found = rules.quality_findings(spark.createDataFrame(T5, "customer_id bigint, revenue double"))
    texts = [r["rule_json"] for r in rules.export_rules(found.withColumn("dataset_id", F.lit("t5"))).collect()]
    again = rules.rules_from_json(texts)
    assert [(r.rule, r.column) for r in again] == [("UniqueRule", "customer_id")]


def test_null_correlation_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 2), ("b", 2, 3), ("b", 1, 4)], "batch string, k int, v int")
    got = {r["batch"]: r["null_rate"] for r in rules.null_correlation(df, "v", F.col("batch"), "batch").collect()}
    assert got == {"a": 0.5, "b": 0.0}
    share = {r["batch"]: (r["n_repeated"], r["repeated_share"]) for r in rules.duplicate_share(df, ["k"], "batch").collect()}
    assert share == {"a": (2, 1.0), "b": (1, 0.5)}


def test_recommendations_in_order(spark):
    f = spark.createDataFrame(
        [("f1", "id", "UNIQUENESS", 0.6), ("f2", "x", "COMPLETENESS", 0.2), ("f3", "y", "SCHEMA", 0.9)],
        "finding_id string, column string, category string, impact_score double",
    )
    got = [(r["finding_id"], r["target"], r["priority"]) for r in recommend.ordered(recommend.recommend(f)).collect()]
    assert got == [
        ("f1", "created_at", "P1"), ("f1", "ingestion_batch_id", "P2"), ("f1", "source_file", "P3"),
        ("f2", "null_distribution", "P1"),
    ]


def test_accuracy_of_the_three_sets(spark):
    labels = spark.createDataFrame([("A", 1, False), ("B", 1, False), ("K", 0, True)], "subject_id string, n_expected int, is_control boolean")
    found = None
    for name, data in (("A", T5), ("B", T6), ("K", T7)):
        f = rules.quality_findings(spark.createDataFrame(data, "customer_id bigint, revenue double"))
        f = f.select(F.lit(name).alias("subject_id"), "severity", F.lit(True).alias("has_evidence"))
        found = f if found is None else found.unionByName(f)
    r = evaluate.detection_accuracy(labels, found).first()
    assert (r["detection_accuracy"], r["false_positives"], r["evidence_completeness"]) == (100.0, 0, 100.0)
