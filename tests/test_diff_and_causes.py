import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import attribution, diff, drift, profile as prof, rootcause

P = (
    "dataset_id string, version_number int, column string, type string, row_count long, null_fraction double, "
    "unique_fraction double, min_value string, max_value string, mean double"
)


def record(version, column="a", kind="INTEGER", rows=100, null=0.0, unique=0.5, low="1", high="9", mean=5.0):
    return ("d", version, column, kind, rows, null, unique, low, high, mean)


def changes(spark, *records):
    found = diff.changes(spark.createDataFrame(list(records), P)).collect()
    return {(r["column"], r["change_type"]): r for r in found}


def test_unchanged(spark):
    p = spark.createDataFrame([record(1), record(2)], P)
    assert diff.changes(p).count() == 0
    assert diff.summary(p, diff.changes(p)).first()["summary"] == "No changes detected."


def test_nan_and_infinity_are_no_change(spark):
    nan, inf = float("nan"), float("inf")
    for values in ([1.0, nan, 2.0], [inf, 1.0], [-inf, inf], [nan]):
        p = prof.profile(spark.createDataFrame([(v,) for v in values], "x double"), exact=True)
        found = diff.compare(p, p)
        assert found.isEmpty() and drift.findings(found).isEmpty()
    p1, p2 = (prof.profile(spark.createDataFrame([(v,)], "x double"), exact=True) for v in (1.0, nan))
    assert not [r for r in drift.findings(diff.compare(p1, p2)).collect() if "NaN" in r["description"]]


def test_approximate_counts_raise_no_cardinality_change(spark):
    one, two = spark.range(5000).withColumn("k", F.col("id") % 4000), spark.range(5000).withColumn("k", F.col("id") % 2000)
    kinds = lambda exact: {r["change_type"] for r in diff.compare(prof.profile(one, exact=exact), prof.profile(two, exact=exact)).filter("column = 'k'").collect()}
    assert "cardinality_shift" in kinds(True) and "cardinality_shift" not in kinds(False)


def test_row_diff_over_widened_types(spark):
    one = spark.createDataFrame([(1, 5, "2024-01-01", 7), (2, 6, None, 8)], "k int, v int, d string, s int").withColumn("d", F.to_date("d"))
    two = spark.createDataFrame([(1, 5, "2024-01-01", "7"), (2, 7, None, "9")], "k bigint, v bigint, d string, s string").withColumn("d", F.to_timestamp_ntz("d"))
    got = {r["k"]: (r["row_status"], r["changed_columns"]) for r in diff.row_diff(one, two, ["k"]).collect()}
    assert got == {1: ("same", []), 2: ("modified", ["v", "s"])}


def test_frequencies_keep_whole_values(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long, [1]), (long, [2]), (None, None)], "t string, a array<int>")
    got = {(r["column"], r["value"]): r["n_current"] for r in diff.frequency_diff(df, df, ["t", "a"]).collect()}
    assert got["t", long] == 2 and got["t", None] == 1 and got["a", '{"a":[1]}'] == 1


def test_added_and_removed(spark):
    got = changes(spark, record(1, "old"), record(2, "new"))
    assert set(got) == {("old", "removed"), ("new", "added")}
    assert got[("old", "removed")]["previous_type"] == "INTEGER" and got[("new", "added")]["current_type"] == "INTEGER"


def test_type_change(spark):
    got = changes(spark, record(1), record(2, kind="VARCHAR", low=None, high=None, mean=None))
    assert set(got) == {("a", "type_changed")}


def test_row_count(spark):
    r = changes(spark, record(1), record(2, rows=200))[("*dataset*", "row_count_shift")]
    assert (r["absolute_delta"], r["relative_delta"]) == (100.0, 1.0)


def test_row_count_from_zero_is_infinite(spark):
    r = changes(spark, record(1, rows=0), record(2, rows=5))[("*dataset*", "row_count_shift")]
    assert r["relative_delta"] == float("inf")


def test_null_and_cardinality(spark):
    got = changes(spark, record(1, null=0.02, unique=0.98), record(2, null=0.31, unique=0.69))
    assert set(got) == {("a", "null_rate_shift"), ("a", "cardinality_shift")}
    assert got[("a", "null_rate_shift")]["absolute_delta"] == pytest.approx(0.29)


def test_noise_floor_is_strict(spark):
    assert changes(spark, record(1, null=0.0), record(2, null=0.0001)) == {}
    assert set(changes(spark, record(1, null=0.0), record(2, null=0.00011))) == {("a", "null_rate_shift")}


def test_max_and_mean(spark):
    r = changes(spark, record(1, high="65"), record(2, high="99"))[("a", "max_shift")]
    assert r["absolute_delta"] == 34.0
    r = changes(spark, record(1, mean=-50.0), record(2, mean=-25.0))[("a", "distribution_shift")]
    assert (r["absolute_delta"], r["relative_delta"]) == (25.0, 0.5)


def test_bounds_that_are_no_numbers_and_long_ones(spark):
    r = changes(spark, record(1, low="apple"), record(2, low="banana"))[("a", "min_shift")]
    assert (r["absolute_delta"], r["relative_delta"]) == (0.0, 0.0)
    big = 2**53
    assert ("a", "max_shift") in changes(spark, record(1, high=str(big)), record(2, high=str(big + 1)))
    assert set(changes(spark, record(1, low="1"), record(2, kind="DOUBLE", low="1.0", high="9.0"))) == {("a", "type_changed")}


def test_no_diff_over_a_gap_and_many_versions_at_once(spark):
    p = spark.createDataFrame([record(1, rows=1), record(2, rows=2), record(4, rows=4), record(5, rows=5)], P)
    assert sorted(r["version_number"] for r in diff.changes(p).collect()) == [2, 5]


version = st.builds(
    record, version=st.just(1), column=st.sampled_from("ab"), kind=st.sampled_from(["INTEGER", "DOUBLE"]),
    rows=st.integers(0, 50), null=st.floats(0, 1), unique=st.floats(0, 1), low=st.sampled_from([None, "0", "5", "x"]),
    mean=st.one_of(st.none(), st.floats(-100, 100)),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=version, b=version)
def test_diff_mirrors(spark, a, b):
    a, b = (a[0], 1, *a[2:]), (b[0], 2, *b[2:])
    forward = changes(spark, a, b)
    back = changes(spark, (b[0], 1, *b[2:]), (a[0], 2, *a[2:]))
    turned = {"added": "removed", "removed": "added"}
    assert {(c, turned.get(t, t)) for c, t in forward} == set(back)
    for (c, t), r in forward.items():
        if r["absolute_delta"] is not None:
            assert back[(c, t)]["absolute_delta"] == -r["absolute_delta"]
    assert changes(spark, a, (a[0], 2, *a[2:])) == {}


V1 = [(1, "x", "a@a"), (2, "y", "b@b"), (3, "z", "c@c")]
V2 = [(1, "x", None), (2, "y", None), (3, "z", "c@c")]


def keyed(df, n):
    return prof.profile(df, exact=True).select(F.lit("users").alias("dataset_id"), F.lit(n).alias("version_number"), "*")


@pytest.fixture
def lost_emails(spark):
    schema = "id bigint, name string, email string"
    p = keyed(spark.createDataFrame(V1, schema), 1).unionByName(keyed(spark.createDataFrame(V2, schema), 2))
    found = diff.changes(p)
    return p, found, drift.findings(found)


def test_lost_emails_raise_two_findings(lost_emails):
    _, found, findings = lost_emails
    got = {r["rule"]: r for r in findings.collect()}
    assert set(got) == {"NullRateShiftRule", "UniquenessDropRule"}
    assert got["NullRateShiftRule"]["description"] == "Null rate increased by 66.7% (now 66.7%)"
    assert all(r["severity"] == "HIGH" for r in got.values())
    inv = drift.open_investigations(findings).first()
    assert inv["n_findings"] == 2 and inv["title"] == "Automated Investigation: users v2"


def test_column_added_and_emails_lost(spark):
    a = keyed(spark.createDataFrame([(i, f"e{i}") for i in range(4)], "id bigint, email string"), 1)
    b = keyed(spark.createDataFrame([(i, f"e{i}" if i > 1 else None, "1") for i in range(4)], "id bigint, email string, phone string"), 2)
    got = {(r["rule"], r["column"]): r["severity"] for r in drift.findings(diff.changes(a.unionByName(b))).collect()}
    assert got == {
        ("SchemaAddRule", "phone"): "LOW", ("NullRateShiftRule", "email"): "HIGH", ("UniquenessDropRule", "email"): "HIGH",
    }


def test_ambiguous_drift(spark):
    """10,000 rows: uniqueness 99.8 to 94 percent, nulls 1 to 18 percent, mean 100 to 40."""
    def version(every, nulls, mean):
        i = F.col("id")
        return spark.range(10000).select(
            F.when(i % every == 1, i - 1).otherwise(i).alias("customer_id"),
            F.when(i >= nulls, F.concat(F.lit("u"), (i % 900).cast("string"))).alias("email"),
            (mean + (i % 3) - 1.0).alias("revenue"),
        )

    p = keyed(version(500, 100, 100), 1).unionByName(keyed(version(16, 1800, 40), 2))
    assert {(r["rule"], r["column"]) for r in drift.findings(diff.changes(p)).collect()} == {
        ("UniquenessDropRule", "customer_id"), ("NullRateShiftRule", "email"), ("DistributionShiftRule", "revenue"),
    }


FINDING = "dataset_id string, version_number int, finding_id string, column string, rule string"
CHANGE = "dataset_id string, version_number int, column string, change_id string, change_kind string, change_type string"


def attributed(spark, rule, column, *changed, aliases=None):
    f = spark.createDataFrame([("d", 2, "f1", column, rule)], FINDING)
    c = spark.createDataFrame([("d", 2, col, f"c{i}", kind, t) for i, (col, kind, t) in enumerate(changed)], CHANGE)
    out = attribution.ranked(attribution.attribute_in_full(f, c, aliases)).orderBy("rank").collect()
    near = attribution.attribute(f, c, aliases).collect()
    assert sum(r["n_changes"] for r in near) == len(changed)
    known = {r["attribution_id"]: r["relevance"] for r in out}
    assert all(known[r["attribution_id"]] == r["relevance"] for r in near if r["change_type"] != "unrelated")
    return [(r["relevance"], r["confidence"]) for r in out]


def test_attribution_order(spark):
    got = attributed(
        spark, "UniqueRule", "customer_id", ("revenue", "column", "distribution_shift"),
        ("customer_id", "column", "null_rate_shift"), ("customer_id", "column", "cardinality_shift"),
    )
    assert got == [("HIGH", 0.9), ("MEDIUM", 0.6), ("LOW", 0.1)]


def test_attribution_cases(spark):
    assert attributed(spark, "NotNullRule", "a", ("a", "column", "null_rate_shift")) == [("HIGH", 0.9)]
    assert attributed(spark, "NotNullRule", "a", ("a", "schema", "type_changed")) == [("HIGH", 0.85)]
    assert attributed(spark, "NotNullRule", "a", ("a", "schema", "removed"), ("a", "schema", "added")) == [("HIGH", 0.95), ("MEDIUM", 0.5)]
    assert attributed(spark, "NotNullRule", "a", ("*dataset*", "column", "row_count_shift")) == [("MEDIUM", 0.5)]
    assert attributed(spark, "NotNullRule", "a", ("b", "schema", "added")) == [("LOW", 0.1)]
    assert attributed(spark, "NullRateShiftRule", "a", ("a", "column", "null_rate_shift")) == [("MEDIUM", 0.6)]
    aliases = {"NullRateShiftRule": "NotNullRule"}
    assert attributed(spark, "NullRateShiftRule", "a", ("a", "column", "null_rate_shift"), aliases=aliases) == [("HIGH", 0.9)]


def test_no_changes_no_attributions(spark):
    f = spark.createDataFrame([("d", 2, "f1", "a", "UniqueRule")], FINDING)
    assert attribution.attribute(f, spark.createDataFrame([], CHANGE)).count() == 0


def test_root_cause_ranking(spark):
    a = spark.createDataFrame(
        [("a1", "f1", "HIGH", 0.9, "r1"), ("a2", "f1", "MEDIUM", 0.6, "r2"), ("a3", "f1", "LOW", 0.1, "r3"), ("a4", "f1", "HIGH", 0.8, "r4")],
        "attribution_id string, finding_id string, relevance string, confidence double, reason string",
    )
    h = spark.createDataFrame(
        [("h1", "f1", "a1", "PROPOSED"), ("h2", "f1", "a2", "PROPOSED"), ("h3", "f1", "a3", "PROPOSED"), ("h5", "f1", None, "PROPOSED")],
        "hypothesis_id string, finding_id string, attribution_id string, status string",
    )
    v = spark.createDataFrame(
        [("h1", "SUPPORTED", "yes", "e1"), ("h3", "REJECTED", "no", "e3"), ("h5", "INCONCLUSIVE", "maybe", "e5")],
        "hypothesis_id string, verdict string, note string, evidence_id string",
    )
    got = [
        (r["hypothesis_id"] or r["attribution_id"], round(r["score"], 6), r["confidence"], r["status"])
        for r in rootcause.candidates(a, h, v).orderBy("rank").collect()
    ]
    assert got == [
        ("h1", 1.0, 0.9, "STRONG"), ("a4", 0.6, 0.8, "PLAUSIBLE"), ("h2", 0.4, 0.6, "PLAUSIBLE"),
        ("h3", 0.0, 0.9, "DISQUALIFIED"), ("h5", 0.0, 0.5, "UNLIKELY"),
    ]
    top = {r["hypothesis_id"]: r for r in rootcause.candidates(a, h, v).collect()}
    assert top["h1"]["explanation"] == "Based on historical change: r1 Hypothesis was supported: yes"
    assert top["h1"]["supporting_evidence"] == "e1" and top["h3"]["contradicting_evidence"] == "e3"
    assert top["h2"]["explanation"].endswith("Hypothesis is proposed but not yet validated.")


def test_row_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, "z", 3), (4, "w", 4), (None, "n", 1)], "k int, s string, v int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 4), (4, "w", 4), (5, "q", 5), (None, "n", 1)], "k int, s string, v int")
    got = {r["k"]: (r["row_status"], r["changed_columns"]) for r in diff.row_diff(a, b, ["k"]).collect()}
    assert got == {
        1: ("same", []), 2: ("modified", ["v"]), 3: ("removed", []), 4: ("ambiguous", []), 5: ("added", []), None: ("same", []),
    }


def test_frequencies(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "s string")
    b = spark.createDataFrame([("x",), ("z",)], "s string")
    got = {r["value"]: (r["n_previous"], r["n_current"], r["share_delta"]) for r in diff.frequency_diff(a, b, ["s"]).collect()}
    assert got == {"x": (2, 1, 0.0), "y": (1, 0, -0.25), None: (1, 0, -0.25), "z": (0, 1, 0.5)}
    assert diff.distribution_distance(diff.frequency_diff(a, b, ["s"])).first()["total_variation"] == 0.5


def test_history_outliers(spark):
    p = spark.createDataFrame([record(i, mean=m) for i, m in enumerate([1.0, 1.1, 0.9, 1.0, 9.0], 1)] + [record(i, "c", mean=2.0) for i in range(1, 6)], P)
    got = {(r["column"], r["version_number"]): r["status"] for r in diff.history_outliers(p, "mean").collect()}
    assert got[("a", 5)] == "failed" and got[("a", 4)] == "passed" and got[("a", 3)] == "unknown"
    assert got[("c", 5)] == "passed"
