"""Mergeable profiles, distances of distributions, segments, lineage, and reports: against plain computations."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path
from tidemark.operators import diff, distributions, null_segments, rules, segments, sketches, synthesis, transform
from tidemark.operators.profile import profile
from tidemark.sources import fingerprints


def numbers(spark, n, seed=1):
    pick = random.Random(seed)
    rows = [(i, i % 7, pick.gauss(50, 20) if i % 11 else None, f"name {i % 300}" if i % 5 else None, -(2**60) + i) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, part int, x double, t string, big bigint")


def test_merged_parts_equal_the_whole(spark):
    df = numbers(spark, 6000)
    merged = sketches.merge(sketches.mergeable(df, ["part"]))
    got = {r["column"]: r for r in sketches.read(merged, ranks=(0.0, 0.5, 1.0)).collect()}
    want = {r["column"]: r for r in profile(df.drop("part"), exact=True).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert [g[k] for k in ("type", "row_count", "null_count", "null_fraction", "min_value", "max_value")] == [w[k] for k in ("type", "row_count", "null_count", "null_fraction", "min_value", "max_value")]
        assert abs(g["unique_count"] - w["unique_count"]) <= sketches.distinct_error() * w["unique_count"] + 1
        for k in ("mean",) if c == "big" else ("mean", "std_dev"):  # doubles near 2 ** 60 lie 256 apart
            assert g[k] == w[k] or math.isclose(g[k], w[k], rel_tol=1e-9)
    values = sorted(r["x"] for r in df.collect() if r["x"] is not None)
    low, middle, high = got["x"]["quantiles"]
    assert (low, high) == (values[0], values[-1]) and abs(sum(v <= middle for v in values) / len(values) - 0.5) <= 2 * sketches.rank_error()
    assert got["t"]["quantiles"] is None
    twice = sketches.merge(sketches.merge(sketches.mergeable(df, ["part"]), ["part"]))
    assert {r["column"]: r["known"] for r in twice.collect()} == {r["column"]: r["known"] for r in merged.collect()}


def test_merging_edges(spark):
    empty = sketches.mergeable(numbers(spark, 10).limit(0))
    assert {r["column"]: (r["row_count"], r["unique_count"], r["mean"]) for r in sketches.read(sketches.merge(empty)).collect()}["x"] == (0, 0, None)
    some = sketches.mergeable(numbers(spark, 10).drop("part"))
    both = sketches.read(sketches.merge(some.unionByName(sketches.mergeable(numbers(spark, 10).drop("part").limit(0)))))
    assert {r["column"]: r["row_count"] for r in both.collect()} == {c: 10 for c in ("id", "x", "t", "big")}
    other = sketches.mergeable(spark.range(3).select(F.col("id").cast("string").alias("id")))
    with pytest.raises(Exception, match="column of several types: id"):
        sketches.merge(some.unionByName(other)).collect()


def test_quantile_drift_is_beyond_the_rank_error(spark):
    df = numbers(spark, 20_000)
    moved = df.withColumn("x", F.col("x") + 5).withColumn("id", F.col("id") + 1)
    a, b = (sketches.mergeable(d) for d in (df, moved))
    got = {(r["column"], r["quantile"]): r for r in sketches.quantile_drift(a, b).collect()}
    assert all(got["x", q]["drifted"] and not got["id", q]["drifted"] for q in sketches.RANKS) and ("t", 0.5) not in got
    values = sorted(r["x"] for r in df.collect() if r["x"] is not None)
    for q in sketches.RANKS:
        r = got["x", q]
        assert r["previous_low"] <= r["previous"] <= r["previous_high"] and abs(sum(v <= r["previous"] for v in values) / len(values) - q) <= 2 * r["rank_error"]
    same = sketches.quantile_drift(a, sketches.mergeable(df.orderBy(F.desc("id"))))
    assert same.where("drifted").isEmpty()


def ks(a, b):
    values = sorted({v for v in (*a, *b)})
    gaps = [(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)), v) for v in values]
    best = max(g for g, _ in gaps)
    return best, min(v for g, v in gaps if g >= best - 1e-12)


def test_distance_equals_brute_force(spark):
    pick = random.Random(3)
    a, b = [round(pick.gauss(0, 1), 2) for _ in range(400)], [round(pick.gauss(0.3, 1.2), 2) for _ in range(300)]
    make = lambda v, ties: spark.createDataFrame([(x, float(i % 3)) for i, x in enumerate(v)] + [(None, None)] * ties, "x double, y double")
    got = {r["column"]: r for r in distributions.ks_distance(make(a, 5), make(b, 0), ["x", "y"]).collect()}
    distance, at = ks(a, b)
    assert (got["x"]["n_previous"], got["x"]["n_current"]) == (400, 300) and math.isclose(got["x"]["distance"], distance, abs_tol=1e-11) and got["x"]["at_value"] == at
    scaled = (math.sqrt(400 * 300 / 700) + 0.12 + 0.11 / math.sqrt(400 * 300 / 700)) * distance
    assert math.isclose(got["x"]["p_value"], 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * scaled) ** 2) for k in range(1, 30)), abs_tol=1e-9)
    assert got["y"]["p_value"] == 1.0 and got["y"]["distance"] < 0.01
    (none,) = distributions.ks_distance(make(a, 0), make([], 2), ["x"]).collect()
    assert none["distance"] is None and none["p_value"] is None
    (same,) = distributions.ks_distance(make([0.0, float("nan")], 0), make([-0.0, float("nan")], 0), ["x"]).collect()
    assert same["distance"] == 0.0


def test_equal_segments_are_not_read(spark, rows):
    before = spark.range(5000).select("id", (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(None, 7)], "id bigint, v bigint"))
    after = before.filter("id IS NULL OR id NOT BETWEEN 700 AND 702").withColumn("v", F.when(F.col("id") == 4321, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(-5, 1)], "id bigint, v bigint"))
    paths = [new_path(spark, "seg") for _ in range(3)]
    for df, path in zip((before, after, before.orderBy(F.desc("id"))), paths, strict=True):
        segments.write_segments(df, "id", path, 100)
    numbers_ = sorted(r[0] for r in segments.differing_segments(spark, *paths[:2]).collect())
    assert numbers_ == [-1, 7, 43]
    out = segments.row_diff_segments(spark, *paths[:2], ["id"])
    want = diff.row_diff(before, after, ["id"]).where("row_status <> 'same'")
    columns = ("id", "n_previous", "n_current", "changed_columns", "row_status")
    assert rows(out, *columns) == rows(want, *columns) and out.count() == 5
    read = {f.split("_segment=")[1].split("/")[0] for f in out.inputFiles()}
    scans = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    assert len(read) <= 52 and scans and all("_segment" in line for line in scans)
    assert segments.row_diff_segments(spark, paths[0], paths[2], ["id"]).isEmpty() and segments.differing_segments(spark, paths[0], paths[2]).isEmpty()


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "double"])
def test_segments_of_other_keys(spark, kind):
    keys = {"string": F.concat(F.lit("k"), F.col("id").cast("string")), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "timestamp": F.timestamp_seconds(F.col("id") * 3600), "double": F.col("id") / 3}
    df = spark.range(300).select(keys[kind].alias("k"), "id")
    changed = df.withColumn("id", F.when(F.col("id") == 100, -1).otherwise(F.col("id")))
    paths = [new_path(spark, "seg") for _ in range(2)]
    for d, path in zip((df, changed), paths, strict=True):
        segments.write_segments(d, "k", path, 10 if kind == "date" else 36_000)
    assert [(r["row_status"], r["changed_columns"]) for r in segments.row_diff_segments(spark, *paths, ["k"]).collect()] == [("modified", ["id"])]


def test_null_segments_equal_all_groupings(spark):
    pick = random.Random(5)
    data = [(pick.choice("ab"), pick.choice(["x", "y", None]), pick.randrange(4), None if pick.random() < 0.2 else 1.0) for _ in range(800)]
    df = spark.createDataFrame(data, "a string, b string, c int, v double")
    got = {(r["dimensions"], tuple(r["values"])): (r["n_rows"], r["n_nulls"]) for r in null_segments.null_segments(df, "v", ["a", "b", "c"], 60).collect()}
    want = {}
    for size in (1, 2, 3):
        for dims in itertools.combinations(range(3), size):
            for d in data:
                key = (",".join("abc"[i] for i in dims), tuple(None if d[i] is None else str(d[i]) for i in dims))
                n, g = want.get(key, (0, 0))
                want[key] = (n + 1, g + (d[3] is None))
    assert got == {k: v for k, v in want.items() if v[0] >= 60} and any(len(k[1]) == 2 for k in got)
    assert null_segments.null_segments(df, "v", ["a", "b"], 10_000).count() == 0 and null_segments.null_segments(df.limit(0), "v", ["a"], 1).count() == 0
    assert {r["dimensions"] for r in null_segments.null_segments(df, "v", ["a", "b", "c"], 1, 1).collect()} == {"a", "b", "c"}


def test_ancestors(spark):
    chain = [(f"v{i}", f"v{i + 1}") for i in range(30)] + [("v3", "v9"), ("w", "v9"), ("same", "same")]
    df = spark.createDataFrame(chain, "input_fingerprint string, output_fingerprint string")
    got = {(r["version"], r["ancestor"]): r["steps"] for r in transform.ancestors(df).collect()}
    assert got["v30", "v0"] == 25 and got["v9", "v3"] == 1 and got["v10", "w"] == 2 and ("same", "same") not in got
    assert len(got) == sum(range(31)) + 22
    with pytest.raises(ValueError, match="circle"):
        transform.ancestors(df.union(spark.createDataFrame([("v30", "v5")], df.schema)))
    assert transform.ancestors(df.limit(0)).isEmpty()


def test_content_digest(spark):
    import hashlib

    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "é")], "i int, t string")
    digest = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:15], 16)
    (row,) = fingerprints.content_digest(df).collect()
    assert row["row_count"] == 4 and int(row["content_digest"]) == digest("1:11:a") + 2 * digest("1:2-") + digest("1:32:é")
    assert int(fingerprints.content_digest(df.limit(0)).first()["content_digest"]) == 0


def test_findings_report_lines(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0), (3, 40.0), (4, None), (5, 60.0)], "customer_id bigint, revenue double")
    found = rules.quality_findings(df)
    lines = [r["line"] for r in rules.findings_report(found).where("impact_score > 0.5").orderBy("place").collect()]
    assert lines[0] == "[X] HIGH" and lines[4:8] == ["Explanation:", lines[5], "Evidence:", "  - [METRIC] Observed 1 violations"]
    assert lines[-4:] == ["Suggested next steps:", *[f"  {i}. [{k}] " + w for i, k, w in ((1, "COMPARE", "Compare timestamp across duplicate groups to identify chronologically later duplicates."), (2, "INSPECT", "Check if duplicate records originated from the same ingestion batch."), (3, "COMPARE", "Compare source file lineage to detect duplicate processing."))]]
    short = [r["line"] for r in rules.findings_report(found, explain=False).collect()]
    assert not any(line.startswith(("Explanation", "    SQL")) for line in short)


def test_context_errors(spark):
    contexts = spark.createDataFrame([(1, "i1", "v1", "s1"), (2, "i1", "v2", "s1"), (3, "i1", "v1", "s2"), (4, "i1", "v2", "s2"), (5, "i1", "v1", None), (6, "i9", "v1", "s1")], "context_id int, investigation_id string, version_id string, synthesis_id string")
    investigations = spark.createDataFrame([("i1", "v1"), ("i2", "v2")], "investigation_id string, version_id string")
    syntheses = spark.createDataFrame([("s1", "i1"), ("s2", "i2")], "synthesis_id string, investigation_id string")
    got = {r["context_id"]: r["error"] for r in synthesis.context_errors(contexts, investigations, syntheses).collect()}
    assert got == {
        2: "Dataset mismatch: Investigation targets v1, but provided version is v2", 3: "Synthesis mismatch: Expected i1, got i2", 4: "Synthesis mismatch: Expected i1, got i2",
        5: "Synthesis mismatch: Expected i1, got None", 6: "Synthesis mismatch: Expected i9, got i1",
    }
