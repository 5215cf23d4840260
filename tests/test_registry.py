import datetime
import itertools

import pytest
from pyspark.sql import Window as W, functions as F

from tidemark.functions import ordered
from tidemark.operators import audit, memory, recall_index, registry, synthesis, timeline, transform
from tidemark.streaming import ingest

T0 = datetime.datetime(2024, 1, 1)


def hours(n):
    return T0 + datetime.timedelta(hours=n)


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_numbering_and_lag_by_bucket_equal_plain_windows(spark, unit):
    """One key holds a third of the rows, and timestamps tie."""
    i = F.col("id")
    df = spark.range(600).select(
        F.when(i % 3 == 0, -1).when(i % 50 == 7, F.lit(None)).otherwise(i % 11).alias("k"),
        (F.lit(T0) + F.make_dt_interval(hours=((i * 37) % 200).cast("int"))).alias("ts"), i.alias("event_id"),
        (i % 5).alias("v"),
    )
    w = W.partitionBy("k").orderBy("ts", "event_id")
    want = df.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("p", F.lag("v").over(w))
    bucket = F.date_trunc(unit, "ts")
    a = ordered.number_rows(df, ["k"], [F.col("ts"), F.col("event_id")], bucket, "n")
    b = ordered.previous_value(df, ["k"], ["ts", "event_id"], "v", bucket, "p")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, want.drop("p").collect()))
    assert sorted(map(repr, b.collect())) == sorted(map(repr, want.drop("n").collect()))


def test_identical_bytes_make_no_version(spark):
    versions = spark.createDataFrame([("d", "h1", 1), ("d", "h2", 2)], "dataset_id string, file_hash string, version_number long")
    arrivals = spark.createDataFrame(
        [("d", "h2", 1), ("d", "h3", 2), ("d", "h3", 3), ("e", "h2", 4)], "dataset_id string, file_hash string, arrival long"
    )
    fresh = registry.new_arrivals(versions, arrivals, ["arrival"])
    out = registry.next_versions(versions, fresh, ["arrival"], F.lit(0))
    assert sorted((r["dataset_id"], r["arrival"], r["version_number"]) for r in out.collect()) == [("d", 2, 3), ("e", 4, 1)]


INV = "investigation_id string, workspace_id string, status string, title string, description string, created_at timestamp_ntz"


def test_search_and_page(spark):
    inv = spark.createDataFrame(
        [(f"i{n:02}", "w", "OPEN" if n % 2 else "RESOLVED", f"Case 100%_{n}", "x", hours(n)) for n in range(25)], INV
    )
    findings = spark.createDataFrame([("i01", "HIGH"), ("i01", "HIGH"), ("i02", "HIGH")], "investigation_id string, severity string")
    hit = registry.search(inv, findings, workspace_id="w", status="OPEN", severity="HIGH")
    assert [r["investigation_id"] for r in hit.collect()] == ["i01"]
    assert registry.search(inv, text="CASE 100%_1").count() == 11
    assert registry.search(inv, text="100__").count() == 0
    rows = registry.page(inv, 3, 10).collect()
    assert [r["investigation_id"] for r in rows] == [f"i{n:02}" for n in (4, 3, 2, 1, 0)] and rows[0]["total"] == 25
    with pytest.raises(ValueError):
        registry.page(inv, 1, 101)


def test_highest_severity_ignores_info(spark):
    inv = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "investigation_id string")
    f = spark.createDataFrame([("i1", "LOW"), ("i1", "HIGH"), ("i2", "INFO")], "investigation_id string, severity string")
    got = {r[0]: r[1] for r in registry.highest_severity(inv, f).collect()}
    assert got == {"i1": "HIGH", "i2": None, "i3": None}


def test_status_machine(spark):
    paths = {
        "ok": ["OPEN", "INVESTIGATING", "RESOLVED"], "skip": ["OPEN", "RESOLVED"], "again": ["OPEN", "REJECTED", "OPEN"],
        "bare": ["OPEN", "INVESTIGATING", "RESOLVED"],
    }
    events = spark.createDataFrame(
        [(k, hours(n), n, s, k != "bare") for k, p in paths.items() for n, s in enumerate(p)],
        "investigation_id string, ts timestamp_ntz, event_id int, status string, has_resolution boolean",
    )
    got = {(r["investigation_id"], r["status"], r["reason"]) for r in registry.illegal_transitions(events, F.date_trunc("hour", "ts")).collect()}
    assert got == {("skip", "RESOLVED", "transition"), ("again", "OPEN", "transition"), ("bare", "RESOLVED", "resolution missing")}


def test_timeline_ties_follow_sequence(spark):
    log = spark.createDataFrame([("i", 2)], "investigation_id string, sequence_number long")
    new = spark.createDataFrame([("i", hours(1), "b"), ("i", hours(1), "a"), ("i", hours(0), "c"), ("j", hours(0), "d")],
                                "investigation_id string, ts timestamp_ntz, event_id string")
    out = timeline.append(log, new, F.date_trunc("hour", "ts"))
    got = [(r["event_id"], r["sequence_number"]) for r in timeline.chronological(out).collect()]
    assert got == [("c", 3), ("a", 4), ("b", 5), ("d", 1)]


def plain_recall(current, past, k):
    out = {}
    for c in current:
        scored = []
        for p in past:
            s = 0.5 * (c[1].lower() == p[1].lower() != "") + 0.3 * len(set(c[2]) & set(p[2])) + 0.3 * len(set(c[3]) & set(p[3]))
            if s > 0 and p[0] != c[0]:
                scored.append((round(min(1.0, s), 6), p[4], p[0]))
        out[c[0]] = [(x[2], x[0]) for x in sorted(scored, reverse=True)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_recall_equals_brute_force(spark, k):
    """A third of the past has one signature; some currents are part of the past."""
    metrics = [[], ["null_fraction"], ["mean", "null_fraction"], ["row_count"]]
    columns = [[], ["a"], ["b"], ["a", "b", "c"]]
    combos = list(itertools.product(["Sales", "sales", "hr", ""], metrics, columns))
    past = [
        (n, *(("Sales", ["null_fraction"], ["a"]) if n % 3 == 0 else combos[(n * 7) % len(combos)]), hours((n * 13) % 40))
        for n in range(150)
    ]
    schema = "investigation_id long, dataset_name string, metrics array<string>, columns array<string>, created_at timestamp_ntz"
    resolved = spark.createDataFrame(past, schema).withColumn("title", F.lit("t"))
    now = [past[0], past[5], (1000, "SALES", ["mean"], ["c"], hours(0)), (1001, "x", [], [], hours(0)), (1002, "x", ["row_count"], [], hours(0))]
    got = {}
    for r in memory.similar(spark.createDataFrame(now, schema), resolved, k).orderBy("current_id", "rank").collect():
        got.setdefault(r["current_id"], []).append((r["investigation_id"], r["similarity_score"]))
    want = plain_recall(now, past, k)
    assert got == {c: v for c, v in want.items() if v}


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_indexed_recall_equals_brute_force(spark, tmp_path, monkeypatch, size):
    """The same matches from an index; blocks that can't hold a better match are not read."""
    combos = list(itertools.product(["Sales", "hr", "", None], [[], ["mean", "null_fraction"], ["row_count"]], [[], ["b"], ["a", "b", "c"]]))
    past = [(n, *(("Sales", ["mean", "null_fraction"], ["a", "b"]) if n % 3 == 0 else combos[(n * 7) % len(combos)]), hours((n * 13) % 140)) for n in range(400)]
    schema = "investigation_id long, dataset_name string, metrics array<string>, columns array<string>, created_at timestamp_ntz"
    resolved = spark.createDataFrame(past, schema).withColumn("title", F.lit("t"))
    now = [past[0], past[5], (1000, "SALES", ["mean"], ["b", "c"], hours(0)), (1001, "x", [], [], hours(0)), (1002, "x", ["row_count"], [], hours(0)), (1003, None, ["mean"], ["a"], hours(0))]
    path, read = str(tmp_path / "index"), []
    recall_index.build(resolved, path, size)
    matches = recall_index._matches
    monkeypatch.setattr(recall_index, "_matches", lambda pairs, *rest: read.append(pairs.select("block").distinct().count()) or matches(pairs, *rest))
    got = {}
    for r in recall_index.similar(spark.createDataFrame(now, schema), path, resolved.schema, 3).orderBy("current_id", "rank").collect():
        got.setdefault(r["current_id"], []).append((r["investigation_id"], r["similarity_score"]))
    want = plain_recall([(c, d or "", m, x, t) for c, d, m, x, t in now], [(c, d or "", m, x, t) for c, d, m, x, t in past], 3)
    assert got == {c: v for c, v in want.items() if v}
    blocks = spark.read.parquet(f"{path}/blocks").count()
    assert blocks > 5 if size == 7 else blocks >= 1
    with pytest.raises(ValueError):
        recall_index.similar(resolved, path, resolved.schema, recall_index.MOST + 1)
    # One request of the commonest signature finds its matches in the newest blocks.
    read.clear()
    recall_index.similar(spark.createDataFrame([(2000, "Sales", ["mean", "null_fraction"], ["a", "b"], hours(0))], schema), path, resolved.schema, 3).collect()
    assert sum(read) <= max(1, blocks - 2)


def test_recall_factors(spark):
    schema = "investigation_id long, dataset_name string, metrics array<string>, columns array<string>, created_at timestamp_ntz"
    past = spark.createDataFrame([(1, "users", ["null_fraction"], ["email"], T0)], schema)
    now = spark.createDataFrame([(2, "Users", ["mean", "null_fraction"], ["email"], T0)], schema)
    r = memory.similar(now, past).first()
    assert r["matched_factors"] == ["Same dataset (Users)", "Similar metrics: null_fraction", "Affected columns: email"]
    assert r["similarity_score"] == 1.0


CONTEXT = ["user_id", "revenue"]
RESPONSES = {
    "good": ("The column 'user_id' drifted, see metric 'mean'.", [], ["SELECT drop_count FROM dataset"], ["ev_1", "attr_1", "f_1", "hyp_1"]),
    "column": ("Look at column 'ghost'.", [], [], []),
    "metric": ("ok", ["The metric 'vibes' fell."], [], []),
    "strong": ("This is a strong root cause.", [], [], []),
    "sql": ("ok", [], ["DROP TABLE dataset"], []),
    "sure": ("The hypothesis is confirmed.", [], [], []),
    "cite": ("ok", [], [], ["ev_9"]),
}


def test_audit(spark):
    rows = [(k, 1, *v, False, False) for k, v in RESPONSES.items()]
    rows.append(("foreign", 2, "The column 'user_id' drifted.", [], [], ["ev_1"], False, False))
    responses = spark.createDataFrame(
        rows, "response_id string, investigation_id long, answer string, claims array<string>, queries array<string>, citations array<string>, has_strong boolean, has_supported boolean"
    )
    ids = spark.createDataFrame([(1, "ev_1"), (1, "attr_1"), (1, "f_1"), (1, "hyp_1"), (2, "ev_2")], "investigation_id long, id string")
    schema = spark.createDataFrame([(1, c.upper()) for c in CONTEXT] + [(2, "price")], "investigation_id long, column string")
    got = {(r["response_id"], r["check"], r["severity"]) for r in audit.audit(responses, ids, schema).collect()}
    assert got == {
        ("column", "column", "ERROR"), ("metric", "metric", "ERROR"), ("strong", "overclaim", "ERROR"),
        ("sql", "sql", "ERROR"), ("sure", "overclaim", "ERROR"), ("cite", "citation", "WARN"),
        ("foreign", "column", "ERROR"), ("foreign", "citation", "WARN"),
    }
    fine = responses.withColumn("has_strong", F.lit(True)).withColumn("has_supported", F.lit(True))
    assert audit.overclaims(fine).count() == 0


def test_repairs_chain_their_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "active"), (2, 2, None), (3, 2, "active"), (4, 3, "inactive")], "pos int, id bigint, status string")
    one, two = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    first = transform.write_step(df, transform.dropping(["id"], ["pos"]), one, "start").first()
    second = transform.write_step(spark.read.parquet(one), transform.filling("status", "unknown"), two, first["output_fingerprint"]).first()
    assert spark.read.parquet(one).count() == 3
    statuses = sorted(r["status"] for r in spark.read.parquet(two).collect())
    assert statuses == ["active", "inactive", "unknown"]
    assert second["input_fingerprint"] == first["output_fingerprint"] != second["output_fingerprint"]
    assert second["generated_code"] == "df = fill_nulls(df, column='status', value='unknown')" and first["affected_columns"] == ["id"]


def test_unintended_changes_are_marked(spark):
    before = spark.createDataFrame([(1, None), (2, 5.0)], "id int, v double")
    after = spark.createDataFrame([(1, 0.0), (1, 5.0)], "id int, v double")
    got = {(r["column"], r["unintended"]) for r in transform.transform_check(before, after, ["v"]).collect()}
    assert got == {("v", False), ("id", True)}


def test_context_checks(spark):
    contexts = spark.createDataFrame([("c1", "i1", "v1"), ("c2", "i1", "v9")], "context_id string, investigation_id string, version_id string")
    inv = spark.createDataFrame([("i1", "v1")], "investigation_id string, version_id string")
    assert [r["context_id"] for r in synthesis.context_mismatches(contexts, inv).collect()] == ["c2"]
    texts = spark.createDataFrame([("a" * 100_001,), ("a" * 100_000,)], "t string")
    assert synthesis.oversize_contexts(texts, "t").count() == 1


def test_ingest_is_idempotent(spark, tmp_path):
    """Three versions, one sent twice; a batch that runs again leaves the same tables."""
    def put(name, emails):
        path = str(tmp_path / name)
        spark.createDataFrame([(i, e) for i, e in enumerate(emails)], "id bigint, email string").write.parquet(path)
        return path

    paths = [put("v1", "abc"), put("v2", [None, None, "c"]), put("v3", [None, None, None])]
    broken = tmp_path / "broken.parquet"
    broken.write_text("no parquet")
    manifest = [("w1", "users", p, "parquet", f"h{i}", i) for i, p in enumerate(paths)]
    first = spark.createDataFrame(manifest[:2] + [("w1", "users", paths[0], "parquet", "h0", 9), ("w2", "other", str(broken), "parquet", "hb", 3)], ingest.MANIFEST)
    later = spark.createDataFrame(manifest[1:] + [("w2", "other", paths[0], "parquet", "h9", 4)], ingest.MANIFEST)
    root = str(tmp_path / "registry")
    exact = ("id", "email")
    ingest.ingest(first, 0, root, exact)
    ingest.ingest(later, 1, root, exact)

    def state():
        found = spark.read.parquet(f"{root}/findings")
        return sorted((r["version_number"], r["rule"], r["column"]) for r in found.collect())

    want = [(2, "NullRateShiftRule", "email"), (2, "UniquenessDropRule", "email"), (3, "NullRateShiftRule", "email"), (3, "UniquenessDropRule", "email")]
    assert state() == want
    tables = ["versions", "findings", "investigations", "evidence", "attributions", "hypotheses", "attribution_evidence", "timeline", "rejected_versions"]
    counts = [spark.read.parquet(f"{root}/{t}").count() for t in tables]
    ingest.ingest(later, 1, root, exact)
    assert state() == want
    assert [spark.read.parquet(f"{root}/{t}").count() for t in tables] == counts
    assert counts[:3] == [5, 4, 2] and min(counts) > 0 and counts[4] == counts[5] == counts[6]
    bad = ingest.table(spark, root, "rejected_versions").collect()
    assert [(r["workspace_id"], r["dataset_id"], r["version_number"]) for r in bad] == [("w2", "other", 1)]
    assert {r["workspace_id"] for r in ingest.table(spark, root, "findings").collect()} == {"w1"}
    opened = {r["investigation_id"]: r["version_number"] for r in ingest.table(spark, root, "investigations").collect()}
    log = ingest.table(spark, root, "timeline").collect()
    assert {r["investigation_id"] for r in log} == set(opened)
    kinds = {r["event_type"] for r in log}
    assert {"STATUS_CHANGED", "DATASET_VERSION_CREATED", "HISTORICAL_CHANGE_DISCOVERED", "FINDING_DETECTED", "ATTRIBUTION_GENERATED", "HYPOTHESIS_CREATED"} <= kinds


def test_many_manifest_rows_are_profiled_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "VERSIONS_PER_PLAN", 2)
    rows = []
    for i in range(5):
        path = str(tmp_path / f"v{i}")
        spark.range(i + 1).write.parquet(path)
        rows.append(("w", "d", path, "parquet", f"h{i}", 0))
    root = str(tmp_path / "registry")
    ingest.ingest(spark.createDataFrame(rows, ingest.MANIFEST), 0, root)
    got = sorted((r["version_number"], r["row_count"]) for r in ingest.table(spark, root, "column_profiles").collect())
    assert got == [(i + 1, i + 1) for i in range(5)]  # equal arrival times are settled by the hash


def test_passing_errors_fail_the_batch(spark, tmp_path, monkeypatch):
    """A read that fails for a passing reason sets nothing aside; the batch that runs again takes the version in."""
    path = str(tmp_path / "v1")
    spark.range(3).write.parquet(path)
    batch = spark.createDataFrame([("007", "d", path, "parquet", "h", 0)], ingest.MANIFEST)
    root, read = str(tmp_path / "registry"), ingest.read_version

    def failing(*_):
        raise RuntimeError("Job aborted due to stage failure: ExecutorLostFailure (no space left on device)")

    monkeypatch.setattr(ingest, "read_version", failing)
    with pytest.raises(RuntimeError):
        ingest.ingest(batch, 0, root)
    monkeypatch.setattr(ingest, "read_version", read)
    ingest.ingest(batch, 0, root)
    assert ingest.stored(spark, root, "rejected_versions", ingest.REJECTED + ", batch_id bigint", 9).isEmpty()
    assert [(r["workspace_id"], r["version_number"], r["row_count"]) for r in ingest.table(spark, root, "column_profiles").collect()] == [("007", 1, 3)]


def test_a_missing_version_may_come_again(spark, tmp_path):
    there, path, root = str(tmp_path / "v0"), str(tmp_path / "v1"), str(tmp_path / "registry")
    spark.range(2).write.parquet(there)
    rows = [("w", "d", there, "parquet", "h0", 0), ("w", "d", path, "parquet", "h1", 1)]
    ingest.ingest(spark.createDataFrame(rows, ingest.MANIFEST), 0, root)
    assert [(r["version_number"], r["retry"]) for r in ingest.table(spark, root, "rejected_versions").collect()] == [(2, True)]
    spark.range(3).write.parquet(path)
    ingest.ingest(spark.createDataFrame(rows, ingest.MANIFEST), 1, root)
    got = sorted((r["version_number"], r["row_count"]) for r in ingest.table(spark, root, "column_profiles").collect())
    assert got == [(1, 2), (3, 3)]
