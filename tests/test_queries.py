"""Registered queries against their SQL on the smallest tables; tools/check.py runs all of them at any size."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidemark.plans.catalog import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "scan_csv", "scan_json", "malformed_rows", "schema_fingerprint", "profile_full", "profile_by_version",
    "quality_findings", "diff_changes", "diff_all_versions", "attributions", "root_cause", "synthesis_markdown",
    "row_diff", "inbox_page", "timeline_append", "memory_factors", "experiment_result", "audit_all", "ingest_stream",
    "scan_csv_split", "scan_json_split", "profile_merged", "quantile_drift", "ks_distance", "row_diff_segments", "null_segments", "findings_report",
    "context_errors", "content_digest", "lineage_ancestors", "memory_indexed",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    assert check.compare(spark, con, name, SF_DIR).startswith("ok")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())
