"""What the plans of the main operators must and must not hold."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import diff, profile as prof, registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_profile_reads_only_its_columns_once(spark, capsys):
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = plan(prof.profile(lineitem, columns=["l_tax", "l_quantity"]), capsys)
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    assert text.count("ReadSchema") == 1


def test_exact_counts_read_only_the_named_column_again(spark, capsys):
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = plan(prof.profile(lineitem, exact=["l_orderkey"]), capsys)
    assert text.count("ReadSchema") == 2 and "ReadSchema: struct<l_orderkey:bigint>" in text


def test_filters_reach_the_scan(spark, capsys):
    versions = spark.read.parquet(f"{SF_DIR}/customer.parquet").select(
        F.col("c_nationkey").alias("dataset_id"), F.col("c_custkey").alias("version_number")
    )
    assert "EqualTo(c_nationkey,7)" in plan(registry.version_history(versions, 7), capsys)


def test_row_diff_is_one_shuffle(spark, capsys):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    text = plan(diff.row_diff(orders, orders, ["o_orderkey"]), capsys)
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and "Join" not in tree and "SortAggregate" not in tree


@pytest.mark.parametrize("name", ["memory_topk", "attributions", "inbox_search", "timeline_append", "rule_referential", "audit_all"])
def test_no_cross_or_nested_loop_join(spark, capsys, name):
    text = plan(entry.queries()[name](spark, SF_DIR), capsys)
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
