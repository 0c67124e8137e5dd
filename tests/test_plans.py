"""Plans: what is pushed down, what is broadcast, what runs in Python."""

import os

import pytest

import __spark_entry__ as entry
from gridsmith.operators.filters import Condition, apply_filters
from gridsmith.operators.joins import join_tables
from gridsmith.operators.summary import extended_numeric_summary

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(apply_filters(orders.select("o_orderkey", "o_totalprice"), [Condition("o_totalprice", ">", "1000"), Condition("o_orderkey", "in", "1,2")]))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "In(o_orderkey, [1,2])" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_null_safe_joins_are_hash_joins(spark):
    left = spark.read.parquet(f"{FOLDER}/orders.parquet")
    right = spark.read.parquet(f"{FOLDER}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    for how in ("inner", "left", "right", "outer"):
        assert "NestedLoop" not in plan(join_tables(left, right, "o_custkey", how))


def test_summary_reads_its_columns_once_per_aggregate(spark):
    text = plan(extended_numeric_summary(spark.read.parquet(f"{FOLDER}/lineitem.parquet"), ["l_quantity", "l_tax"]))
    assert text.count("FileScan") == 2 and "ReadSchema: struct<l_quantity:double,l_tax:double>" in text


def test_windows_over_data_are_partitioned(spark):
    """The only single-partition windows run over one row per value range."""
    text = plan(entry.queries()["missing_forward_fill"](spark, FOLDER))
    for line in text.splitlines():
        if "Window [" in line and "event_id" in line:
            assert "__range" in line


def test_flagship_is_one_scan_per_step(spark):
    assert plan(entry.entry(spark)).count("FileScan") <= 2
