"""Every registered query with SQL, on the smallest tables."""

import os

import pytest
from oracle import check, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


# Queries that end in a small pandas UDF over result rows, and one whose result is a product.
PYTHON_QUERIES = {"anova_single", "anova_scan", "anova_p_values"}
PRODUCT_QUERIES = {"join_cross"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    plans = []
    _, _, problem = check(spark, con, FOLDER, name, QUERIES[name], SQL[name], plans)
    assert problem is None, problem
    assert "BatchEvalPython" not in plans[0]
    if name not in PYTHON_QUERIES:
        assert "ArrowEvalPython" not in plans[0] and "MapInPandas" not in plans[0]
    if name not in PRODUCT_QUERIES:
        assert "CartesianProduct" not in plans[0] and "NestedLoop" not in plans[0]


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
