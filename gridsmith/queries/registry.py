"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that the order of summation does not show."""
    columns: list[Column] = []
    for field in df.schema.fields:
        column = F.col("`" + field.name + "`")
        if field.dataType.typeName() == "double":
            column = F.round(column, special.get(field.name, digits)) + F.lit(0.0)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# The given tables hold no nulls. These views blank single cells by key; every row stays.
LINEITEM_GAPS = """lineitem_gaps AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
         l_tax,
         CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)"""

EVENTS_GAPS = """events_gaps AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value
  FROM events)"""

# NaN is missing: these values are null for SQL and NaN for Spark.
EVENTS_NAN = """events_nan AS (
  SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"""

CUSTOMER_GAPS = """customer_gaps AS (
  SELECT c_custkey, c_name,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         c_acctbal,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


def _blank(df: DataFrame, column: str, key: str, step: int) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) % step != 0, F.col(column)))


def lineitem_gaps(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    df = _blank(df, "l_quantity", "l_orderkey", 7)
    df = _blank(df, "l_discount", "l_partkey", 11)
    return _blank(df, "l_returnflag", "l_suppkey", 13)


def events_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _blank(table(spark, folder, "events").drop("props"), "value", "event_id", 5)


def events_nan(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return df.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))


def customer_gaps(spark: SparkSession, folder: str) -> DataFrame:
    df = _blank(table(spark, folder, "customer"), "c_nationkey", "c_custkey", 17)
    return _blank(df, "c_mktsegment", "c_custkey", 9)


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
