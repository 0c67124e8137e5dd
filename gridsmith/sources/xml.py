"""XML rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One row per ``row_tag`` element, all fields as text."""
    return spark.read.option("rowTag", row_tag).option("inferSchema", False).xml(path)
