"""Tables and queries of databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAVE_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def read_sql_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A table, lazily; filters and columns are pushed to the database.

    With ``partition_column``, ``bounds`` and ``partitions`` the table is read by as many
    connections, each taking a range; rows outside the bounds go to the first or last range.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partition_column is not None:
        if bounds is None or partitions is None:
            raise ValueError("a partition column needs bounds and a number of partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=partitions,
        )
    return reader.load()


def read_sql_query(
    spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None
) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()


def read_sql_tables(
    spark: SparkSession, url: str, tables: list[str], properties: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    return {t: read_sql_table(spark, url, t, properties) for t in tables}


def write_sql(
    df: DataFrame, url: str, table: str, if_exists: str = "replace", properties: dict[str, str] | None = None
) -> None:
    if if_exists not in SAVE_MODES:
        raise ValueError(f"if_exists must be one of {', '.join(SAVE_MODES)}")
    options = {"url": url, "dbtable": table, **(properties or {})}
    df.write.format("jdbc").options(**options).mode(SAVE_MODES[if_exists]).save()
