"""Incremental loads: only rows whose key is above the last one committed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ..functions.columns import ref

_STATE_SCHEMA = "source_id string, last_key long, committed_at timestamp"


def source_name(url: str, table: str, key: str) -> str:
    return f"{url}|{table}|{key}"


@dataclass(frozen=True)
class IncrementalLoad:
    """``rows`` to be written by the caller, who then calls ``commit``."""

    rows: DataFrame
    top: int | None
    state_path: str
    source_id: str

    def commit(self) -> int | None:
        """Record the largest key of ``rows``; the state stays as it is when there is none.

        Call it after the rows have been stored: a job lost in between loads them again. The
        key was taken before the rows were read, so rows that arrive since are loaded next time.
        """
        if self.top is not None:
            spark = self.rows.sparkSession
            state = spark.createDataFrame([(self.source_id, self.top)], "source_id string, last_key long")
            state.withColumn("committed_at", F.current_timestamp()).write.mode("append").json(self.state_path)
        return self.top


def last_key(spark: SparkSession, state_path: str, source_id: str) -> int | None:
    """Largest committed key of a source; None before the first load."""
    try:
        state = spark.read.schema(_STATE_SCHEMA).json(state_path)
        return state.where(F.col("source_id") == source_id).agg(F.max("last_key").alias("k")).first()["k"]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_incremental(table: DataFrame, key: str, state_path: str, source_id: str) -> IncrementalLoad:
    """New rows of a table or JDBC scan, up to the largest key there is now; both bounds are pushed to the source.

    A key that is not a whole number has no order to go by: all rows are read, nothing is committed.
    """
    if not isinstance(table.schema[key].dataType, T.IntegralType):
        return IncrementalLoad(table, None, state_path, source_id)
    known = last_key(table.sparkSession, state_path, source_id)
    rows = table if known is None else rows_after(table, key, known)
    top = rows.agg(F.max(ref(key)).cast("long").alias("top")).first()["top"]
    # Rows without a key are read by the first load only.
    within = ref(key) <= F.lit(top) if known is not None else ref(key).isNull() | (ref(key) <= F.lit(top))
    return IncrementalLoad(rows.where(within) if top is not None else rows, top, state_path, source_id)


def rows_after(table: DataFrame, key: str, known: int) -> DataFrame:
    return table.where(ref(key) > F.lit(known))
