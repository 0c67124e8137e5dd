"""Incremental loads of files as a stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def load_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    steps: list[Callable[[DataFrame], DataFrame]] | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Process the files that arrived since the last run and append them to ``target``.

    ``steps`` are row-wise operators: casts, filters, label cleaning, arithmetic, rules,
    fitted encodings and predictions. ``checkpoint`` records what was loaded and must lie
    in shared storage, so that a lost driver or executor neither skips nor repeats a file.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    for step in steps or []:
        stream = step(stream)
    return (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
