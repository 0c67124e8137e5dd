"""Session helpers: the checkpoint folder, written tables and null-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    A folder of our own is made only when the session names none and runs in local mode.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="gridsmith-checkpoint-")
    context.setCheckpointDir(folder)


def shared_path(spark: SparkSession) -> str:
    """A new path below the checkpoint folder, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/gridsmith-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder and continue from the written table.

    Lost executors recompute nothing, and the planner sees the true size afterwards. (A
    checkpoint keeps the size estimate of its plan, which a loop of joins squares each
    round.) The session's folder is emptied like any checkpoint folder, by its owner.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` holds (no job is run).

    The optimizer's estimate, but not more than a few times the tables it reads: after joins
    the estimate is a product. One megabyte when nothing is known.
    """
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        return min(int(str(plan.stats().sizeInBytes())), 8 * read) if read < 1 << 60 else 1 << 20
    except (AttributeError, ValueError):  # not a classic session, or a number with thousands of digits
        return 1 << 20


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join per-key results back to the rows they were computed from.

    ``table`` holds one row per key. No side is hinted: adaptive execution broadcasts it if its
    bytes turn out to be few, however wide the rows are, and splits hot keys otherwise.
    Keys compare null-safe; the key columns of ``df`` are kept.
    """
    return null_safe_join(df, table, on, how)


def null_safe_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key meets a null key; keeps the key columns of ``df``."""
    renamed = table.select(
        *[table[f"`{k}`"].alias(f"__key_{i}") for i, k in enumerate(on)],
        *[table[f"`{c}`"] for c in table.columns if c not in on],
    )
    condition = None
    for i, key in enumerate(on):
        term = df[f"`{key}`"].eqNullSafe(renamed[f"__key_{i}"])
        condition = term if condition is None else condition & term
    joined = df.join(renamed, condition, how)
    return joined.drop(*[f"__key_{i}" for i in range(len(on))])
