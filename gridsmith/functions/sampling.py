"""Row hashes that do not depend on partitioning, and samples drawn with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import ref

HASH_BITS = 52


def row_hash(keys: list[str], seed: int = 42) -> Column:
    """A number in [0, 2**52) from the key columns and the seed (first 13 digits of MD5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(ref(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash: a distributed top-n, the same on every run."""
    hashed = df.withColumn("__hash", row_hash(keys, seed))
    return hashed.orderBy("__hash", *map(ref, keys)).limit(n).drop("__hash")


def sample_per_group(df: DataFrame, group: str, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per group; ranks above ``n`` are cut before the shuffle."""
    within = W.partitionBy(ref(group)).orderBy("__hash", *map(ref, keys))
    ranked = df.withColumn("__hash", row_hash(keys, seed)).withColumn("__rank", F.row_number().over(within))
    return ranked.where(F.col("__rank") <= n).drop("__hash", "__rank")
