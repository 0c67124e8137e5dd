"""Frequency tables, imbalance and cross tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref
from ..session import attach


def freq_table(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """(value, count, fraction of all rows); null is a value of its own."""
    counts = df.groupBy(ref(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    # The row count is a scalar subquery: its value is put into the plan, nothing is joined.
    total = df.agg(F.count("*")).scalar()
    table = counts.withColumn("fraction", F.col("count") / total)
    return table.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()) if ordered else table


def top_categories(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return freq_table(df, column).limit(n)


def imbalance_score(df: DataFrame, column: str) -> DataFrame:
    """Share of the most frequent value; 0 for an empty table."""
    counts = df.groupBy(ref(column)).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)).alias("imbalance"))


def crosstab_long(df: DataFrame, a: str, b: str, normalize: str | None = None) -> DataFrame:
    """(a, b, value) for the pairs that occur; rows with a null in either are left out.

    ``normalize``: ``index``, ``columns`` or ``all`` turn counts into shares.
    """
    pairs = df.where(ref(a).isNotNull() & ref(b).isNotNull())
    counts = pairs.groupBy(ref(a), ref(b)).agg(F.count("*").cast("long").alias("value"))
    if normalize is None:
        return counts
    if normalize == "all":
        return counts.withColumn("value", F.col("value") / pairs.agg(F.count("*")).scalar())
    if normalize not in ("index", "columns"):
        raise ValueError(f"unknown normalize {normalize!r}")
    side = a if normalize == "index" else b
    totals = pairs.groupBy(ref(side)).agg(F.count("*").alias("__total"))
    joined = attach(counts, totals, [side])
    return joined.select(ref(a), ref(b), (F.col("value") / F.col("__total")).alias("value"))


def crosstab(
    df: DataFrame, a: str, b: str, normalize: str | None = None, max_columns: int | None = None
) -> DataFrame:
    """Wide cross table, one column per value of ``b``; pairs that do not occur are 0."""
    found = df.where(ref(b).isNotNull() & ref(a).isNotNull()).select(ref(b).cast("string").alias("v"))
    found = found.distinct()
    values = sorted(r["v"] for r in (found if max_columns is None else found.limit(max_columns + 1)).collect())
    if max_columns is not None and len(values) > max_columns:
        raise ValueError(f"{b} has more than {max_columns} values; use crosstab_long")
    long = crosstab_long(df, a, b, normalize).withColumn(b, ref(b).cast("string"))
    wide = long.groupBy(ref(a)).pivot(b, values).agg(F.first("value"))
    zero = F.lit(0 if normalize is None else 0.0)
    return wide.select(ref(a), *[F.coalesce(ref(v), zero).alias(v) for v in values]).orderBy(ref(a))

