"""Data-quality warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, is_numeric, known, numeric_columns, ref, text_columns
from .outliers import IQR_FACTOR, iqr_bounds

IMBALANCE_SHARE = 0.9
_SCHEMA = "check string, column string, detail string, value double"


def imbalance_warnings(df: DataFrame, columns: list[str], threshold: float = IMBALANCE_SHARE) -> DataFrame:
    """Columns whose top value (null counts as one) holds at least ``threshold`` of the rows."""
    parts = [_top_value(df, c) for c in columns]
    found = reduce(DataFrame.unionByName, parts)
    return found.where(F.col("top_fraction") >= threshold)


def _top_value(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(ref(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    best = F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))
    return counts.agg(best.alias("top"), (F.max("n") / F.sum("n")).alias("top_fraction")).select(
        F.lit(column).alias("column"), F.col("top").alias("top_category"), "top_fraction"
    )


def outlier_warnings(df: DataFrame, columns: list[str], k: float = IQR_FACTOR) -> DataFrame:
    """Columns with values beyond the quartile bounds, and how many."""
    bounds = iqr_bounds(df, columns, k)
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, n_outliers long")
    counted = df.agg(
        *[
            F.count_if((as_double(ref(c)) < low) | (as_double(ref(c)) > high)).alias(f"n{i}")
            for i, (c, (low, high)) in enumerate(bounds.items())
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_outliers")) for i, c in enumerate(bounds)]
    return counted.select(F.inline(F.array(*rows))).where("n_outliers > 0")


def missing_extremes_warnings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns without a single value although the table has rows."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count(known(df, c)).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), ((F.col(f"n{i}") == 0) & (F.col("rows") > 0)).alias("hit"))
        for i, c in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*rows))).where("hit").select("column")


def validate(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """All warnings in one table: check, column, detail, value."""
    if types is None:
        numeric, categorical = numeric_columns(df), text_columns(df)
    else:
        numeric = [c for c in df.columns if types.get(c) == "numeric" and is_numeric(df.schema[c].dataType)]
        categorical = [c for c in df.columns if types.get(c) == "categorical"]
    parts = []
    if categorical:
        parts.append(
            imbalance_warnings(df, categorical).select(
                F.lit("imbalance").alias("check"), "column",
                F.col("top_category").alias("detail"), F.col("top_fraction").alias("value"),
            )
        )
    if numeric:
        parts.append(
            outlier_warnings(df, numeric).select(
                F.lit("outliers").alias("check"), "column",
                F.lit(None).cast("string").alias("detail"), F.col("n_outliers").cast("double").alias("value"),
            )
        )
        parts.append(
            missing_extremes_warnings(df, numeric).select(
                F.lit("missing_extremes").alias("check"), "column",
                F.lit("no values").alias("detail"), F.lit(None).cast("double").alias("value"),
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    return reduce(DataFrame.unionByName, parts)
