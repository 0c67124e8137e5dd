"""Outlier bounds, detection, flags and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, numeric_columns, ref
from ..functions.ordered import quantile_table

# Distance factors.
IQR_FACTOR = 1.5
Z_LIMIT = 3.0


def iqr_bounds(df: DataFrame, columns: list[str], k: float = IQR_FACTOR) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column that has values (two numbers per column)."""
    if not columns:
        return {}
    row = quantile_table(df, columns, [0.25, 0.75]).first()
    bounds = {}
    for column in columns:
        if row[column] is not None and row[column][0] is not None:
            low, high = row[column]
            bounds[column] = (low - k * (high - low), high + k * (high - low))
    return bounds


def clip_outliers(df: DataFrame, columns: list[str] | None = None, k: float = IQR_FACTOR) -> DataFrame:
    """Pull values beyond the bounds back to them; nulls stay null, NaN becomes null."""
    columns = numeric_columns(df) if columns is None else columns
    changed = {}
    for column, (low, high) in iqr_bounds(df, columns, k).items():
        value = as_double(ref(column))
        changed[column] = F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)
    return df.withColumns(changed) if changed else df


def _tests(df: DataFrame, columns: list[str], method: str, k: float, limit: float) -> dict[str, Column]:
    if method == "iqr":
        return {
            c: (as_double(ref(c)) < low) | (as_double(ref(c)) > high) for c, (low, high) in iqr_bounds(df, columns, k).items()
        }
    if method != "zscore":
        raise ValueError(f"unknown method {method!r}")
    row = df.agg(
        *[F.avg(as_double(ref(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(as_double(ref(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: F.abs((as_double(ref(c)) - row[f"m{i}"]) / row[f"s{i}"]) > limit
        for i, c in enumerate(columns)
        if row[f"s{i}"]
    }


def detect_outliers(
    df: DataFrame, columns: list[str], keys: list[str], method: str = "iqr",
    k: float = IQR_FACTOR, limit: float = Z_LIMIT,
) -> DataFrame:
    """One row per outlying value: key columns, column, method, value. One scan for all columns."""
    tests = _tests(df, columns, method, k, limit)
    key_type = [ref(c) for c in keys]
    if not tests:
        tests = {c: F.lit(False) for c in columns[:1]}
    found = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(method).alias("method"),
                ref(c).cast("double").alias("value"), F.coalesce(t, F.lit(False)).alias("hit"),
            )
            for c, t in tests.items()
        ]
    )
    return df.select(*key_type, F.inline(F.filter(found, lambda s: s["hit"]))).drop("hit")


def mark_outliers(
    df: DataFrame, columns: list[str], method: str = "iqr", k: float = IQR_FACTOR, limit: float = Z_LIMIT
) -> DataFrame:
    """Add a boolean ``{column}_is_outlier_{method}`` for every column asked for."""
    tests = _tests(df, columns, method, k, limit)
    return df.withColumns(
        {
            f"{c}_is_outlier_{method}": F.coalesce(tests[c], F.lit(False)) if c in tests else F.lit(False)
            for c in columns
        }
    )
