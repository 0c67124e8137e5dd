"""Duplicate removal and reports, by partial aggregation instead of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref


def drop_duplicates(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | bool = "any",
    order_by: list[str] | None = None,
) -> DataFrame:
    """Keep any, the first, the last or none (``keep=False``) of equal rows.

    ``min_by``/``max_by`` combine on the map side, so a key that holds a large share of the
    rows reaches its reducer as one row per map task.
    """
    subset = subset or df.columns
    names = df.columns
    if keep == "any" or (keep in ("first", "last") and set(subset) == set(names)):
        return df.dropDuplicates(subset)
    whole = F.struct(*map(ref, names))
    grouped = df.groupBy(*[ref(c).alias(f"__k{i}") for i, c in enumerate(subset)])
    if keep is False:
        picked = grouped.agg(F.count("*").alias("__n"), F.any_value(whole).alias("__row"))
        picked = picked.where("__n = 1")
    elif keep in ("first", "last"):
        if not order_by:
            raise ValueError("keep first or last needs order_by, rows have no order of their own")
        position = F.struct(*map(ref, order_by))
        pick = F.min_by if keep == "first" else F.max_by
        picked = grouped.agg(pick(whole, position).alias("__row"))
    else:
        raise ValueError(f"unknown keep {keep!r}")
    return picked.select("__row.*")


def duplicate_rows(df: DataFrame, subset: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """All members of groups of equal rows, ordered by the columns compared.

    The repeated keys are found first; the rows then meet them in a semi join, which
    adaptive execution can split on a hot key.
    """
    subset = subset or df.columns
    repeated = (
        df.groupBy(*[ref(c).alias(f"__k{i}") for i, c in enumerate(subset)])
        .agg(F.count("*").alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    condition = None
    for i, column in enumerate(subset):
        term = df["`" + column + "`"].eqNullSafe(repeated[f"__k{i}"])
        condition = term if condition is None else condition & term
    rows = df.join(repeated, condition, "left_semi")
    # Equal keys are spread by the other columns, so that a hot key is not one range of the sort.
    rest = [c for c in df.columns if c not in subset]
    return rows.orderBy(*map(ref, subset), *map(ref, rest)) if ordered else rows


def partial_duplicates(df: DataFrame, columns: list[str], ordered: bool = True) -> DataFrame:
    """Rows that agree with another row on ``columns``."""
    if not columns:
        raise ValueError("name the columns to compare")
    return duplicate_rows(df, columns, ordered)
