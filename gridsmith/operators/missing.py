"""Filling and dropping missing values, column by column from left to right."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import known, ref
from ..functions.ordered import carry_value, mode_table, quantile_table
from ..session import attach
from .types import native_logical_type

# The strategies' names.
STRATEGIES = (
    "auto", "drop", "mean", "median", "mode", "ffill", "bfill", "constant", "by_group",
)


@dataclass(frozen=True)
class Fill:
    strategy: str = "auto"
    constant: Any = None
    group_by: str | None = None


def fill_missing(
    df: DataFrame,
    fills: dict[str, Fill] | None = None,
    types: dict[str, str] | None = None,
    order_by: list[str] | None = None,
    default: Fill | None = Fill(),
) -> DataFrame:
    """Apply one strategy per column; columns not named get ``default`` (None: left alone).

    NaN is missing like null. A numeric column filled with a mean or median becomes double.

    A ``drop`` removes rows before later columns' statistics are taken, so the columns fall
    into stretches between drops. Per stretch one light pass counts nulls and takes means;
    medians and modes are computed only for columns that do have nulls. What comes back to
    the driver is one number or label per column.
    """
    fills = fills or {}
    types = types or {f.name: native_logical_type(f.dataType) or "categorical" for f in df.schema.fields}
    plan = [(c, fills.get(c, default)) for c in df.columns]
    plan = [(c, f) for c, f in plan if f is not None]
    for _, fill in plan:
        if fill.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {fill.strategy!r}")
    df = df.withColumns({c: known(df, c) for c, _ in plan}) if plan else df
    stretch: list[tuple[str, str, Fill]] = []
    for column, fill in plan:
        if fill.strategy == "drop":
            df = _fill_stretch(df, stretch, order_by).dropna(subset=["`" + column + "`"])
            stretch = []
        else:
            stretch.append((column, _effective(fill, types.get(column)), fill))
    return _fill_stretch(df, stretch, order_by)


def _effective(fill: Fill, logical: str | None) -> str:
    kind = fill.strategy
    if kind in ("mean", "median") and logical == "numeric":
        return kind
    if kind in ("mode", "ffill", "bfill", "constant"):
        return kind
    if kind == "by_group" and fill.group_by:
        return "group_median" if logical == "numeric" else "group_mode"
    return "median" if logical == "numeric" else "mode"


def _fill_stretch(
    df: DataFrame, stretch: list[tuple[str, str, Fill]], order_by: list[str] | None
) -> DataFrame:
    for column, kind, fill in stretch:
        if kind == "constant" and fill.constant is None:
            raise ValueError(f"{column}: the constant strategy needs a value")
        if kind in ("ffill", "bfill") and not order_by:
            raise ValueError(f"{column}: {kind} needs order_by, rows have no order of their own")
    values = _column_values(df, [(c, k) for c, k, _ in stretch if k in ("mean", "median", "mode")])
    for column, kind, fill in stretch:
        data_type = df.schema[column].dataType
        if kind == "constant":
            df = df.withColumn(column, F.coalesce(ref(column), F.lit(fill.constant).cast(data_type)))
        elif kind in ("ffill", "bfill"):
            df = carry_value(df, column, order_by, forward=kind == "ffill")
        elif kind.startswith("group_"):
            df = _fill_by_group(df, column, fill.group_by, kind)
        elif values.get(column) is not None:
            df = df.withColumn(column, _filled(column, data_type, values[column], kind))
    return df


def _filled(column: str, data_type: T.DataType, value: Any, kind: str):
    if kind == "mode" or not isinstance(data_type, T.IntegralType):
        return F.coalesce(ref(column), F.lit(value).cast(data_type))
    # A mean or median of whole numbers need not be whole.
    return F.coalesce(ref(column).cast("double"), F.lit(float(value)))


def _column_values(df: DataFrame, wanted: list[tuple[str, str]]) -> dict[str, Any]:
    if not wanted:
        return {}
    first = df.agg(
        *[F.count_if(ref(c).isNull()).alias(f"nulls_{i}") for i, (c, _) in enumerate(wanted)],
        *[F.avg(ref(c)).alias(f"mean_{i}") for i, (c, k) in enumerate(wanted) if k == "mean"],
    ).first()
    values: dict[str, Any] = {}
    gaps = [(i, c, k) for i, (c, k) in enumerate(wanted) if first[f"nulls_{i}"] > 0]
    for i, column, kind in gaps:
        if kind == "mean":
            values[column] = first[f"mean_{i}"]
    medians = [c for _, c, k in gaps if k == "median"]
    if medians:
        row = quantile_table(df, medians, [0.5]).first()
        values.update({c: row[c][0] for c in medians if row[c] is not None})
    for column in (c for _, c, k in gaps if k == "mode"):
        values[column] = mode_table(df, column).first()["mode"]
    return values


def _fill_by_group(df: DataFrame, column: str, group: str, kind: str) -> DataFrame:
    """Rows with a null group keep what they have; a group without values stays null."""
    keyed = df.where(ref(group).isNotNull())
    if kind == "group_median":
        table = quantile_table(keyed, [column], [0.5], [group])
        table = table.select(ref(group), ref(column)[0].alias("__fill"))
    else:
        table = mode_table(keyed, column, [group]).select(ref(group), F.col("mode").alias("__fill"))
    names = df.columns
    joined = attach(df, table, [group])
    if isinstance(df.schema[column].dataType, T.IntegralType) and kind == "group_median":
        filled = F.coalesce(ref(column).cast("double"), F.col("__fill"))
    else:
        filled = F.coalesce(ref(column), F.col("__fill").cast(df.schema[column].dataType))
    return joined.withColumn(column, filled).select(*map(ref, names))
