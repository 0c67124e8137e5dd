"""Conditions on columns, projections and previews."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import is_numeric, ref

# The operators' names.
OPERATORS = (">", ">=", "<", "<=", "==", "!=", "contains", "in", "not in", "between")


@dataclass(frozen=True)
class Condition:
    """``value`` is the text a user types; ``in`` and ``between`` take comma lists."""

    column: str
    op: str
    value: Any


def literal(value: Any, data_type: T.DataType) -> Column:
    """The value as a literal of the column's own kind, so that it is pushed to the scan."""
    text = value.strip() if isinstance(value, str) else value
    if isinstance(data_type, T.IntegralType):
        number = float(text)
        return F.lit(int(text)) if not isinstance(text, float) and number.is_integer() and "." not in str(text) and "e" not in str(text).lower() else F.lit(number)
    if isinstance(data_type, T.DecimalType):
        return F.lit(Decimal(str(text)))
    if is_numeric(data_type):
        return F.lit(float(text))
    if isinstance(data_type, T.BooleanType):
        words = {"true": True, "false": False}
        if isinstance(text, str):
            if text.lower() not in words:
                raise ValueError(f"not a boolean: {value!r}")
            text = words[text.lower()]
        return F.lit(bool(text))
    if isinstance(data_type, T.DateType):
        return F.lit(text if isinstance(text, date) else date.fromisoformat(text))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        moment = text if isinstance(text, datetime) else datetime.fromisoformat(text)
        return F.lit(moment.isoformat(sep=" ")).cast(data_type)
    return F.lit(str(value))


def _items(value: Any) -> list[Any]:
    if isinstance(value, str):
        return [part.strip() for part in value.split(",")]
    return list(value)


def predicate(schema: T.StructType, condition: Condition) -> Column | None:
    """Spark condition, or None when the column or the operator is unknown."""
    if condition.column not in schema.fieldNames() or condition.op not in OPERATORS:
        return None
    column, data_type = ref(condition.column), schema[condition.column].dataType
    if condition.op == "contains":
        return column.cast("string").rlike(str(condition.value))
    if condition.op in ("in", "not in"):
        inside = column.isin(*[literal(v, data_type) for v in _items(condition.value)])
        return inside if condition.op == "in" else column.isNull() | ~inside
    if condition.op == "between":
        bounds = _items(condition.value)
        if len(bounds) != 2:
            raise ValueError("between needs exactly two values: low,high")
        low, high = (literal(v, data_type) for v in bounds)
        return column.between(low, high)
    value = literal(condition.value, data_type)
    if condition.op == "==":
        return column == value
    if condition.op == "!=":
        return ~column.eqNullSafe(value)
    if condition.op in (">", ">="):
        above = column > value if condition.op == ">" else column >= value
        # NaN is missing, but Spark sorts it above every number.
        return above & ~F.isnan(column) if isinstance(data_type, (T.DoubleType, T.FloatType)) else above
    return column < value if condition.op == "<" else column <= value


def apply_filters(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Rows that meet every condition."""
    terms = [predicate(df.schema, c) for c in conditions]
    terms = [t for t in terms if t is not None]
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def filter_count(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    return apply_filters(df, conditions).agg(F.count("*").alias("rows"))


def preview(df: DataFrame, n: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """First rows; with ``order_by`` a distributed top-n, never a full sort."""
    return (df.orderBy(*map(ref, order_by)) if order_by else df).limit(n)


def preview_filter(
    df: DataFrame, conditions: list[Condition], n: int = 20, order_by: list[str] | None = None
) -> DataFrame:
    return preview(apply_filters(df, conditions), n, order_by)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*map(ref, columns))


def select_by_type(df: DataFrame, logical_type: str, types: dict[str, str] | None = None) -> DataFrame:
    """Columns of one logical type, from ``types`` or else from the physical schema."""
    from .types import native_logical_type

    kinds = types or {f.name: native_logical_type(f.dataType) or "categorical" for f in df.schema.fields}
    return df.select(*[ref(c) for c in df.columns if kinds.get(c) == logical_type])
