"""Suggestions drawn from column types and cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.chartdata import suggest_charts
from ..operators.summary import cardinality
from ..operators.types import logical_types


def chart_suggestions(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(columns, chart, reason) for a table; two small results come back to the driver."""
    types = logical_types(df, overrides)
    labels = [c for c, t in types.items() if t in ("categorical", "ordinal", "boolean")]
    distinct = {}
    if labels:
        distinct = {r["column"]: r["n_distinct"] for r in cardinality(df, labels, exact=False).collect()}
    return suggest_charts(types, distinct, df.sparkSession)
