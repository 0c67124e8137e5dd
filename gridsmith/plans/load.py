"""From text columns to typed columns."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..operators.types import cast_types, infer_schema


def auto_type(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Infer every column's type in one job, then cast in one lazy projection.

    Each datetime column is read with the layout that fits most of its values. When the
    plan of the inference is refused, the table is returned as it came; a failed job raises.
    """
    try:
        # One row per column.
        found = infer_schema(df, overrides).select("column", "logical_type", "datetime_format").collect()
    except AnalysisException as error:
        warnings.warn(f"types could not be inferred, columns stay text: {error}", stacklevel=2)
        return df
    types = {r["column"]: r["logical_type"] for r in found}
    layouts = {r["column"]: r["datetime_format"] for r in found if r["datetime_format"]}
    typed = cast_types(df, types, datetime_format=layouts)
    for name, logical in types.items():
        typed = typed.withMetadata(name, {"logical_type": logical})
    return typed
