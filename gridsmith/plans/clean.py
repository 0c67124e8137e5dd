"""The cleaning pipeline: missing values, numbers, labels, features, warnings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.features import Arithmetic, GroupAggregate, add_arithmetic, add_group_aggregates
from ..operators.labels import clean_labels
from ..operators.missing import Fill, fill_missing
from ..operators.outliers import IQR_FACTOR, clip_outliers
from ..operators.types import native_logical_type
from ..operators.validation import validate
from ..functions.columns import is_numeric

# The names and order of the steps.
STEPS = ("missing_values", "numeric_cleaning", "categorical_cleaning", "feature_engineering", "validation")


@dataclass(frozen=True)
class CleaningPlan:
    fills: dict[str, Fill] = field(default_factory=dict)
    default_fill: Fill | None = Fill()
    clip: bool = False
    iqr_factor: float = IQR_FACTOR
    strip_space: bool = True
    title: bool = True
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    arithmetic: list[Arithmetic] = field(default_factory=list)
    group_aggregates: list[GroupAggregate] = field(default_factory=list)
    order_by: list[str] | None = None


def clean(
    df: DataFrame, plan: CleaningPlan = CleaningPlan(), types: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, report). The table is lazy; the report is computed when it is read.

    Statistics for filling and clipping come back as constants, so that the cleaned table
    is a projection of the input (plus joins for grouped features).
    """
    types = types or {f.name: native_logical_type(f.dataType) or "categorical" for f in df.schema.fields}
    work = fill_missing(df, plan.fills, types, plan.order_by, plan.default_fill)
    numeric = [c for c, t in types.items() if t == "numeric" and c in work.columns and is_numeric(work.schema[c].dataType)]
    if plan.clip:
        work = clip_outliers(work, numeric, plan.iqr_factor)
    labels = [c for c, t in types.items() if t == "categorical" and c in work.columns]
    work = clean_labels(work, labels, plan.strip_space, plan.title, plan.mappings)
    checked = work
    work = add_arithmetic(work, plan.arithmetic)
    work = add_group_aggregates(work, plan.group_aggregates)
    # Features add columns, never rows, so the warnings need not wait for their joins.
    if {f.name for f in [*plan.arithmetic, *plan.group_aggregates]} & set(types):
        checked = work
    return work, cleaning_report(df, checked, validate(checked, types), len(work.columns))


def cleaning_report(before: DataFrame, after: DataFrame, warnings: DataFrame, columns_after: int) -> DataFrame:
    """(section, item, detail, value): shapes, steps and warnings."""
    spark = before.sparkSession
    columns = "section string, item string, detail string, value double"
    steps = spark.createDataFrame(
        [("step", name, None, float(i + 1)) for i, name in enumerate(STEPS)]
        + [("shape", "columns_before", None, float(len(before.columns))), ("shape", "columns_after", None, float(columns_after))],
        columns,
    )

    def rows(df: DataFrame, item: str) -> DataFrame:
        return df.agg(F.count("*").cast("double").alias("value")).select(
            F.lit("shape").alias("section"), F.lit(item).alias("item"), F.lit(None).cast("string").alias("detail"), "value"
        )

    found = warnings.select(
        F.concat(F.lit("warning_"), "check").alias("section"), F.col("column").alias("item"), "detail", "value"
    )
    return steps.unionByName(rows(before, "rows_before")).unionByName(rows(after, "rows_after")).unionByName(found)
