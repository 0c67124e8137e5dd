"""Engineered columns: arithmetic on two columns and group aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import known, ref
from ..functions.ordered import quantile_table
from ..session import attach, cut_lineage

ARITHMETIC = ("add", "sub", "mul", "div")
GROUP_FUNCTIONS = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp,
}


@dataclass(frozen=True)
class Arithmetic:
    name: str
    left: str
    right: str
    op: str


@dataclass(frozen=True)
class GroupAggregate:
    name: str
    group: str
    target: str
    func: str


def add_arithmetic(df: DataFrame, features: list[Arithmetic]) -> DataFrame:
    """Add the features in order; a later one may use an earlier one.

    Division by zero gives null. A feature on a column that does not exist is skipped.
    """
    for feature in features:
        if feature.left not in df.columns or feature.right not in df.columns:
            continue
        left, right = ref(feature.left), ref(feature.right)
        if feature.op == "div":
            value = F.try_divide(left.cast("double"), right.cast("double"))
        elif feature.op == "add":
            value = left + right
        elif feature.op == "sub":
            value = left - right
        elif feature.op == "mul":
            value = left * right
        else:
            raise ValueError(f"unknown operation {feature.op!r}")
        df = df.withColumn(feature.name, value)
    return df


def add_group_aggregates(df: DataFrame, features: list[GroupAggregate]) -> DataFrame:
    """Add group aggregates as columns; rows with a null group get null.

    Aggregate, then join back: partial aggregation absorbs a hot group and a small result
    is broadcast, where a window would hold the whole group in one task. The result is written
    and read back, so the planner sees its true size, not that of the rows it came from.
    Features that share a group share one pass.
    """
    present = [f for f in features if f.group in df.columns and f.target in df.columns]
    for feature in present:
        if feature.func != "median" and feature.func not in GROUP_FUNCTIONS:
            raise ValueError(f"unknown aggregate {feature.func!r}")
    for group in dict.fromkeys(f.group for f in present):
        wanted = [f for f in present if f.group == group]
        keyed = df.where(ref(group).isNotNull())
        plain = [f for f in wanted if f.func != "median"]
        medians = [f for f in wanted if f.func == "median"]
        if plain:
            table = keyed.groupBy(ref(group)).agg(
                *[GROUP_FUNCTIONS[f.func](known(df, f.target)).alias(f.name) for f in plain]
            )
            df = attach(df, cut_lineage(table), [group])
        if medians:
            targets = list(dict.fromkeys(f.target for f in medians))
            table = quantile_table(keyed, targets, [0.5], [group])
            table = table.select(ref(group), *[ref(f.target)[0].alias(f.name) for f in medians])
            df = attach(df, cut_lineage(table), [group])
    return df
