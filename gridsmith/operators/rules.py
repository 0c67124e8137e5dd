"""Decision rules: if a column meets a condition, set a target column."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import ref
from .filters import Condition, predicate

RULE_OPERATORS = (">", ">=", "<", "<=", "==", "!=")


@dataclass(frozen=True)
class Rule:
    source: str
    op: str
    threshold: Any
    target: str
    value: Any


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Apply rules in order: later ones win and may read targets set before.

    A new target starts as false when its value is a boolean, else as null. Rules with an
    unknown operator only create their target. The result is one projection.
    """
    for rule in rules:
        if rule.source not in df.columns:
            raise ValueError(f"no column {rule.source!r}")
        kind = _kind(rule.value)
        if rule.target not in df.columns:
            start = F.lit(False) if isinstance(rule.value, bool) else F.lit(None).cast(kind)
            df = df.withColumn(rule.target, start)
        if rule.op not in RULE_OPERATORS:
            continue
        present = df.schema[rule.target].dataType
        if isinstance(present, T.StringType) != isinstance(kind, T.StringType) and rule.value is not None:
            raise ValueError(f"{rule.target}: rule values of different kinds")
        hit = predicate(df.schema, Condition(rule.source, rule.op, rule.threshold))
        value = F.lit(rule.value) if not isinstance(present, T.BooleanType) else F.lit(bool(rule.value))
        df = df.withColumn(rule.target, F.when(hit, value).otherwise(ref(rule.target)))
    return df


def _kind(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    return T.DoubleType() if isinstance(value, float) else T.StringType()
