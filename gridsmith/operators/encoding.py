"""Category encodings: one-hot, ordinal and frequency, with fitted maps for reuse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref
from ..functions.ordered import running_totals
from ..session import attach

OTHER = "Other"


@dataclass(frozen=True)
class Encoding:
    encoding: str = "one_hot"
    ordered: tuple[str, ...] | None = None
    min_freq: int | None = None
    min_frac: float | None = None


def value_counts(df: DataFrame, column: str) -> DataFrame:
    text = ref(column).cast("string")
    return df.where(text.isNotNull()).groupBy(text.alias("value")).agg(F.count("*").alias("n"))


def rare_values(
    df: DataFrame, column: str, min_freq: int | None = None, min_frac: float | None = None
) -> DataFrame:
    """Values seen too seldom. The share is taken of all rows, nulls included."""
    counts = value_counts(df, column)
    rare = F.lit(False)
    if min_freq is not None:
        rare = rare | (F.col("n") < min_freq)
    if min_frac is not None:
        rare = rare | (F.col("n") / F.lit(df.count()) < min_frac)
    return counts.where(rare).select("value")


def collapse_rare(
    df: DataFrame, column: str, min_freq: int | None = None, min_frac: float | None = None
) -> DataFrame:
    """Replace rare values by ``Other``; nulls stay null."""
    if min_freq is None and min_frac is None:
        return df
    table = rare_values(df, column, min_freq, min_frac)
    table = table.select(F.col("value").alias(column), F.lit(True).alias("__rare"))
    text = df.withColumn(column, ref(column).cast("string"))
    joined = attach(text, table, [column])
    value = F.when(F.col("__rare"), F.lit(OTHER)).otherwise(ref(column))
    return joined.withColumn(column, value).select(*map(ref, df.columns))


def encode_one_hot(
    df: DataFrame,
    columns: list[str],
    min_freq: int | None = None,
    min_frac: float | None = None,
    max_columns: int | None = None,
) -> DataFrame:
    """Replace each column by one boolean per value; a null row is false everywhere.

    The result is as wide as the column has values; ``one_hot_long`` holds any number of them.
    With ``max_columns`` more values than that are refused.
    """
    for column in columns:
        df = collapse_rare(df, column, min_freq, min_frac)
        values = value_counts(df, column).select("value")
        found = (values if max_columns is None else values.limit(max_columns + 1)).collect()
        if max_columns is not None and len(found) > max_columns:
            raise ValueError(
                f"{column} has more than {max_columns} values; set min_freq or min_frac, or use one_hot_long"
            )
        text = ref(column).cast("string")
        flags = [
            F.coalesce(text == F.lit(v), F.lit(False)).alias(f"{column}_{v}")
            for v in sorted(r["value"] for r in found)
        ]
        df = df.select(*[ref(c) for c in df.columns if c != column], *flags)
    return df


def one_hot_long(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The true cells of a one-hot encoding as rows (keys, feature); any number of values."""
    text = ref(column).cast("string")
    return df.where(text.isNotNull()).select(
        *map(ref, keys), F.concat(F.lit(f"{column}_"), text).alias("feature")
    )


def fit_ordinal(df: DataFrame, column: str, ordered: list[str] | None = None) -> DataFrame:
    """(column, value, code): the given order, else the sorted values."""
    if ordered:
        rows = [(column, v, float(i)) for i, v in enumerate(ordered)]
        table = df.sparkSession.createDataFrame(rows, "column string, value string, code double")
        return table.groupBy("column", "value").agg(F.max("code").alias("code"))
    values = value_counts(df, column).select("value")
    positions = running_totals(values, "value", {"code": F.lit(1)})
    return positions.select(F.lit(column).alias("column"), "value", F.col("code").cast("double").alias("code"))


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    """(column, value, code): the share of each value among the non-null rows."""
    total = df.where(ref(column).isNotNull()).agg(F.count("*").alias("n")).first()["n"]
    return value_counts(df, column).select(
        F.lit(column).alias("column"), "value", (F.col("n") / F.lit(total)).alias("code")
    )


def apply_encoding(df: DataFrame, mapping: DataFrame, column: str, unseen: float | None = None) -> DataFrame:
    """Replace a column by the codes of a fitted map; works on streams too."""
    table = mapping.where(F.col("column") == column).select(F.col("value").alias(column), F.col("code").alias("__code"))
    text = df.withColumn(column, ref(column).cast("string"))
    if df.isStreaming:
        joined = text.join(table, column, "left")
    else:
        joined = attach(text, table, [column])
    code = F.col("__code") if unseen is None else F.coalesce("__code", F.lit(unseen))
    return joined.withColumn(column, code).select(*map(ref, df.columns))


def encode_ordinal(df: DataFrame, column: str, ordered: list[str] | None = None) -> DataFrame:
    return apply_encoding(df, fit_ordinal(df, column, ordered), column)


def encode_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    for column in columns:
        df = apply_encoding(df, fit_frequency(df, column), column, unseen=0.0)
    return df


def encode(
    df: DataFrame, columns: list[str], encodings: dict[str, Encoding] | None = None, default: str = "one_hot"
) -> DataFrame:
    """Encode each column by its own setting, or by the default."""
    for column in columns:
        setting = (encodings or {}).get(column, Encoding(default))
        if setting.encoding == "one_hot":
            df = encode_one_hot(df, [column], setting.min_freq, setting.min_frac)
        elif setting.encoding == "ordinal":
            df = encode_ordinal(df, column, list(setting.ordered) if setting.ordered else None)
        elif setting.encoding == "frequency":
            df = encode_frequency(df, [column])
        else:
            raise ValueError(f"unknown encoding {setting.encoding!r}")
    return df
