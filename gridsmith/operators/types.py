"""Logical column types: inference, casting and the error policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    DATETIME_FORMATS, INFERRED_BOOLEAN_WORDS, is_numeric, maybe_datetime, ref, text_to_boolean, text_to_datetime,
    text_to_number,
)

# Shares of parsed values that decide a type.
NUMERIC_SHARE = 0.95
DATETIME_SHARE = 0.7

LOGICAL_TYPES = ("numeric", "datetime", "boolean", "categorical", "ordinal")


def native_logical_type(data_type: T.DataType) -> str | None:
    """Logical type of an already typed column; None for text, which must be inferred."""
    if is_numeric(data_type):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return None if isinstance(data_type, T.StringType) else "categorical"


_OTHER_WORD = 1 << len(INFERRED_BOOLEAN_WORDS)


def _marks(value: Column) -> list[Column]:
    """Number or not, the layouts that read the text as bits (day and month may be either), and its boolean word as a bit."""
    layout = F.lit(0)
    for k, name in enumerate(DATETIME_FORMATS):
        layout = layout + F.when(text_to_datetime(value, name).isNotNull(), F.lit(1 << k)).otherwise(0)
    known = F.array(*map(F.lit, INFERRED_BOOLEAN_WORDS))
    place = F.when(F.octet_length(value) <= 5, F.array_position(known, F.lower(value))).otherwise(0)
    bit = F.when(place > 0, F.pow(F.lit(2.0), place - 1)).otherwise(_OTHER_WORD).cast("int")
    return [
        text_to_number(value).isNotNull().alias("is_number"),
        F.when(maybe_datetime(value), layout).otherwise(0).alias("layout"), bit.alias("word"),
    ]


def _text_counts(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """Counts per text column. The columns are stacked, so that one short piece of code serves
    all of them; map-side combining leaves one row per column and task."""
    stacked = F.array(*[F.struct(F.lit(i).alias("i"), ref(c).alias("v")) for i, c in columns])
    values = df.select(F.inline(stacked)).where("v is not null")
    return values.select("i", "v", *_marks(F.col("v"))).groupBy("i").agg(
        F.count("*").alias("n"), F.approx_count_distinct("v").alias("d"),
        F.count_if("is_number").alias("numbers"), F.bit_or("word").alias("words"),
        F.array(*[F.count_if(F.col("layout").bitwiseAND(1 << k) != 0) for k in range(len(DATETIME_FORMATS))]).alias("layouts"),
    )


def _typed_counts(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """The same for columns that have their type already."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    counted = df.agg(
        *[F.count(ref(c)).alias(f"n{i}") for i, c in columns],
        *[
            (F.max(F.lit(None).cast("long")) if isinstance(df.schema[c].dataType, nested) else F.approx_count_distinct(ref(c))).alias(f"d{i}")
            for i, c in columns
        ],
    )
    rows = [
        F.struct(
            F.lit(i).alias("i"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d"), F.lit(0).cast("long").alias("numbers"),
            F.lit(0).alias("words"), F.array(F.lit(0).cast("long")).alias("layouts"),
        )
        for i, _ in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def infer_schema(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row per column: logical and physical type, with the shares behind the decision.

    Each text is reduced to three small marks (reads as a number, which layout reads it,
    which boolean word it is), and only those are counted; no value sets are collected.
    """
    overrides = overrides or {}
    native = [native_logical_type(f.dataType) for f in df.schema.fields]
    spec = df.sparkSession.createDataFrame(
        [
            (i, f.name, native[i], overrides.get(f.name), f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields)
        ],
        "i int, column string, native string, override string, inferred_type string",
    )
    texts = [(i, c) for i, c in enumerate(df.columns) if native[i] is None]
    typed = [(i, c) for i, c in enumerate(df.columns) if native[i] is not None]
    counts = [count(df, columns) for count, columns in ((_text_counts, texts), (_typed_counts, typed)) if columns]
    # One row per column on both sides.
    joined = spec.join(F.broadcast(reduce(DataFrame.unionByName, counts)), "i", "left")
    total, best = F.coalesce("n", F.lit(0)), F.array_max("layouts")
    is_native = F.col("native").isNotNull()
    numeric = F.when(is_native, (F.col("native") == "numeric").cast("double")).otherwise(F.try_divide(F.col("numbers"), total))
    dated = F.when(is_native, (F.col("native") == "datetime").cast("double")).otherwise(F.try_divide(best, total))
    logical = F.coalesce(
        F.col("override"), F.col("native"),
        F.when(total == 0, "categorical")
        .when(numeric >= NUMERIC_SHARE, "numeric")
        .when(dated > DATETIME_SHARE, "datetime")
        .when((F.col("words") < _OTHER_WORD) & (F.bit_count("words") <= 2), "boolean")
        .otherwise("categorical"),
    )
    place = (F.array_position("layouts", best) - 1).cast("int")
    layout = F.when((logical == "datetime") & ~is_native & (best > 0), F.get(F.array(*map(F.lit, DATETIME_FORMATS)), place))
    return joined.select(
        "column", logical.alias("logical_type"), "inferred_type", total.alias("n_values"),
        numeric.alias("numeric_frac"), dated.alias("datetime_frac"),
        F.coalesce("d", F.lit(0)).alias("approx_distinct"), layout.alias("datetime_format"),
    )


def logical_types(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Column → logical type. Runs the inference only when there are text columns."""
    overrides = overrides or {}
    known = {f.name: native_logical_type(f.dataType) for f in df.schema.fields}
    unknown = [c for c, kind in known.items() if kind is None and c not in overrides]
    if unknown:
        found = infer_schema(df.select(*map(ref, unknown))).collect()  # one row per column
        known.update({r["column"]: r["logical_type"] for r in found})
    return {**known, **overrides}


def cast_types(
    df: DataFrame,
    types: dict[str, str],
    datetime_format: str | dict[str, str] | None = None,
    errors: str = "coerce",
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Cast columns to their logical types in one projection.

    ``errors``: ``coerce`` makes unreadable values null, ``raise`` fails the job, ``ignore``
    keeps the column as it was unless all its values can be read.
    """
    if errors not in ("coerce", "raise", "ignore"):
        raise ValueError(f"unknown error policy {errors!r}")
    if isinstance(datetime_format, dict):
        layouts = datetime_format
    else:
        layouts = {c: datetime_format for c in df.columns}
    changed: dict[str, Column] = {}
    for name, logical in types.items():
        if name not in df.columns:
            continue
        data_type = df.schema[name].dataType
        column = _cast(ref(name), data_type, logical, layouts.get(name))
        if column is not None:
            changed[name] = column
    strict = [c for c in changed if types[c] in ("numeric", "datetime")]
    if errors == "raise":
        for name in strict:
            lost = ref(name).isNotNull() & changed[name].isNull()
            message = F.concat(F.lit(f"{name}: cannot read "), ref(name).cast("string"))
            changed[name] = F.when(lost, F.raise_error(message)).otherwise(changed[name])
    elif errors == "ignore" and strict:
        failures = df.agg(
            *[F.count_if(ref(c).isNotNull() & changed[c].isNull()).alias(c) for c in strict]
        ).first()
        changed = {c: e for c, e in changed.items() if c not in strict or failures[c] == 0}
    result = df.withColumns(changed) if changed else df
    for name, ordered in (levels or {}).items():
        if types.get(name) == "ordinal" and name in result.columns:
            result = result.withMetadata(name, {"logical_type": "ordinal", "levels": ordered})
    return result


def _cast(column: Column, data_type: T.DataType, logical: str, layout: str | None) -> Column | None:
    is_text = isinstance(data_type, T.StringType)
    if logical == "numeric":
        if is_text:
            return text_to_number(column)
        return column.cast("double") if isinstance(data_type, T.BooleanType) else None
    if logical == "datetime":
        return text_to_datetime(column, layout) if is_text else None
    if logical == "boolean":
        if isinstance(data_type, T.BooleanType):
            return None
        return text_to_boolean(column.cast("string"))
    if logical in ("categorical", "ordinal"):
        return column.cast("string")
    return None
