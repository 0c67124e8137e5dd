"""Numeric summaries, histograms, grouped summaries and table overviews."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import as_double, finite, known, numeric_columns, ref
from ..functions.ordered import quantile_table

# Shares reported by summaries and the default bin count.
QUARTILES = (0.25, 0.5, 0.75)
BINS = 20


def corrected_skew(n: Column, g1: Column) -> Column:
    """Sample skewness G1 from the population value; zero without spread, null below 3 rows."""
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(F.nanvl(g1, F.lit(0.0)) * F.when(n > 2, factor), F.lit(0.0)))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis G2 from the population value; null below 4 rows."""
    factor = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)))
    value = factor * ((n + 1) * F.nanvl(g2, F.lit(None).cast("double")) + 6)
    return F.when(n >= 4, F.coalesce(value, F.lit(0.0)))


def _moments(value: Column, i: int) -> list[Column]:
    return [
        F.count(value).alias(f"count_{i}"), F.avg(value).alias(f"mean_{i}"),
        F.stddev_samp(value).alias(f"std_{i}"), F.min(value).alias(f"min_{i}"),
        F.max(value).alias(f"max_{i}"), F.var_samp(value).alias(f"var_{i}"),
        F.skewness(value).alias(f"g1_{i}"), F.kurtosis(value).alias(f"g2_{i}"),
    ]


def extended_numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max, var, skew, kurt.

    Moments of all columns come from one aggregate; the two one-row results meet by an
    equi-join on the column name after being turned into rows.
    """
    columns = numeric_columns(df) if columns is None else columns
    moments = df.agg(*[m for i, c in enumerate(columns) for m in _moments(as_double(ref(c)), i)])
    rows = []
    for i, column in enumerate(columns):
        n = F.col(f"count_{i}").cast("double")
        rows.append(
            F.struct(
                F.lit(column).alias("column"), F.col(f"count_{i}").alias("count"),
                F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std"),
                F.col(f"min_{i}").alias("min"), F.col(f"max_{i}").alias("max"),
                F.col(f"var_{i}").alias("var"),
                corrected_skew(n, F.col(f"g1_{i}")).alias("skew"),
                corrected_kurtosis(n, F.col(f"g2_{i}")).alias("kurt"),
            )
        )
    stats = moments.select(F.inline(F.array(*rows)))
    quantiles = quantile_table(df, columns, list(QUARTILES)).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        *[F.get(ref(c), k).alias(f"q{int(100 * q)}") for k, q in enumerate(QUARTILES)],
                    )
                    for c in columns
                ]
            )
        )
    )
    return stats.join(F.broadcast(quantiles), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "var", "skew", "kurt"
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return extended_numeric_summary(df, columns).select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def value_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest finite value per column that has one (two numbers each)."""
    row = df.agg(
        *[F.min(finite(ref(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(finite(ref(c))).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal-width bins."""
    width = (high - low) / bins
    return [low + i * width for i in range(bins)] + [high]


def add_bins(df: DataFrame, bins: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """Add, per new column, the bin of a value by binary search over its edges.

    Bins are closed on the left, the last one on both sides. Null stays null.
    """
    values = {f"__value_{i}": value for i, (value, _) in enumerate(bins.values())}
    numbers = [f"__bin_{i}" for i in range(len(bins))]
    bucketizer = Bucketizer(
        splitsArray=[edges for _, edges in bins.values()], inputCols=list(values), outputCols=numbers,
        handleInvalid="keep",
    )
    found = bucketizer.transform(df.withColumns(values))
    for name, value, number in zip(bins, values, numbers):
        found = found.withColumn(name, F.when(F.col(value).isNotNull(), F.col(number).cast("int")))
    return found.drop(*values, *numbers)


def widened(low: float, high: float) -> tuple[float, float]:
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histograms(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """(column, bin, lo, hi, count) for all columns in one counting pass; empty bins count 0."""
    ranges = {c: widened(*r) for c, r in value_ranges(df, columns).items()}
    if not ranges:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count long")
    edges = {c: bin_edges(lo, hi, bins) for c, (lo, hi) in ranges.items()}
    places = {c: f"__at_{i}" for i, c in enumerate(ranges)}
    narrow = df.select(*[finite(ref(c)).alias(c) for c in ranges])
    binned = add_bins(narrow, {places[c]: (ref(c), edges[c]) for c in ranges})
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(places[c]).alias("bin")) for c in ranges])
    counted = (
        binned.select(F.inline(cells)).where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("count"))
    )
    rows = [(c, b, edges[c][b], edges[c][b + 1]) for c in ranges for b in range(bins)]
    spec = df.sparkSession.createDataFrame(rows, "column string, bin int, lo double, hi double")
    # Both sides hold one row per bin.
    return spec.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count")
    )


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    return histograms(df, [column], bins)


def analyze_numeric(df: DataFrame, columns: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """The extended summary with each column's histogram as an array of counts."""
    columns = numeric_columns(df) if columns is None else columns
    counts = histograms(df, columns, bins).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "count"))), lambda s: s["count"]).alias("bin_counts")
    )
    return extended_numeric_summary(df, columns).join(F.broadcast(counts), "column", "left")


def grouped_summary(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group ``{col}_count/mean/median/std/min/max``; null groups are dropped."""
    keyed = df.where(ref(group).isNotNull())
    stats = keyed.groupBy(ref(group)).agg(
        *[
            expression
            for c in columns
            for expression in (
                F.count(known(df, c)).alias(f"{c}_count"), F.avg(known(df, c)).alias(f"{c}_mean"),
                F.stddev_samp(known(df, c)).alias(f"{c}_std"), F.min(known(df, c)).alias(f"{c}_min"),
                F.max(known(df, c)).alias(f"{c}_max"),
            )
        ]
    )
    medians = quantile_table(keyed, columns, [0.5], [group]).select(
        ref(group), *[F.get(ref(c), 0).alias(f"{c}_median") for c in columns]
    )
    joined = stats.join(medians, group, "left")
    names = [f"{c}_{s}" for c in columns for s in ("count", "mean", "median", "std", "min", "max")]
    return joined.select(ref(group), *map(ref, names)).orderBy(ref(group))


def overview(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, filled rows and nulls, from one aggregate."""
    counted = df.agg(
        F.count("*").alias("rows"), *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows"), F.col(f"n{i}").alias("n_values"), (F.col("rows") - F.col(f"n{i}")).alias("n_nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*rows)))


def cardinality(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column.

    The exact count takes one scan and one shuffle for all columns: a value is sent as its
    column's number and 128 bits, which are a whole number itself or two hashes of anything else,
    and equal ones are merged before the shuffle. NaN is one value, and so are 0.0 and -0.0.
    """
    columns = columns or df.columns
    if not exact:
        counted = df.agg(*[F.approx_count_distinct(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_distinct")) for i, c in enumerate(columns)]
        return counted.select(F.inline(F.array(*rows)))
    cells, names = [], []
    for i, column in enumerate(columns):
        value, kind = ref(column), df.schema[column].dataType
        if isinstance(kind, T.IntegralType):
            bits = (value.cast("bigint"), F.lit(0).cast("bigint"))
        else:
            value = value + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
            bits = (F.when(value.isNotNull(), F.xxhash64(value)), F.xxhash64(F.lit(1), value))
        cells.append(F.struct(F.lit(i).alias("c"), bits[0].alias("a"), bits[1].alias("b")))
        names.append(F.struct(F.lit(i).alias("c"), F.lit(column).alias("column")))
    counted = df.select(F.inline(F.array(*cells))).where("a IS NOT NULL").distinct().groupBy("c").agg(F.count("*").alias("n"))
    named = df.sparkSession.range(1).select(F.inline(F.array(*names)))
    return named.join(counted, "c", "left").select("column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_distinct"))


def profile_report(df: DataFrame) -> DataFrame:
    """Overview and numeric summary in long form: (section, column, metric, value)."""
    shape = overview(df).select(
        F.lit("overview").alias("section"), "column",
        F.inline(
            F.array(
                F.struct(F.lit("dtype").alias("metric"), F.col("dtype").alias("value")),
                F.struct(F.lit("rows").alias("metric"), F.col("rows").cast("string").alias("value")),
                F.struct(F.lit("n_values").alias("metric"), F.col("n_values").cast("string").alias("value")),
                F.struct(F.lit("n_nulls").alias("metric"), F.col("n_nulls").cast("string").alias("value")),
            )
        ),
    )
    numeric = numeric_columns(df)
    if not numeric:
        return shape.withColumn("number", F.lit(None).cast("double"))
    summary = extended_numeric_summary(df, numeric)
    metrics = [c for c in summary.columns if c != "column"]
    numbers = summary.select(
        F.lit("numeric").alias("section"), "column",
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("number")) for m in metrics]
            )
        ),
    )
    return shape.withColumn("number", F.when(F.col("metric") != "dtype", F.col("value").try_cast("double"))).unionByName(
        numbers.withColumn("value", F.lit(None).cast("string"))
    )
