"""Numeric against categorical columns (one-way ANOVA) and keys shared between tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import as_double, quoted, ref
from ..functions.distributions import f_tail_column


def anova(df: DataFrame, numeric: str, categorical: str) -> DataFrame:
    return scan_relationships(df, [numeric], [categorical])


def scan_relationships(df: DataFrame, numerics: list[str], categoricals: list[str]) -> DataFrame:
    """One row per pair: F, degrees of freedom, p value and the share of variance explained.

    Per categorical one aggregation serves all numerics. Groups with a single value and the
    null group are left out; fewer than two groups give p = 1. Groups that differ without any
    spread inside them give an infinite F and p = 0; no spread at all gives null for both.
    """
    values = df.select(
        *[as_double(ref(c)).alias(c) for c in numerics],
        *[ref(c) for c in categoricals if c not in numerics],
    )
    # Means near which the group means lie: squares of differences keep their digits.
    centres = values.agg(*[F.avg(ref(c)).alias(f"c{i}") for i, c in enumerate(numerics)]).first()
    parts = [_anova_rows(values, numerics, c, centres) for c in categoricals]
    table = reduce(DataFrame.unionByName, parts)
    tail = f_tail_column("f", "df1", "df2")
    p = (
        F.when(F.col("df1").isNull(), F.lit(1.0))
        .when(F.col("f") == float("inf"), F.lit(0.0))
        .when(F.col("f").isNotNull(), tail)
    )
    return table.withColumn("p_value", p).select(
        "numeric", "categorical", "f", "df1", "df2", "p_value", "effect_size"
    )


def _anova_rows(values: DataFrame, numerics: list[str], categorical: str, centres) -> DataFrame:
    groups = values.where(ref(categorical).isNotNull()).groupBy(ref(categorical)).agg(
        *[
            e
            for i, c in enumerate(numerics)
            for e in (
                F.count(ref(c)).alias(f"n{i}"),
                F.avg(ref(c) - F.lit(centres[f"c{i}"] or 0.0)).alias(f"m{i}"),
                F.var_pop(ref(c)).alias(f"v{i}"),
            )
        ]
    )
    terms: list[Column] = []
    for i in range(len(numerics)):
        used, n, m = F.col(f"n{i}") > 1, F.col(f"n{i}").cast("double"), F.col(f"m{i}")
        terms += [
            F.count_if(used).alias(f"k{i}"),
            F.coalesce(F.sum(F.when(used, n)), F.lit(0.0)).alias(f"n{i}"),
            F.sum(F.when(used, n * m)).alias(f"s{i}"),
            F.sum(F.when(used, n * m * m)).alias(f"q{i}"),
            F.sum(F.when(used, n * F.col(f"v{i}"))).alias(f"w{i}"),
        ]
    total = groups.agg(*terms)
    rows = []
    for i, numeric in enumerate(numerics):
        k, n = F.col(f"k{i}"), F.col(f"n{i}")
        enough = (k >= 2) & (n > k)
        between = F.greatest(F.col(f"q{i}") - F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), n), F.lit(0.0))
        inside = F.col(f"w{i}")
        df1, df2 = (k - 1).cast("double"), n - k
        apart = enough & (inside == 0) & (between > 0)
        f = F.when(apart, F.lit(float("inf"))).when(enough, F.try_divide(between / F.when(df1 > 0, df1), inside / F.when(df2 > 0, df2)))
        rows.append(
            F.struct(
                F.lit(numeric).alias("numeric"), F.lit(categorical).alias("categorical"), f.alias("f"),
                F.when(enough, df1).alias("df1"), F.when(enough, df2).alias("df2"),
                F.when(enough, F.try_divide(between, between + inside)).alias("effect_size"),
            )
        )
    return total.select(F.inline(F.array(*rows)))


def _family(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.IntegralType):
        return "whole"
    if isinstance(data_type, T.StringType):
        return "text"
    return None


def _stacked(table: DataFrame, columns: list[tuple[int, str, str]], words: int) -> DataFrame:
    """(c, a, b, w0, …) per value that is not null: 128 bits of it, and its column's bit.

    Whole numbers are their own bits; a text has two hashes.
    """
    cells = []
    for i, name, family in columns:
        value = quoted(name)
        a, b = (f"cast({value} AS bigint)", "0L") if family == "whole" else (f"if({value} IS NULL, NULL, xxhash64({value}))", f"xxhash64(1, {value})")
        bits = ", ".join(f"shiftleft(1L, {i % 64}) AS w{k}" if k == i // 64 else f"0L AS w{k}" for k in range(words))
        cells.append(f"struct({i} AS c, {a} AS a, {b} AS b, {bits})")
    # One expression: a plan of some hundred columns is parsed faster than built call by call.
    return table.selectExpr(f"inline(array({', '.join(cells)}))").where("a IS NOT NULL")


def _counted(table: DataFrame, columns: list[tuple[int, str, str]]) -> DataFrame:
    """(p, rows, n): rows of the table and values of each column."""
    counts = table.groupBy().agg(F.expr("count(*) AS rows"), *[F.expr(f"count({quoted(c)}) AS n{i}") for i, c, _ in columns])
    return counts.selectExpr("inline(array(" + ", ".join(f"struct({i} AS p, rows, n{i} AS n)" for i, _, _ in columns) + "))")


def detect_relationships(
    tables: dict[str, DataFrame], min_coverage: float = 1.0, families: tuple[str, ...] = ("whole", "text")
) -> DataFrame:
    """Columns whose values are found in a unique column of another table.

    Returns (parent, child, parent_col, child_col, coverage), coverage being the share of
    the child's non-null rows. Nothing is decided by a sketch and no job runs before the result's:
    all columns of all tables are stacked and grouped by value once, into the bitmap of the
    columns that hold it. Few different bitmaps remain, and how many values (or, for a coverage
    below 1, rows of each column) have each of them tells both which columns are unique and
    which lie within which. Texts are compared by 128 bits of hashes.

    Whole-number and text columns are looked at, each kind among itself. A column without values
    is related to nothing; a unique column has no nulls.
    """
    columns = [
        (i, t, f.name, _family(f.dataType))
        for i, (t, f) in enumerate((t, f) for t, table in tables.items() for f in table.schema.fields if _family(f.dataType) in families)
    ]
    spark = next(iter(tables.values())).sparkSession
    schema = "parent string, child string, parent_col string, child_col string, coverage double"
    if not columns:
        return spark.createDataFrame([], schema)
    mine = {t: [(i, c, f) for i, of, c, f in columns if of == t] for t in tables}
    words = [f"w{k}" for k in range(-(-len(columns) // 64))]
    stacked = reduce(DataFrame.unionByName, [_stacked(tables[t], cs, len(words)) for t, cs in mine.items() if cs])
    totals = reduce(DataFrame.unionByName, [_counted(tables[t], cs) for t, cs in mine.items() if cs])

    bitmap = [F.bit_or(w).alias(w) for w in words]

    def held(name: str) -> Column:
        """A row for each column of a bitmap."""
        inside = F.filter(
            F.sequence(F.lit(0), F.lit(len(columns) - 1)),
            lambda i: F.call_function("getbit", F.get(F.array(*words), F.floor(i / 64).cast("int")), i % 64) == 1,
        )
        return F.explode(inside).alias(name)

    value = ["a", "b"]
    if min_coverage >= 1.0:
        # A child lies within its parent when all its values do.
        sets = stacked.groupBy(*value).agg(*bitmap).groupBy(*words).agg(F.count("*").alias("n"))
        by_set = sets.select(*words, held("c"), "n", F.col("n").alias("different"))
    else:
        counts = stacked.groupBy(*value, "c", *words).agg(F.count("*").alias("n"))
        sets = counts.groupBy(*value).agg(*bitmap, F.collect_list(F.struct("c", "n")).alias("of"))
        by_set = sets.select(*words, F.inline("of")).groupBy(*words, "c").agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    none = F.lit(0).cast("bigint")
    pieces = by_set.select("c", held("p"), "n", "different", none.alias("rows"), none.alias("filled")).unionByName(
        totals.select(F.col("p").alias("c"), "p", none.alias("n"), none.alias("different"), "rows", F.col("n").alias("filled"))
    )
    # From here on there is one row per pair of columns; with itself a column shares all it has.
    names = ("n", "different", "rows", "filled")
    shared = pieces.groupBy("c", "p").agg(*[F.sum(x).alias(x) for x in names])
    itself = F.col("c") == F.col("p")

    def of(column: str, what: str) -> Column:
        return F.max(F.when(itself, F.col(what))).over(W.partitionBy(column))

    known = shared.withColumn("all", of("c", "n")).withColumns({f"p_{x}": of("p", x) for x in names[1:]})
    of_table, of_column = (F.from_json(F.lit(json.dumps([c[k] for c in columns])), "array<string>") for k in (1, 2))
    called = {"parent": F.get(of_table, "p"), "child": F.get(of_table, "c"), "parent_col": F.get(of_column, "p"), "child_col": F.get(of_column, "c")}
    coverage = F.try_divide(F.col("n"), F.col("all"))
    return (
        known.where((F.col("p_different") == F.col("p_filled")) & (F.col("p_filled") == F.col("p_rows")) & (coverage >= min_coverage))
        .select(*[e.alias(name) for name, e in called.items()], coverage.alias("coverage"))
        .where("parent <> child")
    )
