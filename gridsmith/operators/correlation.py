"""Pearson, Spearman and Kendall correlation of all column pairs, pairwise complete."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import as_double, numeric_columns, ref
from ..functions.ordered import row_positions

METHODS = ("pearson", "spearman", "kendall")


def corr_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(col_a, col_b, corr) for every ordered pair, the diagonal included."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    columns = numeric_columns(df) if columns is None else columns
    values = df.select(*[as_double(ref(c)).alias(c) for c in columns])
    if method == "pearson":
        half = _pearson(values, columns)
    else:
        ranked = _spearman if method == "spearman" else _kendall
        parts = [ranked(values.select(*map(ref, c)), c) for c in _complete_sets(values, columns)]
        spread = values.agg(
            *[(F.min(ref(c)) < F.max(ref(c))).alias(f"v{i}") for i, c in enumerate(columns)]
        ).select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("col_a"), F.lit(c).alias("col_b"),
                            F.when(F.col(f"v{i}"), F.lit(1.0)).alias("corr"),
                        )
                        for i, c in enumerate(columns)
                    ]
                )
            )
        )
        half = reduce(DataFrame.unionByName, parts, spread)
    mirrored = F.when(
        F.col("col_a") == F.col("col_b"), F.array(F.struct("col_a", "col_b", "corr"))
    ).otherwise(
        F.array(
            F.struct("col_a", "col_b", "corr"),
            F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"),
        )
    )
    return half.select(F.inline(mirrored))


def _pearson(values: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair is three aggregates of a single scan; the result is one row.

    Spread and covariance are taken apart because the built-in correlation fails the job
    on a constant column under ANSI rules.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggregates = [F.var_pop(ref(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    for i, (a, b) in enumerate(pairs):
        both = ref(a).isNotNull() & ref(b).isNotNull()
        aggregates += [
            F.covar_pop(ref(a), ref(b)).alias(f"c{i}"),
            F.stddev_pop(F.when(both, ref(a))).alias(f"a{i}"), F.stddev_pop(F.when(both, ref(b))).alias(f"b{i}"),
        ]
    structs = [
        F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.when(F.col(f"v{i}") > 0, F.lit(1.0)).alias("corr"))
        for i, c in enumerate(columns)
    ]
    for i, (a, b) in enumerate(pairs):
        value = F.try_divide(F.col(f"c{i}"), F.col(f"a{i}") * F.col(f"b{i}"))
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), value.alias("corr")))
    return values.agg(*aggregates).select(F.inline(F.array(*structs)))


def _complete_sets(values: DataFrame, columns: list[str]) -> list[list[str]]:
    """Column sets that can be ranked together: all columns without nulls, else single pairs."""
    counted = values.agg(F.count("*").alias("rows"), *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    full = [c for i, c in enumerate(columns) if counted[f"n{i}"] == counted["rows"]]
    pairs = [[a, b] for a, b in combinations(columns, 2) if not (a in full and b in full)]
    return ([full] if len(full) > 1 else []) + pairs


def _ranked_rows(values: DataFrame, columns: list[str]) -> DataFrame:
    return row_positions(values.dropna(subset=["`" + c + "`" for c in columns]), columns)


def _pair_rows(row: DataFrame, columns: list[str], corr) -> DataFrame:
    structs = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), corr(i, j).alias("corr"))
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
    ]
    return row.select(F.inline(F.array(*structs)))


def _spearman(values: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of average ranks, over distinct rows weighted by their copies."""
    rows = _ranked_rows(values, columns)
    # Twice the average rank, moved to its middle: whole numbers, so the sums stay exact longer.
    total = values.dropna(subset=["`" + c + "`" for c in columns]).agg(F.count("*")).scalar()
    ranks = [2 * F.col(f"__below_{i}") + F.col(f"__equal_{i}") - total for i in range(len(columns))]
    ranks = [r.cast("double") for r in ranks]
    n = F.col("n").cast("double")
    sums = rows.agg(
        *[
            F.sum(n * ranks[i] * ranks[j]).alias(f"s{i}_{j}")
            for i in range(len(columns))
            for j in range(i, len(columns))
        ]
    )
    return _pair_rows(
        sums, columns,
        lambda i, j: F.try_divide(F.col(f"s{i}_{j}"), F.sqrt(f"s{i}_{i}") * F.sqrt(f"s{j}_{j}")),
    )


def _kendall(values: DataFrame, columns: list[str]) -> DataFrame:
    """Tau-b from exact counts of agreeing and disagreeing pairs, without forming pairs."""
    rows = _ranked_rows(values, columns)
    total = values.dropna(subset=["`" + c + "`" for c in columns]).count()
    parts = []
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        points = rows.select(
            F.col(f"__below_{i}").alias("px"), F.col(f"__below_{j}").alias("py"), "n",
            (F.col("n") * (F.col(f"__equal_{i}") - 1)).cast("decimal(38,0)").alias("tx"),
            (F.col("n") * (F.col(f"__equal_{j}") - 1)).cast("decimal(38,0)").alias("ty"),
        )
        net = _net_agreement(points, total)
        # Ordered pairs that differ in x, and in y.
        pairs = F.lit(float(total) * (total - 1))
        ties = points.agg(
            (pairs - F.sum("tx").cast("double")).alias("x"), (pairs - F.sum("ty").cast("double")).alias("y")
        )
        x, y = ties.select("x").scalar(), ties.select("y").scalar()
        corr = F.try_divide(2 * F.col("net"), F.sqrt(x) * F.sqrt(y))
        parts.append(net.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), corr.alias("corr")))
    return reduce(DataFrame.unionByName, parts)


def _net_agreement(points: DataFrame, total: int) -> DataFrame:
    """Agreeing minus disagreeing pairs of points (px, py, n); px and py lie below ``total``.

    Two y positions differ first at one binary digit, so each pair of points is met at
    exactly one digit, among the points that share all higher digits. There a point needs
    only the running number of points with smaller x and the other digit. Runs are cut into
    x blocks, with block totals carried over, so that even the top digit, where all points
    share one run, is spread over many tasks.
    """
    digits = max(1, int(total).bit_length())
    block = max(1, total // 512)
    spread = points.select(
        "px", "py", "n", F.floor(F.col("px") / block).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("digit"),
    )
    power = F.expr("shiftleft(1L, digit)")
    is_one = F.expr("shiftright(py, digit) & 1L") == 1
    cells = spread.groupBy("digit", F.floor(F.col("py") / (power * 2)).alias("head"), "block", "px").agg(
        F.sum(F.when(~is_one, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(is_one, F.col("n")).otherwise(0)).alias("ones"),
    )
    run = ["digit", "head"]
    blocks = cells.groupBy(*run, "block").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    # At most 513 blocks per run.
    before = W.partitionBy(*run).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *run, "block",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("zeros", "ones")],
    )
    inside = W.partitionBy(*run, "block").orderBy("px").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in ("zeros", "ones")],
    ).join(blocks, [*run, "block"])
    zeros_below = (F.col("zeros_before") + F.col("zeros_inside")).cast("decimal(19,0)")
    ones_below = (F.col("ones_before") + F.col("ones_inside")).cast("decimal(19,0)")
    agree = F.sum(F.col("ones").cast("decimal(18,0)") * zeros_below)
    against = F.sum(F.col("zeros").cast("decimal(18,0)") * ones_below)
    return cells.agg((agree.cast("double") - against.cast("double")).alias("net"))
