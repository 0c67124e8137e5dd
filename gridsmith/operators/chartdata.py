"""The small tables charts are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, finite, known, numeric_columns, ref, sortable_number
from ..functions.ordered import quantile_table, running_totals
from ..functions.sampling import sample_per_group, sample_rows
from ..session import attach
from .categories import freq_table
from .correlation import corr_matrix
from .summary import add_bins, bin_edges, histograms, value_ranges, widened

# Sizes of the drawings.
CHART_BINS = 30
KDE_POINTS = 200
KDE_CUT = 3.0
WHISKER = 1.5
BAND = 1.96
TOP_BARS = 30
PAIR_SAMPLE = 1000
# Beyond this many bandwidths a Gaussian adds less than the last digit of a double.
_KDE_REACH = 9.0


def histogram_chart(df: DataFrame, columns: list[str] | None = None, bins: int = CHART_BINS) -> DataFrame:
    """Histograms of one or many columns, counted in one pass."""
    return histograms(df, numeric_columns(df) if columns is None else columns, bins)


def kde_curve(
    df: DataFrame, column: str, group: str | None = None, points: int = KDE_POINTS
) -> DataFrame:
    """Gaussian density with Scott's bandwidth: ([group], point, x, density).

    Equal values are counted first. A value is then sent only to the grid points within its
    reach, so the more rows there are (the narrower the bandwidth), the fewer points a value
    touches; the sums combine on the map side to one row per group and point.
    """
    keys = ["g"] if group else []
    base = df.select(*([ref(group).alias("g")] if group else []), finite(ref(column)).alias("v"))
    base = base.where("v is not null" + (" and g is not null" if group else ""))
    stats = base.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    width = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.withColumn("bw", width).where("bw > 0")
    stats = stats.withColumn("start", F.col("lo") - KDE_CUT * F.col("bw"))
    stats = stats.withColumn("step", (F.col("hi") + KDE_CUT * F.col("bw") - F.col("start")) / (points - 1))
    stats = stats.select(*keys, "n", "bw", "start", "step")
    counts = base.groupBy(*keys, "v").agg(F.count("*").alias("m"))
    if group:
        joined = attach(counts, stats, keys, "inner")
    else:
        one = stats.first()
        if one is None:
            raise ValueError(f"{column} has no spread")
        joined = counts.withColumns({c: F.lit(one[c]) for c in stats.columns})
    reach = _KDE_REACH * F.col("bw")
    first = F.greatest(F.lit(0), F.ceil((F.col("v") - reach - F.col("start")) / F.col("step"))).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("v") + reach - F.col("start")) / F.col("step"))).cast("int")
    # A reach narrower than one grid step can miss every point.
    near = joined.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    z = (F.col("start") + F.col("point") * F.col("step") - F.col("v")) / F.col("bw")
    weight = F.sum(F.col("m") * F.exp(-0.5 * z * z))
    sums = near.groupBy(*keys, "point").agg(weight.alias("w"))
    if group:
        grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    else:
        grid = df.sparkSession.range(points).select(
            F.col("id").cast("int").alias("point"), *[F.lit(one[c]).alias(c) for c in stats.columns]
        )
    curve = attach(grid, sums, [*keys, "point"])
    density = F.coalesce("w", F.lit(0.0)) / (F.col("n") * F.col("bw") * (2 * 3.141592653589793) ** 0.5)
    x = F.col("start") + F.col("point") * F.col("step")
    named = [F.col("g").alias(group)] if group else []
    return curve.select(*named, "point", x.alias("x"), density.alias("density"))


def kde_curves(df: DataFrame, columns: list[str], points: int = KDE_POINTS) -> DataFrame:
    """Gaussian densities of several numeric columns, each on its own grid: (column, point, x, density).

    All columns are counted in one scan. A column without spread has no curve.
    """
    if not columns:
        raise ValueError("no columns given")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("double").alias("value")) for c in columns])
    return kde_curve(df.select(F.inline(cells)), "value", "column", points)


def scatter_points(
    df: DataFrame, x: str, y: str, keys: list[str], hue: str | None = None, n: int | None = None
) -> DataFrame:
    """Every point, or ``n`` of them chosen by key hash."""
    columns = list(dict.fromkeys([*keys, x, y, *([hue] if hue else [])]))
    points = df.select(*map(ref, columns))
    return points if n is None else sample_rows(points, keys, n)


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 50, hue: str | None = None) -> DataFrame:
    """Counts on an equal-width grid: the whole table as a drawable scatter plot."""
    ranges = value_ranges(df, [x, y])
    used = df.where(finite(ref(x)).isNotNull() & finite(ref(y)).isNotNull())
    extra = [ref(hue)] if hue else []
    cells = {f"{s}_bin": (finite(ref(c)), bin_edges(*widened(*ranges[c]), bins)) for c, s in ((x, "x"), (y, "y"))}
    binned = add_bins(used.select(*[ref(c) for c in dict.fromkeys([x, y, *([hue] if hue else [])])]), cells)
    return binned.groupBy("x_bin", "y_bin", *extra).agg(F.count("*").alias("count"))


def line_points(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of y per x (and hue) with a 95 % band from the standard error."""
    keys = [ref(x)] + ([ref(hue)] if hue else [])
    value = known(df, y)
    stats = df.where(ref(x).isNotNull() & value.isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("__s")
    )
    half = F.coalesce(BAND * F.col("__s") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))
    return stats.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half).drop("__s")


def bar_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value without nulls, all or the ``top`` most frequent."""
    bars = freq_table(df.where(ref(column).isNotNull()), column).select("value", "count")
    return bars.limit(top) if top else bars


def box_stats(df: DataFrame, y: str, x: str | None = None, hue: str | None = None) -> DataFrame:
    """Quartiles, whiskers to the furthest value within 1.5 IQR, and the number of fliers."""
    keys = [k for k in (x, hue) if k]
    base = df.select(*map(ref, keys), finite(ref(y)).alias("__y")).where("__y is not null")
    for key in keys:
        base = base.where(ref(key).isNotNull())
    quartiles = quantile_table(base, ["__y"], [0.25, 0.5, 0.75], keys)
    quartiles = quartiles.select(
        *map(ref, keys), F.col("__y")[0].alias("q1"), F.col("__y")[1].alias("median"), F.col("__y")[2].alias("q3")
    )
    if keys:
        joined = attach(base, quartiles, keys, "inner")
    else:
        one = quartiles.first()
        joined = base.withColumns({c: F.lit(one[c]) for c in ("q1", "median", "q3")})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.col("__y").between(low, high)
    return joined.groupBy(*map(ref, keys), "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, F.col("__y"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__y"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def violin(df: DataFrame, y: str, x: str | None = None, points: int = KDE_POINTS, hue: str | None = None) -> DataFrame:
    """Density curve and quartiles: of the whole column, per category, or per category and hue."""
    keys = [k for k in (x, hue) if k]
    box = box_stats(df, y, x, hue).select(*map(ref, keys), "q1", "median", "q3")
    if not keys:
        one = box.first()  # three numbers
        return kde_curve(df, y, None, points).withColumns({c: F.lit(one[c]) for c in ("q1", "median", "q3")})
    if len(keys) == 1:
        return attach(kde_curve(df, y, keys[0], points), box, keys)
    used = df.where(ref(x).isNotNull() & ref(hue).isNotNull())
    both = kde_curve(used.withColumn("__both", F.struct(ref(x), ref(hue))), y, "__both", points)
    return attach(both.select("__both.*", "point", "x", "density"), box, keys)


def swarm_points(
    df: DataFrame, x: str, y: str, keys: list[str], n: int | None = None, hue: str | None = None
) -> DataFrame:
    """Every point, or up to ``n`` per category chosen by key hash."""
    columns = list(dict.fromkeys([*keys, x, y, *([hue] if hue else [])]))
    picked = df.select(*map(ref, columns)).where(ref(x).isNotNull() & ref(y).isNotNull())
    return picked if n is None else sample_per_group(picked, x, keys, n)


def correlation_heatmap(df: DataFrame, method: str = "pearson") -> DataFrame:
    return corr_matrix(df, numeric_columns(df), method)


def pair_plot_sample(df: DataFrame, keys: list[str], columns: list[str] | None = None, n: int = PAIR_SAMPLE) -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    return sample_rows(df.select(*[ref(c) for c in dict.fromkeys([*keys, *columns])]), keys, n)


def multi_line(df: DataFrame, order_by: str, columns: list[str], points: int = 500) -> DataFrame:
    """Several columns over row order, in ``points`` steps of as many rows: mean, min and max per step.

    A row's place is the number of rows before it, so rows that are equal in ``order_by`` share a step.
    """
    place = sortable_number(order_by, df.schema[order_by].dataType)
    placed = df.where(ref(order_by).isNotNull()).withColumn("__place", place)
    counts = placed.groupBy("__place").agg(F.count("*").alias("__rows"))
    total = placed.count()
    steps = running_totals(counts, "__place", {"__before": F.col("__rows")}).select(
        "__place", F.floor(F.col("__before") * F.lit(points) / F.lit(max(total, 1))).cast("int").alias("step")
    )
    cells = F.array(*[F.struct(F.lit(c).alias("line"), as_double(ref(c)).alias("v")) for c in columns])
    spread = attach(placed, steps, ["__place"]).select("step", F.inline(cells))
    return spread.where("v is not null").groupBy("line", "step").agg(
        F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def importance_bars(importances: DataFrame, top: int | None = 20) -> DataFrame:
    ordered = importances.orderBy(F.abs("importance").desc(), "feature")
    return ordered.limit(top) if top else ordered


def predicted_vs_actual(df: DataFrame, actual: str, predicted: str, keys: list[str], n: int | None = None) -> DataFrame:
    """Every point, or ``n`` of them chosen by key hash, with the ends of the diagonal."""
    pairs = df.where(ref(actual).isNotNull() & ref(predicted).isNotNull())
    ends = pairs.agg(
        F.least(F.min(ref(actual)), F.min(ref(predicted))).cast("double").alias("low"),
        F.greatest(F.max(ref(actual)), F.max(ref(predicted))).cast("double").alias("high"),
    ).first()
    points = pairs.select(*[ref(c) for c in dict.fromkeys([*keys, actual, predicted])])
    points = points if n is None else sample_rows(points, keys, n)
    return points.withColumns({"line_low": F.lit(ends["low"]), "line_high": F.lit(ends["high"])})


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", ref(actual) - ref(predicted))


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score, plus the start at (0, 0)."""
    ranked, totals = ranked_scores(df, label, score, positive)
    pos, neg = totals["pos"], totals["neg"]
    points = ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.lit(neg) - F.col("neg_below"), F.lit(neg)).alias("fpr"),
        F.try_divide(F.lit(pos) - F.col("pos_below"), F.lit(pos)).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def ranked_scores(df: DataFrame, label: str, score: str, positive=1):
    """Positives and negatives per distinct score with the totals below it."""
    hit = ref(label).cast("string") == F.lit(str(positive))
    used = df.where(ref(label).isNotNull() & ref(score).isNotNull())
    counts = used.groupBy(ref(score).cast("double").alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    totals = used.agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")).first()
    ranked = running_totals(counts, "score", {"pos_below": F.col("pos"), "neg_below": F.col("neg")})
    return ranked, totals


def confusion_chart(
    df: DataFrame, actual: str, predicted: str, labels: list | None = None, normalize: bool = False
) -> DataFrame:
    """(actual, predicted, value) for every pair of labels, zeros included, or row shares."""
    counts = df.groupBy(ref(actual).cast("string").alias("actual"), ref(predicted).cast("string").alias("predicted")).agg(
        F.count("*").alias("n")
    )
    if labels is None:
        seen = counts.select(F.explode(F.array("actual", "predicted")).alias("v")).where("v is not null").distinct()
        labels = sorted(r["v"] for r in seen.collect())  # class labels
    names = [str(v) for v in labels]
    every = F.array(*map(F.lit, names))
    rows = df.sparkSession.createDataFrame([(v,) for v in names], "actual string")
    grid = rows.withColumn("predicted", F.explode(every))
    filled = attach(grid, counts, ["actual", "predicted"]).withColumn("n", F.coalesce("n", F.lit(0)))
    if not normalize:
        return filled.select("actual", "predicted", F.col("n").cast("double").alias("value"))
    totals = filled.groupBy("actual").agg(F.sum("n").alias("__total"))
    share: Column = F.coalesce(F.try_divide(F.col("n"), F.col("__total")), F.lit(0.0))
    return attach(filled, totals, ["actual"]).select("actual", "predicted", share.alias("value"))


def suggest_charts(types: dict[str, str], distinct: dict[str, int], spark, many: int = TOP_BARS) -> DataFrame:
    """(columns, chart, reason) by column kinds and numbers of distinct values."""
    rows = []
    numeric = [c for c, t in types.items() if t == "numeric"]
    grouping = [c for c, t in types.items() if t in ("categorical", "ordinal", "boolean") and distinct.get(c, 0) <= many]
    for column, kind in types.items():
        if kind == "numeric":
            rows.append((column, "histogram", "numeric column"))
        elif kind == "datetime":
            rows += [(f"{column}, {n}", "line", "value over time") for n in numeric]
        elif distinct.get(column, 0) <= many:
            rows.append((column, "bar", "few categories"))
        else:
            rows.append((column, "top bar", "many categories"))
    rows += [(f"{a}, {b}", "scatter", "two numeric columns") for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    rows += [(f"{c}, {n}", "box", "numeric by category") for c in grouping for n in numeric]
    if len(numeric) > 2:
        rows.append((", ".join(numeric), "heatmap", "several numeric columns"))
    return spark.createDataFrame(rows, "columns string, chart string, reason string")

