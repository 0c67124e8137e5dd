"""Whole-table order without a single-partition window.

Rows are put into value ranges, each range is worked on by its own task, and a small
table with one row per range carries totals from one range to the next.
"""

from __future__ import annotations

import json

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import attach, cut_lineage, estimated_bytes
from .columns import as_double, ref, sortable_number

MIN_RANGES = 8
_BYTES_PER_RANGE = 1 << 20
# Groups whose brackets are a part of the plan.
LOCAL_ROWS = 200


def range_count(df: DataFrame) -> int:
    """Ranges to cut ``df`` into, by the optimizer's size estimate.

    A range is a megabyte up to a gigabyte, and grows with the square root of the table from
    there: a petabyte makes a million ranges of a gigabyte, and their edges stay a small table.
    """
    size = min(estimated_bytes(df), 1 << 50)
    each = max(_BYTES_PER_RANGE, int((size * _BYTES_PER_RANGE / 1024) ** 0.5))
    return max(MIN_RANGES, size // each)


def _range_edges(df: DataFrame, column: str, spread: list[str], ranges: int) -> list:
    """Values that cut ``column`` into ranges of similar size; at most ``ranges - 1`` of them.

    Numbers and times: approximate quantiles, one pass with a bounded sketch per task.
    Texts: the rows with the smallest hash of ``spread`` are an even sample to cut by.
    """
    data_type = df.schema[column].dataType
    if isinstance(data_type, T.StringType):
        picked = df.where(ref(column).isNotNull()).orderBy(F.xxhash64(*map(ref, spread)))
        return sorted(r[0] for r in picked.select(ref(column)).limit(ranges - 1).collect())
    shares = [i / ranges for i in range(1, ranges)]
    value = sortable_number(column, data_type)
    row = df.agg(F.percentile_approx(value, shares, 4 * ranges).alias("edges")).first()
    return [float(e) for e in (row.edges or [])]


def _range_id(df: DataFrame, column: str, edges: list, name: str) -> DataFrame:
    """Add the range number of ``column`` by a search inside the JVM; nulls, which sort first, are range -1."""
    data_type = df.schema[column].dataType
    inner = sorted({e for e in edges if not isinstance(e, float) or abs(e) != float("inf")})
    if not inner:
        return df.withColumn(name, F.when(ref(column).isNull(), -1.0).otherwise(0.0))
    if isinstance(data_type, T.StringType):
        step = max(1, int(len(inner) ** 0.5))
        blocks = [inner[i : i + step] for i in range(0, len(inner), step)]
        # Two short searches: the last block that starts at or below the value, then inside it.
        heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<string>")
        block = F.size(F.filter(heads, lambda e: e <= ref(column)))
        bodies = F.from_json(F.lit(json.dumps(blocks)), "array<array<string>>")
        inside = F.size(F.filter(F.get(bodies, F.greatest(block - 1, F.lit(0))), lambda e: e <= ref(column)))
        place = (F.greatest(block - 1, F.lit(0)) * (step + 1) + inside).cast("double")
        return df.withColumn(name, F.when(ref(column).isNull(), -1.0).otherwise(place))
    staged = df.withColumn("__split_value", sortable_number(column, data_type))
    bucketizer = Bucketizer(
        splits=[-float("inf"), *inner, float("inf")], inputCol="__split_value", outputCol=name,
        handleInvalid="keep",
    )
    placed = bucketizer.transform(staged).drop("__split_value")
    return placed.withColumn(name, F.when(ref(column).isNull(), -1.0).otherwise(ref(name)))


def running_totals(
    df: DataFrame, order_col: str, sums: dict[str, Column], ranges: int | None = None
) -> DataFrame:
    """Add, per entry of ``sums``, the total over all rows with a smaller ``order_col``.

    ``df`` must hold one row per value of ``order_col`` (aggregate first), so a frequent
    value is one row and no range can grow hot.
    """
    ranges = ranges or range_count(df)
    ranged = _range_id(df, order_col, _range_edges(df, order_col, [order_col], ranges), "__range")
    totals = ranged.groupBy("__range").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    # One row per range: at most ``ranges`` rows, so this window and the broadcast are bounded.
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "__range",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__offset_{n}") for n in sums],
    )
    joined = ranged.join(F.broadcast(offsets), "__range")
    below = W.partitionBy("__range").orderBy(ref(order_col)).rowsBetween(W.unboundedPreceding, -1)
    for name, expression in sums.items():
        inside = F.coalesce(F.sum(expression).over(below), F.lit(0))
        joined = joined.withColumn(f"__inside_{name}", inside)
    for name in sums:
        joined = joined.withColumn(name, ref(f"__offset_{name}") + ref(f"__inside_{name}"))
    helpers = [f"__{kind}_{n}" for n in sums for kind in ("offset", "inside")]
    return joined.drop("__range", *helpers)


def row_positions(df: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Distinct rows with, per column, how many rows lie below and how many are equal.

    Adds ``n`` (copies of the row), ``__below_{i}`` and ``__equal_{i}``. ``df`` holds doubles
    without nulls. Each column costs one shuffle: rows are ranked inside a value range, and
    range totals, two small numbers per range, are added as constants. A value frequent
    enough to fill a range is the lower edge of one; its rows are counted with the totals
    and spread over tasks, as they need no ranking.
    """
    ranges = ranges or range_count(df)
    shares = [i / ranges for i in range(1, ranges)]
    row = df.agg(*[F.percentile_approx(ref(c), shares, 4 * ranges).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    edges = [sorted({float(e) for e in (row[f"e{i}"] or [])}) for i in range(len(columns))]
    ranged = df
    for i, column in enumerate(columns):
        ranged = _range_id(ranged, column, edges[i], f"__range_{i}")
        ranged = ranged.withColumn(f"__range_{i}", F.col(f"__range_{i}").cast("int"))
    # The value at the lower end of each range, in a table beside the rows.
    for i, column in enumerate(columns):
        ranged = ranged.join(F.broadcast(_by_range(df, i, [None, *edges[i]], "lower", "double")), f"__range_{i}", "left")
        ranged = ranged.withColumn(f"__edge_{i}", F.coalesce(ref(column) == F.col(f"__lower_{i}"), F.lit(False))).drop(f"__lower_{i}")
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("c"), F.col(f"__range_{i}").alias("r"), F.col(f"__edge_{i}").alias("edge"))
            for i in range(len(columns))
        ]
    )
    counted = ranged.select(F.inline(cells)).groupBy("c", "r", "edge").agg(F.count("*").alias("n")).collect()
    ids = [f"__{kind}_{i}" for i in range(len(columns)) for kind in ("range", "edge")]
    rows = ranged.groupBy(*map(ref, columns), *ids).agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64(*map(ref, columns)), F.lit(4096))
    for i, column in enumerate(columns):
        sizes = {(r["r"], r["edge"]): r["n"] for r in counted if r["c"] == i}
        starts, equals = [], []
        for r in range(len(edges[i]) + 1):
            equals.append(sizes.get((r, True), 0))
            starts.append(starts[-1] + equals[-2] + sizes.get((r - 1, False), 0) if r else 0)
        for name, values in (("start", starts), ("at", equals)):
            rows = rows.join(F.broadcast(_by_range(df, i, values, name, "long")), f"__range_{i}")
        edge, start, equal = F.col(f"__edge_{i}"), F.col(f"__start_{i}"), F.col(f"__at_{i}")
        inside = W.partitionBy(f"__range_{i}", "__salt").orderBy(ref(column))
        upto = F.sum("n").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
        same = F.sum("n").over(inside.rangeBetween(W.currentRow, W.currentRow))
        rows = rows.withColumn("__salt", F.when(edge, salt).otherwise(-1))
        rows = rows.withColumn("__upto", upto).withColumn("__same", same)
        rows = rows.withColumn(
            f"__below_{i}", F.when(edge, start).otherwise(start + equal + F.col("__upto") - F.col("__same"))
        ).withColumn(f"__equal_{i}", F.when(edge, equal).otherwise(F.col("__same")))
        rows = rows.drop("__salt", "__upto", "__same", f"__start_{i}", f"__at_{i}")
    return rows.drop(*ids)


def _by_range(df: DataFrame, i: int, values: list, name: str, kind: str) -> DataFrame:
    """One row per range of column ``i``: a table, so that a plan does not grow with the ranges."""
    return df.sparkSession.createDataFrame(list(enumerate(values)), f"__range_{i} int, __{name}_{i} {kind}")


def carry_value(
    df: DataFrame, column: str, order_by: list[str], forward: bool = True, ranges: int | None = None
) -> DataFrame:
    """Fill nulls of ``column`` with the nearest earlier (or later) value in row order.

    ``order_by`` must order the rows completely; nulls come first. Its leading column sets the
    ranges; a value that fills several ranges on its own, and null, is split further by the next
    column, and so on.
    """
    ranges = ranges or range_count(df)
    keys: list[str] = []
    ranged, hot = df, F.lit(True)
    for level, name in enumerate(order_by):
        key = f"__range_{level}"
        part = ranged if level == 0 else ranged.where(hot)
        edges = _range_edges(part, name, order_by, ranges)
        repeated = sorted({e for i, e in enumerate(edges) if i and edges[i - 1] == e})
        ranged = _range_id(ranged, name, edges, key)
        if level:  # what lies above a hot value in its range comes after all of its parts
            ranged = ranged.withColumn(key, F.when(hot, ref(key)).otherwise(4.0 * ranges))
        keys.append(key)
        if not repeated and part.where(ref(name).isNull()).isEmpty():
            break
        data_type = df.schema[name].dataType
        value = ref(name) if isinstance(data_type, T.StringType) else sortable_number(name, data_type)
        again = ref(name).isNull() | value.isin(*repeated) if repeated else ref(name).isNull()
        hot = hot & F.coalesce(again, F.lit(False))
    position = F.struct(*[ref(c) for c in order_by])
    pick = F.max_by if forward else F.min_by
    ends = (
        ranged.where(ref(column).isNotNull())
        .groupBy(*keys)
        .agg(pick(ref(column), position).alias("__end"))
    )
    spans = ranged.select(*keys).distinct().join(ends, keys, "left")
    # One row per range again.
    direction = [F.col(k) if forward else F.col(k).desc() for k in keys]
    before = W.orderBy(*direction).rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(*keys, F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    ordering = [ref(c) if forward else ref(c).desc() for c in order_by]
    within = W.partitionBy(*keys).orderBy(*ordering).rowsBetween(W.unboundedPreceding, 0)
    filled = ranged.withColumn("__near", F.last(ref(column), ignorenulls=True).over(within))
    # Every row has a number in every key.
    filled = filled.join(F.broadcast(carried), keys, "left")
    names = df.columns
    return filled.withColumn(column, F.coalesce("__near", "__carry")).select(*map(ref, names))


def quantile_table(
    df: DataFrame,
    columns: list[str],
    shares: list[float],
    group: list[str] | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles: per group one array of doubles per column.

    A sketch gives a bracket of values around each wanted rank; rows below it are only counted
    and rows inside it, a fixed small share, are ranked. No task sees a whole group and only
    bracketed rows are shuffled.
    """
    group = group or []
    narrow = df.select(*map(ref, group), *[as_double(ref(c)).alias(c) for c in columns])
    keys = [f"__g{i}" for i in range(len(group))]
    named = narrow.select(
        *[ref(g).alias(k) for g, k in zip(group, keys)], *[ref(c).alias(f"__v{i}") for i, c in enumerate(columns)]
    )
    hits = _bracketed_ranks(named, len(columns), shares, keys, _sketch_accuracy(narrow))
    picked = hits.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("__column") == i) & (F.col("__share") == t), F.col("__value"))).alias(f"__{i}_{t}")
            for i in range(len(columns))
            for t in range(len(shares))
        ]
    )
    arrays = [F.array(*[F.col(f"__{i}_{t}") for t in range(len(shares))]) for i in range(len(columns))]
    return picked.select(
        *[F.col(k).alias(g) for g, k in zip(group, keys)],
        *[F.when(F.col(f"__{i}_0").isNotNull(), a).alias(c) for (i, c), a in zip(enumerate(columns), arrays)],
    )


def _sketch_accuracy(df: DataFrame) -> int:
    """One over the rank error of a sketch; larger tables get narrower brackets."""
    size = estimated_bytes(df)
    return 1_000 if size < 1 << 28 else 10_000 if size < 1 << 37 else 100_000


def _bracketed_ranks(df: DataFrame, columns: int, shares: list[float], keys: list[str], accuracy: int) -> DataFrame:
    """(keys, __column, __share, __value) from columns ``__v0``, ``__v1``, … of ``df``."""
    # A sketch is off by at most 1/accuracy, and a rank is at most one row away from its share.
    margin = 3.0 / accuracy
    ends = [e for s in shares for e in (max(0.0, s - margin), min(1.0, s + margin))]
    sketched = df.groupBy(*keys).agg(
        *[
            e
            for i in range(columns)
            for e in (
                F.count(f"__v{i}").alias(f"__n{i}"), F.min(f"__v{i}").alias(f"__min{i}"),
                F.max(f"__v{i}").alias(f"__max{i}"), F.percentile_approx(f"__v{i}", ends, accuracy).alias(f"__e{i}"),
            )
        ]
    )
    # A group with fewer rows than the accuracy is its own bracket.
    few = [F.col(f"__n{i}") <= accuracy for i in range(columns)]
    brackets = sketched.select(
        *keys, *[f"__n{i}" for i in range(columns)],
        *[
            e
            for i in range(columns)
            for t in range(len(shares))
            for e in (
                F.when(few[i], F.col(f"__min{i}")).otherwise(F.get(f"__e{i}", 2 * t)).alias(f"__lo{i}_{t}"),
                F.when(few[i], F.col(f"__max{i}")).otherwise(F.get(f"__e{i}", 2 * t + 1)).alias(f"__hi{i}_{t}"),
            )
        ],
    )
    cells = [(i, t) for i in range(columns) for t in range(len(shares))]
    if keys:
        # Written once: one row per group, computed from a scan of its own. Read back, its true
        # size lets a few groups be broadcast; a shuffle on the key would put each group in one task.
        written = cut_lineage(brackets)
        few_rows = written.limit(LOCAL_ROWS + 1).toArrow()
        if few_rows.num_rows <= LOCAL_ROWS:  # a few numbers per group and column, without a scan of their own
            written = df.sparkSession.createDataFrame(few_rows, written.schema)
        wide = attach(df, written, keys, "inner")
    else:
        one = brackets.first()  # a handful of numbers
        wide = df.withColumns({c: F.lit(one[c]) for c in brackets.columns})
    # One scan: rows below a bracket are counted under null, rows inside under their value.
    tried = F.array(
        *[
            F.struct(
                F.lit(i).alias("__column"), F.lit(t).alias("__share"),
                (F.lit(shares[t]) * (F.col(f"__n{i}") - 1)).alias("__at"),
                F.when(F.col(f"__v{i}") >= F.col(f"__lo{i}_{t}"), F.col(f"__v{i}")).alias("__v"),
                (F.col(f"__v{i}") <= F.col(f"__hi{i}_{t}")).alias("upto"),
            )
            for i, t in cells
        ]
    )
    placed = wide.select(*keys, F.inline(tried)).where("upto").groupBy(*keys, "__column", "__share", "__at", "__v").agg(
        F.count("*").alias("__n")
    )
    earlier = W.partitionBy(*keys, "__column", "__share").orderBy(F.col("__v").asc_nulls_first())
    before = F.sum("__n").over(earlier.rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("__start", F.coalesce(before, F.lit(0))).where("__v is not null")
    hits = placed.where(
        (F.ceil("__at") >= F.col("__start")) & (F.floor("__at") < F.col("__start") + F.col("__n"))
    )
    low = F.max(F.when(F.floor("__at") >= F.col("__start"), F.col("__v")))
    high, part = F.max("__v"), F.max(F.col("__at") - F.floor("__at"))
    found = F.max(F.col("__start") + F.col("__n")) > F.ceil(F.max("__at"))
    value = F.when(part == 0, low).otherwise(low * (1 - part) + high * part)
    # The sketch's error bound makes this impossible; a wrong quantile must not pass in silence.
    checked = F.when(found & low.isNotNull(), value).otherwise(
        F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    )
    return hits.groupBy(*keys, "__column", "__share").agg(checked.alias("__value"))


def mode_table(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """Most frequent value (smallest on ties): (group, mode, mode_count).

    Values are counted with map-side combining first, so a frequent value is one row.
    """
    group = group or []
    counts = (
        df.where(ref(column).isNotNull())
        .groupBy(*map(ref, group), ref(column).alias("__value"))
        .agg(F.count("*").alias("__n"))
    )
    best = F.min_by("__value", F.struct((-F.col("__n")).alias("n"), F.col("__value").alias("v")))
    return counts.groupBy(*map(ref, group)).agg(best.alias("mode"), F.max("__n").alias("mode_count"))

