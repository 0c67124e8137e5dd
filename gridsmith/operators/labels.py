"""Normalising category labels and suggesting labels to merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ref, strip, text_columns, title_case
from ..session import attach

FUZZY_THRESHOLD = 0.85
_LITERAL_MAP_SIZE = 200


def normalised(column: Column, strip_space: bool = True, title: bool = True) -> Column:
    value = column.cast("string")
    if strip_space:
        value = strip(value)
    return title_case(value) if title else value


def clean_labels(
    df: DataFrame,
    columns: list[str] | None = None,
    strip_space: bool = True,
    title: bool = True,
    mappings: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Trim, title-case and rename labels. Mapping keys are normalised like the labels."""
    columns = text_columns(df) if columns is None else columns
    mappings = mappings or {}
    df = df.withColumns({c: normalised(ref(c), strip_space, title) for c in columns})
    for column in columns:
        mapping = mappings.get(column)
        if not mapping:
            continue
        table = _mapping_table(df, mapping, strip_space, title)
        if len(mapping) <= _LITERAL_MAP_SIZE:
            pairs = {r["label"]: r["new_label"] for r in table.collect()}
            df = df.replace(pairs, subset=["`" + column + "`"])
        else:
            df = map_labels(df, column, table)
    return df


def _mapping_table(df: DataFrame, mapping: dict[str, str], strip_space: bool, title: bool) -> DataFrame:
    rows = [(i, k, v) for i, (k, v) in enumerate(mapping.items())]
    table = df.sparkSession.createDataFrame(rows, "i long, label string, new_label string")
    table = table.withColumn("label", normalised(F.col("label"), strip_space, title))
    return table.groupBy("label").agg(F.max_by("new_label", "i").alias("new_label"))


def map_labels(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Rename labels by a (label, new_label) table with one row per label."""
    names = df.columns
    side = table.select(F.col("label").alias(column), "new_label")
    joined = attach(df, side, [column])
    return joined.withColumn(column, F.coalesce("new_label", ref(column))).select(*map(ref, names))


def suggest_merges(df: DataFrame, column: str, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Pairs of different labels whose edit similarity reaches ``threshold``: (a, b, score).

    Exact without comparing all pairs: with at most ``d`` edits allowed, one of ``d + 1``
    equal cuts of the shorter label must occur unchanged in the longer one, shifted by at
    most ``d``. Labels meet only through such a cut and are then measured.
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError("threshold must lie above 0.5 and at most at 1")
    allowed = 1.0 - threshold
    labels = df.where(ref(column).isNotNull()).select(ref(column).alias("label")).distinct()
    labels = labels.withColumn("len", F.length("label")).where("len > 0")
    # The longer label of a pair has at most len / threshold characters.
    edits = F.floor(F.col("len") / threshold * allowed + 1e-9).cast("int")
    short = labels.withColumn("d", edits).withColumn("cuts", F.least(F.col("d") + 1, F.col("len")))
    base, extra = F.floor(F.col("len") / F.col("cuts")), F.col("len") % F.col("cuts")
    short = short.select(
        "label", "len", "d", "cuts", base.cast("int").alias("base"), extra.cast("int").alias("extra"),
        F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"),
    )
    # The first cuts have the base length, the last ``extra`` ones a character more.
    plain = F.col("cuts") - F.col("extra")
    size = F.col("base") + (F.col("cut") >= plain).cast("int")
    start = F.col("cut") * F.col("base") + F.greatest(F.lit(0), F.col("cut") - plain)
    short = short.select(
        F.col("label").alias("a"), F.col("len").alias("a_len"), "d", start.alias("a_start"),
        F.substring("label", (start + 1).cast("int"), size.cast("int")).alias("piece"),
        size.cast("int").alias("size"),
    )
    # Only lengths that some cut has are worth slicing out of the longer labels.
    sizes = [r["size"] for r in short.select("size").distinct().collect()]  # ≤ longest cut
    if not sizes:
        return short.select("a", F.lit("").alias("b"), F.lit(0.0).alias("score")).limit(0)
    slices = F.flatten(
        F.transform(
            F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: s <= F.col("len")),
            lambda s: F.transform(
                F.sequence(F.lit(0), F.col("len") - s),
                lambda p: F.struct(p.alias("b_start"), s.alias("size"), F.col("label").substr(p + 1, s).alias("piece")),
            ),
        )
    )
    long = labels.select(F.col("label").alias("b"), F.col("len").alias("b_len"), F.inline(slices))
    near = (
        (F.col("b_len") >= F.col("a_len"))
        & (F.col("b_len") - F.col("a_len") <= F.col("d"))
        & (F.abs(F.col("b_start") - F.col("a_start")) <= F.col("d"))
        & (F.col("a") != F.col("b"))
    )
    met = short.join(long, ["size", "piece"]).where(near)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    score = 1.0 - F.levenshtein("a", "b") / longest
    return pairs.withColumn("score", score).where(F.col("score") >= threshold)
