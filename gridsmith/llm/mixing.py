"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are filled like connected vessels: the budget is shared by weight, sources that would get
more than their cap stop there, and their excess is shared again until none is above. The level is
a fraction of whole numbers, so reruns get the same targets.

A source gives as many complete epochs as its target holds, then a part of one: every document gets
an exponential key -ln(u) / quality, u from a hash of its id, and documents are taken by ascending key
until the words of the source, added up in that order, reach what is left of the target; the document at
the border gives its first words only. No source is sorted as a whole: the words per cell of a
logarithmic scale of keys are added up first, which leaves one cell per source to sort. Whatever the
qualities, a cell of 1/R octave holds no more than about 0.26 / R of a source, so R follows
from the number of documents and a hot source has as many cells as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import running_totals
from ..session import attach, cut_lineage, null_safe_join

WEIGHTS, SHARE, CAP = (5, 2, 1), (3, 2), 2
# Documents that a cell of keys is meant to hold; a quality that is not positive counts as this one.
CELL, LEAST_QUALITY = 20_000, 1e-6
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of a hash of the parts' texts."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, source: str, words: str, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``target`` to one row per source (null is one): its words of a mix.

    Sources in the order of their bytes, null last, weigh ``weights``, repeated, and share
    ``share`` (a fraction) of all words; none gets more than ``cap`` times its own.
    """
    named = sources.select(F.col(source).alias("s"), F.col(words).alias("w"))
    texts = running_totals(named.where("s IS NOT NULL"), "s", {"place": F.lit(1)})
    count = named.where("s IS NOT NULL").agg(F.count("*")).first()[0]
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    placed = cut_lineage(
        texts.select("s", "w", F.col("place").cast("bigint").alias("place"))
        .unionByName(named.where("s IS NULL").withColumn("place", F.lit(count).cast("bigint")))
        .withColumn("weight", weight).drop("place")
    )
    total = int(placed.agg(F.sum(F.col("w").cast("decimal(38,0)"))).first()[0] or 0)
    # The level is top / bottom words per weight; a source is full when cap * w * bottom <= weight * top.
    top, bottom, full = total * share[0], share[1] * int(placed.agg(F.sum("weight")).first()[0] or 0), 0
    wide = "decimal(38,0)"
    while True:
        at_cap = F.col("w").cast("decimal(20,0)") * cap * F.lit(str(bottom)).cast("decimal(18,0)") <= F.col("weight").cast("decimal(10,0)") * F.lit(str(top)).cast("decimal(28,0)")
        row = placed.where(at_cap).agg(F.count("*"), F.sum(F.col("w").cast(wide)), F.sum("weight")).first()
        if row[0] == full or not bottom:
            break
        full = row[0]
        rest = int(placed.agg(F.sum("weight")).first()[0]) - int(row[2] or 0)
        if not rest:
            break
        top, bottom = total * share[0] - cap * share[1] * int(row[1] or 0), share[1] * rest
    if not bottom:
        return sources.withColumn("target", F.lit(0.0))
    # Weights are ints and ``top`` is one too while it is small: their product is not.
    level = (F.col("weight").cast("decimal(10,0)") * F.lit(str(top)).cast("decimal(28,0)")).cast("double") / F.lit(float(bottom))
    capped = (F.col("w") * cap).cast("double")
    found = placed.select(F.col("s").alias(source), F.when(at_cap, capped).otherwise(level).alias("target"))
    return null_safe_join(sources, found, [source])


def mix_sources(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", size: str | None = None,
    quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, cell: int = CELL,
) -> DataFrame:
    """One row per document: key, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` words.

    A document's size is its number of words, or the column ``size`` if it is named; ``taken`` counts
    repeats. A source's taken words
    differ from its target by less than one word, and no document gives more than ``cap`` times
    its size. Documents of higher ``quality`` tend to be taken first; null, NaN and qualities that
    are not positive count as one in a million. Null sources are one source, null texts are
    empty, and null keys are a key. Rows of equal key, source, size and quality are counted as
    copies and follow each other in the sample. An empty table gives no rows; columns that are
    not named here are not read.
    """
    good = F.lit(1.0) if quality is None else quality.cast("double")
    sound = F.coalesce(F.when((good > LEAST_QUALITY) & ~F.isnan(good), F.least(good, F.lit(1e6))), F.lit(LEAST_QUALITY))
    length = word_count(F.col(text)) if size is None else F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint"))
    sized = docs.select(F.col(source).alias("source"), F.col(key).alias("id"), length.alias("size"), sound.alias("quality"))
    # One scan of the texts; what is left of a document is a few numbers.
    rows = cut_lineage(
        sized.groupBy("source", "id", "size", "quality").agg(F.count("*").alias("copies"))
        .withColumn("at", -F.ln(uniform(F.col("id"), F.col("size"))) / F.col("quality"))
    )
    sources = cut_lineage(
        rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("documents"))
    )
    most = sources.agg(F.max("documents")).first()[0] or 1
    octave = max(1, -(-most * 26 // (100 * cell)))
    rows = rows.withColumn("cell", F.floor(F.log2("at") * octave))

    aimed = targets(sources, "source", "source_size", weights, share, cap)
    budget = F.floor(F.col("target") + 0.5)
    whole = F.greatest("source_size", F.lit(1))
    aimed = aimed.withColumn("epochs", F.floor(budget / whole)).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    # One row per cell of a source; its windows do not see documents.
    cells = rows.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    upto = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    border = (
        null_safe_join(before, aimed.select("source", "rest"), ["source"], "inner")
        .where("before <= rest AND rest < before + words").select("source", F.col("cell").alias("border"), "before")
    )
    aimed = cut_lineage(null_safe_join(aimed, border, ["source"]).drop("documents"))
    known = attach(rows, aimed, ["source"], "inner")
    order = W.partitionBy("source", "cell").orderBy("at", "id", "size", "quality")
    words = F.col("size") * F.col("copies")
    # Without a border nothing is left over, or the source has no words.
    sorted_rows = known.where("cell = border").withColumn(
        "start", F.col("before") + F.coalesce(F.sum(words).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    others = known.where("border IS NULL OR cell <> border").withColumn(
        "start", F.when(F.col("cell") < F.col("border"), F.lit(0).cast("bigint"))
    )
    spread = sorted_rows.unionByName(others).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    # Documents before the border are taken whole, those behind it (no start) are not.
    part = (
        F.when(F.col("start").isNull(), F.lit(0))
        .when(F.col("cell") < F.col("border"), F.col("size"))
        .otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("copy") * F.col("size"))))
    )
    return spread.select(
        F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"),
    )
