"""Divergence of sources: how far each source's words are from every other source's and its language's.

Terms are counted in one scan of the texts and numbered by how often they occur, so that terms of
similar counts share a machine word of 64 term ids. For each group (language and source) and each
count, a bitset of the ids with that count is kept, as those of its words that are not empty. For
two groups, ANDing a bitset of the one with a bitset of the other and counting bits gives the number
of terms in that joint cell of counts; ids without a count there are the complement of the group's
bitsets among all ids. A term's share depends on its count alone, so a cell adds its number of
terms times one value.

Words are dealt into tiles with blocks of sources, so no task holds a whole language, and a common
source is one row per count and word like any other. All sums are of whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .tiles import groups

LEAST_DOCS, PARTS, MOST_RANKS = 3, 1_000_000_000, 200
# Different terms held by a task before it passes its counts on.
HELD = 500_000
# Words of 64 ids in a tile, sources in a block of it; tiles that a task works on one after the other.
WORDS, SOURCES, TILES = 64, 32, 4

# Letters in lower case, bytes above 0x7F as they are, everything else a blank: a term is a run without blanks.
_LETTERS = bytes(
    b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, source, text) to (lang, source, term, n, docs), added up as far as memory is meant for."""
    count, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def passed_on() -> pa.RecordBatch:
        rows = [(g, s, term, n, docs[g, s][term]) for (g, s), terms in count.items() for term, n in terms.items()]
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(batch.num_rows):
            terms = batch.column(2)[at].as_buffer().to_pybytes().translate(_LETTERS).split()
            here, seen = count[lang[at], source[at]], docs[lang[at], source[at]]
            before = len(here)
            here.update(terms)
            seen.update(set(terms))
            held += len(here) - before
            if held > HELD:
                yield passed_on()
                count.clear()
                docs.clear()
                held = 0
    yield passed_on()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / (total + terms)), exactly."""
    top = F.lit(PARTS).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", top, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def _gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (lang, part, x, y, block, source, word, p, bits) to (lang, source, item, value).

    A row without a word names a group and its share of a count of 0; one without a source holds
    the ids of a word; the others are bitsets.
    """
    for tile in groups(batches, 4):
        lang, x, y = (tile.column(name)[0].as_py() for name in ("lang", "x", "y"))
        word = tile.column("word").to_numpy()
        block, p = tile.column("block").to_numpy(), tile.column("p").to_numpy()
        bits = tile.column("bits").to_numpy().view(np.uint64)
        names = tile.column("source").to_pylist()
        groups_at = np.flatnonzero(word < 0)
        place = {names[i]: k for k, i in enumerate(groups_at)}
        size, zero, side = len(place), p[groups_at], block[groups_at]
        value = np.zeros((size, size), np.int64)
        levels = np.flatnonzero(word >= 0)
        levels = levels[np.argsort(word[levels], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, np.diff(word[levels]) != 0]) if len(levels) else []
        for at in np.split(levels, cuts[1:]) if len(levels) else []:
            ids = next(bits[i] for i in at if names[i] is None)
            at = np.array([i for i in at if names[i] is not None], np.int64)
            group = np.array([place[names[i]] for i in at], np.int64)
            seen = np.zeros(size, np.uint64)
            np.bitwise_or.at(seen, group, bits[at])
            # A group's ids without a count are the complement of its bitsets.
            group, share = np.r_[group, np.arange(size)], np.r_[p[at], zero]
            level = np.r_[bits[at], ids & ~seen]
            a, b = np.flatnonzero(side[group] == x), np.flatnonzero(side[group] == y)
            joint = np.bitwise_count(level[a][:, None] & level[b][None, :]).astype(np.int64)
            i, j = np.nonzero(joint)
            n, i, j = joint[i, j], a[i], b[j]
            for one, other in ((i, j), (j, i)) if x != y else ((i, j),):
                f = (share[one] - share[other]) ** 2 // share[other]
                np.add.at(value, (group[one], group[other]), n * f)
        wanted = (side[:, None] == x) & (side[None, :] == y)
        one, other = np.nonzero((wanted | wanted.T) & ~np.eye(size, dtype=bool))
        called = np.array([names[i] for i in groups_at], object)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(one), pa.string()), pa.array(called[one], pa.string()), pa.array(called[other], pa.string()), pa.array(value[one, other])],
            ["lang", "source", "item", "value"],
        )


def _tiled(groups_of: DataFrame, ids: DataFrame, levels: DataFrame, langs: DataFrame) -> DataFrame:
    """Every row once for each tile that needs it."""
    columns = ["lang", "part", "x", "y", "block", "source", "word", "p", "bits"]
    null = F.lit(None)

    def dealt(df: DataFrame, every_part: bool, every_block: bool) -> DataFrame:
        df = df.join(langs, "lang")
        if every_part:
            df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        else:
            df = df.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        if every_block:  # rows without a source are in all tiles of their part
            df = df.withColumn("block", F.lit(-1)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            return df.withColumn("y", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1))).select(*columns)
        df = df.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return df.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).select(*columns)

    first = groups_of.select("lang", "source", F.lit(-1).cast("bigint").alias("word"), F.col("zero").alias("p"), F.lit(0).cast("bigint").alias("bits"))
    masks = ids.select("lang", null.cast("string").alias("source"), "word", F.lit(0).cast("bigint").alias("p"), "bits")
    return dealt(first, True, False).unionByName(dealt(masks, False, True)).unionByName(dealt(levels.select("lang", "source", "word", "p", "bits"), False, False))


def audit_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", ranks: int = MOST_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and a source in ``docs``.

    Terms are runs of letters and of characters above U+007F, A-Z in lower case; a language keeps
    those in at least three of its documents. Of N occurrences of V kept terms in a group, one that
    occurs n times has the share p = 1 + floor(10^9 (n + 1) / (N + V)), so p and all that follows are
    whole numbers. Part ``pair``: how far the group is from each other source of its language, the
    sum over all kept terms of floor((p - q)^2 / q), q the other's share. Part ``term``: the group's
    own terms with p above the share q in the whole language, by the same value, to rank ``ranks``.
    Ranks go by value, then by the item's bytes.

    A null text, language or source counts as ''. Repeated rows are documents of their own. A group
    without terms is compared like any other; a language without kept terms has pairs of value 0.
    An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = texts.mapInArrow(_count_terms, "lang string, source string, term binary, n bigint, docs bigint")
    counts = cut_lineage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups_of = texts.select("lang", "source").distinct()
    kept = cut_lineage(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    )
    by_count = ["lang", F.col("total").desc(), "term"]
    numbered = cut_lineage(
        kept.repartitionByRange(*by_count).sortWithinPartitions(*by_count).withColumn("id", F.monotonically_increasing_id())
    )
    known = counts.drop("docs").join(numbered, ["lang", "term"])
    known = cut_lineage(known)
    of_lang = numbered.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    of_group = known.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups_of = cut_lineage(
        groups_of.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["terms", "lang_total", "group_total"])
        .withColumn("zero", _share(F.lit(0), F.col("group_total"), F.col("terms")))
    )
    shared = known.join(groups_of, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("group_total"), F.col("terms")))

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % 64).cast("int"))
    word = F.shiftright("id", 6).alias("word")
    levels = shared.groupBy("lang", "source", word, "n").agg(F.first("p").alias("p"), F.bit_or(bit).alias("bits"))
    ids = numbered.groupBy("lang", word).agg(F.bit_or(bit).alias("bits"))
    langs = groups_of.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.max("terms") / (64 * WORDS))).cast("int").alias("parts"),
        F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"),
    )
    langs = cut_lineage(langs)
    most = langs.agg(F.sum(F.col("parts") * F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    keys = ["lang", "part", "x", "y"]
    tiles = _tiled(groups_of, ids, levels, langs).repartition(int(min(-(-most // TILES), 100_000)), *keys).sortWithinPartitions(*keys)
    pairs = (
        tiles.mapInArrow(_cells, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    q = _share(F.col("total"), F.col("lang_total"), F.col("terms"))
    own = (
        shared.withColumn("q", q).where("p > q")
        .select("lang", "source", F.col("term").cast("string").alias("item"), _gain(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(own.select(*columns))
