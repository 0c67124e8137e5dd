"""Hard negatives: exact integer scores by Kronecker-packed products.

Components are scaled to whole numbers. In a tile of anchors and candidates the candidates'
components are raised by a bias until none is negative, and several candidates are put beside
each other into separated fields of one wide integer per component. Each anchor component is
raised in the same way and multiplied with that integer once; the sums of the products stay
inside their fields, so shifting and masking gives the exact sum of every candidate, and the
biases' share is subtracted. The width of a field follows from the data: by Cauchy and Schwarz
no sum exceeds the largest squared length of a raised vector. Where one field would not fit 62
bits, Python's unbounded integers take four fields each.

The anchors meet all rows twice, in tiles: first for their positives, then for the negatives
within the positives' windows. A tile passes on only its first few rows per anchor (or anchor
and positive), which are merged by rank. Anchors are a stated query set; the copies of rows
that this costs grow with the number of blocks of anchors, nothing else is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .tiles import groups

SCALE = 256
# Numbers of a tile's candidates; an anchor block holds a fourth as many.
TILE_NUMBERS, MOST_ROWS = 1 << 18, 4096
# Scores that are unpacked at a time.
STRIP = 1 << 20
# Bits of a signed machine integer that fields may use; fields of a wide one.
BITS, WIDE = 62, 4


def pack(rows: np.ndarray, width: int, fields: int) -> np.ndarray:
    """Rows of whole numbers, none negative, ``fields`` of them beside each other in one integer."""
    short = -len(rows) % fields
    padded = np.concatenate([rows, np.zeros((short, rows.shape[1]), rows.dtype)])
    packed = padded[::fields].copy()
    for k in range(1, fields):
        packed += padded[k::fields] << (width * k)
    return packed


def unpack(packed: np.ndarray, width: int, fields: int, rows: int) -> np.ndarray:
    """The fields of every column of ``packed``, in the order in which ``pack`` took them."""
    mask = (1 << width) - 1
    out = np.empty((packed.shape[0], packed.shape[1], fields), packed.dtype)
    for k in range(fields):
        out[:, :, k] = (packed >> (width * k)) & mask
    return out.reshape(len(packed), -1)[:, :rows]


def plan(longest: int) -> tuple[int, int, type]:
    """Width of a field, fields of an integer and its kind, for the largest squared length of a raised row."""
    width = max(1, longest.bit_length())
    return (width, BITS // width, np.int64) if width <= BITS else (width, WIDE, object)


class Product:
    """Inner products of anchors with packed candidates."""

    def __init__(self, candidates: np.ndarray, bias: int, longest: int) -> None:
        self.width, self.fields, self.kind = plan(longest)
        self.rows, self.bias, self.dim = len(candidates), bias, candidates.shape[1]
        raised = candidates.astype(self.kind) + bias
        self.sums = raised.sum(1)
        self.packed = pack(raised, self.width, self.fields).T.copy()

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        raised = anchors.astype(self.kind) + self.bias
        total = unpack(raised @ self.packed, self.width, self.fields, self.rows)
        # (a + b)(c + b) = ac + b(a + b) + b(c + b) - bb
        total -= self.bias * (raised.sum(1)[:, None] + self.sums[None, :])
        total += self.dim * self.bias * self.bias
        return total.astype(np.int64)


def _first(score: np.ndarray, wanted: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first ``n`` wanted entries of each row: by score, then by id."""
    if score.shape[1] > n:
        least = np.where(wanted, score, np.iinfo(np.int64).min)
        edge = np.partition(least, -n, axis=1)[:, -n]
        wanted = wanted & (score >= edge[:, None])
    at, column = np.nonzero(wanted)
    order = np.lexsort((ids[column], -score[at, column], at))
    at, column = at[order], column[order]
    begins = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[place < n], column[place < n]


def _matrix(column: pa.ChunkedArray, scale: int, exact: bool) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    scaled = np.floor(scale * flat)
    if not exact:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def _tiles(batches: Iterator[pa.RecordBatch], scale: int, bias: int, longest: int):
    """Per tile: its anchors (a table), strips of them with their scores, its candidates (ids, labels, rows)."""
    exact = plan(longest)[2] is object
    for tile in groups(batches, 3):
        is_anchor = tile.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
        anchors, others = tile.filter(pa.array(is_anchor)), tile.filter(pa.array(~is_anchor))
        if not anchors.num_rows or not others.num_rows:
            continue
        product = Product(_matrix(others.column("vector"), scale, exact), bias, longest)
        lines = _matrix(anchors.column("vector"), scale, exact)
        step = max(1, STRIP // others.num_rows)
        about = tuple(others.column(name).to_numpy() for name in ("id", "label", "row"))
        for start in range(0, anchors.num_rows, step):
            yield anchors.slice(start, step), product.scores(lines[start : start + step]), *about


def _sound(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite


def _placed(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each ``by`` by score and id, with their ``rank``."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _blocks(rows: DataFrame, anchors: DataFrame, dim_blocks: DataFrame) -> DataFrame:
    """Rows and anchors of equal dimension, once for each tile they are in: (dim, a, c, anchor, …)."""
    tiles = sum(r["a"] * r["c"] for r in dim_blocks.collect())  # one row per length of vectors

    def hashed(blocks: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    columns = ["dim", "a", "c", "anchor", "row", "id", "label", "vector"]
    extra = [c for c in anchors.columns if c not in ("dim", "row", "id", "label", "vector")]
    kept = rows.join(dim_blocks, "dim").withColumn("c", hashed("c")).withColumn("a", every("a")).withColumn("anchor", F.lit(False))
    asked = anchors.join(dim_blocks, "dim").withColumn("a", hashed("a")).withColumn("c", every("c")).withColumn("anchor", F.lit(True))
    both = kept.select(*columns).unionByName(asked.select(*columns, *extra), allowMissingColumns=True)
    return both.repartition(max(1, min(tiles, 100_000)), "dim", "a", "c").sortWithinPartitions("dim", "a", "c", "id")


def mine_negatives(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each component x counts as floor(``scale`` * x) and a score is an exact inner product. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of another label with low * positive <= 100 * negative <= high * positive are returned.
    Higher scores come first, ties by smaller key.

    Rows with a null key, label or vector, an empty vector, or a component that is null, NaN or
    infinite take no part. Only vectors of equal length are compared. Equal rows count once; rows
    that share a key but differ otherwise are rows of their own. A score has to fit a long: one
    that does not raises an error. ``key`` and the label must be whole numbers, ``scale`` a power
    of two; columns of ``df`` that are not named here are not read. An empty table gives no rows.
    """
    named = df.select(
        F.col(key).cast("bigint").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asked"),
    )
    usable = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _sound("vector"))
    rows = cut_lineage(
        usable.distinct().withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id())
    )
    # Rounding down changes a component by at most 1.
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * scale)
    about = rows.agg(
        F.min(F.array_min("vector")).alias("least"), F.max(squares).alias("squares"), F.max(size).alias("size"), F.max("dim").alias("dim")
    ).first()
    schema = "anchor bigint, id bigint, row bigint, score bigint"
    if about["dim"] is None:
        bias, longest = 0, 1
    else:
        bias = max(0, -int(np.floor(scale * about["least"])))
        # Whole numbers above the largest squared length of a raised vector, rounding included.
        longest = int(about["squares"] * 1.0001) + 2 * bias * (max(0, int(about["size"] * 1.0001)) + 1) + about["dim"] * bias * bias + 1
    each = F.greatest(F.lit(64), F.least(F.lit(MOST_ROWS), F.lit(TILE_NUMBERS) / F.col("dim")))
    dim_blocks = cut_lineage(
        rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).where("m > 0").select(
            "dim", F.ceil(F.col("m") * 4 / each).cast("int").alias("a"), F.ceil(F.col("n") / each).cast("int").alias("c")
        )
    )

    def positives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, score, ids, labels, numbers in _tiles(batches, scale, bias, longest):
            own, ours = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
            wanted = (labels[None, :] == own[:, None]) & (numbers[None, :] != ours[:, None])
            at, column = _first(score, wanted, ids, positives)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (ours[at], ids[column], numbers[column], score[at, column])], ["anchor", "id", "row", "score"]
            )

    def negatives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, score, ids, labels, numbers in _tiles(batches, scale, bias, longest):
            own, ours = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
            other = labels[None, :] != own[:, None]
            bounds = anchors.column("scores").to_pylist()
            for k in range(max(map(len, bounds))):
                # An anchor with fewer positives gets an empty window.
                windows = [_window(b[k], low, high) if k < len(b) else (1, 0) for b in bounds]
                least, most = np.array(windows, np.int64).T
                at, column = _first(score, other & (score >= least[:, None]) & (score <= most[:, None]), ids, negatives)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (ours[at], np.full(len(at), k + 1, np.int32), ids[column], numbers[column], score[at, column])],
                    ["anchor", "place", "id", "row", "score"],
                )

    asked = rows.where("asked").drop("asked")
    tiles = _blocks(rows, asked, dim_blocks)
    best = cut_lineage(_placed(tiles.mapInArrow(positives_of, schema), ["anchor"], positives))
    # As many numbers per anchor as it has positives.
    scores = best.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    tiles = _blocks(rows, asked.join(scores, "row"), dim_blocks)
    found = _placed(tiles.mapInArrow(negatives_of, "anchor bigint, place int, id bigint, row bigint, score bigint"), ["anchor", "place"], negatives)
    return (
        found.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(best.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"])
        .join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100
