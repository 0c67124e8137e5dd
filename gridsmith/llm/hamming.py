"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learnt on a bounded sample (``SAMPLE`` vectors): principal axes, then alternately
the nearest corners of the cube and the rotation that fits them best, so that the signs of the
rotated coordinates are balanced bits. The bits are cut into substrings, one table each; vectors
of one label whose codes agree on a whole substring meet in that table's bucket. With more
vectors the substrings get longer, so buckets stay small, and there are more of them (from
further rotations), so that a pair at the threshold still meets with a probability of 1 - ``MISS``.
How many it takes is measured: sampled vectors that the rotations are not learnt from get partners
at the threshold, and tables are added until no more than ``MISS`` of those pairs agree on none. Vectors that share a direction
agree less often once their mean is subtracted; substrings get shorter if ``TABLES`` are not enough.

Every vector is in every table. Buckets are compared in tiles of bounded size with the original
vectors, by cosine in double precision, so no pair below the threshold is linked; a pair that
meets in several tables counts in the first only. Pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import components
from .tiles import groups, linked_rows

SAMPLE, ROUNDS, SEED = 20_000, 30, 11
THRESHOLD, MISS = 0.98, 0.005
# Vectors a bucket is meant to hold; rows of a tile.
BUCKET, TILE = 16, 512
# Pairs of each kind that the tables are measured with; tables above which substrings get shorter.
PAIRS, TABLES = 10_000, 64


@dataclass
class Quantiser:
    """Signs of rotated coordinates, cut into ``tables`` substrings of ``width`` bits."""

    mean: np.ndarray
    rotations: list[np.ndarray]
    width: int
    tables: int

    def substrings(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        bits = np.concatenate([(unit - self.mean) @ r >= 0 for r in self.rotations], 1)
        bits = bits[:, : self.tables * self.width].reshape(len(x), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def plan(rows: int) -> tuple[int, int]:
    """Width and least number of substrings for so many vectors of one label."""
    width = min(32, max(6, math.ceil(math.log2(max(2, rows) / BUCKET))))
    agree = (1 - math.acos(THRESHOLD) / math.pi) ** width
    return width, math.ceil(math.log(MISS) / math.log(1 - agree))


def _pairs(unit: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their partners at the threshold: in any direction, then towards another vector."""
    base = np.tile(unit[random.permutation(len(unit))[:PAIRS]], (-(-PAIRS // len(unit)), 1))[:PAIRS]
    base = np.concatenate([base, base])
    side = random.normal(size=base.shape)
    towards = unit[random.integers(len(unit), size=PAIRS)] - base[PAIRS:]
    differs = np.linalg.norm(towards, axis=1) > 1e-6
    side[PAIRS:][differs] = towards[differs]
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    other = THRESHOLD * base + math.sqrt(1 - THRESHOLD**2) * side
    return base, other / np.linalg.norm(other, axis=1, keepdims=True)


def _rotations(unit: np.ndarray, mean: np.ndarray, random: np.random.Generator) -> Iterator[np.ndarray]:
    """Rotations without end. Few vectors, fewer than four per dimension, get random ones."""
    dim = unit.shape[1]
    few = len(unit) < 4 * dim
    if not few:
        _, axes = np.linalg.eigh(np.cov(unit - mean, rowvar=False))  # principal axes, in columns
        projected = (unit - mean) @ axes
    while True:
        turn = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        if few:
            yield turn
            continue
        for _ in range(ROUNDS):
            corners = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ projected)
            turn = (u @ v).T
        # A substring takes bits from axes of all sizes.
        yield axes @ turn[:, random.permutation(dim)]


def learn(sample: np.ndarray, dim: int, width: int, tables: int) -> Quantiser:
    """Fit the rotations; take ``tables`` or as many more as pairs at the threshold need to meet.

    The width is reduced if that would be more than ``TABLES``; without bits all vectors meet.
    """
    random = np.random.default_rng(SEED + dim)
    # Random rotations treat all directions alike, so any vectors show how often pairs agree.
    unit = sample if len(sample) else random.normal(size=(1, dim))
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    # A fourth is kept from learning: signs agree more often on vectors that were learnt from.
    base, other = _pairs(unit[::4], np.random.default_rng(SEED))
    unit = unit[np.arange(len(unit)) % 4 > 0]
    mean = np.zeros(dim) if len(unit) < 4 * dim else unit.mean(0)
    turns, rotations, same = _rotations(unit, mean, random), [], np.zeros((len(base), 0), bool)
    least = tables
    while True:
        met = np.zeros(len(base), bool)
        agree = 0.0
        for at in range(max(TABLES, least)):
            while same.shape[1] < (at + 1) * width:
                rotations.append(next(turns))
                bits = ((base - mean) @ rotations[-1] >= 0) == ((other - mean) @ rotations[-1] >= 0)
                same = np.concatenate([same, bits], 1)
            hit = same[:, at * width : (at + 1) * width].all(1)
            met |= hit
            agree += min(hit[:PAIRS].mean(), hit[PAIRS:].mean())
            missed = 1 - min(met[:PAIRS].mean(), met[PAIRS:].mean())
            if missed <= MISS and at + 1 >= least:
                return Quantiser(mean, rotations[: max(1, -(-width * (at + 1) // dim))], width, at + 1)
            # Tables that agree as often as these, were they independent, would not be enough.
            if at >= 3 and (1 - agree / (at + 1)) ** max(TABLES, least) > MISS:
                break
        width, least = width - 1, 1


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, dim)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (label, dim, at, part, x, y, chunk, id, copies, parts, vector) to (id, root, links)."""
    for tile in groups(batches, 6):
        if tile.num_rows < 2:
            continue
        first = {name: tile.column(name)[0].as_py() for name in ("dim", "at", "x", "y")}
        vectors = _matrix(tile.column("vector"), first["dim"])
        parts = np.array(tile.column("parts").to_pylist(), np.int64)
        ids, copies, chunk = (tile.column(name).to_numpy() for name in ("id", "copies", "chunk"))
        size = np.sqrt((vectors * vectors).sum(1))
        linked = vectors @ vectors.T / (size[:, None] * size[None, :]) >= THRESHOLD
        if first["x"] != first["y"]:  # pairs within a chunk belong to its own tile
            linked &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(linked, False)
        for before in range(first["at"]):  # an earlier table has counted these
            if not linked.any():
                break
            linked &= parts[:, None, before] != parts[None, :, before]
        links = linked @ copies
        keep = links > 0
        root = linked_rows(linked, ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[keep]), pa.array(root[keep]), pa.array(links[keep].astype(np.int64))], ["id", "root", "links"]
        )


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``df``: key, ``n_links``, ``component_id`` and ``kept``.

    Vectors are compared only if their labels are equal and not null and their lengths are equal.
    A vector that is null, empty or zero, or holds a null, NaN or infinite number, links with
    nothing. Rows with a null key have no class. Equal vectors are compared once and count as
    often as they occur. ``key`` and ``label`` must be whole numbers; other columns are not read.
    """
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("bigint").alias("label")
    )
    sound = (
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound
    distinct = cut_lineage(
        rows.where(usable)
        .groupBy("label", "vector")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vector"))
    )
    # One row per length of vectors.
    shape = {r["dim"]: (r["n"], r["most"]) for r in distinct.groupBy("dim", "label").agg(F.count("*").alias("m")).groupBy("dim").agg(F.sum("m").alias("n"), F.max("m").alias("most")).collect()}
    every = max(1, -(-sum(n for n, _ in shape.values()) // SAMPLE))
    taken = distinct.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).select("id", "dim", "vector").collect()
    taken.sort(key=lambda r: r["id"])
    quantisers = {}
    for dim, (_, most) in shape.items():
        sample = np.array([r["vector"] for r in taken if r["dim"] == dim], np.float64).reshape(-1, dim)
        quantisers[dim] = learn(sample, dim, *plan(most))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                codes = quantisers[dim].substrings(_matrix(part.column(4), dim))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(codes), pa.list_(pa.int64()))], [*part.schema.names, "parts"]
                )

    columns = ["label", "dim", "id", "copies", "vector"]
    coded = cut_lineage(
        distinct.select(*columns).mapInArrow(encode, "label bigint, dim int, id bigint, copies bigint, vector array<double>, parts array<bigint>")
    )
    bucket = ["label", "dim", "at", "part"]
    held = coded.select("label", "dim", "id", F.posexplode("parts").alias("at", "part"))
    full = held.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    full = full.select(*bucket, F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    meeting = (
        coded.select(*columns, "parts", F.posexplode("parts").alias("at", "part"))
        .join(full, bucket)
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"x": F.least("chunk", "other"), "y": F.greatest("chunk", "other")})
        .select(*bucket, "x", "y", "chunk", "id", "copies", "parts", "vector")
    )
    found = cut_lineage(
        meeting.repartition(*bucket, "x", "y")
        .sortWithinPartitions(*bucket, "x", "y", "id")
        .mapInArrow(_compare, "id bigint, root bigint, links bigint")
    )
    classes = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    placed = (
        distinct.select("label", "vector", "copies", "id")
        .join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
        .join(links, "id", "left")
        .select("label", "vector", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    out = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Rows that cannot link stay out of the join, however many there are.
    joined = out.where("usable").join(placed, ["label", "vector"], "left")
    alone = out.where("NOT usable").select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("links"))
    return joined.select("id", "root", "links").unionByName(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), F.col("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept")
    )
