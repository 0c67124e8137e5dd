"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal shingle sets are one row of the matrix. Its columns are ordered, n-grams
that many documents share last; if two rows have a similarity of 0.8 or more, they share a
column among the first n - ceil(0.8 n) + 1 of each. The product over those leading columns
accumulates overlap counts per pair of rows; the sizes bound how much the other columns can add,
and pairs that stay below the overlap their sizes need are discarded. A leading column with many
rows would fill its block of the product: its rows are only tied together, not paired.

What is shuffled is kept small. The leading cells go to the blocks in packed records of some
bytes a cell, with five bytes of a column's hash: columns that collide only add pairs to look at.
Columns then meet by their first row, where those that the same rows share give one pair list.

What is left hangs together in small families of rows. Their whole rows are brought together,
in tiles of bounded size, and the product of each tile over all columns gives exact overlaps.
Only texts that may be in a family are shuffled, compressed; a tile makes their rows itself.
A tile returns, per row, its number of links and the smallest row it is linked with in the tile;
pairs are never written out. Components of those links give the classes.

The order of the columns changes the cost only, never the result, so the n-grams to put last are
found by looking for repeats within batches of texts, and their number has a bound.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import release_memory, with_maybe
from .components import components
from .shingles import shingle_set
from .tiles import groups, linked_rows

# Columns put last: so many at most, seen at least so often among batches of so many shingles.
LAST, SEEN, BATCH = 200_000, 6, 1_500_000
# Rows that a leading column pairs; rows of a tile.
FULL, TILE = 128, 512
# Bytes kept of a leading column's hash; cells that are packed at a time, cells of a block, blocks at most.
WIDTH, CELLS, BLOCK, BLOCKS = 5, 400_000, 50_000, 8192
# Members of a full column in one row; pairs that are counted at a time.
MEMBERS, PAIRS = 10_000, 400_000
# The ratio of sizes in a band: above 1 / 0.8, so that similar rows are at most one band apart.
BAND = 1.26
_COLUMNS = 2048


def _signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell shingle sets apart."""
    if not len(grams):
        return 0, 0
    place = np.arange(1, len(grams) + 1, dtype=np.uint64)
    first = np.bitwise_xor.reduce((grams ^ place) * np.uint64(0x9FB21C651E98DF25) + place)
    second = np.add.reduce((grams * np.uint64(0xD6E8FEB86659FD93)) ^ (grams >> np.uint64(29)))
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def _leading(n: int) -> int:
    """How many leading columns of a row of ``n`` must hold one that any similar row shares."""
    return n - -(-8 * n // 10) + 1 if n else 0


def _among(grams: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(last):
        return np.zeros(len(grams), bool)
    return last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams


def common_grams(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that repeat in many texts, ascending; at most ``LAST`` of them."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[tuple[int, int]] = set()
        size = 0

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n > 1
            return pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(n[keep])], ["gram", "n"])

        for batch in batches:
            for value in batch.column(0):
                grams = shingle_set(value.as_py())
                signature = _signature(grams)
                if signature in known:
                    continue
                known.add(signature)
                held.append(grams)
                size += len(grams)
                if size >= BATCH:
                    yield counted()
                    held, known, size = [], set(), 0
        if held:
            yield counted()
        held, known = [], set()
        release_memory()

    found = docs.select(text).mapInArrow(repeats, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "gram").limit(LAST).select("gram").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _lead(docs: DataFrame, key: str, text: str, last: np.ndarray) -> DataFrame:
    """Per row of ``docs``: its signature, its number of shingles and its leading columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, size, lead = [], [], [], []
            for value in batch.column(1):
                grams = shingle_set(value.as_py())
                first, second = _signature(grams)
                one.append(first)
                two.append(second)
                size.append(len(grams))
                want = _leading(len(grams))
                late = _among(grams, last)
                early = grams[~late][:want]
                if len(early) < want:
                    early = np.concatenate([early, grams[late][: want - len(early)]])
                lead.append(early.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes())
            columns = [pa.array(x, pa.int64()) for x in (one, two, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(lead, pa.binary())], ["id", "one", "two", "n", "lead"]
            )
        release_memory()

    return docs.select(key, text).mapInArrow(run, f"id {dict(docs.dtypes)[key]}, one bigint, two bigint, n bigint, lead binary")


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as the least of them and as many bytes above it as the largest needs, low bytes first."""
    low = int(values.min())
    above = values.astype(np.int64).view(np.uint64) - np.int64(low).view(np.uint64)
    width = max(1, (int(above.max()).bit_length() + 7) // 8)
    return low.to_bytes(8, "little", signed=True) + above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    body = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, n)
    full[:, : len(body)] = body.T
    low = np.frombuffer(raw, "<i8", 1).astype(np.int64).view(np.uint64)
    return (full.view("<u8")[:, 0].astype(np.uint64) + low).view(np.int64)


def _blocks(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (rep, n, lead) to their leading cells, packed by block of columns: (block, size, grams, reps, ns)."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("rep")
        raw = rows.column("lead").to_pylist()
        size = np.array([len(x) for x in raw]) // WIDTH
        full = np.zeros((int(size.sum()), 8), np.uint8)
        full[:, :WIDTH] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH)
        grams = full.view("<u8")[:, 0].astype(np.int64)
        reps, ns = (np.repeat(rows.column(c).to_numpy(), size) for c in ("rep", "n"))
        block = grams % blocks
        order = np.argsort(block, kind="stable")
        block, grams, reps, ns = block[order], grams[order], reps[order], ns[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(block)]
        columns = [[_packed(x[a:b]) for a, b in zip(starts, ends)] for x in (grams, reps, ns)]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]],
            ["block", "size", "grams", "reps", "ns"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                held.append(batch.slice(start, 1000))
                size += sum(len(x) for x in held[-1].column("lead").to_pylist()) // WIDTH
                if size >= CELLS:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)
        held = []
        release_memory()

    return run


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def _columns(full: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to the columns that rows share: (first, members, ns, tied), members by size.

    Columns of more than ``full`` rows are only tied together. In the others, a row without a
    partner of similar size is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 1):
            sizes = part.column("size").to_pylist()
            grams, reps, ns = (
                np.concatenate([_unpacked(raw, n) for raw, n in zip(part.column(c).to_pylist(), sizes)]) for c in ("grams", "reps", "ns")
            )
            order = np.lexsort((reps, ns, grams))
            grams, reps, ns = grams[order], reps[order], ns[order]
            # Two hashes of a row may collide in the bytes that are kept.
            once = np.r_[True, (grams[1:] != grams[:-1]) | (reps[1:] != reps[:-1])]
            grams, reps, ns = grams[once], reps[once], ns[once]
            new = np.r_[True, grams[1:] != grams[:-1]]
            size = np.diff(np.r_[np.flatnonzero(new), len(new)])[np.cumsum(new) - 1]
            tied = size > full
            fits = ~new[1:] & (10 * ns[:-1] >= 8 * ns[1:])
            keep = tied | np.r_[False, fits] | np.r_[fits, False]
            if not keep.any():
                continue
            grams, reps, ns, tied = grams[keep], reps[keep], ns[keep], tied[keep]
            new = np.r_[True, grams[1:] != grams[:-1]]
            starts = np.flatnonzero(new)
            first = np.minimum.reduceat(reps, starts)[np.cumsum(new) - 1]
            # A full column is cut into rows of bounded length.
            starts = np.flatnonzero(new | ((np.arange(len(new)) - starts[np.cumsum(new) - 1]) % MEMBERS == 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[starts]), _lists(reps, starts), _lists(ns, starts), pa.array(tied[starts])], ["first", "members", "ns", "tied"]
            )
        release_memory()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns (members, ns), those of one first row together, to (a, b, na, nb, shared): na <= nb."""

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, na, nb = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        shared = np.diff(np.r_[starts, len(a)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(v[starts] for v in (a, b, na, nb)), shared)], ["a", "b", "na", "nb", "shared"])

    held: list[np.ndarray] = []
    made = 0
    for batch in batches:
        members, ns = (batch.column(c) for c in ("members", "ns"))
        offsets = members.offsets.to_numpy()
        values, sizes = members.values.to_numpy(), ns.values.to_numpy()
        shift = ns.offsets.to_numpy()[0] - offsets[0]
        length = np.diff(offsets)
        for n in np.unique(length[length > 1]):
            i, j = np.triu_indices(n, 1)
            rows = offsets[:-1][length == n]
            step = max(1, PAIRS // (2 * len(i)))
            for start in range(0, len(rows), step):
                at = rows[start : start + step, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                near = 10 * sizes[a + shift] >= 8 * sizes[b + shift]
                a, b = a[near], b[near]
                held.append(np.stack([values[a], values[b], sizes[a + shift], sizes[b + shift]]))
                made += len(a)
                if made >= PAIRS:
                    yield counted(held)
                    held, made = [], 0
    if made:
        yield counted(held)
    held = []
    release_memory()


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix of ``rows`` with itself: how many columns two rows share."""
    total = np.zeros((len(rows), len(rows)), np.float64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns, place, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = n[place] > 1
    of, place = of[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    width = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, width, _COLUMNS):
        low, high = np.searchsorted(place, (start, start + _COLUMNS))
        block = np.zeros((len(rows), min(_COLUMNS, width - start)), np.float32)
        block[of[low:high], place[low:high] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text), the text compressed."""
    for batch in batches:
        raw = [None if t is None else zlib.compress(t.encode("utf-8", "replace"), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "raw"])


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (family, x1, x2, y1, y2, in_x, id, copies, one, two, raw) to (id, root, links)."""
    for tile in groups(batches, 5):
        rows, fits = [], []
        for raw, one, two in zip(*(tile.column(c).to_pylist() for c in ("raw", "one", "two"))):
            grams = shingle_set(raw and zlib.decompress(raw).decode())
            fits.append(_signature(grams) == (one, two))  # another text may have the same key
            if fits[-1]:
                rows.append(grams)
        if len(rows) < 2:
            continue
        tile = tile.filter(pa.array(fits))
        in_x = tile.column("in_x").to_numpy().astype(bool)
        ids = tile.column("id").to_numpy()
        copies = tile.column("copies").to_numpy()
        across = any(tile.column(f"x{k}")[0].as_py() != tile.column(f"y{k}")[0].as_py() for k in (1, 2))
        size = np.array([len(r) for r in rows])
        shared = overlaps(rows)
        linked = 100 * shared >= 80 * (size[:, None] + size[None, :] - shared)
        if across:  # pairs within a chunk belong to its own tile
            linked &= in_x[:, None] != in_x[None, :]
        np.fill_diagonal(linked, False)
        links = linked @ copies
        root = linked_rows(linked, ids)
        keep = links > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[keep]), pa.array(root[keep]), pa.array(links[keep].astype(np.int64))], ["id", "root", "links"]
        )
    release_memory()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id`` and ``n_links``.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more; ``component_id`` is the smallest key reachable by links, ``n_links`` counts other
    documents linked directly. Texts without words (null, empty, blanks) link with nothing. Rows
    with a null key have neither class nor links. ``key`` must be a whole number. Other columns
    are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    led = cut_lineage(_lead(docs, "id", "text", common_grams(docs, "text")))
    # One row of the matrix per set of shingles, whatever the number of copies.
    sets = led.where("n > 0 AND id IS NOT NULL").groupBy("one", "two")
    rows = cut_lineage(sets.agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")))
    cells = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * 8 / 10) + 1)).first()[0] or 0
    columns = cut_lineage(
        sets.agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("lead").alias("lead"))
        .select("rep", "n", "lead")
        .mapInArrow(_blocks(max(16, min(BLOCKS, cells // BLOCK))), "block int, size int, grams binary, reps binary, ns binary")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_columns(FULL), "first bigint, members array<bigint>, ns array<bigint>, tied boolean")
    )
    # A full column ties its rows to its first one.
    ties = columns.where("tied").select(F.col("first").alias("a"), F.explode("members").alias("b")).where("a <> b")
    paired = (
        columns.where("NOT tied").select("first", "members", "ns").repartition("first").sortWithinPartitions("first").select("members", "ns")
        .mapInArrow(_pairs, "a bigint, b bigint, na bigint, nb bigint, shared bigint")
    )
    rest = lambda n: F.ceil(F.col(n) * 8 / 10) - 1  # noqa: E731  columns beyond the leading ones
    counted = (
        paired.groupBy("a", "b", "na", "nb")
        .agg(F.sum("shared").alias("shared"))
        # overlap * 180 >= 80 * (na + nb) is needed; the rest can add at most so much.
        .where((F.col("shared") + F.greatest(rest("na"), rest("nb"))) * 180 >= 80 * (F.col("na") + F.col("nb")))
        .select("a", "b")
    )
    families = components(ties.unionByName(counted))
    # A large family is cut into bands of sizes: rows that may be similar are in one or in neighbours.
    known = families.join(rows.select(F.col("rep").alias("node"), "one", "two", "copies", "n"), "node")
    large = families.groupBy("root").agg((F.count("*") > TILE).alias("large"))
    known = known.join(large, "root").withColumn("band", F.when(F.col("large"), F.floor(F.log("n") / math.log(BAND))).otherwise(0).cast("int"))
    chunks = known.groupBy("root", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    # One entry per band, some dozens.
    chunks = chunks.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "chunks"))).alias("chunks"))
    members = cut_lineage(
        known.join(chunks, "root").select(F.col("node").alias("id"), F.col("root").alias("family"), "band", "chunks", "one", "two", "copies")
    )

    place = lambda band, chunk: F.struct(band.alias("band"), chunk.alias("chunk"))
    own = place(F.col("band"), F.pmod(F.xxhash64("id"), F.try_element_at("chunks", F.col("band"))).cast("int"))
    others = F.flatten(
        F.transform(
            F.filter(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda b: F.try_element_at("chunks", b).isNotNull()),
            lambda b: F.transform(F.sequence(F.lit(0), F.try_element_at("chunks", b) - 1), lambda c: place(b, c)),
        )
    )
    brought = (
        with_maybe(docs, "id", members).where("maybe").select("id", "text")
        .mapInArrow(_compressed, "id bigint, raw binary")
        .join(members, "id")
        .select("family", "id", "copies", own.alias("own"), others.alias("others"), "one", "two", "raw")
        .withColumn("other", F.explode("others"))
        .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        .select(
            "family", F.col("x.band").alias("x1"), F.col("x.chunk").alias("x2"), F.col("y.band").alias("y1"), F.col("y.chunk").alias("y2"),
            (F.col("own") == F.col("x")).alias("in_x"), "id", "copies", "one", "two", "raw",
        )
    )
    tile = ["family", "x1", "x2", "y1", "y2"]
    products = cut_lineage(
        brought.repartition(*tile)
        .sortWithinPartitions(*tile, "id")
        .mapInArrow(_multiply, "id bigint, root bigint, links bigint")
    )
    classes = components(products.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = products.groupBy("id").agg(F.sum("links").alias("links"))
    placed = (
        rows.select("one", "two", "rep", "copies")
        .join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .select("one", "two", "rep", "copies", "root", "links")
    )
    return led.select("id", "one", "two", "n").join(placed, ["one", "two"], "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"),
        F.when(F.col("id").isNull() | (F.col("n") == 0), F.lit(0))
        .otherwise(F.coalesce(F.col("copies"), F.lit(1)) - 1 + F.coalesce("links", F.lit(0)))
        .cast("bigint")
        .alias("n_links"),
    )
