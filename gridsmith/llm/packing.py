"""Best-fit packing of token sequences by bin completion with branch and bound.

Pieces of one length are alike, so a packing is a list of patterns: which lengths share a
sequence, and how many sequences look like that. The driver sees the number of pieces of each
length only, at most ``capacity`` numbers, and returns patterns; the pieces find their places by
their rank among the pieces of their length, on the executors.

Best-fit decreasing gives the first incumbent. Bin completion then takes the largest piece left,
enumerates the undominated fillings around it, the least waste first and each when the search
comes to it, and repeats a filling as often as pieces last. A branch is left as soon as its waste rules out fewer sequences than the
incumbent has. The search ends at the lower bound, ceil(tokens / capacity), or after ``NODES``
fillings, its only limit; every piece is packed in either case.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .bpe import PrefixBpe, encoder

CAPACITY = 4096
END = 1
# Fillings that the search may look at; choices of the last bins that stay in memory.
NODES, OPEN = 20_000, 50

# (number of sequences, [(length, how many of it), ...])
Pattern = tuple[int, list[tuple[int, int]]]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, all pieces of a length at a time."""
    groups: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # the rooms that groups have left, ascending

    def put(room: int, pattern: Pattern) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append(pattern)

    def take(room: int) -> Pattern:
        pattern = groups[room].pop()
        if not groups[room]:
            del groups[room]
            rooms.remove(room)
        return pattern

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (left // each, [(length, each)]))
                if left % each:
                    put(capacity - left % each * length, (1, [(length, left % each)]))
                break
            room = rooms[at]
            times, items = take(room)
            each = room // length
            full = min(times, left // each)
            if full:
                put(room - each * length, (full, [*items, (length, each)]))
                left -= full * each
                times -= full
            if times and 0 < left < each:
                put(room - left * length, (1, [*items, (length, left)]))
                times, left = times - 1, 0
            if times:
                put(room, (times, items))
    return [pattern for held in groups.values() for pattern in held]


def _exact(counts: list[int], lengths: list[int], reach: list[int], room: int, top: int) -> Iterator[Counter]:
    """Every choice among ``lengths[:top]`` that adds up to ``room``; ``reach[k]`` has a bit for each sum of the first k."""
    if not room:
        yield Counter()
        return
    for at in range(bisect.bisect_right(lengths, room, 0, top) - 1, -1, -1):
        if not reach[at + 1] >> room & 1:
            return
        length = lengths[at]
        for each in range(min(counts[at], room // length), 0, -1):
            if reach[at] >> room - each * length & 1:
                for rest in _exact(counts, lengths, reach, room - each * length, at):
                    rest[length] = each
                    yield rest


def fillings(counts: dict[int, int], lengths: list[int], room: int, spent: list[int]) -> Iterator[tuple[int, Counter]]:
    """Undominated ways to fill ``room`` as (waste, lengths), the least waste first, one at a time.

    A filling is dominated when a piece that is left would still fit, alone or in place of a
    shorter one. ``lengths`` are the lengths at hand, ascending; ``spent`` counts the fillings looked at.
    """
    lengths = lengths[: bisect.bisect_right(lengths, room)]
    left = [min(counts[length], room // length) for length in lengths]
    reach, mask = [1], (2 << room) - 1
    for length, n in zip(lengths, left):
        sums, step = reach[-1], 1
        while n:  # copies in powers of two
            step = min(step, n)
            sums |= sums << step * length & mask
            n, step = n - step, 2 * step
        reach.append(sums)

    def undominated(chosen: Counter, waste: int) -> bool:
        for length in [0, *chosen]:
            for at in range(bisect.bisect_right(lengths, length), bisect.bisect_right(lengths, length + waste)):
                if counts[lengths[at]] > chosen.get(lengths[at], 0):
                    return False
        return True

    for waste in range(room + 1):
        if reach[-1] >> room - waste & 1:
            for chosen in _exact(left, lengths, reach, room - waste, len(lengths)):
                spent[0] += 1
                if not waste or undominated(chosen, waste):
                    yield waste, chosen
                elif spent[0] > NODES:
                    return


class _Choices:
    """The fillings around one piece, which can be left and taken up again where they were."""

    def __init__(self, counts: dict[int, int], lengths: list[int], room: int, spent: list[int]) -> None:
        self.about, self.taken, self.running = (counts, lengths, room, spent), 0, None

    def next(self) -> tuple[int, Counter] | None:
        """The next filling. The pieces at hand must be those there were at first."""
        if self.running is None:
            self.running = itertools.islice(fillings(*self.about), self.taken, None)
        self.taken += 1
        return next(self.running, None)


def complete_bins(counts: dict[int, int], capacity: int, incumbent: list[Pattern]) -> list[Pattern]:
    """Branch and bound over fillings; the incumbent if nothing better is found."""
    total = sum(length * n for length, n in counts.items())
    bound = math.ceil(total / capacity)
    best, best_size = incumbent, sum(times for times, _ in incumbent)
    counts = dict(counts)
    lengths = sorted(counts)
    # Of each completed bin: (choices still open, its piece, what was taken, how often, its waste).
    path: list[tuple[_Choices, int, Counter, int, int]] = []
    waste = used = 0
    spent = [0]

    def change(items: Counter, times: int, sign: int) -> None:
        for length, each in items.items():
            before = counts.get(length, 0)
            counts[length] = before + sign * each * times
            if not counts[length]:
                del counts[length]
                lengths.pop(bisect.bisect_left(lengths, length))
            elif not before:
                bisect.insort(lengths, length)

    choices: _Choices | None = None
    largest = 0
    while best_size > bound and spent[0] <= NODES:
        if not counts:
            best = [(times, sorted(items.items(), reverse=True)) for _, _, items, times, _ in path]
            best_size = used
            option = None
        else:
            if choices is None:
                largest = lengths[-1]
                choices = _Choices(counts, lengths, capacity - largest, spent)
            alone = Counter([largest])
            change(alone, 1, -1)
            option = choices.next()
            change(alone, 1, 1)
        # Fewer sequences than the incumbent leave only so much waste; later fillings waste more.
        allowed = (best_size - 1) * capacity - total
        if option is not None and waste + option[0] <= allowed:
            lost, items = option[0], option[1] + alone
            times = min(counts[length] // each for length, each in items.items())
            if lost:
                times = max(1, min(times, (allowed - waste) // lost))
            change(items, times, -1)
            path.append((choices, largest, items, times, lost * times))
            if len(path) > OPEN:
                path[-OPEN - 1][0].running = None
            waste += lost * times
            used += times
            choices = None
        elif path:
            choices, largest, items, times, lost = path.pop()
            change(items, times, 1)
            waste -= lost
            used -= times
        else:
            break
    return best


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece; ``counts`` is the number of pieces of each length."""
    return complete_bins(counts, capacity, best_fit(counts, capacity))


def cut_documents(docs: DataFrame, path: str, key: str, text: str, capacity: int) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut after each ``capacity`` ids."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        yield from cut(bpe, batches)
        bpe.rest()

    def cut(bpe: PrefixBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(bpe.encode_all(v.as_py() for v in batch.column(1))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)],
                ],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bucket_rows: int = 100_000
) -> DataFrame:
    """Every piece with its sequence and its place there.

    A document is its ids and the end id; only longer ones than ``capacity`` are cut. Null texts
    are empty and have the end id alone; rows with one key are documents of their own; an empty
    table gives no rows. Columns besides ``key`` and ``text`` are not read.

    The pieces are written once below the checkpoint folder, so texts are encoded once. A length
    that very many pieces share is ranked in buckets.
    """
    pieces = cut_lineage(cut_documents(docs, path, key, text, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # One row per run of a pattern: at most some thousands, whatever the number of pieces.
    slots: list[tuple[int, int, int, int, int]] = []
    given: Counter = Counter()
    sequence = 0
    for times, items in pack_lengths(counts, capacity):
        offset = 0
        for length, each in items:
            slots.append((length, given[length], each, sequence, offset))
            given[length] += times * each
            offset += length * each
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)

    buckets = max(1, sum(counts.values()) // bucket_rows)
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        bucketed.groupBy("length", "__bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("__ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("length", "__bucket").orderBy(key, "piece", "start", "ids_crc32")
    ranked = (
        bucketed.withColumn("__within", F.row_number().over(within) - 1)
        .join(ahead, ["length", "__bucket"])
        .select(key, "piece", "start", "length", "ids_crc32", (F.col("__ahead") + F.col("__within")).alias("rank"))
    )
    schema = ranked.drop("rank").schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = table[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(table) else table
            turn = rank - slot[:, 1]
            columns = [*batch.columns[:-1], pa.array(slot[:, 3] + turn // slot[:, 2]), pa.array(slot[:, 4] + turn % slot[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema.replace(":", " "))
