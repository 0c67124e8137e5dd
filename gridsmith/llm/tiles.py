"""Tiles: bounded groups of rows that one task multiplies with each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``keys`` columns (whole numbers) in sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and (start or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def linked_rows(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a tile reaches by the links in it."""
    root = ids.copy()
    while True:
        near = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1)
        smaller = np.minimum(root, near)
        if (smaller == root).all():
            return root
        root = smaller
