"""Shingle sets of texts as sorted arrays of 64-bit hashes, by array arithmetic on the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
# Bytes of text that are hashed at a time; longer texts go in parts, cut at blanks.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)], dtype=np.uint64)
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _parts(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > PART:
        cut = raw.find(b" ", start + PART)
        if cut < 0:
            break
        yield raw[start:cut]
        start = cut
    yield raw[start:]


def _hashes(raw: bytes) -> np.ndarray:
    """A hash of each word; words end at ASCII blanks."""
    code = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[code]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    letters = code[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    return mix(np.add.reduceat(letters * _powers(int(size.max()))[place], first))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text with A-Z in lower case."""
    raw = (text or "").encode("utf-8", "replace").lower()
    if len(raw) <= PART:
        return _hashes(raw)
    return np.concatenate([_hashes(part) for part in _parts(raw)])


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles, ascending: runs of ``size`` words; of fewer words the whole sequence; of none nothing."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        total = total * np.uint64(_BASE) + words[k : k + n]
    return np.unique(mix(total))
