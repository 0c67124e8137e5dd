"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of its bins, and the model is a lookup table per feature
plus one per chosen pair of features: a score is a sum of looked-up numbers. The tables are
boosted in cycles: in every round each feature in turn gets one shallow tree over its bins, fitted
to the present gradients and shrunk; then the pairs whose joint cuts gain most get theirs.

Learning takes a bounded sample of labelled rows (``SAMPLE`` of each class); the driver holds
their features (some numbers a row), never texts. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, labelled_sample

SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 80, 40, 0.15, 2.0

FEATURES = [
    "words", "word_length", "capitals", "digits", "symbols", "bars", "exclamations", "commas", "stops",
    "lines", "beyond_ascii", "distinct_words", "repeated_words", "longest_word",
]

_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b"#$%&*+<>=@\\^_`{}~[]",
    b"|",
    b"!?",
    b",;:",
    b".",
    b"\n",
    bytes(range(128, 256)),
]
_TABLE = np.zeros((256, len(_CLASSES)))
for _column, _members in enumerate(_CLASSES):
    _TABLE[list(_members), _column] = 1


def features(texts: Iterable[str | None]) -> np.ndarray:
    """One row of numbers per text; a null text is an empty one."""
    rows, counts = [], []
    for text in texts:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        counts.append(np.bincount(raw, minlength=256))
        words = (text or "").split()
        n = max(1, len(words))
        repeated = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
        longest = max(map(len, words), default=0)
        rows.append((len(raw), len(words), len(set(words)) / n, repeated / n, longest))
    size, words, distinct, repeated, longest = np.array(rows, float).reshape(-1, 5).T
    shares = np.array(counts, float).reshape(-1, 256) @ _TABLE / np.maximum(size, 1)[:, None]
    length = size / np.maximum(words, 1)
    return np.column_stack([np.log1p(words), length, shares, distinct, repeated, np.log1p(longest)])


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``score`` adds up what it looks up."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for column, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, column], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[
                np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")
            ]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between neighbouring values, near the quantiles."""
    values = np.sort(values)
    if not len(values):
        return np.zeros(0)
    marks = np.unique(values[(np.arange(1, bins) * len(values)) // bins])
    above = np.minimum(np.searchsorted(values, marks, "left"), len(values) - 1)
    return np.unique([(values[i] + values[i - 1]) / 2 for i in above if i and values[i] > values[i - 1]])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of a row of bins with the largest gain: bins before it, bins from it on."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of a tree of this depth over the bins of one feature."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + SHRINK))
    return np.concatenate([_shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Of a grid of bins: the gain and the values of the best cut into four quarters."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        low, row, column, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        parts.append((low, row - low, column - low, all_ - row - column + low))
    gain = sum(_gain(a, b) for a, b in zip(*parts)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    values = [a[i, j] / (b[i, j] + SHRINK) for a, b in zip(*parts)]
    tree = np.empty(g.shape)
    tree[: i + 1, : j + 1], tree[: i + 1, j + 1 :], tree[i + 1 :, : j + 1], tree[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), tree


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> AdditiveModel:
    """Boost the tables. Without rows of both classes the score is the share of label 1, or 0.5."""
    model = AdditiveModel()
    model.edges = [_edges(x[:, c], BINS) for c in range(x.shape[1])]
    model.pair_edges = [_edges(x[:, c], PAIR_BINS) for c in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    share = float(np.average(y, weights=weight)) if len(y) else 0.5
    model.intercept = float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))))
    if not len(y) or not 0 < share < 1:
        return model
    weight = weight / weight.mean()
    bins = [np.searchsorted(e, x[:, c], "right") for c, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, c], "right") for c, e in enumerate(model.pair_edges)]
    margin = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for c, b in enumerate(bins):
            g, h = gradients()
            size = len(model.tables[c])
            step = RATE * _shallow_tree(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[c] += step
            margin += step[b]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    gains = {p: _quadrants(grid(*p, g), grid(*p, h))[0] for p in itertools.combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: -gains[p])[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for table, (a, b) in zip(model.pair_tables, model.pairs):
            g, h = gradients()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            margin += step[coarse[a], coarse[b]]
    return model


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> AdditiveModel:
    """Learn from the labelled rows of ``docs`` outside the held-out fold; the text is the only input."""
    # Bounded by `sample` rows of each class.
    chosen = F.broadcast(labelled_sample(labels, docs, key, label, FOLDS, HELD_OUT, sample))
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = features(batch.column(3).to_pylist())
            numbers = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], numbers], ["key", "label", "weight", "x"])

    rows = known.select("key", "label", "weight", "text").mapInArrow(
        measure, f"key {dict(docs.dtypes)[key]}, label int, weight double, x array<double>"
    ).collect()
    rows.sort(key=lambda r: (r["key"], r["label"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows], float))


def score_documents(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row; null and empty texts are scored like any.

    Only ``key`` and ``text`` are read; repeated rows come back as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            score = model.score(features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")
    return scored.select(
        key,
        F.coalesce(fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted to be good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            score = model.score(features(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
