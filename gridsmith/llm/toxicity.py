"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: words in lower case and the first four and five letters of
longer words, each as a 32-bit hash. The score adds a weight per term and, for every pair of
terms in the text, the product of their factors, so that two terms can say together what neither
says alone. The pair sum takes linear time: half of (sum of factors)^2 - sum of squares.

Learning takes a bounded sample of labelled rows (``SAMPLE`` of each class) and a bounded number
of terms; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, labelled_sample

SAMPLE = 6_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
FACTORS, EPOCHS, BATCH, RATE, PAIR_RATE, DECAY = 6, 24, 128, 0.3, 0.05, 3e-5
# Toxic rows count more: missing one costs more than the low threshold alone makes up for.
POSITIVE = 2.0
# Terms in the model: those that tell most by themselves, and common ones for their company.
TELLING, COMMON, LEAST = 6_000, 4_000, 4
CACHE = 400_000
_WORD = re.compile(r"[^\W_]+")


def run_terms(run: str) -> list[int]:
    """Hashes of the terms in a run without blanks."""
    terms = []
    for word in _WORD.findall(run):
        terms.append("=" + word)
        if len(word) > 4:
            terms.append("<" + word[:4])
        if len(word) > 5:
            terms.append("<" + word[:5])
    return [zlib.crc32(t.encode("utf-8", "replace")) for t in terms]


def text_terms(text: str | None) -> np.ndarray:
    runs = set((text or "").lower().split())
    return np.unique(np.fromiter(chain.from_iterable(map(run_terms, runs)), np.uint32))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # hashes, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """``rows``: for each text the places of its terms in ``terms``."""
        out = np.full(len(rows), self.bias)
        for i, places in enumerate(rows):
            if len(places):
                v = self.factors[places]
                s = v.sum(0)
                out[i] += self.weights[places].sum() + 0.5 * (s @ s - (v * v).sum())
        return out


def _choose(ids: np.ndarray, of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The terms to learn: by chi-square of their presence, and by frequency."""
    terms, place = np.unique(ids, return_inverse=True)
    seen = np.bincount(place, minlength=len(terms)).astype(float)
    hits = np.bincount(place, y[of], minlength=len(terms))
    n, positive = len(y), y.sum()
    expected = seen * positive / n
    spread = expected * (1 - positive / n) * np.maximum(1 - seen / n, 1e-9)
    chi = (hits - expected) ** 2 / np.maximum(spread, 1e-9)
    enough = np.flatnonzero(seen >= LEAST)
    telling = enough[np.argsort(-chi[enough], kind="stable")[:TELLING]]
    common = enough[np.argsort(-seen[enough], kind="stable")[:COMMON]]
    return terms[np.union1d(telling, common)]


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Adaptive gradient steps over ``EPOCHS`` passes. Without rows of both classes only the bias is learnt."""
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    clipped = min(max(share, 1e-3), 1 - 1e-3)
    bias = float(np.log(clipped / (1 - clipped)))
    if not 0 < share < 1:
        return FactorizationMachine(np.zeros(0, np.uint32), bias, np.zeros(0), np.zeros((0, FACTORS)))
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms = _choose(np.concatenate(rows), of, y)
    places = []
    for row in rows:
        at = np.minimum(np.searchsorted(terms, row), len(terms) - 1)
        places.append(at[terms[at] == row])
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), random.normal(0, 0.01, (len(terms), FACTORS))
    w_sum, v_sum = np.full(len(terms), 1e-2), np.full((len(terms), FACTORS), 1e-2)
    bias_sum = 1e-2
    weight = weight / weight.mean() * np.where(y == 1, POSITIVE, 1.0)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            size = np.array([len(places[r]) for r in batch])
            ids = np.concatenate([places[r] for r in batch])
            row = np.repeat(np.arange(len(batch)), size)
            vs = v[ids]
            sums = np.stack([np.bincount(row, vs[:, f], len(batch)) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (vs * vs).sum(1), len(batch))
            margin = bias + np.bincount(row, w[ids], len(batch)) + 0.5 * ((sums * sums).sum(1) - squares)
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]) / len(batch)
            used, local = np.unique(ids, return_inverse=True)
            each = error[row]
            gw = np.bincount(local, each, len(used)) + DECAY * w[used]
            inner = sums[row] - vs
            gv = np.stack([np.bincount(local, each * inner[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * v[used]
            w_sum[used] += gw * gw
            v_sum[used] += gv * gv
            w[used] -= RATE * gw / np.sqrt(w_sum[used])
            v[used] -= PAIR_RATE * RATE * gv / np.sqrt(v_sum[used])
            gb = error.sum()
            bias_sum += gb * gb
            bias -= RATE * gb / np.sqrt(bias_sum)
    return FactorizationMachine(terms, float(bias), w, v)


class Scorer:
    """Looks up the terms of runs; a bounded memory of runs only saves time."""

    def __init__(self, model: FactorizationMachine) -> None:
        self.model = model
        self.at = {t: i for i, t in enumerate(model.terms.tolist())}
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, text: str | None) -> np.ndarray:
        runs = set((text or "").lower().split())
        known, at = self.known, self.at
        for run in runs.difference(known):
            found = [at[t] for t in run_terms(run) if t in at]
            known[run] = tuple(found)
        out = np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, runs)), np.int64))
        if len(known) > CACHE:
            known.clear()
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.model.margin([self.places(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> FactorizationMachine:
    """Learn from the labelled rows of ``docs`` outside the held-out fold; the text is the only input."""
    # Bounded by `sample` rows of each class.
    chosen = F.broadcast(labelled_sample(labels, docs, key, label, FOLDS, HELD_OUT, sample))
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([text_terms(v.as_py()).tobytes() for v in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], terms], ["key", "label", "weight", "terms"])

    rows = known.select("key", "label", "weight", "text").mapInArrow(
        hashed, f"key {dict(docs.dtypes)[key]}, label int, weight double, terms binary"
    ).collect()
    rows.sort(key=lambda r: (r["key"], r["label"], bytes(r["terms"])))
    terms = [np.frombuffer(bytes(r["terms"]), np.uint32) for r in rows]
    return fit(terms, np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows], float))


def score_documents(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row; null and empty texts get the bias alone.

    Only ``key`` and ``text`` are read; repeated rows come back as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            score = np.concatenate([scorer.score([v.as_py()]) for v in batch.column(1)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")
    return scored.select(
        key,
        F.coalesce(fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_civil(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            score = np.concatenate([scorer.score([v.as_py()]) for v in texts] or [np.zeros(0)])
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
