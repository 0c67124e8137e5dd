"""Scores of predictions, as plain aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import ref
from ..functions.sampling import row_hash
from ..session import cut_lineage
from ..operators.chartdata import ranked_scores

SILHOUETTE_SAMPLE = 2000
# Bytes of vectors in a block of rows, and distances held at a time.
BLOCK_BYTES = 8 << 20
DISTANCES = 1 << 22
# Below this share of the squared norms, a squared distance is taken from the differences.
CLOSE = 1e-6


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: r2, rmse, mae."""
    y, error = ref(actual).cast("double"), ref(actual).cast("double") - ref(predicted).cast("double")
    return df.agg(
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(
        ref(actual).cast("string").alias("actual"), ref(predicted).cast("string").alias("predicted")
    ).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, score: str | None = None, positive=1) -> DataFrame:
    """One row: accuracy, f1, precision and recall weighted by support, and roc_auc.

    Everything follows from the confusion counts. ``score`` is the probability of the
    ``positive`` label in a two-label problem.
    """
    counts = confusion(df, actual, predicted)
    cells = F.array(
        F.struct(
            F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
            F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    per_label = counts.select(F.inline(cells)).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("claimed")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("claimed") + F.col("support")), zero)
    total = F.sum("support")
    result = per_label.agg(
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / total).alias("f1"),
        (F.sum(precision * F.col("support")) / total).alias("precision"),
        (F.sum(recall * F.col("support")) / total).alias("recall"),
    )
    if score is None:
        return result.withColumn("roc_auc", F.lit(None).cast("double"))
    return result.withColumn("roc_auc", roc_auc(df, actual, score, positive).scalar())


def roc_auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """Share of positive/negative pairs in the right order, ties counting half."""
    ranked, totals = ranked_scores(df, actual, score, positive)
    pos, neg = float(totals["pos"]), float(totals["neg"])
    right = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2).cast("double"))
    return ranked.agg((right / F.lit(pos * neg if pos * neg else None).cast("double")).alias("roc_auc"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(ref(label)).agg(F.count("*").alias("n"))


def clustering_metrics(df: DataFrame, features: str, label: str, distance: str = "squared") -> DataFrame:
    """(cluster, n, silhouette): sizes, and one silhouette value for the whole clustering.

    The silhouette is null with a single cluster or with noise (−1). ``squared`` Euclidean
    distance needs one pass; ``euclidean`` meets every pair of rows (``silhouettes``).
    """
    if distance not in ("squared", "euclidean"):
        raise ValueError(f"unknown distance {distance!r}")
    sizes = cluster_sizes(df, label)
    labels = [r[0] for r in sizes.select(ref(label)).limit(2).collect()]
    noise = df.where(ref(label) == -1).limit(1).count() > 0
    silhouette = None
    if len(labels) > 1 and not noise:
        if distance == "euclidean":
            silhouette = silhouettes(df, features, label, []).agg(F.avg("silhouette")).first()[0]
        else:
            evaluator = ClusteringEvaluator(featuresCol=features, predictionCol="__cluster")
            silhouette = evaluator.evaluate(df.withColumn("__cluster", ref(label).cast("double")))
    return sizes.select(ref(label).alias("cluster"), "n", F.lit(silhouette).cast("double").alias("silhouette"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` from those of ``b``."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)
    squared = norms - 2 * (a @ b.T)
    # The product form loses the digits of small distances.
    left, right = np.nonzero(squared < CLOSE * norms)
    step = max(1, DISTANCES // max(1, a.shape[1]))
    for at in range(0, len(left), step):
        i, j = left[at : at + step], right[at : at + step]
        gap = a[i] - b[j]
        squared[i, j] = (gap * gap).sum(1)
    return np.sqrt(squared)


def silhouettes(df: DataFrame, features: str, label: str, keys: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keys…, label, silhouette): the Euclidean silhouette of every row, from all rows.

    (b − a) / max(a, b) with a the mean distance from the rest of the row's cluster and b the
    smallest mean distance from another one; 0 in a cluster of one row, null with one cluster.
    ``features`` is an array or a vector. Rows without a label, or with a null, empty or
    non-finite vector, take no part and get null; vectors must be equally long.

    Every pair of rows is measured once, in tiles: a tile is two blocks of at most about
    ``block_bytes`` and gives sums per row and cluster, never pairs. Work grows with the square
    of the rows and the shuffle with rows times blocks; ``clustering_metrics`` has the one-pass
    squared form.
    """
    vector = ref(features)
    if not isinstance(df.schema[features].dataType, T.ArrayType):
        vector = vector_to_array(vector)
    vector = vector.cast("array<double>")
    limit = float("inf")
    finite = F.forall(vector, lambda x: x.isNotNull() & (x > -limit) & (x < limit))
    usable = F.coalesce((F.size(vector) > 0) & finite & ref(label).isNotNull(), F.lit(False))
    rows = cut_lineage(df.select(
        *[ref(k).alias(f"__key_{i}") for i, k in enumerate(keys)], ref(label).alias("__label"),
        F.when(usable, vector).alias("__vector"), F.monotonically_increasing_id().alias("__id"),
    ))
    points = rows.where("__vector IS NOT NULL").select("__id", "__label", "__vector")
    count, longest = points.agg(F.count("*"), F.max(F.size("__vector"))).first()
    blocks = max(1, -(-count * 8 * (longest or 1) // block_bytes))
    others = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda other: F.struct(F.least("__block", other).alias("i"), F.greatest("__block", other).alias("j")),
    )
    block = F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int")
    dealt = points.withColumn("__block", block).select("__id", "__label", "__vector", "__block", F.inline(others))
    label_type = df.schema[label].dataType.simpleString()
    schema = f"__id long, __cluster {label_type}, total double"
    sums = dealt.groupBy("i", "j").applyInPandas(_tile_sums, schema).groupBy("__id", "__cluster").agg(F.sum("total").alias("total"))
    sizes = points.groupBy(F.col("__label").alias("__cluster")).agg(F.count("*").alias("n"))
    own = F.col("__cluster") == F.col("__label")
    means = sums.join(sizes, "__cluster").join(points.select("__id", "__label"), "__id").groupBy("__id").agg(
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("b").isNull(), None).when((F.col("n") == 1) | (widest == 0), 0.0).otherwise((F.col("b") - F.col("a")) / widest)
    found = means.select("__id", value.cast("double").alias("silhouette"))
    names = [F.col(f"__key_{i}").alias(k) for i, k in enumerate(keys)]
    return rows.join(found, "__id", "left").select(*names, F.col("__label").alias(label), "silhouette")


def _tile_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Distance sums of a tile: from the rows of each of its blocks to the clusters of the other."""
    parts = [rows[rows["__block"] == b] for b in sorted(rows["__block"].unique())]
    held = [(p["__id"].to_numpy(), *np.unique(p["__label"].to_numpy(), return_inverse=True), np.stack(p["__vector"].to_numpy())) for p in parts]
    # A block meets itself in the tile of its own number only.
    same = rows["i"].iloc[0] == rows["j"].iloc[0]
    if len(held) < 2 and not same:
        return pd.DataFrame({"__id": [], "__cluster": [], "total": []})
    first, second = held[0], held[0] if same else held[1]
    found = []
    for (ids, _, _, a), (_, clusters, codes, b) in [(first, second)] if same else [(first, second), (second, first)]:
        member = np.zeros((len(b), len(clusters)))
        member[np.arange(len(b)), codes] = 1
        step = max(1, DISTANCES // len(b))
        total = np.concatenate([distances(a[at : at + step], b) @ member for at in range(0, len(a), step)])
        found.append(pd.DataFrame({"__id": np.repeat(ids, len(clusters)), "__cluster": np.tile(clusters, len(ids)), "total": total.ravel()}))
    return pd.concat(found)


def sampled_silhouette(
    df: DataFrame, features: str, label: str, keys: list[str], n: int = SILHOUETTE_SAMPLE, seed: int = 42
) -> DataFrame:
    """Mean Euclidean silhouette of a sample against itself; exact when ``n`` covers the table.

    Every sampled row meets the sample, which is a bounded array constant per task.
    """
    hashed = df.select(
        F.col(features).alias("f"), ref(label).alias("l"), row_hash(keys, seed).alias("h"), *map(ref, keys)
    ).orderBy("h", *map(ref, keys)).limit(n)
    rows = hashed.select("f", "l").withColumn("i", F.monotonically_increasing_id())
    points = rows.collect()  # at most n rows
    matrix = np.array([r["f"].toArray() if hasattr(r["f"], "toArray") else r["f"] for r in points], dtype=float)
    names = sorted({r["l"] for r in points})
    codes = np.array([names.index(r["l"]) for r in points])

    def score(frames):
        counts = np.bincount(codes, minlength=len(names))
        for frame in frames:
            found = []
            for at in frame["at"]:
                distance = np.sqrt(((matrix - matrix[at]) ** 2).sum(axis=1))
                sums = np.bincount(codes, weights=distance, minlength=len(names))
                own = codes[at]
                if counts[own] < 2:
                    found.append(0.0)
                    continue
                inside = sums[own] / (counts[own] - 1)
                others = [sums[k] / counts[k] for k in range(len(names)) if k != own and counts[k]]
                outside = min(others) if others else inside
                found.append((outside - inside) / max(inside, outside) if max(inside, outside) else 0.0)
            yield pd.DataFrame({"s": found})

    at = df.sparkSession.range(len(points)).select(F.col("id").alias("at"))
    return at.mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"))
