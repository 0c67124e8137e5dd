"""Planted signals, round trips, and row-wise operators on streams."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridsmith.ml.metrics import classification_metrics, clustering_metrics, roc_auc, sampled_silhouette, silhouettes
from gridsmith.ml.models import (
    feature_importance, feature_names, load_model, permutation_importance, permuted_rows, predict, predict_proba, save_model,
    score_with_rules, suggest_targets, train_classification, train_clustering, train_regression,
)
from gridsmith.operators.chartdata import importance_bars
from gridsmith.operators.encoding import apply_encoding, fit_frequency, fit_ordinal
from gridsmith.operators.features import Arithmetic, add_arithmetic
from gridsmith.operators.filters import Condition, apply_filters
from gridsmith.operators.labels import clean_labels
from gridsmith.operators.rules import Rule, apply_rules
from gridsmith.operators.types import cast_types
from gridsmith.plans.load import auto_type
from gridsmith.streaming.incremental import load_new_files


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(4)
    rows = []
    for k in range(600):
        x, noise, c = draw.uniform(-2, 2), draw.gauss(0, 1), draw.choice(["a", "b", None])
        y = 3.0 * x + (5.0 if c == "b" else 0.0) + 10 + draw.gauss(0, 0.01)
        rows.append((k, None if k % 29 == 0 else x, noise, c, y, "yes" if x + 0.2 * noise > 0 else "no"))
    return spark.createDataFrame(rows, "k long, x double, noise double, c string, y double, label string").repartition(4).cache()


def test_linear_regression_recovers_the_signal(spark, planted):
    model = train_regression(planted.dropna(subset=["x"]), "linear", ["x", "noise"], ["c"], "y", ["k"])
    assert model.key == "reg_linear_y" and model.metrics["r2"] > 0.8
    step = spark.createDataFrame([(0, 0.0, 0.0, "a"), (1, 1.0, 0.0, "a"), (2, 0.0, 0.0, "never seen")], "k long, x double, noise double, c string")
    found = {r["k"]: r["prediction"] for r in predict(model, step).collect()}
    assert found[1] - found[0] == pytest.approx(3.0, abs=0.3)
    assert found[2] is not None


def test_forest_importance_and_permutation_importance(spark, planted):
    model = train_regression(planted, "rf", ["x", "noise"], ["c"], "y", ["k"], trees=20, depth=6)
    assert feature_names(model)[:2] == ["x", "noise"] and "c_b" in feature_names(model)
    ranked = [r["feature"] for r in importance_bars(feature_importance(model, spark)).collect()]
    assert ranked[0] == "x"
    found = {r["feature"]: r["importance"] for r in permutation_importance(model, planted, "k", n_repeats=3).collect()}
    assert found["x"] > found["c"] > 0 and found["x"] > 10 * abs(found["noise"])


@pytest.mark.parametrize("name", ["logistic", "rf"])
def test_classification(spark, planted, name):
    model = train_classification(planted, name, ["x", "noise"], ["c"], "label", ["k"], trees=20, depth=5)
    assert model.key == f"clf_{name}_label" and model.classes == ["no", "yes"]
    assert model.metrics["accuracy"] > 0.9 and model.metrics["roc_auc"] > 0.95
    row = predict_proba(model, planted).first()
    assert row["class_no"] + row["class_yes"] == pytest.approx(1.0)
    assert {r["prediction"] for r in predict(model, planted).select("prediction").distinct().collect()} == {"no", "yes"}


def test_target_must_not_be_a_feature(planted):
    with pytest.raises(ValueError):
        train_regression(planted, "linear", ["x", "y"], [], "y", ["k"])
    with pytest.raises(ValueError):
        train_regression(planted, "ridge", ["x"], [], "y", ["k"])


def test_metrics_by_hand(spark):
    rows = [("a", "a", 0.1), ("a", "b", 0.6), ("b", "b", 0.8), ("b", "b", 0.6), ("c", "a", 0.3)]
    df = spark.createDataFrame(rows, "y string, p string, s double")
    found = classification_metrics(df, "y", "p").first()
    assert found["accuracy"] == pytest.approx(0.6) and found["recall"] == pytest.approx(0.6)
    assert found["precision"] == pytest.approx((2 * 0.5 + 2 * 2 / 3) / 5)
    assert found["f1"] == pytest.approx((2 * 0.5 + 2 * 0.8) / 5)
    assert roc_auc(df.where("y != 'c'"), "y", "s", "b").first()[0] == pytest.approx(3.5 / 4)


def test_kmeans_finds_blobs(spark):
    draw = random.Random(6)
    rows = [(k, draw.gauss(10 * (k % 3), 0.3), draw.gauss(-5 * (k % 3), 0.3)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    model, labelled = train_clustering(df, "kmeans", ["x", "y"], ["k"])
    assert sorted(model.metrics["cluster_sizes"].values()) == [100, 100, 100] and model.metrics["silhouette"] > 0.9
    per_blob = labelled.groupBy((F.col("k") % 3).alias("b")).agg(F.count_distinct("cluster_label").alias("n"))
    assert [r["n"] for r in per_blob.collect()] == [1, 1, 1]
    assert predict(model, df).where("prediction is null").count() == 0
    scaled = model.pipeline.transform(df).withColumn("cluster_label", F.col("__cluster"))
    assert sampled_silhouette(scaled, "__features", "cluster_label", ["k"]).first()[0] > 0.9


def test_silhouette_is_null_for_one_cluster_or_noise(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([0.0]), 0, -1), (Vectors.dense([1.0]), 0, 1)], ["f", "one", "noise"])
    assert clustering_metrics(df, "f", "one").first()["silhouette"] is None
    assert clustering_metrics(df, "f", "noise").first()["silhouette"] is None


def brute_silhouettes(vectors, labels):
    found = []
    for v, own in zip(vectors, labels):
        means = {}
        for other in set(labels):
            members = [w for w, x in zip(vectors, labels) if x == other]
            total = sum(math.dist(v, w) for w in members)
            means[other] = total / (len(members) - (other == own)) if len(members) > (other == own) else None
        inside, outside = means.pop(own), min(means.values())
        found.append(0.0 if inside is None or max(inside, outside) == 0 else (outside - inside) / max(inside, outside))
    return found


@pytest.mark.parametrize("block_bytes", [8 << 20, 1000])
def test_silhouettes_against_brute_force(spark, block_bytes):
    draw = random.Random(11)
    # Tight copies far from the origin, where the product form of a distance has no digits left.
    vectors = [[1e4 * (k % 3) + draw.gauss(0, draw.choice((1e-3, 900))) for _ in range(5)] for k in range(240)]
    vectors += [vectors[0], vectors[0], [7.0] * 5]
    labels = [["a", "b", "c"][draw.choice((k, k, k, draw.randrange(3))) % 3] for k in range(242)] + ["alone"]
    rows = list(zip(range(243), vectors, labels))
    odd = [(900, None, "a"), (901, [1.0, None, 1.0, 1.0, 1.0], "a"), (902, [float("nan")] * 5, "a"), (903, [1.0] * 5, None), (904, [], "b")]
    df = spark.createDataFrame(rows + odd, "k long, f array<double>, l string").repartition(7)
    found = {r.k: r.silhouette for r in silhouettes(df, "f", "l", ["k"], block_bytes).collect()}
    assert len(found) == 248 and all(found[k] is None for k, _, _ in odd)
    assert [found[k] for k in range(243)] == pytest.approx(brute_silhouettes(vectors, labels), abs=1e-9)
    assert found[242] == 0.0


def test_silhouettes_edges(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (2, [1.0], 0)], "k long, f array<double>, l int")
    assert [r.silhouette for r in silhouettes(df, "f", "l", ["k"]).collect()] == [None] * 3
    assert silhouettes(df.limit(0), "f", "l", ["k"]).count() == 0
    same = df.withColumn("f", F.array(F.lit(4.0))).withColumn("l", F.col("k").cast("int"))
    assert [r.silhouette for r in silhouettes(same, "f", "l", []).collect()] == [0.0] * 3
    metrics = clustering_metrics(df.withColumn("l", F.col("k").cast("int")), "f", "l", "euclidean")
    assert {r.cluster: r.n for r in metrics.collect()} == {1: 1, 2: 2} and metrics.first().silhouette == pytest.approx(2 / 3)


def test_permutations_are_random_and_whole(spark):
    n = 2000
    numbered = spark.range(n).withColumnRenamed("id", "__row").withColumn("x", F.col("__row") * 2).repartition(6)
    moved = permuted_rows(numbered, 3).collect()
    partners = [[r["__from"] for r in sorted((m for m in moved if m["__repeat"] == p), key=lambda m: m["__row"])] for p in range(3)]
    for partner in partners:
        assert sorted(partner) == list(range(n))
        # A linear map of the row numbers would have a lag correlation far from 0.
        for lag in (1, 2, 5):
            assert abs(statistics.correlation(partner[:-lag], partner[lag:])) < 0.1
        assert abs(statistics.correlation(partner, range(n))) < 0.1
    assert abs(statistics.correlation(partners[0], partners[1])) < 0.1
    assert all(r["x"] == 2 * r["__row"] for r in moved)


def test_permutation_importance_edges(spark, planted):
    model = train_regression(planted.dropna(subset=["x"]), "linear", ["x", "noise"], ["c"], "y", ["k"])
    empty = permutation_importance(model, planted.limit(0), "k", n_repeats=2).collect()
    assert {(r["feature"], r["importance"]) for r in empty} == {("x", None), ("noise", None), ("c", None)}
    one = permutation_importance(model, planted.limit(1), "k", n_repeats=2)
    assert one.count() == 3 and one.where("importance is not null").count() == 0


def test_dbscan_clusters(spark):
    draw = random.Random(8)
    rows = [(k, draw.gauss(10 * (k % 2), 0.2), draw.gauss(0, 0.2)) for k in range(200)] + [(200, 5.0, 30.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    model, labelled = train_clustering(df, "dbscan", ["x", "y"], ["k"])
    assert model.metrics["cluster_sizes"] == {"0": 100, "1": 100, "-1": 1} and model.metrics["silhouette"] is None
    with pytest.raises(ValueError):
        predict(model, df)


def test_save_and_load(spark, planted, tmp_path):
    model = train_classification(planted, "logistic", ["x"], ["c"], "label", ["k"])
    save_model(model, str(tmp_path), "2024-01-01")
    again = load_model(spark, str(tmp_path), model.key)
    assert again.classes == model.classes and again.metrics == pytest.approx(model.metrics) and again.target == "label"
    a = {r["k"]: r["prediction"] for r in predict(model, planted).collect()}
    assert a == {r["k"]: r["prediction"] for r in predict(again, planted).collect()}


def test_rules_on_predictions(spark, planted):
    model = train_classification(planted, "logistic", ["x"], [], "label", ["k"])
    found = score_with_rules(model, planted, [Rule("prediction", "==", "yes", "alert", True)])
    assert found.where("alert != (prediction = 'yes')").count() == 0


def test_suggested_targets(spark, planted):
    kinds = {"k": "numeric", "x": "numeric", "noise": "numeric", "y": "numeric", "c": "categorical", "label": "categorical"}
    assert [r[0] for r in suggest_targets(planted, "classification", kinds).collect()] == ["c", "label"]
    assert len(suggest_targets(planted, "regression", kinds).collect()) == 4
    assert suggest_targets(planted, "clustering", kinds).count() == 0


def test_auto_type(spark):
    df = spark.createDataFrame([("1", "2020-01-31", "yes", "x"), ("2", "2020-02-01", "no", None)], "n string, d string, b string, c string")
    typed = auto_type(df)
    assert [t for _, t in typed.dtypes] == ["double", "timestamp_ntz", "boolean", "string"]
    assert typed.schema["b"].metadata == {"logical_type": "boolean"}


def test_row_wise_operators_run_on_a_stream(spark, planted, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    text = planted.select("k", F.col("x").cast("string").alias("x"), "noise", F.concat(F.lit(" "), "c").alias("c"))
    model = train_regression(planted, "linear", ["x"], [], "y", ["k"])
    ordinal, share = fit_ordinal(planted, "c", ["a", "b"]), fit_frequency(planted, "c")
    steps = [
        lambda s: cast_types(s, {"x": "numeric"}),
        lambda s: clean_labels(s, ["c"], title=False),
        lambda s: apply_filters(s, [Condition("x", ">", "0")]),
        lambda s: add_arithmetic(s, [Arithmetic("double_x", "x", "x", "add")]),
        lambda s: apply_encoding(s.withColumn("code", F.col("c")), ordinal.withColumn("column", F.lit("code")), "code"),
        lambda s: apply_encoding(s.withColumn("share", F.col("c")), share.withColumn("column", F.lit("share")), "share", 0.0),
        lambda s: predict(model, s),
        lambda s: apply_rules(s, [Rule("prediction", ">", 12.0, "high", True)]),
    ]

    def load():
        load_new_files(spark, source, text.schema, target, str(tmp_path / "checkpoint"), steps).awaitTermination()

    text.where("k < 300").write.mode("append").parquet(source)
    load()
    first = spark.read.parquet(target).count()
    text.where("k >= 300").write.mode("append").parquet(source)
    load()
    load()
    out = spark.read.parquet(target)
    batch = text
    for step in steps:
        batch = step(batch)
    assert 0 < first < out.count() == batch.count()
    a, b = (sorted(tuple(r) for r in d.select("k", "double_x", "prediction", "high", "share").collect()) for d in (out, batch))
    assert a == b


def test_predictions_keep_the_callers_columns(spark, planted):
    names = ("features", "probability", "rawPrediction", "__cluster_note", "class_maybe")
    model = train_classification(planted, "logistic", ["x"], [], "label", ["k"])
    df = planted.withColumns({n: F.lit(f"mine {n}") for n in names}).withColumn("prediction", F.lit("old"))
    for out in (predict(model, df), predict_proba(model, predict(model, df))):
        row = out.first().asDict()
        assert all(row[n] == f"mine {n}" for n in names) and row["prediction"] in model.classes
    assert predict_proba(model, df).first()["prediction"] == "old"


def test_forests_keep_row_nodes_between_passes(planted):
    # Without node ids kept per row, every pass walks each tree from its root (F1: time at 1 GB).
    regression = train_regression(planted, "rf", ["x"], [], "y", ["k"], trees=3, depth=3)
    classification = train_classification(planted, "rf", ["x"], [], "label", ["k"], trees=3, depth=3)
    for model in (regression, classification):
        forest = model.pipeline.stages[-1]
        assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() >= 512
