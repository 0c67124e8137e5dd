"""Training, applying, explaining and storing models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import ref
from ..functions.ordered import running_totals
from ..operators.rules import Rule, apply_rules
from ..operators.summary import cardinality
from ..session import cut_lineage
from .dbscan import dbscan
from .metrics import classification_metrics, clustering_metrics, regression_metrics
from .prep import SEED, TEST_SIZE, make_preprocessor, with_test_flag

# Model settings.
TREES = 200
LOGISTIC_ITERATIONS = 1000
CLUSTERS = 3
DBSCAN_EPS = 0.5
DBSCAN_MIN_SAMPLES = 5
PERMUTATION_REPEATS = 10
# Trees here need a depth limit; MLlib allows up to 30.
TREE_DEPTH = 10
# How forests are grown, not what they are: each row keeps the node it has reached, so that a
# pass over the rows does not walk every tree from its root again, and a pass splits as many
# nodes as fit in this many MB of split statistics per task (MLlib's default is 256).
FOREST_RUN = {"cacheNodeIds": True, "maxMemoryInMB": 512}


# Columns of the pipelines' own: they never meet a column of the caller's.
FEATURES, PREDICTION, RAW, PROBABILITY = "__features", "__prediction", "__raw_prediction", "__probability"


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to apply it."""

    key: str
    kind: str
    name: str
    numeric: list[str]
    categorical: list[str]
    target: str | None
    pipeline: PipelineModel
    classes: list[str] = field(default_factory=list)
    metrics: dict[str, Any] = field(default_factory=dict)

    @property
    def input_columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def train_regression(
    df: DataFrame, model: str, numeric: list[str], categorical: list[str], target: str, keys: list[str],
    test: float = TEST_SIZE, seed: int = SEED, trees: int = TREES, depth: int = TREE_DEPTH,
) -> TrainedModel:
    """``linear`` (least squares) or ``rf``; scored on the rows held back."""
    if model == "linear":
        estimator = LinearRegression(featuresCol=FEATURES, predictionCol=PREDICTION, labelCol="__target", regParam=0.0)
    elif model == "rf":
        estimator = RandomForestRegressor(
            featuresCol=FEATURES, predictionCol=PREDICTION, labelCol="__target", numTrees=trees, maxDepth=depth, seed=seed,
            **FOREST_RUN,
        )
    else:
        raise ValueError(f"unknown regression model {model!r}")
    data = _training_columns(df, numeric, categorical, target, keys)
    data = data.withColumn("__target", ref(target).cast("double")).where("__target is not null")
    # Fitting and scoring pass over the rows many times.
    marked = with_test_flag(data, keys, test, seed).persist()
    try:
        train, held = marked.where(~F.col("__is_test")), marked.where("__is_test")
        pipeline = Pipeline(stages=[*make_preprocessor(train, numeric, categorical, FEATURES), estimator]).fit(train)
        trained = TrainedModel(f"reg_{model}_{target}", "regression", model, numeric, categorical, target, pipeline)
        trained.metrics = regression_metrics(predict(trained, held), target, "prediction").first().asDict()
    finally:
        marked.unpersist()
    return trained


def train_classification(
    df: DataFrame, model: str, numeric: list[str], categorical: list[str], target: str, keys: list[str],
    test: float = TEST_SIZE, seed: int = SEED, stratify: bool = True, trees: int = TREES, depth: int = TREE_DEPTH,
) -> TrainedModel:
    """``logistic`` (L2 with unit strength) or ``rf``; scored on the rows held back."""
    if model not in ("logistic", "rf"):
        raise ValueError(f"unknown classification model {model!r}")
    data = _training_columns(df, numeric, categorical, target, keys).where(ref(target).isNotNull())
    own = {"featuresCol": FEATURES, "predictionCol": PREDICTION, "rawPredictionCol": RAW, "probabilityCol": PROBABILITY}
    found = data.groupBy(ref(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    labels = found.collect()  # the classes to tell apart
    classes = sorted((r["label"] for r in labels), key=_label_order)
    codes = F.array_position(F.array(*map(F.lit, classes)), ref(target).cast("string")) - 1
    data = data.withColumn("__target", codes.cast("double"))
    marked = with_test_flag(data, keys, test, seed, target if stratify else None).persist()
    try:
        train, held = marked.where(~F.col("__is_test")), marked.where("__is_test")
        if model == "logistic":
            # The penalty is given per row here, hence one over the number of rows.
            estimator = LogisticRegression(
                **own, labelCol="__target", maxIter=LOGISTIC_ITERATIONS,
                regParam=1.0 / max(1, train.count()), elasticNetParam=0.0, standardization=False,
            )
        else:
            estimator = RandomForestClassifier(
                **own, labelCol="__target", numTrees=trees, maxDepth=depth, seed=seed, **FOREST_RUN
            )
        pipeline = Pipeline(stages=[*make_preprocessor(train, numeric, categorical, FEATURES), estimator]).fit(train)
        trained = TrainedModel(
            f"clf_{model}_{target}", "classification", model, numeric, categorical, target, pipeline, classes
        )
        two = len(classes) == 2
        score, positive = (f"class_{classes[1]}", classes[1]) if two else (None, None)
        scored = predict_proba(trained, predict(trained, held))
        scored = scored.select(*[ref(c) for c in (target, "prediction", score) if c]).persist()
        trained.metrics = classification_metrics(scored, target, "prediction", score, positive).first().asDict()
        scored.unpersist()
    finally:
        marked.unpersist()
    return trained


def train_clustering(
    df: DataFrame, model: str, numeric: list[str], keys: list[str], k: int = CLUSTERS, seed: int = SEED,
    eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES,
) -> tuple[TrainedModel, DataFrame]:
    """``kmeans`` or ``dbscan`` on standardised numbers: the model and the rows with ``cluster_label``."""
    if model not in ("kmeans", "dbscan"):
        raise ValueError(f"unknown clustering model {model!r}")
    stages = make_preprocessor(df, numeric, output=FEATURES)
    if model == "kmeans":
        stages.append(KMeans(featuresCol=FEATURES, predictionCol="__cluster", k=k, seed=seed))
    pipeline = Pipeline(stages=stages).fit(df)
    trained = TrainedModel(f"clu_{model}", "clustering", model, numeric, [], None, pipeline)
    scaled = pipeline.transform(df)
    if model == "kmeans":
        labelled = scaled.withColumn("cluster_label", F.col("__cluster").cast("int"))
    else:
        points = scaled.select(*map(ref, keys), vector_to_array(FEATURES).alias("__point"))
        # The scaler divides by the sample deviation; eps is meant for the population one.
        rows = df.count()
        labels = dbscan(points, keys, "__point", eps * ((rows - 1) / rows) ** 0.5 if rows > 1 else eps, min_samples)
        # One row per point: joined by a shuffle, not sent through the driver.
        labelled = scaled.join(labels.hint("merge"), keys, "left")
    summary = clustering_metrics(labelled, FEATURES, "cluster_label").collect()  # one row per cluster
    trained.metrics = {
        "silhouette": summary[0]["silhouette"] if summary else None,
        "cluster_sizes": {str(r["cluster"]): r["n"] for r in summary},
    }
    return trained, labelled.select(*map(ref, df.columns), "cluster_label")


def _training_columns(df, numeric, categorical, target, keys) -> DataFrame:
    features = [c for c in [*numeric, *categorical] if c != target]
    if len(features) != len(numeric) + len(categorical):
        raise ValueError(f"the target {target} is among the features")
    return df.select(*[ref(c) for c in dict.fromkeys([*keys, *features, target])])


def _label_order(label: str):
    try:
        return (0, float(label), label)
    except ValueError:
        return (1, 0.0, label)


def predict(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (a number, or the label in its text form). Works on streams.

    Every other column of ``df`` stays; an earlier ``prediction`` is replaced.
    """
    out = model.pipeline.transform(df)
    kept = [ref(c) for c in df.columns if c != "prediction"]
    if model.kind == "clustering":
        if model.name != "kmeans":
            raise ValueError("dbscan labels only the rows it was run on")
        return out.select(*kept, F.col("__cluster").cast("int").alias("prediction"))
    value = F.col(PREDICTION)
    if model.kind == "classification":
        value = F.get(F.array(*map(F.lit, model.classes)), value.cast("int"))
    return out.select(*kept, value.alias("prediction"))


def predict_proba(model: TrainedModel, df: DataFrame) -> DataFrame | None:
    """Add ``class_{label}`` columns; None when the model gives no probabilities.

    Every other column of ``df`` stays; earlier columns of these names are replaced.
    """
    if model.kind != "classification":
        return None
    added = [f"class_{c}" for c in model.classes]
    shares = vector_to_array(PROBABILITY)
    kept = [ref(c) for c in df.columns if c not in added]
    return model.pipeline.transform(df).select(*kept, *[shares[i].alias(name) for i, name in enumerate(added)])


def score_with_rules(model: TrainedModel, df: DataFrame, rules: list[Rule]) -> DataFrame:
    return apply_rules(predict(model, df), rules)


def feature_names(model: TrainedModel) -> list[str]:
    """Names of the assembled features: numbers, then ``column_label`` per label."""
    names = list(model.numeric)
    for stage in model.pipeline.stages:
        if stage.__class__.__name__ == "StringIndexerModel":
            for column, labels in zip(model.categorical, stage.labelsArray):
                names += [f"{column}_{label}" for label in labels]
    return names


def feature_importance(model: TrainedModel, spark: SparkSession) -> DataFrame:
    """(feature, importance) of a forest."""
    if model.name != "rf":
        raise ValueError("only forests have feature importances")
    values = model.pipeline.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(feature_names(model), values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(
    model: TrainedModel, df: DataFrame, key: str, n_repeats: int = PERMUTATION_REPEATS, seed: int = SEED
) -> DataFrame:
    """(feature, importance): mean loss of R² or accuracy when a column is shuffled.

    A repeat gives every row the values of a row drawn without replacement; only the column in
    question takes them. All columns and repeats go through the model together and are scored by
    one grouped aggregate. ``key`` tells rows apart. Importances are null without rows or spread.
    """
    if model.kind == "clustering":
        raise ValueError("clusterings have no score to lose")
    target, columns = model.target, model.input_columns
    data = df.where(ref(target).isNotNull()).select(*[ref(c) for c in dict.fromkeys([key, *columns, target])])
    numbered = cut_lineage(running_totals(data, key, {"__row": F.lit(1)}))
    base = _score(model, numbered, []).first()["score"]
    values = numbered.select(F.col("__row").alias("__from"), *[ref(c).alias(f"__other_{i}") for i, c in enumerate(columns)])
    moved = permuted_rows(numbered, n_repeats, seed).join(values, "__from")
    tries = [
        F.struct(F.lit(i).alias("__feature"), *[(F.col(f"__other_{j}") if i == j else ref(c)).alias(c) for j, c in enumerate(columns)])
        for i in range(len(columns))
    ]
    moved = moved.select("__repeat", ref(target), F.inline(F.array(*tries)))
    scores = _score(model, moved, ["__feature", "__repeat"]).groupBy("__feature").agg(F.avg("score").alias("__score"))
    features = df.sparkSession.createDataFrame(list(enumerate(columns)), "__feature int, feature string")
    lost = F.lit(base).cast("double") - F.col("__score")
    return features.join(scores, "__feature", "left").select("feature", lost.alias("importance"))


def permuted_rows(numbered: DataFrame, n_repeats: int, seed: int = SEED) -> DataFrame:
    """``n_repeats`` copies of the rows with ``__repeat`` and, as ``__from``, the number of another row.

    ``numbered`` counts its rows from 0 in ``__row``. The partner is the row's rank in the order of
    a 64-bit hash of its number, which differs for every row and repeat: a random permutation per
    repeat, the same on every run and found by one distributed ranking for all repeats.
    """
    rows = numbered.agg(F.max("__row")).first()[0]
    rows = 0 if rows is None else int(rows) + 1
    copies = numbered.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    number = F.lit(seed).cast("long") * F.lit(1_000_003) + F.col("__repeat") * F.lit(rows).cast("long") + F.col("__row")
    # One order for all repeats: repeat by repeat, hashes as unsigned numbers within.
    wide = "decimal(38,0)"
    place = F.col("__repeat").cast("decimal(18,0)") * F.lit(Decimal(2**64)) + F.xxhash64(number).cast("decimal(20,0)")
    ranked = running_totals(copies.withColumn("__place", place.cast(wide)), "__place", {"__from": F.lit(1)})
    return ranked.withColumn("__from", F.col("__from") - F.col("__repeat") * F.lit(rows).cast("long")).drop("__place")


def _score(model: TrainedModel, df: DataFrame, by: list[str]) -> DataFrame:
    """(by…, score): R² for regression, accuracy for classification."""
    scored = predict(model, df)
    y = ref(model.target)
    if model.kind == "classification":
        score = F.avg((y.cast("string") == F.col("prediction")).cast("double"))
    else:
        error = y.cast("double") - F.col("prediction")
        score = 1 - F.try_divide(F.sum(error * error), F.var_pop(y.cast("double")) * F.count(y))
    return scored.groupBy(*by).agg(score.alias("score"))


_META = T.StructType([T.StructField("key", T.StringType()), T.StructField("model", T.StringType())])


def save_model(model: TrainedModel, path: str, created_at: str | None = None, version: str = "1.0") -> None:
    """Write the pipeline and its description below ``path/key``, on any file system Spark knows."""
    folder = f"{path.rstrip('/')}/{model.key}"
    model.pipeline.write().overwrite().save(f"{folder}/pipeline")
    described = {
        "key": model.key, "kind": model.kind, "model_name": model.name, "version": version,
        "created_at": created_at, "input_columns": model.input_columns, "numeric": model.numeric,
        "categorical": model.categorical, "target_columns": [model.target] if model.target else [],
        "classes": model.classes, "extra": {"metrics": model.metrics},
    }
    spark = SparkSession.active()
    row = spark.createDataFrame([(model.key, json.dumps(described))], _META)
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def load_model(spark: SparkSession, path: str, key: str) -> TrainedModel:
    folder = f"{path.rstrip('/')}/{key}"
    found = json.loads(spark.read.schema(_META).json(f"{folder}/metadata").first()["model"])
    targets = found["target_columns"]
    return TrainedModel(
        found["key"], found["kind"], found["model_name"], found["numeric"], found["categorical"],
        targets[0] if targets else None, PipelineModel.load(f"{folder}/pipeline"), found["classes"],
        found["extra"]["metrics"],
    )


def suggest_targets(df: DataFrame, task: str, types: dict[str, str], max_classes: int = 20) -> DataFrame:
    """(column) that can be a target: numbers for regression, labels or numbers with few
    distinct values for classification, none for clustering."""
    numeric = [c for c in df.columns if types.get(c) == "numeric"]
    spark = df.sparkSession
    if task == "clustering":
        return spark.createDataFrame([], "column string")
    if task == "regression":
        return spark.createDataFrame([(c,) for c in numeric], "column string")
    if task != "classification":
        raise ValueError(f"unknown task {task!r}")
    labels = spark.createDataFrame([(c,) for c in df.columns if types.get(c) == "categorical"], "column string")
    if not numeric:
        return labels
    few = cardinality(df, numeric).where(F.col("n_distinct") <= max_classes).select("column")
    return labels.unionByName(few)
