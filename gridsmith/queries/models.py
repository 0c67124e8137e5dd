"""Splits, models, metrics, explanations and the cleaning pipeline."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.sampling import HASH_BITS
from ..ml.metrics import (
    classification_metrics, cluster_sizes, clustering_metrics, confusion, regression_metrics, roc_auc, silhouettes,
)
from ..ml.models import (
    feature_importance, load_model, permutation_importance, predict, predict_proba, save_model, score_with_rules, suggest_targets,
    train_classification, train_clustering, train_regression,
)
from ..ml.prep import split, with_test_flag
from ..operators.chartdata import importance_bars
from ..operators.features import Arithmetic, GroupAggregate
from ..operators.missing import Fill
from ..operators.rules import Rule
from ..operators.types import logical_types
from ..plans.clean import CleaningPlan, clean
from ..session import shared_path
from .charts import hash_sql
from .cleaning import _TITLE
from .registry import LINEITEM_GAPS, LINEITEM_KEY, lineitem_gaps, query, rounded, table

_CUT = int(0.2 * 2**HASH_BITS)


@query("ml_split_counts", f"""SELECT {hash_sql('o_orderkey')} < {_CUT} AS is_test, count(*) AS n, sum(o_orderkey)::bigint AS key_sum
FROM orders GROUP BY 1""")
def ml_split_counts(spark, folder):
    train, test = split(table(spark, folder, "orders"), ["o_orderkey"])
    rows = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return rows.groupBy("is_test").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("ml_split_stratified", f"""WITH r AS (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey')}) AS place,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, place <= ceil(0.2::double * n) AS is_test FROM r""")
def ml_split_stratified(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return with_test_flag(df, ["o_orderkey"], stratify="o_orderstatus").withColumnRenamed("__is_test", "is_test")


@query("ml_regression_linear", f"""WITH t AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
  FROM part WHERE NOT {hash_sql('p_partkey')} < {_CUT})
SELECT p_partkey, round(a + b * p_size, 4) AS prediction FROM part, t""")
def ml_regression_linear(spark, folder):
    part = table(spark, folder, "part")
    model = train_regression(part, "linear", ["p_size"], [], "p_retailprice", ["p_partkey"])
    return predict(model, part).select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("ml_model_store", f"""WITH t AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
  FROM part WHERE NOT {hash_sql('p_partkey')} < {_CUT})
SELECT p_partkey, 'reg_linear_p_retailprice' AS key, 'p_size' AS inputs, round(a + b * p_size, 4) AS prediction FROM part, t""")
def ml_model_store(spark, folder):
    part = table(spark, folder, "part")
    trained = train_regression(part, "linear", ["p_size"], [], "p_retailprice", ["p_partkey"])
    path = shared_path(spark)
    save_model(trained, path)
    model = load_model(spark, path, trained.key)
    described = [F.lit(model.key).alias("key"), F.lit(",".join(model.input_columns)).alias("inputs")]
    return predict(model, part).select("p_partkey", *described, F.round("prediction", 4).alias("prediction"))


@query("ml_regression_linear_metrics", f"""WITH p AS (SELECT *, {hash_sql('p_partkey')} < {_CUT} AS held FROM part),
t AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM p WHERE NOT held),
s AS (SELECT p_retailprice AS y, a + b * p_size AS f FROM p, t WHERE held)
SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae FROM s""")
def ml_regression_linear_metrics(spark, folder):
    part = table(spark, folder, "part")
    model = train_regression(part, "linear", ["p_size"], [], "p_retailprice", ["p_partkey"])
    scored = predict(model, split(part, ["p_partkey"])[1])
    return rounded(regression_metrics(scored, "p_retailprice", "prediction"), 4, r2=6)


@query("ml_regression_forest")
def ml_regression_forest(spark, folder):
    part = table(spark, folder, "part")
    model = train_regression(part, "rf", ["p_partkey", "p_size"], ["p_brand", "p_type"], "p_retailprice", ["p_partkey"])
    return predict(model, part).select("p_partkey", "prediction")


@query("ml_metrics_regression", """SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae
FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS f FROM lineitem)""")
def ml_metrics_regression(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("guess", 1500 * F.col("l_quantity"))
    return rounded(regression_metrics(df, "l_extendedprice", "guess"), 4, r2=6)


def _labelled(spark, folder):
    """Labels with simple text measures of their documents."""
    docs = table(spark, folder, "documents")
    words = F.size(F.split("text", r"\s+"))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(F.length("text"), F.lit(1))
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    measured = docs.select(
        "doc_id", "lang", "source", "n_chars", words.alias("n_words"), letters.alias("letter_share"), lines.alias("n_lines"),
    )
    return table(spark, folder, "labels").join(measured, "doc_id")


_NUMBERS = ["n_chars", "n_words", "letter_share", "n_lines"]


@query("ml_classification_logistic")
def ml_classification_logistic(spark, folder):
    df = _labelled(spark, folder)
    model = train_classification(df, "logistic", _NUMBERS, ["lang"], "quality", ["doc_id"])
    return predict(model, df).select("doc_id", "quality", "prediction")


@query("ml_classification_probabilities")
def ml_classification_probabilities(spark, folder):
    df = _labelled(spark, folder)
    model = train_classification(df, "logistic", _NUMBERS, ["lang"], "quality", ["doc_id"])
    return predict_proba(model, df).select("doc_id", "class_0", "class_1")


@query("ml_classification_forest")
def ml_classification_forest(spark, folder):
    df = _labelled(spark, folder)
    model = train_classification(df, "rf", _NUMBERS, ["lang", "source"], "quality", ["doc_id"])
    return predict(model, df).select("doc_id", "quality", "prediction")


_STATUS = """SELECT o_orderstatus AS actual, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'X' END AS predicted FROM orders"""


def _status(spark, folder):
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "F").when(price > 150000, "O").otherwise("X")
    return table(spark, folder, "orders").select(F.col("o_orderstatus").alias("actual"), guess.alias("predicted"))


@query("ml_metrics_classification", f"""WITH c AS (SELECT actual, predicted, count(*) AS n FROM ({_STATUS}) GROUP BY 1, 2),
l AS (SELECT v, sum(support) AS support, sum(claimed) AS claimed, sum(hit) AS hit FROM (
  SELECT actual AS v, n AS support, 0 AS claimed, CASE WHEN actual = predicted THEN n ELSE 0 END AS hit FROM c
  UNION ALL SELECT predicted, 0, n, 0 FROM c) GROUP BY 1)
SELECT round(sum(hit) / sum(support)::double, 6) AS accuracy,
  round(sum(support * CASE WHEN claimed + support = 0 THEN 0 ELSE 2 * hit / (claimed + support)::double END) / sum(support)::double, 6) AS f1,
  round(sum(support * CASE WHEN claimed = 0 THEN 0 ELSE hit / claimed::double END) / sum(support)::double, 6) AS precision,
  round(sum(support * CASE WHEN support = 0 THEN 0 ELSE hit / support::double END) / sum(support)::double, 6) AS recall,
  NULL::double AS roc_auc FROM l""")
def ml_metrics_classification(spark, folder):
    return rounded(classification_metrics(_status(spark, folder), "actual", "predicted"))


@query("ml_metrics_confusion", f"SELECT actual, predicted, count(*) AS n FROM ({_STATUS}) GROUP BY 1, 2")
def ml_metrics_confusion(spark, folder):
    return confusion(_status(spark, folder), "actual", "predicted")


@query("ml_metrics_roc_auc", """WITH s AS (SELECT l_returnflag = 'R' AS pos, l_quantity AS score FROM lineitem),
r AS (SELECT pos, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::double AS r FROM s)
SELECT round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::double * count(*) FILTER (NOT pos)), 6) AS roc_auc FROM r""")
def ml_metrics_roc_auc(spark, folder):
    return rounded(roc_auc(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", "R"))


@query("ml_clustering_kmeans")
def ml_clustering_kmeans(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    _, labelled = train_clustering(df, "kmeans", ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return labelled.select("c_custkey", "cluster_label")


_DBSCAN = """z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x,
  (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y FROM part),
n AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM z a JOIN z b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0025),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4)"""


@query("ml_clustering_dbscan_noise", f"""WITH {_DBSCAN}
SELECT p_partkey, p_partkey NOT IN (SELECT n.b FROM n JOIN core ON core.a = n.a) AS is_noise FROM z""")
def ml_clustering_dbscan_noise(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    _, labelled = train_clustering(df, "dbscan", ["p_size", "p_retailprice"], ["p_partkey"], eps=0.05, min_samples=4)
    return labelled.select("p_partkey", (F.col("cluster_label") == -1).alias("is_noise"))


@query("ml_clustering_dbscan")
def ml_clustering_dbscan(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    _, labelled = train_clustering(df, "dbscan", ["p_size", "p_retailprice"], ["p_partkey"], eps=0.05, min_samples=4)
    return labelled.select("p_partkey", "cluster_label")


@query("ml_metrics_cluster_sizes", """SELECT label, count(*) AS n FROM embeddings GROUP BY 1""")
def ml_metrics_cluster_sizes(spark, folder):
    return cluster_sizes(table(spark, folder, "embeddings"), "label")


@query("ml_metrics_silhouette")
def ml_metrics_silhouette(spark, folder):
    df = table(spark, folder, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return clustering_metrics(df, "features", "label")


@query("ml_metrics_silhouette_euclidean", """WITH v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
n AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS total FROM v a, v b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, d.label, max(CASE WHEN other = d.label THEN total / nullif(n - 1, 0) END) AS a,
  min(CASE WHEN other <> d.label THEN total / n END) AS b FROM d JOIN n ON n.label = other GROUP BY 1, 2)
SELECT vec_id, label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m""")
def ml_metrics_silhouette_euclidean(spark, folder):
    return rounded(silhouettes(table(spark, folder, "embeddings"), "embedding", "label", ["vec_id"]))


@query("ml_feature_importance")
def ml_feature_importance(spark, folder):
    df = _labelled(spark, folder)
    model = train_classification(df, "rf", _NUMBERS, ["lang"], "quality", ["doc_id"])
    return importance_bars(feature_importance(model, spark))


@query("ml_permutation_importance")
def ml_permutation_importance(spark, folder):
    part = table(spark, folder, "part")
    model = train_regression(part, "linear", ["p_partkey", "p_size"], [], "p_retailprice", ["p_partkey"])
    return rounded(permutation_importance(model, part, "p_partkey"))


@query("ml_score_with_rules", f"""WITH t AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
  FROM part WHERE NOT {hash_sql('p_partkey')} < {_CUT}),
s AS (SELECT p_partkey, p_size, round(a + b * p_size, 4) AS prediction, a + b * p_size AS raw FROM part, t)
SELECT p_partkey, prediction, CASE WHEN p_size = 50 THEN 'check' WHEN raw >= 1395 THEN 'dear' END AS band FROM s""")
def ml_score_with_rules(spark, folder):
    part = table(spark, folder, "part")
    model = train_regression(part, "linear", ["p_size"], [], "p_retailprice", ["p_partkey"])
    rules = [Rule("prediction", ">=", 1395.0, "band", "dear"), Rule("p_size", "==", 50, "band", "check")]
    return score_with_rules(model, part, rules).select("p_partkey", F.round("prediction", 4).alias("prediction"), "band")


@query("ml_target_suggestions", """SELECT 'p_name' AS "column" UNION ALL SELECT 'p_brand' UNION ALL SELECT 'p_type'
UNION ALL SELECT c FROM (SELECT 'p_partkey' AS c, count(DISTINCT p_partkey) AS d FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
  UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part) WHERE d <= 50""")
def ml_target_suggestions(spark, folder):
    part = table(spark, folder, "part")
    return suggest_targets(part, "classification", logical_types(part), max_classes=50)


_CLEAN = f"""WITH {LINEITEM_GAPS},
kept AS (SELECT * FROM lineitem_gaps WHERE l_discount IS NOT NULL),
flag AS (SELECT l_returnflag AS v FROM kept WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_returnflag LIMIT 1),
filled AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_gaps)) AS l_quantity,
  coalesce(l_returnflag, (SELECT v FROM flag)) AS l_returnflag) FROM kept),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM filled)),
c AS (SELECT {', '.join(LINEITEM_KEY)}, l_quantity, least(greatest(l_extendedprice, lo), hi) AS l_extendedprice, l_discount,
  CASE {_TITLE.format(c='l_returnflag')} WHEN 'R' THEN 'Returned' ELSE {_TITLE.format(c='l_returnflag')} END AS l_returnflag FROM filled, b)"""


def _cleaned(spark, folder):
    columns = [*LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    plan = CleaningPlan(
        fills={"l_discount": Fill("drop"), "l_quantity": Fill("median"), "l_returnflag": Fill("mode")}, clip=True,
        mappings={"l_returnflag": {"r": "Returned"}},
        arithmetic=[Arithmetic("amount", "l_extendedprice", "l_quantity", "mul")],
        group_aggregates=[GroupAggregate("mean_amount", "l_returnflag", "amount", "mean")],
    )
    kinds = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_returnflag": "categorical"}
    return clean(lineitem_gaps(spark, folder).select(*columns), plan, kinds)


@query("cleaning_pipeline", f"""{_CLEAN}
SELECT *, l_extendedprice * l_quantity AS amount, round(avg(l_extendedprice * l_quantity) OVER (PARTITION BY l_returnflag), 4) AS mean_amount FROM c""")
def cleaning_pipeline(spark, folder):
    df, _ = _cleaned(spark, folder)
    return df.withColumn("mean_amount", F.round("mean_amount", 4))


@query("cleaning_pipeline_report", f"""{_CLEAN},
v AS (SELECT 'l_quantity' AS c, l_quantity AS x FROM c UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM c UNION ALL SELECT 'l_discount', l_discount FROM c),
q AS (SELECT c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1),
w AS (SELECT v.c, count(*) AS n FROM v JOIN q ON v.c = q.c WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) GROUP BY 1),
t AS (SELECT l_returnflag AS f, count(*) AS n FROM c GROUP BY 1)
SELECT 'step' AS section, s.name AS item, NULL::varchar AS detail, s.i::double AS value FROM (VALUES ('missing_values', 1), ('numeric_cleaning', 2), ('categorical_cleaning', 3), ('feature_engineering', 4), ('validation', 5)) s(name, i)
UNION ALL SELECT 'shape', 'columns_before', NULL, 8 UNION ALL SELECT 'shape', 'columns_after', NULL, 10
UNION ALL SELECT 'shape', 'rows_before', NULL, count(*) FROM lineitem UNION ALL SELECT 'shape', 'rows_after', NULL, count(*) FROM c
UNION ALL SELECT 'warning_outliers', c, NULL, n FROM w
UNION ALL SELECT 'warning_imbalance', 'l_returnflag', f, n / (SELECT count(*) FROM c) FROM t WHERE n / (SELECT count(*) FROM c) >= 0.9""")
def cleaning_pipeline_report(spark, folder):
    return _cleaned(spark, folder)[1]
