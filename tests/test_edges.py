"""Literal edge cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridsmith.functions.columns import text_to_boolean, text_to_datetime, text_to_number, title_case
from gridsmith.functions.distributions import f_tail
from gridsmith.operators.categories import crosstab, imbalance_score
from gridsmith.operators.correlation import corr_matrix
from gridsmith.operators.duplicates import drop_duplicates, partial_duplicates
from gridsmith.operators.encoding import encode_frequency, encode_one_hot, encode_ordinal
from gridsmith.operators.features import Arithmetic, GroupAggregate, add_arithmetic, add_group_aggregates
from gridsmith.operators.filters import Condition, apply_filters
from gridsmith.operators.joins import join_tables
from gridsmith.operators.labels import clean_labels, map_labels
from gridsmith.operators.missing import Fill, fill_missing
from gridsmith.operators.outliers import clip_outliers, detect_outliers, mark_outliers
from gridsmith.operators.relations import anova, scan_relationships
from gridsmith.operators.rules import Rule, apply_rules
from gridsmith.operators.summary import (
    cardinality, extended_numeric_summary, grouped_summary, histogram, profile_report,
)
from gridsmith.operators.types import cast_types, infer_schema, logical_types
from gridsmith.operators.validation import missing_extremes_warnings


def column(spark, values, kind="double", name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_numbers_in_text(spark):
    texts = ["1e5", " 12 ", "inf", "NaN", "0x1F", "1_000", "1,000", "True", "-.5", "5.", "1d", "2f", "+3", "Infinity", ""]
    found = [r[0] for r in column(spark, texts, "string").select(text_to_number(F.col("v"))).collect()]
    assert found == [1e5, 12.0, math.inf, None, None, None, None, None, -0.5, 5.0, None, None, 3.0, math.inf, None]


def test_datetime_uses_one_layout(spark):
    df = column(spark, ["2020-01-01", "01/02/2020", "2020-03-01"], "string")
    found = [r[0] for r in df.select(text_to_datetime(F.col("v"), "yyyy-MM-dd")).collect()]
    assert found == [dt.datetime(2020, 1, 1), None, dt.datetime(2020, 3, 1)]


def test_boolean_words(spark):
    df = column(spark, [" Yes", "N", "t", "0", "maybe", None], "string")
    assert [r[0] for r in df.select(text_to_boolean(F.col("v"))).collect()] == [True, False, True, False, None, None]


@pytest.mark.parametrize("text", ["o'neil mcDONALD x2y a-b éa", "straße élan", "ABC", "", "1st of may"])
def test_title_case_like_python(spark, text):
    found = column(spark, [text], "string").select(title_case(F.col("v"))).first()[0]
    assert found == text.title()


def test_inference(spark):
    df = spark.createDataFrame(
        [("1", "2020-01-01", "yes", "x", None, "1"), ("2", "2020-01-02", "no", "y", None, "0"), (None, "bad", None, "z", None, "1")]
        + [("3", "2020-02-01", "yes", "w", None, "0")] * 2,
        "n string, d string, b string, c string, e string, f string",
    )
    kinds = logical_types(df)
    assert kinds == {"n": "numeric", "d": "datetime", "b": "boolean", "c": "categorical", "e": "categorical", "f": "numeric"}
    assert logical_types(df, {"n": "categorical"})["n"] == "categorical"
    found = {r["column"]: r for r in infer_schema(df).collect()}
    assert found["d"]["datetime_format"] == "yyyy-MM-dd" and found["d"]["datetime_frac"] == 0.8


def test_cast_error_policies(spark):
    df = column(spark, ["1", "x"], "string")
    assert [r[0] for r in cast_types(df, {"v": "numeric"}).collect()] == [1.0, None]
    assert cast_types(df, {"v": "numeric"}, errors="ignore").schema["v"].dataType.simpleString() == "string"
    with pytest.raises(Exception, match="cannot read x"):
        cast_types(df, {"v": "numeric"}, errors="raise").collect()
    leveled = cast_types(df, {"v": "ordinal"}, levels={"v": ["x", "1"]})
    assert leveled.schema["v"].metadata["levels"] == ["x", "1"]


@pytest.mark.parametrize("kind,values,best", [("int", [3, 1, 3, 1, 2], 1), ("string", ["b", "a", "b", "a"], "a")])
def test_mode_takes_the_smallest(spark, kind, values, best):
    df = column(spark, [*values, None], kind)
    assert best == fill_missing(df, {"v": Fill("mode")}).collect()[-1][0]


def test_summary_values(spark):
    row = extended_numeric_summary(column(spark, [1, 2, 3, 4, 10, None], "int")).first()
    assert (row["count"], row["q25"], row["q50"], row["q75"]) == (5, 2.0, 3.0, 4.0)
    assert row["std"] == pytest.approx(3.5355339059)
    assert row["skew"] == pytest.approx(1.6970562748) and row["kurt"] == pytest.approx(3.152)


def test_summary_without_spread_or_rows(spark):
    row = extended_numeric_summary(column(spark, [5, 5, 5, 5], "int")).first()
    assert row["skew"] == 0.0 and row["kurt"] == 0.0
    row = extended_numeric_summary(column(spark, [5, 6], "int")).first()
    assert row["skew"] is None and row["kurt"] is None
    row = extended_numeric_summary(column(spark, [None], "double")).first()
    assert row["count"] == 0 and row["q50"] is None


def test_histogram_edges(spark):
    found = histogram(column(spark, [1, 2, 3, 4, 10], "int"), "v", 4).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["count"]) for r in found] == [(1, 3.25, 3), (3.25, 5.5, 1), (5.5, 7.75, 0), (7.75, 10, 1)]
    found = histogram(column(spark, [5, 5], "int"), "v", 2).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["count"]) for r in found] == [(4.5, 5, 0), (5, 5.5, 2)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_null_keys_meet(spark, rows, how):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    joined = join_tables(left, right, "k", how)
    assert joined.columns == ["k", "v_left", "v_right"]
    assert rows(joined) == [(1, "a", "y"), (None, "b", "x")]


def test_outer_join_keeps_both_sides(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, r string")
    found = rows(join_tables(left, right, "k", "OUTER"))
    assert found == [(1, "a", None), (2, "b", "x"), (2, "b", "y"), (2, "c", "x"), (2, "c", "y"), (3, None, "z")]
    assert join_tables(left, right, "k", "sideways").count() == 4
    assert join_tables(left, right, how="cross").count() == 9


def test_not_equal_and_not_in_keep_nulls(spark):
    df = column(spark, [1, None, 2], "int")
    assert [r[0] for r in apply_filters(df, [Condition("v", "!=", "1")]).collect()] == [None, 2]
    assert [r[0] for r in apply_filters(df, [Condition("v", "not in", "1")]).collect()] == [None, 2]


def test_contains_is_a_pattern(spark):
    df = column(spark, ["15", "5.0", "5x0", None], "string")
    assert [r[0] for r in apply_filters(df, [Condition("v", "contains", "5.0")]).collect()] == ["5.0", "5x0"]


def test_filter_errors(spark):
    df = column(spark, [1, 2], "int")
    with pytest.raises(ValueError):
        apply_filters(df, [Condition("v", "between", "1,2,3")])
    with pytest.raises(ValueError):
        apply_filters(df, [Condition("v", ">", "many")])
    assert apply_filters(df, [Condition("v", ">", "1.5")]).count() == 1
    assert apply_filters(df, [Condition("w", ">", "1"), Condition("v", "like", "1")]).count() == 2


def test_crosstab_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), ("b", None)], "a string, b string")
    assert [tuple(r) for r in crosstab(df, "a", "b").collect()] == [("a", 1, 1)]
    assert [tuple(r) for r in crosstab(df, "a", "b", "all").collect()] == [("a", 0.5, 0.5)]


def test_correlations_skip_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 1.0)], "a double, b double")
    for method, expected in (("pearson", 0.99339927), ("spearman", 1.0), ("kendall", 1.0)):
        found = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(df, method=method).collect()}
        assert found["a", "b"] == pytest.approx(expected) == found["b", "a"]
        assert found["a", "a"] == 1.0


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_constant_column_has_no_correlation(spark, method):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 7.0)], "a double, b double")
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(df, method=method).collect()}
    assert found["a", "b"] is None and found["a", "a"] is None and found["b", "b"] == 1.0


def test_fill_by_group(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", None, 2), ("y", None, 3), (None, 5.0, 4)], "g string, v double, k int")
    filled = fill_missing(df, {"v": Fill("by_group", group_by="g")}, default=None).orderBy("k")
    assert [r["v"] for r in filled.collect()] == [1.0, 1.0, None, 5.0]


def test_whole_numbers_filled_with_a_mean(spark):
    df = column(spark, [1, 2, None], "int")
    assert [r[0] for r in fill_missing(df, {"v": Fill("mean")}).collect()] == [1.0, 2.0, 1.5]
    assert fill_missing(column(spark, [1, 2], "int")).schema["v"].dataType.simpleString() == "int"


def test_fill_errors(spark):
    df = column(spark, [1, None], "int")
    with pytest.raises(ValueError, match="order_by"):
        fill_missing(df, {"v": Fill("ffill")})
    with pytest.raises(ValueError, match="needs a value"):
        fill_missing(df, {"v": Fill("constant")})
    with pytest.raises(ValueError, match="unknown strategy"):
        fill_missing(df, {"v": Fill("guess")})


def test_group_key_is_filled_before_it_groups(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", 3.0, 2), (None, None, 3)], "g string, v double, k int")
    filled = fill_missing(df, {"g": Fill("mode"), "v": Fill("by_group", group_by="g")}, default=None)
    assert filled.where("k = 3").first()["v"] == 2.0


def test_arithmetic(spark):
    df = spark.createDataFrame([(1, 0), (2, 2)], "a int, b int")
    found = add_arithmetic(df, [Arithmetic("r", "a", "b", "div"), Arithmetic("s", "r", "a", "add"), Arithmetic("t", "q", "a", "add")])
    assert [tuple(r) for r in found.select("r", "s").collect()] == [(None, None), (1.0, 3.0)] and "t" not in found.columns


def test_group_aggregates(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0)], "g string, v double")
    features = [GroupAggregate("m", "g", "v", "median"), GroupAggregate("n", "g", "v", "count"), GroupAggregate("s", "g", "v", "std")]
    found = [tuple(r)[2:] for r in add_group_aggregates(df, features).orderBy("v").collect()]
    assert found[2] == (None, None, None)
    assert found[0][:2] == (2, pytest.approx(math.sqrt(2)))
    assert found[0][2] == 2.0


def test_encodings(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "c string, k int")
    hot = [tuple(r) for r in encode_one_hot(df, ["c"], min_freq=2).orderBy("k").select("c_Other", "c_a").collect()]
    assert hot == [(False, True), (False, True), (True, False), (False, False)]
    shares = [r["c"] for r in encode_frequency(df, ["c"]).orderBy("k").collect()]
    assert shares == [pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3), 0.0]
    assert [r["c"] for r in encode_ordinal(df, "c", ["b"]).orderBy("k").collect()] == [None, None, 0.0, None]
    assert [r["c"] for r in encode_ordinal(df, "c").orderBy("k").collect()] == [0.0, 0.0, 1.0, None]
    with pytest.raises(ValueError, match="one_hot_long"):
        encode_one_hot(df, ["c"], max_columns=1)


def test_duplicates_with_nulls(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "v int, k int")
    assert rows(drop_duplicates(df, ["v"], "first", ["k"])) == [(1, 3), (None, 1)]
    assert rows(drop_duplicates(df, ["v"], "last", ["k"])) == [(1, 3), (None, 2)]
    assert rows(drop_duplicates(df, ["v"], False)) == [(1, 3)]
    assert [r["k"] for r in partial_duplicates(df, ["v"]).orderBy("k").collect()] == [1, 2]
    with pytest.raises(ValueError):
        drop_duplicates(df, ["v"], "first")


def test_labels(spark):
    df = column(spark, [" ny ", "N.Y.", "boston", None], "string")
    mapping = {"v": {"NY": "New York", "n.y.": "New York"}}
    assert [r[0] for r in clean_labels(df, mappings=mapping).collect()] == ["New York", "New York", "Boston", None]
    table = spark.createDataFrame([("boston", "Boston MA")], "label string, new_label string")
    assert [r[0] for r in map_labels(df, "v", table).collect()] == [" ny ", "N.Y.", "Boston MA", None]
    large = {f"k{i}": "Many" for i in range(300)} | {"boston": "Boston MA"}
    assert [r[0] for r in clean_labels(df, mappings={"v": large}).collect()][2] == "Boston MA"


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(i % 5), 1.0) for i in range(50)] + [(50, 100.0, 1.0), (51, None, 1.0)], "k int, v double, c double")
    found = detect_outliers(df, ["v", "c"], ["k"]).collect()
    assert [(r["k"], r["column"], r["value"]) for r in found] == [(50, "v", 100.0)]
    assert [r["k"] for r in detect_outliers(df, ["v", "c"], ["k"], "zscore").collect()] == [50]
    marked = mark_outliers(df, ["v", "c"], "zscore")
    assert marked.where("v_is_outlier_zscore").count() == 1 and marked.where("c_is_outlier_zscore").count() == 0
    clipped = clip_outliers(df, ["v"])
    assert clipped.agg(F.max("v")).first()[0] == 6.0 and clipped.where("v is null").count() == 1


def test_missing_extremes_only_for_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in missing_extremes_warnings(df, ["a", "b"]).collect()] == ["a"]


def test_f_distribution():
    assert f_tail(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-5)
    assert f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert f_tail(0.0, 2, 3) == 1.0 and f_tail(math.inf, 2, 3) == 0.0
    # Two degrees of freedom above have a closed form.
    for f, d in ((0.3, 7), (2.5, 40), (900.0, 12)):
        assert f_tail(f, 2, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-10)


def test_anova_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 5.0), ("c", 9.0), (None, 3.0), ("b", None)], "g string, v double"
    )
    row = anova(df, "v", "g").first()
    assert (row["df1"], row["df2"]) == (1.0, 2.0) and row["f"] == pytest.approx(18.0)
    assert row["p_value"] == pytest.approx(0.05132, abs=1e-4) and row["effect_size"] == pytest.approx(0.9)
    assert anova(df.where("g = 'a'"), "v", "g").first()["p_value"] == 1.0


def test_grouped_summary(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 4.0), (None, 9.0)], "g string, v double")
    found = grouped_summary(df, "g", ["v"]).collect()
    assert [r["g"] for r in found] == ["x", "y"] and found[0]["v_std"] is None and found[1]["v_median"] == 3.0


def test_imbalance_of_nothing(spark):
    assert imbalance_score(column(spark, [], "string"), "v").first()[0] == 0.0


def test_rules_in_order(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, None)], "k int, p double")
    rules = [
        Rule("p", ">", 0.5, "alert", True), Rule("p", "!=", 0.2, "level", "other"), Rule("p", "<=", 0.5, "level", "low"),
        Rule("alert", "==", True, "level", "high"), Rule("p", "~", 0.5, "noted", "x"),
    ]
    found = [tuple(r)[2:] for r in apply_rules(df, rules).orderBy("k").collect()]
    assert found == [(True, "high", None), (False, "low", None), (False, "other", None)]
    with pytest.raises(ValueError):
        apply_rules(df, [Rule("p", ">", 0.5, "t", "x"), Rule("p", ">", 0.5, "t", 1.0)])


def test_profile_report_without_numbers(spark):
    assert profile_report(column(spark, ["a"], "string")).count() == 4


@pytest.mark.parametrize("text, expected", [
    ("13/01/2020", dt.datetime(2020, 1, 13)), ("2020-01-01T10:00:00Z", dt.datetime(2020, 1, 1, 10)),
    ("2020-01-01T10:00:00+02:00", dt.datetime(2020, 1, 1, 8)), ("2020-01-01 10:00", dt.datetime(2020, 1, 1, 10)),
    ("1 Jan 2020", dt.datetime(2020, 1, 1)), ("3 March 2020", dt.datetime(2020, 3, 3)), ("Mar 3, 2020", dt.datetime(2020, 3, 3)),
    ("02-Feb-2020", dt.datetime(2020, 2, 2)), ("13/13/2020", None), ("1 Foo 2020", None),
])
def test_datetime_layouts(spark, text, expected):
    assert column(spark, [text], "string").select(text_to_datetime(F.col("v"))).first()[0] == expected


def test_anova_without_spread(spark):
    apart = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    row = scan_relationships(apart, ["v"], ["g"]).first()
    assert row["f"] == math.inf and row["p_value"] == 0 and row["effect_size"] == 1
    flat = scan_relationships(apart.withColumn("v", F.lit(2.0)), ["v"], ["g"]).first()
    assert flat["f"] is None and flat["p_value"] is None


def test_filling_reads_nan_as_missing(spark):
    df = column(spark, [1.0, 2.0, None, float("nan"), 3.0, 4.0], "double")
    for strategy in ("mean", "median"):
        assert [r[0] for r in fill_missing(df, {"v": Fill(strategy)}).collect()] == [1.0, 2.0, 2.5, 2.5, 3.0, 4.0]


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("order", [["t", "k"], ["k"], ["g", "t", "k"], ["x", "k"]])
def test_fills_where_the_order_key_is_missing(spark, ranges, order):
    """Rows without an order key come first, like any other rows of one key."""
    import datetime as dt
    import random

    from gridsmith.functions.ordered import carry_value

    draw = random.Random(ranges)
    day = dt.datetime(2024, 1, 1)
    rows = [
        (draw.choice([None, 3.5, float(k), -1.0]), k, draw.choice(["a", "b\u00e9", "", None]), draw.choice([None, None, f"v{k}"]),
         draw.choice([None, day, day + dt.timedelta(seconds=k, microseconds=k)]))
        for k in range(300)
    ]
    df = spark.createDataFrame(rows, "t double, k long, g string, v string, x timestamp_ntz").repartition(4)
    at = {"t": 0, "k": 1, "g": 2, "x": 4}

    def place(row):
        parts = []
        for c in order:
            value = row[at[c]]
            parts.append((value is not None, value.encode() if isinstance(value, str) else value if value is not None else 0))
        return parts

    for forward in (True, False):
        ordered, near, expected = sorted(rows, key=place, reverse=not forward), None, {}
        for row in ordered:
            near = row[3] if row[3] is not None else near
            expected[row[1]] = near
        found = {r["k"]: r["v"] for r in carry_value(df, "v", order, forward, ranges).collect()}
        assert found == expected


def test_many_ranges_are_a_table_not_a_plan(spark):
    from gridsmith.functions.ordered import carry_value, row_positions

    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 AS double) AS a", "id % 13 AS h", "if(id % 3 = 0, id, null) AS v", "id AS k")
    for out in (carry_value(df, "v", ["a", "k"], ranges=5_000), row_positions(df.select("a"), ["a"], ranges=5_000)):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(text) < 60_000 and out.count() == 20_000


def test_cardinality_of_every_type(spark):
    rows = [
        (1, 0.0, "a", True, [1], "2024-01-01"), (1, -0.0, "", False, [1], "2024-01-01"), (None, float("nan"), None, None, None, None),
        (-(2**63), float("nan"), "a", True, [], "2024-01-02"), (0, 2.0, "A", None, [1, 2], None),
    ]
    df = spark.createDataFrame(rows, "`a.b` long, d double, s string, t boolean, l array<int>, c string")
    df = df.withColumn("day", F.to_date("c")).withColumn("price", F.col("d").cast("decimal(9,2)")).withColumn("none", F.lit(None).cast("int")).drop("c")
    found = {r["column"]: r["n_distinct"] for r in cardinality(df.repartition(3)).collect()}
    assert found == {"a.b": 3, "d": 3, "s": 3, "t": 2, "l": 3, "day": 2, "price": 2, "none": 0}
    assert {r["n_distinct"] for r in cardinality(df.limit(0)).collect()} == {0}
    assert cardinality(df)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 1
