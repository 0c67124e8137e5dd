"""Operators that work by ranges, cells or hashes, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.functions.ordered import carry_value, quantile_table, row_positions, running_totals
from gridsmith.functions.sampling import sample_per_group, sample_rows
from gridsmith.ml.dbscan import dbscan
from gridsmith.ml.prep import split, with_test_flag
from gridsmith.operators.correlation import corr_matrix
from gridsmith.operators.duplicates import drop_duplicates, duplicate_rows
from gridsmith.operators.encoding import fit_ordinal
from gridsmith.operators.features import GroupAggregate, add_group_aggregates
from gridsmith.operators.labels import suggest_merges
from gridsmith.operators.relations import detect_relationships


def skewed(n=3000, seed=3):
    """(k, g, v, w): one group and one value hold a third of the rows; some values are null."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        hot = draw.random() < 0.34
        value = 7.0 if hot else round(draw.gauss(0, 50), 1)
        rows.append((k, "hot" if draw.random() < 0.34 else f"g{draw.randint(0, 9)}", None if k % 17 == 0 else value, float(draw.randint(0, 5))))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(skewed(), "k long, g string, v double, w double").repartition(5).cache()


def test_quantiles_by_ranges_equal_percentile(table):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    exact = table.agg(F.percentile("v", F.array(*map(F.lit, shares))), F.percentile("w", F.array(*map(F.lit, shares)))).first()
    found = quantile_table(table, ["v", "w"], shares).first()
    assert found["v"] == pytest.approx(exact[0]) and found["w"] == pytest.approx(exact[1])


def test_grouped_quantiles_by_ranges_equal_percentile(table):
    with_null_group = table.withColumn("g", F.when(F.col("g") != "g3", F.col("g")))
    found = {r["g"]: r["v"] for r in quantile_table(with_null_group, ["v"], [0.25, 0.5], ["g"]).collect()}
    exact = {r[0]: r[1] for r in with_null_group.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).collect()}
    assert found.keys() == exact.keys() and None in found
    for group in exact:
        assert found[group] == pytest.approx(exact[group])


def test_grouped_quantiles_do_not_shuffle_rows_by_a_few_groups(spark):
    # Three groups of a large table: sorted by the group key, each would be one task.
    df = spark.range(3_000_000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    found = quantile_table(df, ["v"], [0.5], ["g"])
    medians = {r["g"]: r["v"][0] for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    exact = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("v", 0.5)).collect()}
    assert medians == pytest.approx(exact)

def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert quantile_table(empty, ["v"], [0.5]).first()["v"] is None


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_row_positions_with_a_hot_value(table, ranges):
    data = table.dropna().select("v", "w")
    values = sorted(r["v"] for r in data.collect())
    found = row_positions(data, ["v", "w"], ranges).collect()
    assert sum(r["n"] for r in found) == len(values)
    for r in found:
        assert r["__below_0"] == np.searchsorted(values, r["v"], "left")
        assert r["__equal_0"] == np.searchsorted(values, r["v"], "right") - r["__below_0"]


@pytest.mark.parametrize("kind", ["double", "string", "date"])
def test_running_totals(spark, kind):
    draw = random.Random(1)
    numbers = sorted(draw.sample(range(10_000), 400))
    text = [f"{n:05d}" if kind == "string" else str(n) for n in numbers]
    df = spark.createDataFrame(list(zip(text, numbers)), "t string, n long").repartition(4)
    if kind == "double":
        df = df.withColumn("t", F.col("t").cast("double"))
    if kind == "date":
        df = df.withColumn("t", F.date_add(F.lit("2000-01-01").cast("date"), F.col("t").cast("int")))
    found = {r["n"]: r["below"] for r in running_totals(df, "t", {"below": F.col("n")}, ranges=20).collect()}
    total = 0
    for n in numbers:
        assert found[n] == total
        total += n


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("ranges", [1, 9, 200])
def test_carry_over_ranges_and_hot_leading_values(spark, forward, ranges):
    draw = random.Random(5)
    rows = [(7 if draw.random() < 0.4 else draw.randint(0, 30), i, f"x{i}" if draw.random() < 0.05 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "day int, id long, v string").repartition(6)
    found = {r["id"]: r["v"] for r in carry_value(df, "v", ["day", "id"], forward, ranges).collect()}
    last = None
    for _, i, v in sorted(rows, reverse=not forward):
        last = v if v is not None else last
        assert found[i] == last


def test_carry_by_text(spark):
    rows = [(f"k{i:04d}", i if i % 7 == 0 else None) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(3)
    found = {r["k"]: r["v"] for r in carry_value(df, "v", ["k"], ranges=30).collect()}
    assert found == {k: (int(k[1:]) // 7 * 7 or None) for k, _ in rows}


def test_ordinal_codes_follow_the_sorted_order(spark):
    labels = [f"Brand#{i}" for i in range(300)]
    found = fit_ordinal(spark.createDataFrame([(v,) for v in labels], "b string"), "b").collect()
    assert [r["value"] for r in sorted(found, key=lambda r: r["code"])] == sorted(labels)


def brute_kendall(x, y):
    net = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            net, tx, ty = net + a * b, tx + (a != 0), ty + (b != 0)
    return net / math.sqrt(tx * ty)


def test_kendall_and_spearman_against_brute_force(spark):
    draw = random.Random(9)
    rows = [(float(draw.randint(0, 8)), draw.gauss(0, 1), None if draw.random() < 0.1 else float(draw.randint(0, 40))) for _ in range(300)]
    rows = [(a, a + 2 * b, c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for method in ("kendall", "spearman"):
        found = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(df, method=method).collect()}
        for i, p in enumerate("abc"):
            for j, q in enumerate("abc"):
                if i == j:
                    continue
                pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
                x, y = [u for u, _ in pairs], [v for _, v in pairs]
                if method == "kendall":
                    expected = brute_kendall(x, y)
                else:
                    expected = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
                assert found[p, q] == pytest.approx(expected)


def average_ranks(values):
    ordered_values = sorted(values)
    return [(np.searchsorted(ordered_values, v, "left") + np.searchsorted(ordered_values, v, "right") + 1) / 2 for v in values]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85])
def test_merge_suggestions_find_every_pair(spark, threshold):
    draw = random.Random(11)
    labels = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 12))) for _ in range(150)}
    labels |= {"new york city", "new york citi", "nev york city", "newyork city"}
    found = {(r["a"], r["b"]) for r in suggest_merges(spark.createDataFrame([(v,) for v in labels], "v string"), "v", threshold).collect()}
    expected = {
        (a, b) for a in labels for b in labels if a < b and 1 - edit_distance(a, b) / max(len(a), len(b)) >= threshold
    }
    assert found == expected


def brute_dbscan(points, eps, min_samples):
    n = len(points)
    close = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    core = [len(c) >= min_samples for c in close]
    labels, current = [-1] * n, 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack, labels[i] = [i], current
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in close[p]:
                if labels[q] == -1:
                    labels[q] = current
                    stack.append(q)
        current += 1
    return labels


@pytest.mark.parametrize("dims,eps,seed", [(1, 0.05, 1), (2, 0.25, 2), (3, 0.5, 3), (5, 0.9, 4)])
def test_dbscan_against_brute_force(spark, dims, eps, seed):
    draw = random.Random(seed)
    centres = [[draw.uniform(-3, 3) for _ in range(dims)] for _ in range(4)]
    points = [[c + draw.gauss(0, 0.35) for c in centres[i % 4]] for i in range(260)]
    points += [list(centres[0])] * 60 + [[draw.uniform(-4, 4) for _ in range(dims)] for _ in range(60)]
    draw.shuffle(points)
    df = spark.createDataFrame(list(enumerate(points)), "k long, p array<double>").repartition(4)
    found = {r["k"]: r["cluster_label"] for r in dbscan(df, ["k"], "p", eps, 5).collect()}
    expected = brute_dbscan(points, eps, 5)
    assert [found[i] for i in range(len(points))] == expected and max(expected) >= 1



def _broadcast_types(df):
    """Column types of every table the executed plan of ``df`` broadcasts."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    inner = {"AdaptiveSparkPlan": "executedPlan", "ReusedExchange": "child"}
    while todo:
        node = todo.pop()
        if node.nodeName() == "BroadcastExchange":
            out = node.output()
            found += [out.apply(i).dataType().simpleString() for i in range(out.size())]
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() in inner or node.nodeName().endswith("QueryStage"):
            todo.append(getattr(node, inner.get(node.nodeName(), "plan"))())
    return found


def test_dbscan_sends_no_points_through_the_driver(spark):
    # Point tables read back from parquet are a few kilobytes here, as they are a few
    # megabytes at a million rows: small enough to be broadcast, yet they hold every point.
    draw = random.Random(5)
    points = [[draw.gauss(i % 3, 0.2), draw.gauss(0, 0.2)] for i in range(400)]
    df = spark.createDataFrame(list(enumerate(points)), "k long, p array<double>").repartition(4)
    result = dbscan(df, ["k"], "p", 0.2, 5)
    found = {r["k"]: r["cluster_label"] for r in result.collect()}
    assert [found[i] for i in range(len(points))] == brute_dbscan(points, 0.2, 5)
    assert "array<double>" not in _broadcast_types(result)

def test_group_aggregates_do_not_depend_on_broadcasts(spark, table, rows):
    features = [GroupAggregate("m", "g", "v", "mean"), GroupAggregate("d", "g", "v", "median")]
    small = rows(add_group_aggregates(table, features))
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        large = rows(add_group_aggregates(table, features))
    finally:
        for limit in limits:
            spark.conf.unset(limit)
    assert len(small) == len(large) == 3000
    for a, b in zip(small, large):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])



def test_group_aggregates_of_a_few_groups_are_broadcast(spark):
    # Three groups of a large table: joined back by a shuffle on the group, each would be one task.
    df = spark.range(3_000_000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 1000).cast("double").alias("v"))
    added = add_group_aggregates(df, [GroupAggregate("m", "g", "v", "mean")])
    found = {r["g"]: r["m"] for r in added.groupBy("g").agg(F.min("m").alias("m"), F.max("m").alias("top")).where("m = top").collect()}
    plan = added._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    exact = {r[0]: r[1] for r in df.groupBy("g").agg(F.avg("v")).collect()}
    assert found == pytest.approx(exact)

@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(spark, table, rows, parts):
    moved = table.repartition(parts, "w").sortWithinPartitions(F.col("k").desc())
    assert rows(drop_duplicates(moved, ["g", "w"], "first", ["k"])) == rows(drop_duplicates(table, ["g", "w"], "first", ["k"]))
    assert rows(duplicate_rows(moved, ["v"])) == rows(duplicate_rows(table, ["v"]))
    assert rows(sample_rows(moved, ["k"], 50)) == rows(sample_rows(table, ["k"], 50))
    assert rows(sample_per_group(moved, "g", ["k"], 5)) == rows(sample_per_group(table, "g", ["k"], 5))
    for stratify in (None, "g"):
        assert rows(split(moved, ["k"], stratify=stratify)[1]) == rows(split(table, ["k"], stratify=stratify)[1])


def test_stratified_split_takes_the_same_share_of_every_label(table):
    flagged = with_test_flag(table, ["k"], stratify="g")
    for r in flagged.groupBy("g").agg(F.count_if("__is_test").alias("t"), F.count("*").alias("n")).collect():
        assert r["t"] == math.ceil(0.2 * r["n"])


def test_relationships(spark):
    parents = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id long, name string")
    children = spark.createDataFrame([(i, i % 5, "p1", i % 2) for i in range(40)], "cid long, pid long, pname string, flag long")
    found = {tuple(r)[:4] for r in detect_relationships({"p": parents, "c": children}).collect()}
    assert found == {("p", "c", "id", "pid"), ("p", "c", "name", "pname"), ("p", "c", "id", "flag"), ("c", "p", "cid", "id")}
    none = detect_relationships({"c": children.select("flag"), "d": children.select(F.col("flag").alias("f"))})
    assert none.count() == 0


def test_relationships_against_sets(spark):
    """Texts and whole numbers, more columns than a bitmap word has bits, nulls, repeated and shared values."""
    import random

    draw = random.Random(6)
    wide = {f"n{k}": [draw.randrange(40) if draw.random() > 0.1 else None for _ in range(30)] for k in range(66)}
    wide |= {"few": [draw.choice(("a", "b", "cé")) for _ in range(30)], "void": [None] * 30, "blank": ["", *["a"] * 29]}
    keys = {"id": list(range(40)), "word": [*"abcdefgh", "cé", "", *[f"w{k}" for k in range(30)]], "gap": [None, *range(1, 40)], "far": [k << 40 for k in range(40)]}

    def frame(table):
        schema = ", ".join(f"`{c}` {'string' if any(isinstance(v, str) for v in values) else 'long'}" for c, values in table.items())
        return spark.createDataFrame(list(zip(*table.values())), schema).repartition(3)

    def expected(least):
        found = set()
        for pt, ps, ct, cs in (("keys", keys, "wide", wide), ("wide", wide, "keys", keys)):
            for p, parent in ps.items():
                for c, child in cs.items():
                    own = [v for v in child if v is not None]
                    if not own or None in parent or len(set(parent)) < len(parent):
                        continue
                    share = sum(v in set(parent) for v in own) / len(own)
                    if share >= least and share > 0:
                        found.add((pt, ct, p, c, round(share, 9)))
        return found

    tables = {"wide": frame(wide), "keys": frame(keys)}
    for least in (1.0, 0.2):
        rows = {(*r[:4], round(r[4], 9)) for r in map(tuple, detect_relationships(tables, least).collect())}
        assert rows == expected(least) and rows
