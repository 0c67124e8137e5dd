"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sampling import HASH_BITS
from ..operators.chartdata import (
    bar_counts, box_stats, confusion_chart, correlation_heatmap, histogram_chart, kde_curve, kde_curves, line_points,
    multi_line, pair_plot_sample, predicted_vs_actual, residuals, roc_curve, scatter_density, scatter_points,
    swarm_points, violin,
)
from ..plans.suggest import chart_suggestions
from .profiles import _corr_sql, histogram_sql
from .registry import CUSTOMER_GAPS, LINEITEM_GAPS, LINEITEM_KEY, customer_gaps, lineitem_gaps, query, rounded, table

_KEYS = ", ".join(LINEITEM_KEY)


def hash_sql(*keys: str, seed: int = 42) -> str:
    """The row hash in SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce({k}::varchar, '')" for k in keys]])
    return f"('0x' || substr(md5({text}), 1, {HASH_BITS // 4}))::bigint"


@query("chart_histogram", f"""WITH {histogram_sql('orders', ['o_totalprice'], 30)}
SELECT e."column", e.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, coalesce(count, 0) AS count FROM e LEFT JOIN n USING ("column", bin)""")
def chart_histogram(spark, folder):
    return rounded(histogram_chart(table(spark, folder, "orders"), ["o_totalprice"]), 4)


@query("chart_histograms_many", f"""WITH {histogram_sql('part', ['p_partkey', 'p_size', 'p_retailprice'], 30)}
SELECT e."column", e.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, coalesce(count, 0) AS count FROM e LEFT JOIN n USING ("column", bin)""")
def chart_histograms_many(spark, folder):
    return rounded(histogram_chart(table(spark, folder, "part")), 4)


@query("chart_kde", """WITH s AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS bw, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT n, bw, lo - 3 * bw AS start, (hi + 3 * bw - (lo - 3 * bw)) / 199 AS step FROM s),
p AS (SELECT i::int AS point, start + i * step AS x, n, bw FROM g, range(200) t(i)),
v AS (SELECT value, count(*) AS m FROM events GROUP BY 1)
SELECT point, round(x, 6) AS x, round(sum(m * exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9) AS density
FROM p, v GROUP BY point, x""")
def chart_kde(spark, folder):
    return rounded(kde_curve(table(spark, folder, "events"), "value"), 6, density=9)


@query("chart_kde_columns", """WITH u AS (SELECT 'p_size' AS "column", p_size::double AS value FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
s AS (SELECT "column", count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS bw, min(value) AS lo, max(value) AS hi FROM u GROUP BY 1),
g AS (SELECT "column", n, bw, lo - 3 * bw AS start, (hi + 3 * bw - (lo - 3 * bw)) / 199 AS step FROM s),
p AS (SELECT "column", i::int AS point, start + i * step AS x, n, bw FROM g, range(200) t(i)),
v AS (SELECT "column", value, count(*) AS m FROM u GROUP BY 1, 2)
SELECT p."column", point, round(x, 6) AS x, round(sum(m * exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9) AS density
FROM p JOIN v ON p."column" = v."column" GROUP BY p."column", point, x""")
def chart_kde_columns(spark, folder):
    return rounded(kde_curves(table(spark, folder, "part"), ["p_size", "p_retailprice"]), 6, density=9)


@query("chart_violin", """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS bw, min(value) AS lo, max(value) AS hi,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
g AS (SELECT *, lo - 3 * bw AS start, (hi + 3 * bw - (lo - 3 * bw)) / 199 AS step FROM s),
p AS (SELECT event_type, i::int AS point, start + i * step AS x, n, bw, q1, median, q3 FROM g, range(200) t(i)),
v AS (SELECT event_type, value, count(*) AS m FROM events GROUP BY 1, 2)
SELECT p.event_type, point, round(x, 6) AS x, round(sum(m * exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9) AS density,
  round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3
FROM p JOIN v ON p.event_type = v.event_type GROUP BY p.event_type, point, x""")
def chart_violin(spark, folder):
    return rounded(violin(table(spark, folder, "events"), "value", "event_type"), 6, density=9)


@query("chart_violin_ungrouped", """WITH s AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS bw, min(value) AS lo, max(value) AS hi,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events),
g AS (SELECT *, lo - 3 * bw AS start, (hi + 3 * bw - (lo - 3 * bw)) / 199 AS step FROM s),
p AS (SELECT i::int AS point, start + i * step AS x, n, bw, q1, median, q3 FROM g, range(200) t(i)),
v AS (SELECT value, count(*) AS m FROM events GROUP BY 1)
SELECT point, round(x, 6) AS x, round(sum(m * exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9) AS density,
  round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3 FROM p, v GROUP BY point, x""")
def chart_violin_ungrouped(spark, folder):
    return rounded(violin(table(spark, folder, "events"), "value"), 6, density=9)


@query("chart_violin_hue", """WITH s AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS bw, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
  quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1, 2),
g AS (SELECT *, lo - 3 * bw AS start, (hi + 3 * bw - (lo - 3 * bw)) / 199 AS step FROM s),
p AS (SELECT o_orderstatus, o_orderpriority, i::int AS point, start + i * step AS x, n, bw, q1, median, q3 FROM g, range(200) t(i)),
v AS (SELECT o_orderstatus, o_orderpriority, o_totalprice, count(*) AS m FROM orders GROUP BY ALL)
SELECT o_orderstatus, o_orderpriority, point, round(x, 4) AS x, round(sum(m * exp(-0.5 * ((x - o_totalprice) / bw) * ((x - o_totalprice) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) AS density,
  round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3
FROM p JOIN v USING (o_orderstatus, o_orderpriority) GROUP BY o_orderstatus, o_orderpriority, point, x""")
def chart_violin_hue(spark, folder):
    return rounded(violin(table(spark, folder, "orders"), "o_totalprice", "o_orderstatus", hue="o_orderpriority"), 4, density=12)


@query("chart_scatter_sample", f"""SELECT {_KEYS}, l_quantity, l_extendedprice, l_returnflag FROM lineitem
ORDER BY {hash_sql(*LINEITEM_KEY)}, {_KEYS} LIMIT 5000""")
def chart_scatter_sample(spark, folder):
    return scatter_points(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", LINEITEM_KEY, "l_returnflag", 5000)


@query("chart_scatter", f"SELECT {_KEYS}, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def chart_scatter(spark, folder):
    return scatter_points(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", LINEITEM_KEY, "l_returnflag")


@query("chart_scatter_density", """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem),
e AS (SELECT i, a + i * ((b - a) / 50) AS qlo, a + (i + 1) * ((b - a) / 50) AS qhi, c + i * ((d - c) / 50) AS plo, c + (i + 1) * ((d - c) / 50) AS phi FROM r, range(50) t(i))
SELECT x.i::int AS x_bin, y.i::int AS y_bin, l_returnflag, count(*) AS count FROM lineitem
JOIN e x ON l_quantity >= x.qlo AND (l_quantity < x.qhi OR x.i = 49)
JOIN e y ON l_extendedprice >= y.plo AND (l_extendedprice < y.phi OR y.i = 49) GROUP BY 1, 2, 3""")
def chart_scatter_density(spark, folder):
    return scatter_density(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", hue="l_returnflag")


@query("chart_line", """SELECT o_orderdate, o_orderstatus, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n,
  round(avg(o_totalprice) - coalesce(1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 0), 4) AS low,
  round(avg(o_totalprice) + coalesce(1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 0), 4) AS high
FROM orders GROUP BY 1, 2""")
def chart_line(spark, folder):
    return rounded(line_points(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus"), 4)


@query("chart_bar", f"""WITH {CUSTOMER_GAPS} SELECT c_mktsegment AS value, count(*) AS count FROM customer_gaps WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def chart_bar(spark, folder):
    return bar_counts(customer_gaps(spark, folder), "c_mktsegment")


@query("chart_bar_top", """SELECT user_id::varchar AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, value COLLATE C LIMIT 30""")
def chart_bar_top(spark, folder):
    return bar_counts(table(spark, folder, "events"), "user_id", 30)


_BOX = """WITH {cte} q AS (SELECT {keys}, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median, quantile_cont({y}, 0.75) AS q3 FROM {source} WHERE {used} GROUP BY ALL)
SELECT {out}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
  round(min(CASE WHEN {y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {y} END), 6) AS whisker_low,
  round(max(CASE WHEN {y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {y} END), 6) AS whisker_high,
  count(CASE WHEN {y} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS fliers
FROM {source} s JOIN q ON {on} WHERE {used} GROUP BY ALL"""


@query("chart_box_by_group", _BOX.format(
    cte=f"{LINEITEM_GAPS},", keys="l_returnflag, l_linestatus", out="s.l_returnflag, s.l_linestatus", y="l_extendedprice",
    source="lineitem_gaps", used="s.l_returnflag IS NOT NULL".replace("s.", ""), on="s.l_returnflag = q.l_returnflag AND s.l_linestatus = q.l_linestatus",
).replace("ON s.l_returnflag = q.l_returnflag AND s.l_linestatus = q.l_linestatus WHERE l_returnflag", "ON s.l_returnflag = q.l_returnflag AND s.l_linestatus = q.l_linestatus WHERE s.l_returnflag"))
def chart_box_by_group(spark, folder):
    return rounded(box_stats(lineitem_gaps(spark, folder), "l_extendedprice", "l_returnflag", "l_linestatus"))


@query("chart_box", _BOX.format(cte="", keys="1 AS one", out="1 AS one", y="value", source="events", used="true", on="true"))
def chart_box(spark, folder):
    return rounded(box_stats(table(spark, folder, "events"), "value").select(F.lit(1).alias("one"), "*"))


@query("chart_swarm", "SELECT event_id, event_type, value, user_id FROM events")
def chart_swarm(spark, folder):
    return swarm_points(table(spark, folder, "events"), "event_type", "value", ["event_id"], hue="user_id")


@query("chart_swarm_sample", f"""SELECT event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('event_id')}, event_id) <= 500""")
def chart_swarm_sample(spark, folder):
    return swarm_points(table(spark, folder, "events"), "event_type", "value", ["event_id"], 500)


@query("chart_correlation_heatmap", f"""SELECT col_a, col_b, round(corr, 6) AS corr FROM ({
    _corr_sql('part', ['p_partkey', 'p_size', 'p_retailprice'], 'SELECT corr({a}, {b}) FROM {source}')})""")
def chart_correlation_heatmap(spark, folder):
    return rounded(correlation_heatmap(table(spark, folder, "part")))


@query("chart_pair_plot_sample", f"""SELECT event_id, user_id, value FROM events ORDER BY {hash_sql('event_id')}, event_id LIMIT 1000""")
def chart_pair_plot_sample(spark, folder):
    return pair_plot_sample(table(spark, folder, "events"), ["event_id"])


@query("chart_multi_line", """WITH p AS (SELECT *, floor((row_number() OVER (ORDER BY event_id) - 1) * 500 / (SELECT count(*) FROM events))::int AS step FROM events),
u AS (SELECT step, 'value' AS line, value AS v FROM p UNION ALL SELECT step, 'user_id', user_id::double FROM p)
SELECT line, step, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM u GROUP BY 1, 2""")
def chart_multi_line(spark, folder):
    return rounded(multi_line(table(spark, folder, "events"), "event_id", ["value", "user_id"]))


_SCORED = "scored AS (SELECT p_partkey, p_size::double AS actual, p_retailprice / 40 AS predicted FROM part)"


def _scored(spark, folder):
    df = table(spark, folder, "part")
    return df.select("p_partkey", F.col("p_size").cast("double").alias("actual"), (F.col("p_retailprice") / 40).alias("predicted"))


@query("chart_predicted_vs_actual", f"""WITH {_SCORED} SELECT p_partkey, actual, predicted,
  (SELECT least(min(actual), min(predicted)) FROM scored) AS line_low, (SELECT greatest(max(actual), max(predicted)) FROM scored) AS line_high
FROM scored""")
def chart_predicted_vs_actual(spark, folder):
    return predicted_vs_actual(_scored(spark, folder), "actual", "predicted", ["p_partkey"])


@query("chart_residuals", f"WITH {_SCORED} SELECT p_partkey, actual, round(predicted, 6) AS predicted, round(actual - predicted, 6) AS residual FROM scored")
def chart_residuals(spark, folder):
    return rounded(residuals(_scored(spark, folder), "actual", "predicted"))


_CONFUSION = "SELECT o_orderstatus AS actual, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'X' END AS predicted FROM orders"


def _status_guess(spark, folder):
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "F").when(price > 150000, "O").otherwise("X")
    return table(spark, folder, "orders").select(F.col("o_orderstatus").alias("actual"), guess.alias("predicted"))


_GRID = f"""WITH c AS (SELECT actual, predicted, count(*) AS n FROM ({_CONFUSION}) GROUP BY 1, 2),
l AS (SELECT actual AS v FROM c UNION SELECT predicted FROM c),
g AS (SELECT a.v AS actual, b.v AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v)"""


@query("chart_confusion_matrix", f"{_GRID} SELECT actual, predicted, n::double AS value FROM g")
def chart_confusion_matrix(spark, folder):
    return confusion_chart(_status_guess(spark, folder), "actual", "predicted")


@query("chart_confusion_matrix_shares", f"""{_GRID} SELECT actual, predicted,
  round(CASE WHEN sum(n) OVER (PARTITION BY actual) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY actual) END::double, 6) AS value FROM g""")
def chart_confusion_matrix_shares(spark, folder):
    return rounded(confusion_chart(_status_guess(spark, folder), "actual", "predicted", normalize=True))


@query("chart_roc_curve", """WITH s AS (SELECT quality, (n_chars % 1000)::double AS score FROM labels JOIN documents USING (doc_id)),
c AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM s GROUP BY 1)
SELECT score AS threshold, round((sum(n) OVER w / (SELECT sum(n) FROM c))::double, 6) AS fpr, round((sum(p) OVER w / (SELECT sum(p) FROM c))::double, 6) AS tpr
FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT 'infinity'::double, 0.0, 0.0""")
def chart_roc_curve(spark, folder):
    scored = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    scored = scored.select("quality", (F.col("n_chars") % 1000).cast("double").alias("score"))
    curve = roc_curve(scored, "quality", "score")
    return curve.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("chart_suggestions", """SELECT * FROM (VALUES ('o_orderkey', 'histogram', 'numeric column'), ('o_custkey', 'histogram', 'numeric column'),
  ('o_totalprice', 'histogram', 'numeric column'), ('o_orderdate, o_orderkey', 'line', 'value over time'),
  ('o_orderdate, o_custkey', 'line', 'value over time'), ('o_orderdate, o_totalprice', 'line', 'value over time'),
  ('o_orderkey, o_custkey', 'scatter', 'two numeric columns'), ('o_orderkey, o_totalprice', 'scatter', 'two numeric columns'),
  ('o_custkey, o_totalprice', 'scatter', 'two numeric columns'), ('o_orderkey, o_custkey, o_totalprice', 'heatmap', 'several numeric columns'))
  t("columns", chart, reason)
UNION ALL SELECT c, 'bar', 'few categories' FROM (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS d FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders) WHERE d <= 30
UNION ALL SELECT c || ', ' || n, 'box', 'numeric by category' FROM (VALUES ('o_orderstatus'), ('o_orderpriority')) a(c), (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) b(n)""")
def chart_suggestion(spark, folder):
    return chart_suggestions(table(spark, folder, "orders"))
