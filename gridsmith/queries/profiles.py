"""Features, encodings, summaries, categories, correlations and ANOVA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.categories import crosstab, crosstab_long, freq_table, imbalance_score, top_categories
from ..operators.correlation import corr_matrix
from ..operators.encoding import (
    Encoding, collapse_rare, encode, encode_frequency, encode_one_hot, encode_ordinal, fit_frequency,
    fit_ordinal, one_hot_long,
)
from ..operators.features import Arithmetic, GroupAggregate, add_arithmetic, add_group_aggregates
from ..operators.missing import fill_missing
from ..operators.relations import anova, scan_relationships
from ..operators.rules import Rule, apply_rules
from ..operators.summary import (
    analyze_numeric, cardinality, extended_numeric_summary, grouped_summary, histogram, histograms,
    numeric_summary, overview, profile_report,
)
from .registry import (
    CUSTOMER_GAPS, LINEITEM_GAPS, LINEITEM_KEY, customer_gaps, lineitem_gaps, query, rounded, table,
)

_KEYS = ", ".join(LINEITEM_KEY)
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def unpivot_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::double AS v FROM {source}""" for c in columns)


# --- flagship -------------------------------------------------------------------------


@query("flagship_fill_feature_summary", f"""WITH {LINEITEM_GAPS},
flag AS (SELECT l_returnflag AS v FROM lineitem_gaps WHERE l_returnflag IS NOT NULL
         GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1),
filled AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_gaps)) AS l_quantity,
  l_extendedprice, coalesce(l_returnflag, (SELECT v FROM flag)) AS l_returnflag FROM lineitem_gaps),
r AS (SELECT l_returnflag, l_quantity, l_extendedprice * l_quantity AS revenue FROM filled)
SELECT l_returnflag, count(revenue) AS revenue_count, round(avg(revenue), 4) AS revenue_mean,
  round(quantile_cont(revenue, 0.5), 4) AS revenue_median, round(stddev_samp(revenue), 4) AS revenue_std,
  round(min(revenue), 4) AS revenue_min, round(max(revenue), 4) AS revenue_max,
  count(l_quantity) AS l_quantity_count, round(avg(l_quantity), 4) AS l_quantity_mean,
  round(quantile_cont(l_quantity, 0.5), 4) AS l_quantity_median, round(stddev_samp(l_quantity), 4) AS l_quantity_std,
  round(min(l_quantity), 4) AS l_quantity_min, round(max(l_quantity), 4) AS l_quantity_max
FROM r GROUP BY l_returnflag""")
def flagship(spark, folder):
    df = lineitem_gaps(spark, folder).select("l_quantity", "l_extendedprice", "l_returnflag")
    df = add_arithmetic(fill_missing(df), [Arithmetic("revenue", "l_extendedprice", "l_quantity", "mul")])
    return rounded(grouped_summary(df, "l_returnflag", ["revenue", "l_quantity"]), 4)


# --- features and encodings -----------------------------------------------------------


@query("features_arithmetic", f"""SELECT {_KEYS}, l_extendedprice + l_tax AS total, total - l_discount AS net,
  l_extendedprice * l_quantity AS gross,
  round(CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END, 4) AS ratio FROM lineitem""")
def features_arithmetic(spark, folder):
    features = [
        Arithmetic("total", "l_extendedprice", "l_tax", "add"), Arithmetic("net", "total", "l_discount", "sub"),
        Arithmetic("gross", "l_extendedprice", "l_quantity", "mul"), Arithmetic("ratio", "l_extendedprice", "l_discount", "div"),
        Arithmetic("skipped", "l_extendedprice", "no_such_column", "add"),
    ]
    df = add_arithmetic(table(spark, folder, "lineitem"), features)
    return df.select(*LINEITEM_KEY, "total", "net", "gross", F.round("ratio", 4).alias("ratio"))


@query("features_group_aggregates", f"""WITH {LINEITEM_GAPS}, g AS (
  SELECT l_returnflag AS k, round(avg(l_quantity), 6) AS mean_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price,
    round(sum(l_quantity), 2) AS sum_quantity, count(l_quantity) AS n_quantity, round(stddev_samp(l_discount), 6) AS std_discount
  FROM lineitem_gaps WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT {_KEYS}, l_returnflag, mean_quantity, median_price, sum_quantity, n_quantity, std_discount
FROM lineitem_gaps LEFT JOIN g ON l_returnflag = k""")
def features_group_aggregates(spark, folder):
    features = [
        GroupAggregate("mean_quantity", "l_returnflag", "l_quantity", "mean"),
        GroupAggregate("median_price", "l_returnflag", "l_extendedprice", "median"),
        GroupAggregate("sum_quantity", "l_returnflag", "l_quantity", "sum"),
        GroupAggregate("n_quantity", "l_returnflag", "l_quantity", "count"),
        GroupAggregate("std_discount", "l_returnflag", "l_discount", "std"),
    ]
    df = add_group_aggregates(lineitem_gaps(spark, folder), features)
    names = [f.name for f in features]
    return rounded(df.select(*LINEITEM_KEY, "l_returnflag", *names), 6, sum_quantity=2)


@query("features_group_aggregate_many_groups", f"""SELECT {_KEYS}, round(sum(l_quantity) OVER (PARTITION BY l_partkey), 2) AS part_quantity FROM lineitem""")
def features_group_aggregate_many_groups(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINEITEM_KEY, "l_quantity")
    df = add_group_aggregates(df, [GroupAggregate("part_quantity", "l_partkey", "l_quantity", "sum")])
    return rounded(df.drop("l_quantity"), 2)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("encode_one_hot", f"""WITH {CUSTOMER_GAPS} SELECT c_custkey, {', '.join(
    f"coalesce(c_mktsegment = '{s}', false) AS c_mktsegment_{s}" for s in _SEGMENTS)} FROM customer_gaps""")
def encode_one_hot_query(spark, folder):
    return encode_one_hot(customer_gaps(spark, folder).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("encode_one_hot_long", """SELECT p_partkey, 'p_brand_' || p_brand AS feature FROM part""")
def encode_one_hot_long(spark, folder):
    return one_hot_long(table(spark, folder, "part"), "p_brand", ["p_partkey"])


@query("encode_collapse_rare", """WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n < 40 OR n / (SELECT count(*) FROM part) < 0.02 THEN 'Other' ELSE p.p_name END AS p_name
FROM part p JOIN n ON p.p_name = n.p_name""")
def encode_collapse_rare(spark, folder):
    return collapse_rare(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", 40, 0.02)


@query("encode_one_hot_rare", """WITH n AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
f AS (SELECT p_partkey, CASE WHEN n / (SELECT count(*) FROM part) < 0.16 THEN 'Other' ELSE p.p_type END AS t FROM part p JOIN n USING (p_type))
SELECT p_partkey, 'p_type_' || t AS feature FROM f""")
def encode_one_hot_rare(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_type")
    wide = encode_one_hot(df, ["p_type"], min_frac=0.16)
    flags = [c for c in wide.columns if c != "p_partkey"]
    set_flags = F.filter(F.array(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in flags]), lambda c: c.isNotNull())
    return wide.select("p_partkey", F.explode(set_flags).alias("feature"))


@query("encode_ordinal_given", """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1
  WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END::double AS o_orderpriority FROM orders""")
def encode_ordinal_given(spark, folder):
    order = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return encode_ordinal(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", order)


@query("encode_ordinal_sorted", """SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand COLLATE C) - 1)::double AS p_brand FROM part""")
def encode_ordinal_sorted(spark, folder):
    return encode_ordinal(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_brand")


@query("encode_frequency", f"""WITH {CUSTOMER_GAPS}, f AS (
  SELECT c_mktsegment, count(*) / (SELECT count(c_mktsegment) FROM customer_gaps) AS share
  FROM customer_gaps WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT c_custkey, round(coalesce(share, 0.0)::double, 6) AS c_mktsegment
FROM customer_gaps c LEFT JOIN f ON c.c_mktsegment = f.c_mktsegment""")
def encode_frequency_query(spark, folder):
    df = customer_gaps(spark, folder).select("c_custkey", "c_mktsegment")
    return rounded(encode_frequency(df, ["c_mktsegment"]))


@query("encode_mixed", f"""WITH f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1)
SELECT p_partkey, round(share::double, 6) AS p_brand, p_size::double - 1 AS p_size, {', '.join(
    f"p_type = '{t}' AS p_type_{t}" for t in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))}
FROM part p JOIN f USING (p_brand)""")
def encode_mixed(spark, folder):
    settings = {
        "p_brand": Encoding("frequency"),
        "p_size": Encoding("ordinal", ordered=tuple(str(i) for i in range(1, 51))),
    }
    df = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return rounded(encode(df, ["p_brand", "p_size", "p_type"], settings))


@query("encode_fitted_maps", """SELECT 'p_type' AS "column", p_type AS value, round((count(*) / (SELECT count(*) FROM part))::double, 6) AS code FROM part GROUP BY p_type
UNION ALL SELECT 'p_brand', p_brand, (row_number() OVER (ORDER BY p_brand COLLATE C) - 1)::double FROM (SELECT DISTINCT p_brand FROM part)""")
def encode_fitted_maps(spark, folder):
    part = table(spark, folder, "part")
    return rounded(fit_frequency(part, "p_type").unionByName(fit_ordinal(part, "p_brand")))


@query("rules_decision", """SELECT o_orderkey, o_totalprice, o_orderpriority,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' WHEN o_totalprice > 200000 THEN 'high' END AS risk,
  CASE WHEN (CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' WHEN o_totalprice > 200000 THEN 'high' END) IS DISTINCT FROM 'high' THEN true ELSE false END AS calm
FROM orders""")
def rules_decision(spark, folder):
    rules = [
        Rule("o_totalprice", ">", 200000, "risk", "high"), Rule("o_orderpriority", "==", "1-URGENT", "risk", "rush"),
        Rule("risk", "!=", "high", "calm", True),
    ]
    return apply_rules(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), rules)


# --- summaries ------------------------------------------------------------------------

_SUMMARY = """round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max"""


@query("summary_numeric", f"""WITH {LINEITEM_GAPS}, u AS ({unpivot_sql('lineitem_gaps', _MEASURES)})
SELECT "column", count(v) AS count, {_SUMMARY} FROM u GROUP BY "column" """)
def summary_numeric(spark, folder):
    return rounded(numeric_summary(lineitem_gaps(spark, folder), _MEASURES))


@query("summary_numeric_extended", f"""WITH {LINEITEM_GAPS}, u AS ({unpivot_sql('lineitem_gaps', _MEASURES)})
SELECT "column", count(v) AS count, {_SUMMARY}, round(var_samp(v), 3) AS var, round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt
FROM u GROUP BY "column" """)
def summary_numeric_extended(spark, folder):
    return rounded(extended_numeric_summary(lineitem_gaps(spark, folder), _MEASURES), var=3)


def histogram_sql(source: str, columns: list[str], bins: int) -> str:
    return f"""u AS ({unpivot_sql(source, columns)}),
r AS (SELECT "column", CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS a,
  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS b FROM u WHERE v IS NOT NULL GROUP BY 1),
e AS (SELECT "column", i::int AS bin, a, b, a + i * ((b - a) / {bins}) AS lo,
  CASE WHEN i = {bins} - 1 THEN b ELSE a + (i + 1) * ((b - a) / {bins}) END AS hi FROM r, range({bins}) t(i)),
n AS (SELECT e."column", bin, count(*) AS count FROM u JOIN e ON u."column" = e."column"
  AND v >= lo AND (v < hi OR (bin = {bins} - 1 AND v <= hi)) GROUP BY 1, 2)
"""


@query("summary_histogram", f"""WITH {LINEITEM_GAPS}, {histogram_sql('lineitem_gaps', ['l_quantity'], 20)}
SELECT e."column", e.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(count, 0) AS count FROM e LEFT JOIN n USING ("column", bin)""")
def summary_histogram(spark, folder):
    return rounded(histogram(lineitem_gaps(spark, folder), "l_quantity"))


@query("summary_histograms_all", f"""WITH {LINEITEM_GAPS}, {histogram_sql('lineitem_gaps', _MEASURES, 20)}
SELECT e."column", e.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(count, 0) AS count FROM e LEFT JOIN n USING ("column", bin)""")
def summary_histograms_all(spark, folder):
    return rounded(histograms(lineitem_gaps(spark, folder), _MEASURES))


@query("summary_analyze_numeric", f"""WITH {LINEITEM_GAPS}, {histogram_sql('lineitem_gaps', _MEASURES, 20)},
h AS (SELECT "column", list(coalesce(count, 0) ORDER BY bin) AS bin_counts FROM e LEFT JOIN n USING ("column", bin) GROUP BY 1),
s AS (SELECT "column", count(v) AS count, {_SUMMARY}, round(var_samp(v), 3) AS var, round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt FROM u GROUP BY "column")
SELECT s.*, array_to_string(bin_counts, ',') AS bin_counts FROM s JOIN h USING ("column")""")
def summary_analyze_numeric(spark, folder):
    found = rounded(analyze_numeric(lineitem_gaps(spark, folder), _MEASURES), var=3)
    return found.withColumn("bin_counts", F.array_join(F.col("bin_counts").cast("array<string>"), ","))


def _grouped(column: str) -> str:
    return f"""count({column}) AS {column}_count, round(avg({column}), 6) AS {column}_mean,
  round(quantile_cont({column}, 0.5), 6) AS {column}_median, round(stddev_samp({column}), 6) AS {column}_std,
  min({column}) AS {column}_min, max({column}) AS {column}_max"""


@query("summary_grouped", f"""WITH {LINEITEM_GAPS} SELECT l_returnflag, {_grouped('l_quantity')}, {_grouped('l_discount')}
FROM lineitem_gaps WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def summary_grouped(spark, folder):
    return rounded(grouped_summary(lineitem_gaps(spark, folder), "l_returnflag", ["l_quantity", "l_discount"]))


@query("summary_grouped_many_groups", f"""SELECT user_id, {_grouped('value')} FROM events GROUP BY 1""")
def summary_grouped_many_groups(spark, folder):
    return rounded(grouped_summary(table(spark, folder, "events"), "user_id", ["value"]))


_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
_OVERVIEW = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS rows, count({c}) AS n_values, count(*) - count({c}) AS n_nulls FROM lineitem_gaps"""
    for c, t in _TYPES.items()
)


@query("summary_overview", f"WITH {LINEITEM_GAPS} {_OVERVIEW}")
def summary_overview(spark, folder):
    return overview(lineitem_gaps(spark, folder))


@query("summary_cardinality", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def summary_cardinality(spark, folder):
    return cardinality(table(spark, folder, "orders"))


@query("summary_profile_report", f"""WITH {LINEITEM_GAPS}, o AS ({_OVERVIEW}),
u AS ({unpivot_sql('lineitem_gaps', [c for c, t in _TYPES.items() if t in ('bigint', 'int', 'double')])}),
s AS (SELECT "column", count(v)::double AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25,
  quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max, skewness(v) AS skew, kurtosis(v) AS kurt, var_samp(v) AS var FROM u GROUP BY 1)
SELECT 'overview' AS section, "column", 'dtype' AS metric, dtype AS value, NULL::double AS number FROM o
UNION ALL SELECT 'overview', "column", 'rows', rows::varchar, rows FROM o
UNION ALL SELECT 'overview', "column", 'n_values', n_values::varchar, n_values FROM o
UNION ALL SELECT 'overview', "column", 'n_nulls', n_nulls::varchar, n_nulls FROM o
UNION ALL SELECT 'numeric', "column", 'var', format('{{:.6e}}', var), NULL FROM s
UNION ALL SELECT 'numeric', "column", metric, NULL, round(number, 5) FROM (UNPIVOT s ON count, mean, std, min, q25, q50, q75, max, skew, kurt INTO NAME metric VALUE number)""")
def summary_profile_report(spark, folder):
    # The size of a variance varies too much for one rounding: it is compared by its digits.
    report = profile_report(lineitem_gaps(spark, folder))
    var = F.col("metric") == "var"
    report = report.withColumn("value", F.when(var, F.format_string("%.6e", "number")).otherwise(F.col("value")))
    return rounded(report.withColumn("number", F.when(~var, F.col("number"))), 5)


# --- categories -----------------------------------------------------------------------


@query("categories_frequency", f"""WITH {CUSTOMER_GAPS} SELECT c_mktsegment AS value, count(*) AS count,
  round((count(*) / (SELECT count(*) FROM customer_gaps))::double, 6) AS fraction FROM customer_gaps GROUP BY 1""")
def categories_frequency(spark, folder):
    return rounded(freq_table(customer_gaps(spark, folder), "c_mktsegment"))


@query("categories_frequency_text", """SELECT text AS value, count(*) AS count,
  round((count(*) / (SELECT count(*) FROM documents))::double, 6) AS fraction FROM documents GROUP BY 1""")
def categories_frequency_text(spark, folder):
    return rounded(freq_table(table(spark, folder, "documents"), "text"))


@query("categories_top", """SELECT source AS value, count(*) AS count, round((count(*) / (SELECT count(*) FROM documents))::double, 6) AS fraction
FROM documents GROUP BY 1 ORDER BY count DESC, value LIMIT 5""")
def categories_top(spark, folder):
    return rounded(top_categories(table(spark, folder, "documents"), "source"))


@query("categories_imbalance", f"""WITH {CUSTOMER_GAPS} SELECT round((max(n) / sum(n))::double, 6) AS imbalance
FROM (SELECT count(*) AS n FROM customer_gaps GROUP BY c_mktsegment)""")
def categories_imbalance(spark, folder):
    return rounded(imbalance_score(customer_gaps(spark, folder), "c_mktsegment"))


_PAIR = f"""WITH {LINEITEM_GAPS}, c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem_gaps
  WHERE l_returnflag IS NOT NULL GROUP BY 1, 2)"""


@query("categories_crosstab", f"""WITH {LINEITEM_GAPS} SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O
FROM lineitem_gaps WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def categories_crosstab(spark, folder):
    return crosstab(lineitem_gaps(spark, folder), "l_returnflag", "l_linestatus")


for _kind, _total in {"index": "PARTITION BY l_returnflag", "columns": "PARTITION BY l_linestatus", "all": ""}.items():

    @query(f"categories_crosstab_by_{_kind}", f"""{_PAIR} SELECT l_returnflag, l_linestatus,
  round((n / sum(n) OVER ({_total}))::double, 6) AS value FROM c""")
    def _crosstab(spark, folder, kind=_kind):
        return rounded(crosstab_long(lineitem_gaps(spark, folder), "l_returnflag", "l_linestatus", kind))


# --- correlation and ANOVA ------------------------------------------------------------


def _corr_sql(source: str, columns: list[str], inner: str) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0::double AS corr" for c in columns]
    for a, b in pairs:
        body = inner.format(a=a, b=b, source=source)
        parts += [f"SELECT '{a}', '{b}', ({body})", f"SELECT '{b}', '{a}', ({body})"]
    return " UNION ALL ".join(parts)


@query("correlation_pearson", f"""WITH {LINEITEM_GAPS} SELECT col_a, col_b, round(corr, 6) AS corr FROM ({
    _corr_sql('lineitem_gaps', _MEASURES, 'SELECT corr({a}, {b}) FROM {source}')})""")
def correlation_pearson(spark, folder):
    return rounded(corr_matrix(lineitem_gaps(spark, folder), _MEASURES))


_RANKS = """SELECT corr(ra, rb) FROM (SELECT avg(pa) OVER (PARTITION BY {a}) AS ra, avg(pb) OVER (PARTITION BY {b}) AS rb FROM (
  SELECT {a}, {b}, row_number() OVER (ORDER BY {a}) AS pa, row_number() OVER (ORDER BY {b}) AS pb
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


@query("correlation_spearman", f"""WITH {LINEITEM_GAPS} SELECT col_a, col_b, round(corr, 6) AS corr FROM ({
    _corr_sql('lineitem_gaps', ['l_quantity', 'l_extendedprice', 'l_discount'], _RANKS)})""")
def correlation_spearman(spark, folder):
    return rounded(corr_matrix(lineitem_gaps(spark, folder), ["l_quantity", "l_extendedprice", "l_discount"], "spearman"))


_TAU = """SELECT sum(x.n * y.n * sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) /
  (sqrt(sum(x.n * y.n * (x.{a} <> y.{a})::int)) * sqrt(sum(x.n * y.n * (x.{b} <> y.{b})::int)))
FROM (SELECT {a}, {b}, count(*)::double AS n FROM {source} GROUP BY 1, 2) x, (SELECT {a}, {b}, count(*)::double AS n FROM {source} GROUP BY 1, 2) y"""


@query("correlation_kendall", f"""SELECT col_a, col_b, round(corr, 6) AS corr FROM ({
    _corr_sql('part', ['p_size', 'p_retailprice', 'p_partkey'], _TAU)})""")
def correlation_kendall(spark, folder):
    return rounded(corr_matrix(table(spark, folder, "part"), ["p_size", "p_retailprice", "p_partkey"], "kendall"))


def _anova_sql(source: str, numerics: list[str], categoricals: list[str]) -> str:
    parts = []
    for c in categoricals:
        for n in numerics:
            parts.append(f"""SELECT '{n}' AS numeric, '{c}' AS categorical, (ssb / (k - 1)) / (ssw / (n - k)) AS f,
  (k - 1)::double AS df1, (n - k)::double AS df2, ssb / (ssb + ssw) AS effect_size,
  CASE WHEN k = 3 THEN pow(1 + 2 * ((ssb / (k - 1)) / (ssw / (n - k))) / (n - k), -(n - k) / 2) END AS p_value FROM (
  SELECT count(*) AS k, sum(cnt) AS n, sum(cnt * (m - gm) * (m - gm)) AS ssb, sum(cnt * vp) AS ssw FROM (
    SELECT *, sum(cnt * m) OVER () / sum(cnt) OVER () AS gm FROM (
      SELECT {c}, count({n}) AS cnt, avg({n}) AS m, var_pop({n}) AS vp FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count({n}) > 1)))""")
    return " UNION ALL ".join(parts)


def _with_p(df):
    # Of three groups the tail of F has a closed form in SQL.
    return rounded(df.withColumn("p_value", F.when(F.col("df1") == 2, F.col("p_value"))))


@query("anova_single", f"""WITH {LINEITEM_GAPS} SELECT numeric, categorical, round(f, 6) AS f, df1, df2, round(effect_size, 6) AS effect_size, round(p_value, 6) AS p_value
FROM ({_anova_sql('lineitem_gaps', ['l_extendedprice'], ['l_returnflag'])})""")
def anova_single(spark, folder):
    return _with_p(anova(lineitem_gaps(spark, folder), "l_extendedprice", "l_returnflag"))


@query("anova_scan", f"""WITH {LINEITEM_GAPS} SELECT numeric, categorical, round(f, 6) AS f, df1, df2, round(effect_size, 6) AS effect_size, round(p_value, 6) AS p_value
FROM ({_anova_sql('lineitem_gaps', _MEASURES, ['l_returnflag', 'l_linestatus', 'l_linenumber'])})""")
def anova_scan(spark, folder):
    return _with_p(scan_relationships(lineitem_gaps(spark, folder), _MEASURES, ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("anova_p_values")
def anova_p_values(spark, folder):
    return rounded(scan_relationships(lineitem_gaps(spark, folder), _MEASURES, ["l_returnflag", "l_linestatus", "l_linenumber"]))
