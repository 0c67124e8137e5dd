"""Missing values, outliers, labels, duplicates and warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.duplicates import drop_duplicates, duplicate_rows, partial_duplicates
from ..operators.labels import clean_labels, suggest_merges
from ..operators.missing import Fill, fill_missing
from ..operators.outliers import clip_outliers, detect_outliers, mark_outliers
from ..operators.validation import (
    imbalance_warnings, missing_extremes_warnings, outlier_warnings, validate,
)
from .registry import (
    CUSTOMER_GAPS, EVENTS_GAPS, LINEITEM_GAPS, LINEITEM_KEY, customer_gaps, events_gaps, lineitem_gaps,
    query, rounded, table,
)

_KEYS = ", ".join(LINEITEM_KEY)


def _only(column: str, fill: Fill, order_by=None):
    def run(spark, folder):
        df = lineitem_gaps(spark, folder).select(*LINEITEM_KEY, column)
        return rounded(fill_missing(df, {column: fill}, order_by=order_by, default=None))

    return run


query("missing_drop_rows", f"WITH {LINEITEM_GAPS} SELECT {_KEYS}, l_quantity FROM lineitem_gaps WHERE l_quantity IS NOT NULL")(
    _only("l_quantity", Fill("drop"))
)
query("missing_fill_mean", f"""WITH {LINEITEM_GAPS}
SELECT {_KEYS}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM lineitem_gaps)), 6) AS l_quantity
FROM lineitem_gaps""")(_only("l_quantity", Fill("mean")))
query("missing_fill_median", f"""WITH {LINEITEM_GAPS}
SELECT {_KEYS}, round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM lineitem_gaps)), 6) AS l_discount
FROM lineitem_gaps""")(_only("l_discount", Fill("median")))
query("missing_fill_mode", f"""WITH {LINEITEM_GAPS},
best AS (SELECT l_returnflag AS v FROM lineitem_gaps WHERE l_returnflag IS NOT NULL
         GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT {_KEYS}, coalesce(l_returnflag, (SELECT v FROM best)) AS l_returnflag FROM lineitem_gaps""")(
    _only("l_returnflag", Fill("mode"))
)
query("missing_fill_constant", f"""WITH {LINEITEM_GAPS}
SELECT {_KEYS}, coalesce(l_returnflag, 'unknown') AS l_returnflag FROM lineitem_gaps""")(
    _only("l_returnflag", Fill("constant", constant="unknown"))
)


def _carry(strategy):
    def run(spark, folder):
        df = events_gaps(spark, folder).select("event_id", "value")
        return fill_missing(df, {"value": Fill(strategy)}, order_by=["event_id"], default=None)

    return run


query("missing_forward_fill", f"""WITH {EVENTS_GAPS}
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events_gaps""")(_carry("ffill"))
query("missing_backward_fill", f"""WITH {EVENTS_GAPS}
SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events_gaps""")(_carry("bfill"))


@query("missing_forward_fill_by_time", f"""WITH {EVENTS_GAPS}
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events_gaps""")
def missing_forward_fill_by_time(spark, folder):
    df = events_gaps(spark, folder).select("event_id", "ts", "value")
    return fill_missing(df, {"value": Fill("ffill")}, order_by=["ts", "event_id"], default=None).drop("ts")


@query("missing_fill_group_median", f"""WITH {CUSTOMER_GAPS},
cust AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer_gaps),
med AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS m FROM cust WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
SELECT c_custkey, c.c_mktsegment, round(coalesce(c_acctbal, m), 6) AS c_acctbal
FROM cust c LEFT JOIN med ON c.c_mktsegment = med.c_mktsegment""")
def missing_fill_group_median(spark, folder):
    df = customer_gaps(spark, folder).select("c_custkey", "c_mktsegment", "c_acctbal")
    df = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    fill = Fill("by_group", group_by="c_mktsegment")
    return rounded(fill_missing(df, {"c_acctbal": fill}, default=None))


@query("missing_fill_group_mode", f"""WITH {CUSTOMER_GAPS},
counts AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer_gaps
           WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY ALL),
best AS (SELECT c_nationkey, c_mktsegment AS m FROM counts
         QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
SELECT c_custkey, c.c_nationkey, coalesce(c_mktsegment, m) AS c_mktsegment
FROM customer_gaps c LEFT JOIN best ON c.c_nationkey = best.c_nationkey""")
def missing_fill_group_mode(spark, folder):
    df = customer_gaps(spark, folder).select("c_custkey", "c_nationkey", "c_mktsegment")
    fill = Fill("by_group", group_by="c_nationkey")
    return fill_missing(df, {"c_mktsegment": fill}, default=None)


@query("missing_fill_auto", f"""WITH {LINEITEM_GAPS},
flag AS (SELECT l_returnflag AS v FROM lineitem_gaps WHERE l_returnflag IS NOT NULL
         GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT {_KEYS}, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_gaps)) AS l_quantity,
  l_extendedprice, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM lineitem_gaps)) AS l_discount,
  l_tax, coalesce(l_returnflag, (SELECT v FROM flag)) AS l_returnflag, l_linestatus, l_shipdate
FROM lineitem_gaps""")
def missing_fill_auto(spark, folder):
    return fill_missing(lineitem_gaps(spark, folder))


@query("missing_drop_then_fill", f"""WITH {LINEITEM_GAPS},
kept AS (SELECT * FROM lineitem_gaps WHERE l_quantity IS NOT NULL)
SELECT {_KEYS}, l_quantity, round(coalesce(l_discount, (SELECT avg(l_discount) FROM kept)), 6) AS l_discount FROM kept""")
def missing_drop_then_fill(spark, folder):
    df = lineitem_gaps(spark, folder).select(*LINEITEM_KEY, "l_quantity", "l_discount")
    fills = {"l_quantity": Fill("drop"), "l_discount": Fill("mean")}
    return rounded(fill_missing(df, fills, default=None))


_BOUNDS = """bounds AS (
  SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"""


@query("outliers_clip_iqr", f"""WITH {_BOUNDS.format(c='value', t='events')}
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value
FROM events, bounds""")
def outliers_clip_iqr(spark, folder):
    return rounded(clip_outliers(table(spark, folder, "events").select("event_id", "value"), ["value"]))


@query("outliers_detect_iqr", f"""WITH {_BOUNDS.format(c='value', t='events')}
SELECT event_id, 'value' AS "column", 'iqr' AS method, value FROM events, bounds WHERE value < lo OR value > hi""")
def outliers_detect_iqr(spark, folder):
    return detect_outliers(table(spark, folder, "events"), ["value"], ["event_id"])


@query("outliers_detect_zscore", """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT event_id, 'value' AS "column", 'zscore' AS method, value FROM events, s WHERE abs((value - m) / sd) > 3""")
def outliers_detect_zscore(spark, folder):
    return detect_outliers(table(spark, folder, "events"), ["value"], ["event_id"], "zscore")


@query("outliers_mark", f"""WITH {_BOUNDS.format(c='l_extendedprice', t='lineitem')}
SELECT {_KEYS}, l_quantity, l_extendedprice, false AS l_quantity_is_outlier_iqr,
  (l_extendedprice < lo OR l_extendedprice > hi) AS l_extendedprice_is_outlier_iqr FROM lineitem, bounds""")
def outliers_mark(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINEITEM_KEY, "l_quantity", "l_extendedprice")
    return mark_outliers(df, ["l_quantity", "l_extendedprice"])


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({c}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:]), '')"


@query("labels_trim", """SELECT conv_id, turn, regexp_replace(' ' || role || chr(9), '^\\s+|\\s+$', '', 'g') AS role,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations""")
def labels_trim(spark, folder):
    df = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    df = df.withColumn("role", F.concat(F.lit(" "), "role", F.lit("\t")))
    return clean_labels(df, ["role", "text"], title=False)


@query("labels_title_case", f"""SELECT doc_id, {_TITLE.format(c="regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} AS text,
  {_TITLE.format(c='lang')} AS lang, {_TITLE.format(c='source')} AS source FROM documents""")
def labels_title_case(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return clean_labels(df, ["text", "lang", "source"])


@query("labels_known_mapping", f"""SELECT c_custkey, CASE {_TITLE.format(c='c_mktsegment')}
  WHEN 'Furniture' THEN 'Home' WHEN 'Household' THEN 'Home' WHEN 'Building' THEN 'Construction'
  ELSE {_TITLE.format(c='c_mktsegment')} END AS c_mktsegment FROM customer""")
def labels_known_mapping(spark, folder):
    mapping = {"furniture": "Home", "HOUSEHOLD": "Home", "Building": "Construction"}
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return clean_labels(df, ["c_mktsegment"], mappings={"c_mktsegment": mapping})


@query("labels_merge_suggestions", """WITH l AS (SELECT DISTINCT p_name AS v FROM part)
SELECT x.v AS a, y.v AS b, round(1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v))::double, 6) AS score
FROM l x JOIN l y ON x.v < y.v
WHERE 1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v))::double >= 0.7""")
def labels_merge_suggestions(spark, folder):
    return rounded(suggest_merges(table(spark, folder, "part"), "p_name", 0.7))


@query("duplicates_drop_exact", "SELECT DISTINCT text, lang FROM documents")
def duplicates_drop_exact(spark, folder):
    return drop_duplicates(table(spark, folder, "documents").select("text", "lang"))


def _keep(which, direction):
    sql = f"""SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id {direction}) = 1"""

    @query(f"duplicates_keep_{which}", sql)
    def run(spark, folder):
        return drop_duplicates(table(spark, folder, "documents"), ["text"], which, ["doc_id"])


_keep("first", "ASC")
_keep("last", "DESC")


@query("duplicates_keep_none", """SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY count(*) OVER (PARTITION BY text) = 1""")
def duplicates_keep_none(spark, folder):
    return drop_duplicates(table(spark, folder, "documents"), ["text"], False)


@query("duplicates_report", """SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY count(*) OVER (PARTITION BY text, lang) > 1 ORDER BY text, lang""")
def duplicates_report(spark, folder):
    return duplicate_rows(table(spark, folder, "documents"), ["text", "lang"])


@query("duplicates_partial", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def duplicates_partial(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return partial_duplicates(df, ["l_orderkey", "l_linenumber"])


@query("warnings_imbalance", """WITH c AS (SELECT toxic::varchar AS v, count(*) AS n FROM labels GROUP BY 1),
q AS (SELECT quality::varchar AS v, count(*) AS n FROM labels GROUP BY 1),
m AS (SELECT 'toxic' AS "column", arg_min(v, (-n, v)) AS top_category, max(n) / sum(n) AS top_fraction FROM c
      UNION ALL SELECT 'quality', arg_min(v, (-n, v)), max(n) / sum(n) FROM q)
SELECT "column", top_category, round(top_fraction::double, 6) AS top_fraction FROM m WHERE top_fraction >= 0.7""")
def warnings_imbalance(spark, folder):
    return rounded(imbalance_warnings(table(spark, folder, "labels"), ["toxic", "quality"], 0.7))


@query("warnings_outliers", """WITH v AS (
  SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
SELECT "column", count(*) AS n_outliers FROM v JOIN q USING ("column")
WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def warnings_outliers(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return outlier_warnings(table(spark, folder, "lineitem"), columns)


@query("warnings_missing_extremes", """SELECT 'empty_amount' AS "column" FROM events
HAVING count(CASE WHEN event_id < 0 THEN value END) = 0 AND count(*) > 0""")
def warnings_missing_extremes(spark, folder):
    df = table(spark, folder, "events").withColumn("empty_amount", F.when(F.col("event_id") < 0, F.col("value")))
    return missing_extremes_warnings(df, ["event_id", "value", "empty_amount"])


@query("warnings_all", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
v AS (SELECT count(*)::double AS n FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)),
t AS (SELECT 'x' AS event_group, count(*) AS n FROM events)
SELECT 'outliers' AS "check", 'value' AS "column", NULL::varchar AS detail, n AS value FROM v WHERE n > 0
UNION ALL SELECT 'imbalance', 'event_group', 'x', 1.0::double FROM t WHERE n > 0""")
def warnings_all(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", "event_type")
    df = df.withColumn("event_group", F.when(F.col("event_type").isNotNull(), F.lit("x")))
    return validate(df)
