"""Typing, filters, projections, joins, relationships and incremental loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import DATETIME_FORMATS
from ..operators.filters import (
    Condition, apply_filters, filter_count, preview, preview_filter, project, select_by_type,
)
from ..operators.joins import common_columns, join_tables, preview_join
from ..operators.relations import detect_relationships
from ..operators.types import cast_types, infer_schema
from ..plans.load import auto_type
from ..session import ensure_checkpoint_dir
from ..sources.csv import read_csv, write_csv
from ..sources.datasets import write_datasets
from ..sources.incremental import read_incremental, rows_after
from ..sources.xml import read_xml
from .registry import (
    CUSTOMER_GAPS, LINEITEM_KEY, as_text, customer_gaps, query, rounded, table,
)

_KEYS = ", ".join(LINEITEM_KEY)

# --- typing ---------------------------------------------------------------------------

_TEXT_TYPES = {
    "lineitem": {
        "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
        "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
        "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime",
    }
}


def _infer_sql(source: str, columns: list[str]) -> str:
    number = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"
    parts = [
        f"""SELECT '{c}' AS "column", count(v) AS n_values,
  count(CASE WHEN regexp_full_match(v, {number}) THEN 1 END) / count(v)::double AS numeric_frac,
  count(coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(v, '%Y-%m-%d %H:%M:%S'))) / count(v)::double AS datetime_frac,
  count(DISTINCT lower(v)) <= 2 AND bool_and(lower(v) IN ('true','false','yes','no','1','0','t','f')) AS boolean_like
FROM (SELECT {c}::varchar AS v FROM {source})"""
        for c in columns
    ]
    return f"""SELECT "column", n_values, round(numeric_frac, 6) AS numeric_frac, round(datetime_frac, 6) AS datetime_frac,
  CASE WHEN n_values = 0 THEN 'categorical' WHEN numeric_frac >= 0.95 THEN 'numeric'
       WHEN datetime_frac > 0.7 THEN 'datetime' WHEN boolean_like THEN 'boolean' ELSE 'categorical' END AS logical_type
FROM ({' UNION ALL '.join(parts)})"""


def _infer(name, columns):
    @query(f"types_infer_{name}", _infer_sql(name, columns))
    def run(spark, folder):
        found = infer_schema(as_text(table(spark, folder, name).select(*columns)))
        return rounded(found.select("column", "n_values", "numeric_frac", "datetime_frac", "logical_type"))


_infer("lineitem", list(_TEXT_TYPES["lineitem"]))
_infer("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
_infer("documents", ["doc_id", "text", "lang", "source", "n_chars"])


@query("types_cast_numeric", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events""")
def types_cast_numeric(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.col("value").cast("string").alias("value"))
    # Every tenth value carries a suffix that only a lenient parser would take for a number.
    df = df.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.concat("value", F.lit("d"))).otherwise(F.col("value")))
    return cast_types(df, {"value": "numeric"})


@query("types_cast_datetime", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders""")
def types_cast_datetime(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.date_format("o_orderdate", "MM/dd/yyyy")
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, odd).otherwise(day).alias("o_orderdate")
    )
    return cast_types(df, {"o_orderdate": "datetime"}, datetime_format="yyyy-MM-dd")


@query("types_cast_boolean", """SELECT doc_id, quality = 1 AS quality,
  CASE WHEN toxic = 1 THEN true WHEN doc_id % 2 = 0 THEN false END AS toxic FROM labels""")
def types_cast_boolean(spark, folder):
    df = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality"),
        F.when(F.col("toxic") == 1, F.lit(" YES ")).when(F.col("doc_id") % 2 == 0, F.lit("n")).otherwise(F.lit("maybe")).alias("toxic"),
    )
    return cast_types(df, {"quality": "boolean", "toxic": "boolean"})


@query("types_cast_categorical", "SELECT p_partkey, p_size::varchar AS p_size, p_brand FROM part")
def types_cast_categorical(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_brand")
    order = [str(i) for i in range(1, 51)]
    return cast_types(df, {"p_size": "ordinal", "p_brand": "categorical"}, levels={"p_size": order})


@query("types_errors_ignore", """SELECT event_id, value, event_type FROM events""")
def types_errors_ignore(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.col("value").cast("string").alias("value"), "event_type")
    return cast_types(df, {"value": "numeric", "event_type": "numeric"}, errors="ignore")


@query("types_errors_raise", """SELECT event_id, value FROM events""")
def types_errors_raise(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.col("value").cast("string").alias("value"))
    return cast_types(df, {"value": "numeric"}, errors="raise")


@query("types_override", """SELECT 'p_size' AS "column", 'categorical' AS logical_type, count(p_size) AS n_values FROM part
UNION ALL SELECT 'p_brand', 'categorical', count(p_brand) FROM part
UNION ALL SELECT 'p_retailprice', 'numeric', count(p_retailprice) FROM part""")
def types_override(spark, folder):
    df = as_text(table(spark, folder, "part").select("p_size", "p_brand", "p_retailprice"))
    return infer_schema(df, {"p_size": "categorical"}).select("column", "logical_type", "n_values")


@query("types_load_infer_cast", f"""SELECT l_orderkey::double AS l_orderkey, l_partkey::double AS l_partkey,
  l_suppkey::double AS l_suppkey, l_linenumber::double AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate FROM lineitem""")
def types_load_infer_cast(spark, folder):
    return auto_type(as_text(table(spark, folder, "lineitem")))


# --- filters and projections ----------------------------------------------------------


def _filter(name, source, columns, conditions, where):
    @query(name, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}")
    def run(spark, folder):
        return apply_filters(table(spark, folder, source).select(*columns), conditions)


_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_filter("filter_greater", "orders", _ORDER, [Condition("o_totalprice", ">", "300000")], "o_totalprice > 300000")
_filter("filter_greater_equal", "orders", _ORDER, [Condition("o_orderdate", ">=", "1997-06-01")], "o_orderdate >= TIMESTAMP '1997-06-01'")
_filter("filter_less", "lineitem", [*LINEITEM_KEY, "l_discount"], [Condition("l_discount", "<", "0.03")], "l_discount < 0.03")
_filter("filter_less_equal", "part", ["p_partkey", "p_size"], [Condition("p_size", "<=", "10")], "p_size <= 10")
_filter("filter_equal", "orders", _ORDER, [Condition("o_orderstatus", "==", "F")], "o_orderstatus = 'F'")
_filter("filter_contains_regex", "documents", ["doc_id", "lang", "text"], [Condition("text", "contains", "th.re")], "regexp_matches(text, 'th.re')")
_filter("filter_in_list", "orders", _ORDER, [Condition("o_orderpriority", "in", "1-URGENT, 2-HIGH")], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("filter_in_numbers", "part", ["p_partkey", "p_size"], [Condition("p_size", "in", "1, 5, 9")], "p_size IN (1, 5, 9)")
_filter("filter_between", "lineitem", [*LINEITEM_KEY, "l_quantity"], [Condition("l_quantity", "between", "10, 20")], "l_quantity BETWEEN 10 AND 20")
_filter(
    "filter_and_combination", "orders", _ORDER,
    [Condition("o_orderstatus", "!=", "P"), Condition("o_totalprice", "<", "100000"), Condition("no_such_column", "==", "1"),
     Condition("o_orderkey", "unknown operator", "1"), Condition("o_orderpriority", "contains", "^[1-3]")],
    "o_orderstatus <> 'P' AND o_totalprice < 100000 AND regexp_matches(o_orderpriority, '^[1-3]')",
)


def _gap_filter(name, condition, where):
    @query(name, f"WITH {CUSTOMER_GAPS} SELECT c_custkey, c_nationkey, c_mktsegment FROM customer_gaps WHERE {where}")
    def run(spark, folder):
        return apply_filters(customer_gaps(spark, folder).select("c_custkey", "c_nationkey", "c_mktsegment"), [condition])


_gap_filter("filter_not_equal_keeps_null", Condition("c_mktsegment", "!=", "BUILDING"), "c_mktsegment IS DISTINCT FROM 'BUILDING'")
_gap_filter("filter_not_in_keeps_null", Condition("c_nationkey", "not in", "1, 2, 3"), "c_nationkey IS NULL OR c_nationkey NOT IN (1, 2, 3)")


@query("filter_count", "SELECT count(*) AS rows FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus = 'O'")
def filter_rows(spark, folder):
    return filter_count(table(spark, folder, "orders"), [Condition("o_totalprice", ">=", "200000"), Condition("o_orderstatus", "==", "O")])


@query("filter_preview", f"SELECT {', '.join(_ORDER)} FROM orders WHERE o_totalprice >= 200000 ORDER BY o_orderkey LIMIT 20")
def filter_preview(spark, folder):
    return preview_filter(table(spark, folder, "orders"), [Condition("o_totalprice", ">=", "200000")], order_by=["o_orderkey"])


@query("project_columns", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def project_columns(spark, folder):
    return project(table(spark, folder, "lineitem"), ["l_orderkey", "l_extendedprice"])


@query("project_by_type", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project_by_type(spark, folder):
    return select_by_type(table(spark, folder, "orders"), "numeric")


# --- joins ----------------------------------------------------------------------------


def _nations(spark, folder):
    """All nations under shifted keys: one key is null and some match no customer."""
    df = table(spark, folder, "nation")
    key = F.when(F.col("n_nationkey") != 3, F.col("n_nationkey") + 5)
    return df.select(key.alias("c_nationkey"), F.col("n_name").alias("c_name"), "n_regionkey")


_JOIN_CTE = f"""{CUSTOMER_GAPS}, n AS (
  SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey + 5 END AS c_nationkey, n_name AS c_name, n_regionkey
  FROM nation)"""
_JOINS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN", "sideways": "JOIN"}


def _join(how):
    sql = f"""WITH {_JOIN_CTE}
SELECT c.c_custkey, c.c_name AS c_name_left, {"n.c_nationkey" if how == "right" else "coalesce(c.c_nationkey, n.c_nationkey)"} AS c_nationkey,
  c.c_acctbal, c.c_mktsegment, n.c_name AS c_name_right, n.n_regionkey
FROM customer_gaps c {_JOINS[how]} n ON c.c_nationkey IS NOT DISTINCT FROM n.c_nationkey"""
    name = {"outer": "join_full_outer", "sideways": "join_unknown_kind_is_inner"}.get(how, f"join_{how}")

    @query(name, sql)
    def run(spark, folder):
        return join_tables(customer_gaps(spark, folder), _nations(spark, folder), "c_nationkey", how.upper())


for _how in _JOINS:
    _join(_how)


@query("join_two_keys", f"""SELECT {_KEYS}, a.l_quantity AS l_quantity_left, b.l_quantity AS l_quantity_right
FROM lineitem a JOIN lineitem b USING ({_KEYS})""")
def join_two_keys(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINEITEM_KEY, "l_quantity")
    return join_tables(df, df, LINEITEM_KEY)


@query("join_cross", """SELECT n.n_nationkey, n.n_name, n.n_regionkey, r.r_regionkey, r.r_name FROM nation n CROSS JOIN region r""")
def join_cross(spark, folder):
    return join_tables(table(spark, folder, "nation"), table(spark, folder, "region"), how="cross")


@query("join_chain", """SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def join_chain(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = join_tables(join_tables(lines, table(spark, folder, "orders"), "o_orderkey"), customers, "o_custkey")
    return joined.groupBy("o_orderpriority", "c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("join_preview", """SELECT n_nationkey, n_name, n_regionkey, s_suppkey, s_name, s_acctbal FROM nation
JOIN supplier ON s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 100""")
def join_preview(spark, folder):
    suppliers = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return preview_join(table(spark, folder, "nation"), suppliers, "n_nationkey", order_by=["s_suppkey"])


@query("table_preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 100")
def table_preview(spark, folder):
    return preview(table(spark, folder, "part"), order_by=["p_partkey"])


@query("join_candidate_columns", """SELECT 'doc_id' AS "column", count(*) AS rows FROM labels""")
def join_candidate_columns(spark, folder):
    labels = table(spark, folder, "labels")
    shared = common_columns(labels, table(spark, folder, "documents"))
    return labels.agg(F.count("*").alias("rows")).select(F.explode(F.array(*map(F.lit, shared))).alias("column"), "rows")


# --- relationships and incremental loads ----------------------------------------------

# Every whole-number and text column of every table, for the SQL; the operator finds them itself.
_WHOLE = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"], "labels": ["doc_id", "quality", "toxic"], "embeddings": ["vec_id", "label"],
    "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
_TEXT = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"],
    "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}


def _relationship_sql() -> str:
    every = [(k, t, c) for k, tables in (("whole", _WHOLE), ("text", _TEXT)) for t, cs in tables.items() for c in cs]
    values = " UNION ALL ".join(f"SELECT '{k}' AS k, '{t}' AS t, '{c}' AS c, {c}::varchar AS v, count(*) AS n FROM {t} GROUP BY {c}" for k, t, c in every)
    return f"""WITH vals AS MATERIALIZED ({values}),
keys AS (SELECT t, c FROM vals GROUP BY t, c HAVING max(n) = 1 AND count(v) = count(*)),
totals AS (SELECT t, c, sum(n) AS rows FROM vals WHERE v IS NOT NULL GROUP BY t, c),
hits AS (SELECT k.t AS parent, x.t AS child, k.c AS parent_col, x.c AS child_col, sum(x.n) AS found
  FROM vals x JOIN vals p ON x.v = p.v AND x.k = p.k AND x.t <> p.t JOIN keys k ON k.t = p.t AND k.c = p.c GROUP BY ALL)
SELECT parent, child, parent_col, child_col, (found / rows)::double AS coverage
FROM hits JOIN totals ON totals.t = child AND totals.c = child_col WHERE found = rows"""


@query("relationships_discover", _relationship_sql())
def relationships_discover(spark, folder):
    return detect_relationships({t: table(spark, folder, t) for t in _WHOLE})


@query("relationships_partial_coverage", """SELECT 'labels' AS parent, 'documents' AS child, 'doc_id' AS parent_col, 'doc_id' AS child_col,
  round((SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM documents)::double, 6) AS coverage
UNION ALL SELECT 'documents', 'labels', 'doc_id', 'doc_id',
  round((SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) / (SELECT count(*) FROM labels)::double, 6)""")
def relationships_partial_coverage(spark, folder):
    tables = {"labels": table(spark, folder, "labels").select("doc_id"), "documents": table(spark, folder, "documents").select("doc_id")}
    return rounded(detect_relationships(tables, min_coverage=0.1))


@query("incremental_rows_after", """WITH w AS (SELECT quantile_disc(event_id, 0.5) AS k FROM events)
SELECT event_id, ts, user_id, event_type, value FROM events, w WHERE event_id > k""")
def incremental_rows_after(spark, folder):
    events = table(spark, folder, "events").drop("props")
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").alias("k")).first()["k"]
    return rows_after(events, "event_id", int(middle))


@query("types_datetime_layouts", """SELECT o_orderkey, o_orderdate FROM orders""")
def types_datetime_layouts(spark, folder):
    """Dates written in the layouts inference knows, by order key, read back without a layout."""
    # Day-first dates cannot be told from month-first ones value by value: the next query has them.
    layouts = [f for f in DATETIME_FORMATS if "SSSSSS" not in f and f != "dd/MM/yyyy"]
    written = F.element_at(
        F.array(*[F.date_format("o_orderdate", f) for f in layouts]), (F.col("o_orderkey") % len(layouts) + 1).cast("int")
    )
    df = table(spark, folder, "orders").select("o_orderkey", written.alias("o_orderdate"))
    return cast_types(df, {"o_orderdate": "datetime"})


@query("types_datetime_day_first", "SELECT o_orderkey, o_orderdate FROM orders")
def types_datetime_day_first(spark, folder):
    """The layout that reads most values of a column is used for all of them."""
    written = F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate")
    return auto_type(table(spark, folder, "orders").select("o_orderkey", written))


def _scratch(spark, name):
    """A new folder below the shared one that the session names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT c_custkey::varchar AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    path = _scratch(spark, "csv")
    write_csv(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return read_csv(spark, path)


@query("datasets_round_trip", "SELECT * FROM orders")
def datasets_round_trip(spark, folder):
    path = _scratch(spark, "datasets")
    write_datasets({"raw": table(spark, folder, "orders")}, path, "orc")
    return spark.read.orc(f"{path}/raw")


@query("xml_round_trip", "SELECT n_nationkey::varchar AS n_nationkey, n_name FROM nation")
def xml_round_trip(spark, folder):
    path = _scratch(spark, "xml")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    nation.write.option("rowTag", "nation").xml(path)
    return read_xml(spark, path, "nation").select("n_nationkey", "n_name")


@query("incremental_two_loads", """WITH w AS (SELECT quantile_disc(event_id, 0.5) AS k FROM events)
SELECT event_id, user_id, value FROM events, w WHERE event_id > k""")
def incremental_two_loads(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    state = _scratch(spark, "state")
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").alias("k")).first()["k"]
    first = read_incremental(events.where(F.col("event_id") <= int(middle)), "event_id", state, "events")
    first.commit()
    return read_incremental(events, "event_id", state, "events").rows
