"""NaN read as missing, operator by operator."""

from __future__ import annotations

from ..operators.features import GroupAggregate, add_group_aggregates
from ..operators.filters import Condition, apply_filters
from ..operators.missing import Fill, fill_missing
from ..operators.outliers import clip_outliers, detect_outliers, mark_outliers
from ..operators.summary import grouped_summary
from ..operators.validation import missing_extremes_warnings, outlier_warnings
from .registry import EVENTS_NAN, events_nan, query, rounded

_IQR = """q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events_nan),
lim AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)"""


@query("nan_filter_greater", f"WITH {EVENTS_NAN} SELECT * FROM events_nan WHERE value > 50")
def nan_filter_greater(spark, folder):
    return apply_filters(events_nan(spark, folder), [Condition("value", ">", "50")])


@query("nan_filter_greater_equal", f"WITH {EVENTS_NAN} SELECT * FROM events_nan WHERE value >= 50")
def nan_filter_greater_equal(spark, folder):
    return apply_filters(events_nan(spark, folder), [Condition("value", ">=", "50")])


@query("nan_fill_mean", f"""WITH {EVENTS_NAN} SELECT event_id, user_id, event_type,
  round(coalesce(value, (SELECT avg(value) FROM events_nan)), 6) AS value FROM events_nan""")
def nan_fill_mean(spark, folder):
    return rounded(fill_missing(events_nan(spark, folder), {"value": Fill("mean")}, default=None))


@query("nan_fill_median", f"""WITH {EVENTS_NAN} SELECT event_id, user_id, event_type,
  round(coalesce(value, (SELECT median(value) FROM events_nan)), 6) AS value FROM events_nan""")
def nan_fill_median(spark, folder):
    return rounded(fill_missing(events_nan(spark, folder), {"value": Fill("median")}, default=None))


@query("nan_clip_iqr", f"""WITH {EVENTS_NAN}, {_IQR} SELECT event_id, user_id, event_type,
  round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events_nan, lim""")
def nan_clip_iqr(spark, folder):
    return rounded(clip_outliers(events_nan(spark, folder), ["value"]))


@query("nan_detect_iqr", f"""WITH {EVENTS_NAN}, {_IQR} SELECT event_id, 'value' AS "column", 'iqr' AS method, round(value, 6) AS value
FROM events_nan, lim WHERE value < lo OR value > hi""")
def nan_detect_iqr(spark, folder):
    return rounded(detect_outliers(events_nan(spark, folder), ["value"], ["event_id"]))


@query("nan_mark_zscore", f"""WITH {EVENTS_NAN}, s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events_nan)
SELECT event_id, coalesce(abs((value - m) / d) > 3, false) AS value_is_outlier_zscore FROM events_nan, s""")
def nan_mark_zscore(spark, folder):
    return mark_outliers(events_nan(spark, folder), ["value"], "zscore").select("event_id", "value_is_outlier_zscore")


@query("nan_outlier_warning", f"""WITH {EVENTS_NAN}, {_IQR} SELECT 'value' AS "column", count(*) AS n_outliers
FROM events_nan, lim WHERE value < lo OR value > hi HAVING count(*) > 0""")
def nan_outlier_warning(spark, folder):
    return outlier_warnings(events_nan(spark, folder), ["value"])


@query("nan_missing_extremes", """SELECT 'value' AS "column" FROM events HAVING count(*) > 0""")
def nan_missing_extremes(spark, folder):
    df = events_nan(spark, folder)
    return missing_extremes_warnings(df.withColumn("value", df["value"] * float("nan")), ["value"])


@query("nan_group_aggregates", f"""WITH {EVENTS_NAN}, g AS (SELECT event_type, avg(value) AS mean_value, sum(value) AS sum_value,
  stddev_samp(value) AS std_value, count(value) AS n_value FROM events_nan GROUP BY 1)
SELECT event_id, round(mean_value, 6) AS mean_value, round(sum_value, 6) AS sum_value, round(std_value, 6) AS std_value, n_value
FROM events_nan JOIN g USING (event_type)""")
def nan_group_aggregates(spark, folder):
    wanted = [GroupAggregate(n, "event_type", "value", f) for n, f in (("mean_value", "mean"), ("sum_value", "sum"), ("std_value", "std"), ("n_value", "count"))]
    return rounded(add_group_aggregates(events_nan(spark, folder), wanted).select("event_id", *[w.name for w in wanted]))


@query("nan_grouped_summary", f"""WITH {EVENTS_NAN} SELECT event_type, count(value) AS value_count, round(avg(value), 6) AS value_mean,
  round(median(value), 6) AS value_median, round(stddev_samp(value), 6) AS value_std, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max
FROM events_nan GROUP BY 1""")
def nan_grouped_summary(spark, folder):
    return rounded(grouped_summary(events_nan(spark, folder), "event_type", ["value"]))
