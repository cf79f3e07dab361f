"""Q: data quality and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import quality as q
from tillstream.plans.registry import register
from tillstream.plans.series_q import trend_frame
from tillstream.sources.testdata import check_lines, daily

_REQ = ("date", "store", "product", "sold", "demand_trend", "cv_7d", "barcode")


@register("q01_required_columns", "column_name:s present:i n_rows:i", """
WITH n AS (SELECT count(*) AS n_rows FROM trend_daily)
SELECT c AS column_name, CAST(c <> 'barcode' AS INT) AS present, n_rows
FROM (VALUES ('date'), ('store'), ('product'), ('sold'), ('demand_trend'), ('cv_7d'), ('barcode')) v(c), n""")
def required_columns(t):
    df = trend_frame(t)
    return q.column_report(df, _REQ).withColumn("n_rows", df.agg(F.count("*")).scalar())


@register("q02_null_counts", "feature:s n_null:i", """
SELECT 'sold' AS feature, count(*) - count(sold) AS n_null FROM trend_daily
UNION ALL SELECT 'demand_trend', count(*) - count(demand_trend) FROM trend_daily
UNION ALL SELECT 'cv_7d', count(*) - count(cv_7d) FROM trend_daily""")
def null_counts(t):
    return q.null_counts(trend_frame(t), ["sold", "demand_trend", "cv_7d", "barcode"])


_NET = """(SELECT date, store, product, sum(CASE event_type WHEN 'sale' THEN qty WHEN 'return' THEN -qty ELSE 0 END) AS sold
  FROM check_lines GROUP BY date, store, product)"""


def _net(t):
    signed = F.when(F.col("event_type") == "sale", F.col("qty")).when(F.col("event_type") == "return", -F.col("qty"))
    return check_lines(t).groupBy("date", "store", "product").agg(F.sum(signed.otherwise(0.0)).alias("sold"))


@register("q03_floors", "n_negative:i n_rows:i n_days:i", f"""
SELECT count(*) FILTER (sold < 0) AS n_negative, count(*) AS n_rows, count(DISTINCT date) AS n_days FROM {_NET}""")
def floors(t):
    return q.floors(_net(t))


@register("q04_duplicate_keys", "n_duplicates:i n_repeated_keys:i", """
SELECT sum(n - 1) AS n_duplicates, count(*) FILTER (n > 1) AS n_repeated_keys
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_keys(t):
    return q.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@register("q05_issue_table", "rule:s severity:s value:f", f"""
SELECT 'negative_target' AS rule, 'error' AS severity, count(*) FILTER (sold < 0) AS value FROM {_NET} HAVING count(*) FILTER (sold < 0) > 0
UNION ALL SELECT 'missing:barcode', 'error', 1
UNION ALL SELECT 'row_floor', 'error', count(*) FROM {_NET} HAVING count(*) < 1000
UNION ALL SELECT 'duplicate_keys', 'error', sum(n - 1) FROM (SELECT count(*) AS n FROM {_NET} GROUP BY date, store) HAVING sum(n - 1) > 0""")
def issue_table(t):
    return q.issue_table(_net(t), ["date", "store", "product", "sold", "barcode"], ["date", "store"])


@register("q06_prediction_drift", "n_recent:i recent_mean:f recent_std:f hist_mean:f hist_std:f drift_ratio:f6 is_drift:i", """
WITH r AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
h AS (SELECT avg(sold) AS hist_mean, stddev_samp(sold) AS hist_std FROM daily),
o AS (SELECT count(*) AS n_recent, avg(value) AS recent_mean, stddev_samp(value) AS recent_std FROM r)
SELECT *, abs(recent_mean - hist_mean) / (hist_std + 1e-8) AS drift_ratio,
  CAST(abs(recent_mean - hist_mean) / (hist_std + 1e-8) > 2 AS INT) AS is_drift FROM o, h WHERE n_recent >= 10""")
def prediction_drift(t):
    log = t("events").select(F.col("ts").alias("timestamp"), F.col("value").alias("prediction"))
    return q.prediction_drift(log, daily(t))
