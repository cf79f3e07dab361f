"""J: keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.functions import weather as wx
from tillstream.operators import joins
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.sources.testdata import daily, daily_prices, hourly, weather

add_base("weather_full", """
SELECT *, temp_max - temp_min AS temp_range, CAST(rain > 1 AS INT) AS is_rainy, CAST(snowfall > 0.5e0 AS INT) AS is_snowy,
  CAST(temp_mean < 0 AS INT) AS is_cold, CAST(temp_mean >= 15 AS INT) AS is_warm, CAST(windspeed_max > 30 AS INT) AS is_windy,
  CAST(rain > 1 OR snowfall > 0.5e0 OR windspeed_max > 30 AS INT) AS is_bad_weather,
  CASE WHEN weathercode = 0 THEN 0 WHEN weathercode <= 3 THEN 1 WHEN weathercode <= 48 THEN 2 WHEN weathercode <= 67 THEN 3
       WHEN weathercode <= 77 THEN 5 WHEN weathercode <= 82 THEN 3 ELSE 6 END AS weather_cat_code
FROM weather""")


def _weather_full(t):
    return weather(t).transform(wx.add_weather_flags).transform(wx.add_weather_category).drop(
        "weather_category", "weathercode")


@register("j01_last_hour", "store:i product:s date:d hour:i qty:f last_hour:i", """
SELECT *, max(hour) OVER (PARTITION BY store, product, date) AS last_hour FROM hourly""")
def last_hour(t):
    return joins.with_last_hour(hourly(t))


@register("j02_eligible_pairs", "store:i product:s date:d hour:i qty:f", """
WITH lh AS (SELECT store, product, date, max(hour) AS last_hour FROM hourly GROUP BY store, product, date),
e AS (SELECT store, product FROM lh WHERE last_hour >= 17 GROUP BY store, product HAVING count(*) >= 5)
SELECT h.* FROM hourly h JOIN lh USING (store, product, date) JOIN e USING (store, product) WHERE last_hour >= 17""")
def eligible_pairs(t):
    full = joins.with_last_hour(hourly(t)).filter(F.col("last_hour") >= 17)
    pairs = full.groupBy("store", "product").agg(F.countDistinct("date").alias("n")).filter(F.col("n") >= 5)
    return joins.matched(full, pairs, ["store", "product"])


@register("j04_weather_join", "date:d store:i product:s temp_mean:f is_bad_weather:i weather_cat_code:i is_matched:i", """
SELECT d.date, d.store, d.product, coalesce(temp_mean, 0) AS temp_mean, coalesce(is_bad_weather, 0) AS is_bad_weather,
       coalesce(weather_cat_code, 0) AS weather_cat_code, CASE WHEN w.city IS NULL THEN 0 ELSE 1 END AS is_matched
FROM daily d LEFT JOIN weather_full w ON d.city = w.city AND d.date = w.date""")
def weather_join(t):
    return joins.attach_filled(daily(t), _weather_full(t), ["city", "date"])


@register("j04_weather_match_rate", "n_rows:i n_matched:i match_rate:f6", """
SELECT count(*) AS n_rows, count(w.city) AS n_matched, count(w.city) / count(*)::DOUBLE AS match_rate
FROM daily d LEFT JOIN weather w ON d.city = w.city AND d.date = w.date""")
def weather_match_rate(t):
    return joins.match_rate(joins.attach_filled(daily(t), _weather_full(t), ["city", "date"]))


_HOL = "(101,102,103,104,105,106,107,108,223,308,501,509,612,1104)"


@register("j05_calendar_join", "date:d store:i product:s sold:f dow:i is_holiday:i is_payday_week:i", f"""
SELECT date, store, product, sold, isodow(date) - 1 AS dow,
       CAST(month(date) * 100 + day(date) IN {_HOL} AS INT) AS is_holiday,
       CAST(day(date) IN (4,5,6,19,20,21) AS INT) AS is_payday_week FROM daily""")
def calendar_join(t):
    d = daily(t).withColumn("is_holiday", F.lit(9))  # an overlapping column is replaced
    return joins.attach_calendar(d, joins.calendar_table(d))


@register("j06_price_join", "date:d store:i product:s sold:f avg_price:f", """
SELECT d.date, d.store, d.product, d.sold, p.avg_price FROM daily d
LEFT JOIN daily_prices p USING (date, store, product)""")
def price_join(t):
    prices = daily_prices(t)
    return daily(t).transform(joins.attach_price, prices).transform(joins.attach_price, prices)


@register("j07_lag_exact_days", "date:d store:i product:s lag_core:f", """
SELECT d.date, d.store, d.product,
  CASE WHEN a.sold IS NULL THEN b.sold WHEN b.sold IS NULL THEN a.sold ELSE (a.sold + b.sold) / 2 END AS lag_core
FROM daily d LEFT JOIN daily a ON a.store = d.store AND a.product = d.product AND a.date = d.date - 7
LEFT JOIN daily b ON b.store = d.store AND b.product = d.product AND b.date = d.date - 14""")
def lag_exact_days(t):
    return joins.lag_mean(daily(t), "sold")


@register("j08_as_of", "date:d store:i product:s asof_7:f asof_14:f", """
SELECT d.date, d.store, d.product, a.sold AS asof_7, b.sold AS asof_14
FROM (SELECT *, date - 7 AS d7, date - 14 AS d14 FROM daily) d
ASOF LEFT JOIN daily a ON a.store = d.store AND a.product = d.product AND d.d7 >= a.date
ASOF LEFT JOIN daily b ON b.store = d.store AND b.product = d.product AND d.d14 >= b.date""")
def as_of(t):
    d = daily(t)
    return joins.as_of(joins.as_of(d, d, "sold", 7, "asof_7"), d, "sold", 14, "asof_14")


@register("j10_one_to_one", "store:i product:s n_days:i total:f", """
SELECT store, product, count(*) AS n_days, sum(sold) AS total FROM daily GROUP BY store, product""")
def one_to_one(t):
    d = daily(t)
    a = d.groupBy("store", "product").agg(F.count("*").alias("n_days"))
    b = d.groupBy("store", "product").agg(F.sum("sold").alias("total"))
    return joins.one_to_one(a, b, ["store", "product"])


@register("j11_hour_grid", "store:i product:s hour:i qty:f", """
SELECT p.store, p.product, h.hour, x.qty FROM (SELECT DISTINCT store, product FROM hourly) p,
  (SELECT unnest(range(24)) AS hour) h
LEFT JOIN (SELECT store, product, hour, sum(qty) AS qty FROM hourly GROUP BY store, product, hour) x
  ON x.store = p.store AND x.product = p.product AND x.hour = h.hour""")
def hour_grid(t):
    per = hourly(t).groupBy("store", "product", "hour").agg(F.sum("qty").alias("qty"))
    return joins.complete_hours(per, ["store", "product"])


@register("j12_dense_calendar", "store:i product:s date:d sold:f", """
WITH span AS (SELECT store, product, min(date) AS a, max(date) AS b FROM daily GROUP BY store, product),
grid AS (SELECT store, product, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT g.store, g.product, g.date, coalesce(sold, 0) AS sold
FROM grid g LEFT JOIN daily d ON g.store = d.store AND g.product = d.product AND g.date = d.date""")
def dense_calendar(t):
    return joins.dense_calendar(daily(t), "sold")


@register("j14_unmatched_stores", "city:s date:d", """
SELECT DISTINCT city, date FROM daily EXCEPT SELECT city, date FROM weather""")
def unmatched_stores(t):
    return joins.unmatched(daily(t), weather(t), ["city", "date"])


@register("j14_matched_stores", "store:i n_rows:i", """
SELECT store, count(*) AS n_rows FROM daily d WHERE EXISTS
  (SELECT 1 FROM weather w WHERE w.city = d.city AND w.date = d.date) GROUP BY store""")
def matched_stores(t):
    return joins.matched(daily(t), weather(t), ["city", "date"]).groupBy("store").agg(F.count("*").alias("n_rows"))


@register("j15_cluster_map", "cluster:i n_rows:i sold:f", """
WITH c AS (SELECT store, product, CASE WHEN avg(sold) < 30 THEN 0 ELSE 1 END AS cluster FROM daily
           GROUP BY store, product HAVING count(*) >= 130)
SELECT coalesce(cluster, -1) AS cluster, count(*) AS n_rows, sum(sold) AS sold
FROM daily LEFT JOIN c USING (store, product) GROUP BY 1""")
def cluster_map(t):
    d = daily(t)
    clusters = d.groupBy("store", "product").agg(
        F.when(F.avg("sold") < 30, 0).otherwise(1).alias("cluster"), F.count("*").alias("_n")
    ).filter(F.col("_n") >= 130)
    return joins.attach_cluster(d, clusters, "cluster").groupBy("cluster").agg(
        F.count("*").alias("n_rows"), F.sum("sold").alias("sold"))
