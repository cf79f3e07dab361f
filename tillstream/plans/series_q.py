"""W: ordered-window features and simple forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import aggregates as agg, joins, series
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.sources.testdata import daily, daily_prices, hourly, sales, stock_daily

_P = "PARTITION BY store, product ORDER BY date"
_KEYS = "store:i product:s date:d"


def _f(n):
    return f"({_P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _lags(c, ks=(1, 2, 3, 7, 14, 30), p=None):
    return ", ".join(f"lag({c}, {k}) OVER ({_P}) AS {p or c}_lag{k}" for k in ks)


def _means(c, ms, p=None):
    return ", ".join(
        f"CASE WHEN count({c}) OVER {_f(n)} >= {m} THEN avg({c}) OVER {_f(n)} END AS {p or c}_roll_mean{n}"
        for n, m in ms)


def _std(c, n=7, p=None):
    return f"CASE WHEN count({c}) OVER {_f(n)} >= 2 THEN stddev_samp({c}) OVER {_f(n)} END AS {p or c}_roll_std{n}"


V2 = ((3, 1), (7, 3), (14, 7), (30, 15))
_SERIES = (" ".join(f"sold_lag{k}:f" for k in series.LAGS) + " "
           + " ".join(f"sold_roll_mean{n}:f" for n, _ in V2) + " sold_roll_std7:f")


@register("w01_lags", f"{_KEYS} " + " ".join(f"sold_lag{k}:f" for k in series.LAGS),
          f"SELECT store, product, date, {_lags('sold')} FROM daily")
def lags(t):
    return daily(t).transform(series.add_lags, "sold")


@register("w02_rolling_mean", f"{_KEYS} " + " ".join(f"sold_roll_mean{n}:f" for n, _ in V2),
          f"SELECT store, product, date, {_means('sold', V2)} FROM daily")
def rolling_mean(t):
    return daily(t).transform(series.add_rolling, "sold")


_CAL = "(PARTITION BY store, product ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@register("w02_rolling_mean_calendar", f"{_KEYS} sold_roll_mean30:f", f"""
SELECT store, product, date, CASE WHEN count(sold) OVER {_CAL} >= 2 THEN avg(sold) OVER {_CAL} END AS sold_roll_mean30
FROM daily""")
def rolling_mean_calendar(t):
    return daily(t).transform(series.add_rolling, "sold", (30,), min_periods={30: 2}, mode="calendar")


@register("w03_rolling_std", f"{_KEYS} sold_roll_std7:f",
          f"SELECT store, product, date, {_std('sold')} FROM daily")
def rolling_std(t):
    return daily(t).transform(series.add_rolling, "sold", (7,), "std")


@register("w04_rolling_median", f"{_KEYS} sold_roll_median3:f sold_roll_median7:f", f"""
SELECT store, product, date, quantile_cont(sold, 0.5) OVER {_f(3)} AS sold_roll_median3,
       quantile_cont(sold, 0.5) OVER {_f(7)} AS sold_roll_median7 FROM daily""")
def rolling_median(t):
    return daily(t).transform(series.add_rolling, "sold", (3, 7), "median")


@register("w05_adaptive_features", f"{_KEYS} sales_lag7:f sales_lag14:f sales_roll_mean14:f sales_roll_std7:f",
          f"SELECT store, product, date, {_lags('qty', (7, 14), 'sales')}, "
          f"{_means('qty', ((14, 7),), 'sales')}, {_std('qty', 7, 'sales')} FROM "
          "(SELECT store, product, date, sum(qty) AS qty FROM hourly GROUP BY store, product, date)")
def adaptive_features(t):
    d = hourly(t).groupBy("store", "product", "date").agg(F.sum("qty").alias("qty"))
    return series.add_adaptive_features(d, "qty", "sales")


_DOW = "(PARTITION BY store, product, isodow(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("w06_same_weekday_mean", f"{_KEYS} sales_dow_mean:f demand_dow_mean:f", f"""
SELECT store, product, date, coalesce(avg(sold) OVER {_DOW}, 0) AS sales_dow_mean,
       coalesce(avg(demand) OVER {_DOW}, 0) AS demand_dow_mean FROM stock_daily""")
def same_weekday_mean(t):
    return stock_daily(t).transform(series.add_same_weekday_mean,
                                    {"sales_dow_mean": "sold", "demand_dow_mean": "demand"})


@register("w07_censoring_history", f"{_KEYS} is_censored_lag1:i lost_qty_lag1:f pct_censored_7d:f", f"""
SELECT store, product, date, coalesce(lag(is_censored) OVER ({_P}), 0) AS is_censored_lag1,
  coalesce(lag(lost_qty) OVER ({_P}), 0) AS lost_qty_lag1,
  coalesce(avg(is_censored) OVER {_f(7)} * 100, 0) AS pct_censored_7d FROM stock_daily""")
def censoring_history(t):
    return stock_daily(t).transform(series.add_censoring_history)


def trend_frame(t):
    return (stock_daily(t)
            .transform(series.add_rolling, "demand", (7, 30))
            .transform(series.add_rolling, "sold", (7,), "mean", None, "sales")
            .transform(series.add_rolling, "sold", (7,), "std", None, "sales")
            .transform(series.add_trend))


add_base("trend_daily", f"""
SELECT *, demand_roll_mean7 / (demand_roll_mean30 + 1e-8) AS demand_trend, sales_roll_std7 / (sales_roll_mean7 + 1) AS cv_7d
FROM (SELECT *, {_means('demand', ((7, 3), (30, 15)))}, {_means('sold', ((7, 3),), 'sales')}, {_std('sold', 7, 'sales')}
      FROM stock_daily)""")


@register("w08_trend", f"{_KEYS} demand_trend:f cv_7d:f",
          "SELECT store, product, date, demand_trend, cv_7d FROM trend_daily")
def trend(t):
    return trend_frame(t)


@register("w09_store_breadth", f"{_KEYS} category:s items_in_store_today:i items_in_store_lag1:i items_change:i", """
WITH p AS (SELECT store, date, count(DISTINCT product) AS n FROM daily_fine GROUP BY store, date),
q AS (SELECT *, lag(n) OVER (PARTITION BY store ORDER BY date) AS prev FROM p)
SELECT d.store, d.product, d.date, d.category, n AS items_in_store_today, coalesce(prev, 0) AS items_in_store_lag1,
       coalesce(n - prev, 0) AS items_change FROM daily_fine d JOIN q ON d.store = q.store AND d.date = q.date""")
def store_breadth(t):
    return _fine(t).transform(series.add_store_breadth)


def _fine(t):
    from tillstream.sources.testdata import daily_fine
    return daily_fine(t)


@register("w10_category_breadth", f"{_KEYS} category:s items_in_category_today:i category_items_change:i", """
WITH p AS (SELECT store, category, date, count(DISTINCT product) AS n FROM daily_fine GROUP BY store, category, date),
q AS (SELECT *, lag(n) OVER (PARTITION BY store, category ORDER BY date) AS prev FROM p)
SELECT d.store, d.product, d.date, d.category, n AS items_in_category_today, coalesce(n - prev, 0) AS category_items_change
FROM daily_fine d JOIN q ON d.store = q.store AND d.category = q.category AND d.date = q.date""")
def category_breadth(t):
    return _fine(t).transform(series.add_category_breadth)


@register("w11_stale_lag", f"{_KEYS} stale_ratio:f stale_ratio_lag1:f", f"""
WITH s AS (SELECT store, category AS product, date,
  sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) / (sum(qty) + 1e-8) AS stale_ratio
  FROM sales s GROUP BY s.store, s.category, s.date)
SELECT *, lag(stale_ratio) OVER ({_P}) AS stale_ratio_lag1 FROM s""")
def stale_lag(t):
    return agg.stale_share(sales(t).withColumn("product", F.col("category"))).transform(series.add_stale_lag)


@register("w12_stock_features", f"{_KEYS} stock_lag1:f sales_lag1:f stock_to_sales:f stock_deficit:f", f"""
SELECT *, stock_lag1 / (sales_lag1 + 1) AS stock_to_sales,
  CASE WHEN sales_lag1 IS NULL THEN 0 ELSE greatest(sales_lag1 - stock_lag1, 0) END AS stock_deficit
FROM (SELECT store, product, date, lag(stock) OVER ({_P}) AS stock_lag1, lag(sold) OVER ({_P}) AS sales_lag1
      FROM stock_daily)""")
def stock_features(t):
    return stock_daily(t).transform(series.add_stock_features)


@register("w13_price_features", f"{_KEYS} avg_price:f price_vs_median:f6 price_lag7:f price_change_7d:f price_roll_mean7:f price_roll_std7:f", f"""
WITH m AS (SELECT product, median(avg_price) AS med FROM daily_prices GROUP BY product)
SELECT store, product, date, avg_price, avg_price / med AS price_vs_median, price_lag7,
       (avg_price - price_lag7) / (price_lag7 + 1e-8) * 100 AS price_change_7d, price_roll_mean7, price_roll_std7
FROM (SELECT store, product, date, avg_price, lag(avg_price, 7) OVER ({_P}) AS price_lag7,
             avg(avg_price) OVER {_f(7)} AS price_roll_mean7, stddev_samp(avg_price) OVER {_f(7)} AS price_roll_std7
      FROM daily_prices) JOIN m USING (product)""")
def price_features(t):
    return series.add_price_features(daily_prices(t))


@register("w14_intraday_share", f"{_KEYS} hour:i share:f6 cum_share:f6", """
SELECT store, product, date, hour, qty / sum(qty) OVER (PARTITION BY store, product, date) AS share,
  sum(qty) OVER (PARTITION BY store, product, date ORDER BY hour) / sum(qty) OVER (PARTITION BY store, product, date) AS cum_share
FROM hourly""")
def intraday_share(t):
    return series.add_intraday_share(hourly(t))


@register("w15_forward_fill", "store:i product:s hour:i qty:f", """
WITH g AS (SELECT p.store, p.product, h.hour, x.qty FROM (SELECT DISTINCT store, product FROM hourly) p,
  (SELECT unnest(range(24)) AS hour) h
  LEFT JOIN (SELECT store, product, hour, sum(qty) AS qty FROM hourly GROUP BY store, product, hour) x
    ON x.store = p.store AND x.product = p.product AND x.hour = h.hour)
SELECT store, product, hour, last_value(qty IGNORE NULLS) OVER (PARTITION BY store, product ORDER BY hour
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty FROM g""")
def forward_fill(t):
    per = hourly(t).groupBy("store", "product", "hour").agg(F.sum("qty").alias("qty"))
    return joins.complete_hours(per, ["store", "product"]).transform(series.forward_fill, "qty")


@register("w16_trailing_average", f"{_KEYS} avg14:f", f"""
SELECT store, product, date, coalesce(avg(demand) OVER {_f(14)}, (SELECT avg(demand) FROM stock_daily)) AS avg14
FROM stock_daily""")
def trailing_average(t):
    return stock_daily(t).transform(series.trailing_average, "demand")


_W = "(PARTITION BY store, product, isodow(date) ORDER BY date"
_PAST = f"avg(demand) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("w17_weekday_naive", f"{_KEYS} dow_last:f dow_mean4:f", f"""
SELECT store, product, date, coalesce(lag(demand) OVER {_W}), {_PAST}) AS dow_last,
  coalesce(avg(demand) OVER {_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), {_PAST}) AS dow_mean4 FROM stock_daily""")
def weekday_naive(t):
    return stock_daily(t).transform(series.weekday_naive, "demand")


@register("w18_horizon_forecast", "store:i product:s date:d step:i window_average:f seasonal_naive:f", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY date DESC) AS back FROM daily),
a AS (SELECT store, product, max(date) AS last_date, avg(sold) FILTER (back <= 30) AS window_average FROM r GROUP BY store, product),
h AS (SELECT a.*, s.step FROM a, (SELECT unnest(range(1, 31)) AS step) s)
SELECT h.store, h.product, h.last_date + CAST(h.step AS INT) AS date, h.step, window_average, r.sold AS seasonal_naive
FROM h LEFT JOIN r ON r.store = h.store AND r.product = h.product AND r.back = 31 - h.step""")
def horizon_forecast(t):
    return series.horizon_forecast(daily(t), "sold")


@register("w19_neighbour_sum", "store:i product:s hour:i near:f", """
WITH x AS (SELECT store, product, hour, sum(qty) AS qty FROM hourly GROUP BY store, product, hour)
SELECT store, product, hour, CASE WHEN count(*) OVER w = 3 THEN sum(qty) OVER w ELSE 0 END AS near
FROM x WINDOW w AS (PARTITION BY store, product ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def neighbour_sum(t):
    per = hourly(t).groupBy("store", "product", "hour").agg(F.sum("qty").alias("qty"))
    return per.withColumn("near", series.neighbour_sum(per, "qty", ["store", "product"]))


DENSE_SQL = """
span AS (SELECT store, product, min(date) AS a, max(date) AS b FROM daily GROUP BY store, product),
grid AS (SELECT store, product, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
dense AS (SELECT g.store, g.product, g.date, coalesce(sold, 0) AS sold
          FROM grid g LEFT JOIN daily d ON g.store = d.store AND g.product = d.product AND g.date = d.date)"""


@register("w20_longest_zero_run", "store:i product:s zero_run_max:i zero_run_ratio:f", f"""
WITH {DENSE_SQL},
m AS (SELECT *, row_number() OVER ({_P}) - sum(CAST(sold = 0 AS INT)) OVER ({_P}) AS island FROM dense),
r AS (SELECT store, product, island, count(*) FILTER (sold = 0) AS zeros, count(*) AS n FROM m GROUP BY store, product, island)
SELECT store, product, max(zeros) AS zero_run_max, max(zeros) / sum(n)::DOUBLE AS zero_run_ratio FROM r GROUP BY store, product""")
def longest_zero_run(t):
    return series.longest_zero_run(joins.dense_calendar(daily(t), "sold"), "sold")


@register("w21_autocorrelation", "store:i product:s acf_lag1:f acf_lag7:f", f"""
SELECT store, product, CASE WHEN count(*) <= 2 THEN 0 ELSE coalesce(corr(demand, l1), 0) END AS acf_lag1,
  CASE WHEN count(*) <= 8 THEN 0 ELSE coalesce(corr(demand, l7), 0) END AS acf_lag7
FROM (SELECT *, lag(demand, 1) OVER ({_P}) AS l1, lag(demand, 7) OVER ({_P}) AS l7 FROM stock_daily) GROUP BY store, product""")
def autocorrelation(t):
    return series.autocorrelation(stock_daily(t), "demand")


_END = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY date DESC) AS back,
  count(*) OVER (PARTITION BY store, product) AS n FROM stock_daily)"""


@register("w22_trend_strength", "store:i product:s trend_abs_60:f6", f"""
{_END} SELECT store, product, CASE WHEN max(n) < 5 OR stddev_pop(demand) < 1e-8 THEN 0
  ELSE abs(regr_slope(demand, -back)) / (abs(avg(demand)) + 1) END AS trend_abs_60
FROM r WHERE back <= 60 GROUP BY store, product""")
def trend_strength(t):
    return series.trend_strength(stock_daily(t), "demand")


def _shift(recent, prior, fn, scale):
    a, b = f"coalesce({fn}(demand) FILTER (r), 0)", f"coalesce({fn}(demand) FILTER (p), 0)"
    return f"""{_END}, u AS (SELECT *, least(greatest(n - {recent}, 0), {prior}) >= 3 AND least(n, {recent}) >= 3 AS usual FROM r),
v AS (SELECT *, CASE WHEN usual THEN back <= {recent} ELSE back <= n - n // 2 END AS r,
  CASE WHEN usual THEN back > {recent} AND back <= {recent + prior} ELSE back > n - n // 2 END AS p FROM u)
SELECT store, product, CASE WHEN max(n) < 4 THEN 0 ELSE abs(({a} - {b}) / ({scale.format(b=b)} + 1)) END AS shift
FROM v GROUP BY store, product"""


@register("w23_level_shift", "store:i product:s shift:f", _shift(30, 30, "avg", "abs({b})"))
def level_shift(t):
    return series.window_shift(stock_daily(t), "demand", 30, 30, "level", "shift")


@register("w24_volatility_shift", "store:i product:s shift:f", _shift(7, 30, "stddev_pop", "{b}"))
def volatility_shift(t):
    return series.window_shift(stock_daily(t), "demand", 7, 30, "volatility", "shift")


SEASONAL_SQL = """
SELECT store, product, CASE WHEN max(n) < 8 OR max(sd) < 1e-8 THEN 0 ELSE least(stddev_pop(m) / max(sd), 5) END AS seasonal_strength_7
FROM (SELECT store, product, isodow(date) AS dow, avg(demand) AS m FROM stock_daily GROUP BY 1, 2, 3)
JOIN (SELECT store, product, count(*) AS n, stddev_pop(demand) AS sd FROM stock_daily GROUP BY store, product) USING (store, product)
GROUP BY store, product"""


@register("w25_seasonal_strength", "store:i product:s seasonal_strength_7:f", SEASONAL_SQL)
def seasonal_strength(t):
    return series.seasonal_strength(stock_daily(t), "demand")


add_base("stability", f"""
SELECT * FROM (SELECT store, product, CASE WHEN count(*) <= 2 THEN 0 ELSE coalesce(corr(demand, l1), 0) END AS acf_lag1,
  CASE WHEN count(*) <= 8 THEN 0 ELSE coalesce(corr(demand, l7), 0) END AS acf_lag7
  FROM (SELECT *, lag(demand, 1) OVER ({_P}) AS l1, lag(demand, 7) OVER ({_P}) AS l7 FROM stock_daily) GROUP BY store, product)
JOIN ({_END} SELECT store, product, CASE WHEN max(n) < 5 OR stddev_pop(demand) < 1e-8 THEN 0
  ELSE abs(regr_slope(demand, -back)) / (abs(avg(demand)) + 1) END AS trend_abs_60
  FROM r WHERE back <= 60 GROUP BY store, product) USING (store, product)
JOIN (SELECT store, product, shift AS mean_shift_norm_30_60 FROM ({_shift(30, 30, "avg", "abs({b})")})) USING (store, product)
JOIN (SELECT store, product, shift AS variance_shift_norm_7_30 FROM ({_shift(7, 30, "stddev_pop", "{b}")})) USING (store, product)
JOIN ({SEASONAL_SQL}) USING (store, product)""")


@register("w25_stability_features", "store:i product:s acf_lag1:f acf_lag7:f trend_abs_60:f mean_shift_norm_30_60:f "
          "variance_shift_norm_7_30:f seasonal_strength_7:f zero_run_max:i", """
SELECT *, 0 AS zero_run_max FROM stability""")
def stability_features(t):
    return series.stability_features(stock_daily(t))


@register("w26_decompose", f"{_KEYS} trend:f seasonal:f residual:f", f"""
WITH b AS (SELECT store, product, date, sold, (row_number() OVER ({_P}) - 1) % 7 AS ph,
  CASE WHEN count(sold) OVER c = 7 THEN avg(sold) OVER c END AS trend FROM daily
  WINDOW c AS ({_P} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT store, product, ph, avg(sold - trend) AS m FROM b GROUP BY store, product, ph),
q AS (SELECT store, product, ph, m - avg(m) OVER (PARTITION BY store, product) AS seasonal FROM s)
SELECT store, product, date, trend, seasonal, sold - trend - seasonal AS residual FROM b JOIN q USING (store, product, ph)""")
def decompose(t):
    return series.decompose(daily(t), "sold")


@register("w27_keep_latest", f"{_KEYS} sold:f source:i", """
WITH n AS (SELECT date, store, category AS product, 100 + sum(qty) AS sold FROM check_lines
           WHERE event_type = 'return' GROUP BY date, store, category),
u AS (SELECT date, store, product, sold, 0 AS source FROM daily UNION ALL SELECT *, 1 FROM n)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY store, product, date ORDER BY source DESC) = 1""")
def keep_latest(t):
    from tillstream.sources.testdata import check_lines
    new = check_lines(t).filter(F.col("event_type") == "return").groupBy(
        "date", "store", F.col("category").alias("product")).agg((F.sum("qty") + 100).alias("sold"))
    both = daily(t).select("date", "store", "product", "sold", F.lit(0).alias("source")).unionByName(
        new.withColumn("source", F.lit(1)))
    return series.keep_latest(both, ["store", "product", "date"], F.col("source"))


@register("w28_sparse_baselines", f"{_KEYS} zero_aware:f interval_rate:f", f"""
WITH {DENSE_SQL}, i AS (SELECT *, row_number() OVER ({_P}) AS i, CASE WHEN sold > 0 THEN sold END AS pos FROM dense),
w AS (SELECT *, count(pos) OVER p AS n_pos, count(*) OVER p AS n, avg(pos) OVER p AS size,
  max(CASE WHEN pos IS NOT NULL THEN i END) OVER p AS last_pos FROM i
  WINDOW p AS ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT store, product, date, CASE WHEN n > 0 THEN n_pos / n::DOUBLE * size END AS zero_aware,
  CASE WHEN n > 0 THEN size / (last_pos / n_pos::DOUBLE) END AS interval_rate FROM w""")
def sparse_baselines(t):
    return series.sparse_baselines(joins.dense_calendar(daily(t), "sold"), "sold")
