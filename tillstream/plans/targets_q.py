"""D15, D16, B06, B07 tiers, B13, B14: target corrections and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.functions import calendar as cal
from tillstream.operators import filters as flt, series, targets as tg
from tillstream.plans.evaluate_q import best_sku
from tillstream.plans.forecasts import all_forecasts
from tillstream.plans.registry import register
from tillstream.sources.testdata import daily, stock_daily

_KEYS = "store:i product:s date:d"
_P = "PARTITION BY store, product ORDER BY date"
_F7 = f"({_P} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
_TRAIN = "(SELECT * FROM daily WHERE date < (SELECT max(date) - 89 FROM daily))"


@register("d15_stockout_targets", f"{_KEYS} target_rolled:f target_deficit:f keep_uncensored:i", f"""
SELECT store, product, date, CASE WHEN stock = 0 THEN greatest(sold, coalesce(r7, 0)) ELSE sold END AS target_rolled,
  CASE WHEN stock = 0 THEN sold + 0.5e0 * CASE WHEN s1 IS NULL THEN 0 ELSE greatest(s1 - st1, 0) END ELSE sold END AS target_deficit,
  CAST(stock <> 0 AS INT) AS keep_uncensored
FROM (SELECT *, CASE WHEN count(sold) OVER {_F7} >= 3 THEN avg(sold) OVER {_F7} END AS r7, lag(sold) OVER ({_P}) AS s1,
      lag(stock) OVER ({_P}) AS st1 FROM stock_daily)""")
def stockout_targets(t):
    df = stock_daily(t).transform(series.add_rolling, "sold", (7,), "mean", None, "sales").transform(series.add_stock_features)
    return tg.stockout_targets(df)


_VOL = """CASE WHEN sold <= 2 THEN '0-2' WHEN sold <= 5 THEN '3-5' WHEN sold <= 10 THEN '6-10' WHEN sold <= 20 THEN '11-20'
  WHEN sold <= 50 THEN '21-50' ELSE '51+' END"""
_LK = f"""k AS (SELECT *, {_VOL} AS volume, CAST(stock = 0 AS INT) AS out_of_stock FROM stock_daily),
l AS (SELECT category, volume, out_of_stock, avg(lost_qty) AS lost_mean, median(lost_qty) AS lost_median, count(*) AS n_rows
      FROM k GROUP BY category, volume, out_of_stock)"""


@register("d16_lost_lookup", "category:s volume:s out_of_stock:i lost_mean:f6 lost_median:f n_rows:i", f"WITH {_LK} SELECT * FROM l")
def lost_lookup(t):
    return tg.lost_lookup(stock_daily(t))


@register("d16_apply_lookup", f"{_KEYS} target:f8 is_adjusted:i", f"""
WITH {_LK} SELECT store, product, date, sold + CASE WHEN lost_mean > 0 AND k.out_of_stock = 1 THEN lost_mean * 0.5e0 ELSE 0 END AS target,
  CAST(lost_mean > 0 AND k.out_of_stock = 1 AS INT) AS is_adjusted FROM k JOIN l USING (category, volume, out_of_stock)""")
def apply_lookup(t):
    df = stock_daily(t)
    return tg.apply_lookup(df, tg.lost_lookup(df), "lost_mean", 0.5, True)


@register("b13_category_bias", f"{_KEYS} bias:f8 corrected:f8", """
WITH b AS (SELECT category, avg(sold - avg14) AS bias FROM all_preds WHERE date < (SELECT max(date) - 89 FROM daily) GROUP BY category)
SELECT store, product, date, bias, greatest(avg14 + bias, 0) AS corrected FROM wide_preds JOIN b USING (category)""")
def category_bias(t):
    df = all_forecasts(t).withColumn("prediction", F.col("avg14"))
    train, test = flt.train_test(df, 90)
    return tg.category_bias(train, test)


@register("b14_clip_targets", f"{_KEYS} clip_p95:f clip_p99:f clip_category_p95:f", f"""
WITH tr AS {_TRAIN}, c AS (SELECT category, quantile_cont(sold, 0.95) AS q FROM tr GROUP BY category),
o AS (SELECT quantile_cont(sold, 0.95) AS p95, quantile_cont(sold, 0.99) AS p99 FROM tr)
SELECT store, product, date, least(sold, p95) AS clip_p95, least(sold, p99) AS clip_p99, least(sold, q) AS clip_category_p95
FROM tr JOIN c USING (category), o""")
def clip_targets(t):
    return tg.clip_targets(flt.train_test(daily(t), 90)[0])


_HOL = "(101,102,103,104,105,106,107,108,223,308,501,509,612,1104)"
_EXP = f"""tr AS {_TRAIN},
po AS (SELECT product, avg(sold) AS a FROM tr GROUP BY product),
pd AS (SELECT product, isodow(date) AS dow, avg(sold) AS m FROM tr GROUP BY 1, 2),
bp AS (SELECT store, product, avg(sold) AS pm, stddev_samp(sold) AS ps FROM tr GROUP BY store, product),
e AS (SELECT t.*, pm * (m / a) AS expected, greatest(coalesce(ps, 1), 1) * 2 AS spread, CAST(list_has_any(
        [month(date) * 100 + day(date), month(date + 1) * 100 + day(date + 1), month(date - 1) * 100 + day(date - 1)],
        [{_HOL[1:-1]}]) AS INT) AS special
      FROM tr t JOIN po ON po.product = t.product JOIN pd ON pd.product = t.product AND pd.dow = isodow(t.date)
      JOIN bp ON bp.store = t.store AND bp.product = t.product),
x AS (SELECT *, CASE WHEN special = 0 AND abs(sold - expected) > spread THEN 1 ELSE 0 END AS is_outlier FROM e)"""


def _expected(t):
    train = flt.train_test(daily(t), 90)[0]
    return tg.weekday_expectation(train, train).transform(cal.add_holiday_flags)


@register("b14_winsorise", f"{_KEYS} expected:f is_outlier:i target:f", f"""
WITH {_EXP} SELECT store, product, date, expected, is_outlier, CASE WHEN is_outlier = 0 THEN sold
  WHEN sold > expected + spread THEN floor(expected + spread + 0.5e0)
  WHEN sold < greatest(expected - spread, 0) THEN floor(greatest(expected - spread, 0) + 0.5e0) ELSE sold END AS target FROM x""")
def winsorise(t):
    return tg.winsorise(_expected(t))


@register("b14_replace_outliers", f"{_KEYS} is_outlier:i target:f", f"""
WITH {_EXP} SELECT store, product, date, is_outlier, CASE WHEN is_outlier = 0 THEN sold
  ELSE floor(greatest(expected, 0) + 0.5e0) END AS target FROM x""")
def replace_outliers(t):
    return tg.winsorise(_expected(t), replace=True)


_WEAK = "w AS (SELECT store, product, best_model, best_r2 FROM best_sku)"


@register("p14_weak_skus", "store:i product:s best_model:s best_r2:f", """
SELECT store, product, best_model, best_r2 FROM best_sku WHERE best_r2 < 0.1e0""")
def weak_skus(t):
    return flt.weak_skus(best_sku(t), 0.1)


@register("p14_weak_flags", "best_model:s is_weak_sku:i is_base_weak:i n_rows:i sold:f", f"""
WITH {_WEAK} SELECT coalesce(best_model, '') AS best_model, CAST(coalesce(best_r2 < 0.1e0, FALSE) AS INT) AS is_weak_sku,
  CAST(coalesce(best_r2 < 0.1e0 AND best_model = 'avg14', FALSE) AS INT) AS is_base_weak, count(*) AS n_rows, sum(sold) AS sold
FROM daily d LEFT JOIN w ON d.store = w.store AND d.product = w.product GROUP BY 1, 2, 3""")
def weak_flags(t):
    df = flt.flag_weak(daily(t), best_sku(t), 0.1, "avg14")
    return df.groupBy("best_model", "is_weak_sku", "is_base_weak").agg(F.count("*").alias("n_rows"), F.sum("sold").alias("sold"))


@register("b14_smooth_weak", f"{_KEYS} target:f8", f"""
WITH {_WEAK}, r AS (SELECT *, CASE WHEN count(sold) OVER {_F7} >= 3 THEN avg(sold) OVER {_F7} END AS r7 FROM daily)
SELECT r.store, r.product, date, CASE WHEN best_r2 < 0.1e0 THEN 0.7e0 * sold + 0.3e0 * coalesce(r7, sold) ELSE sold END AS target
FROM r LEFT JOIN w ON r.store = w.store AND r.product = w.product""")
def smooth_weak(t):
    df = daily(t).transform(series.add_rolling, "sold", (7,), "mean", None, "sales")
    return tg.smooth_weak(flt.flag_weak(df, best_sku(t), 0.1, "avg14"))


@register("b06_sample_weights", f"{_KEYS} w_std:f8 w_inverse_std:f8 w_weak_025:f8 w_weak_050:f8 w_size:f", f"""
WITH {_WEAK}, tr AS {_TRAIN}, s AS (SELECT product, stddev_samp(sold) AS sd FROM tr GROUP BY product),
r AS (SELECT t.store, t.product, date, sd AS a, 1 / (sd + 0.1e0) AS b, CASE WHEN best_r2 < 0.1e0 THEN 0.25e0 ELSE 1 END AS c,
      CASE WHEN best_r2 < 0.1e0 THEN 0.5e0 ELSE 1 END AS d, greatest(sold, 1) AS w_size
      FROM tr t JOIN s ON s.product = t.product LEFT JOIN w ON w.store = t.store AND w.product = t.product)
SELECT store, product, date, a / (SELECT avg(a) FROM r) AS w_std, b / (SELECT avg(b) FROM r) AS w_inverse_std,
  c / (SELECT avg(c) FROM r) AS w_weak_025, d / (SELECT avg(d) FROM r) AS w_weak_050, w_size FROM r""")
def sample_weights(t):
    train = flt.train_test(daily(t), 90)[0]
    return tg.sample_weights(flt.flag_weak(train, best_sku(t), 0.1, "avg14"))


@register("b07_volume_tiers", "tier:s is_high_demand:i n_rows:i product_avg:f6", f"""
WITH a AS (SELECT l_partkey AS part, avg(l_quantity / 2) AS m FROM lineitem WHERE l_returnflag = 'N'
           AND CAST(l_shipdate AS DATE) < (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - 89 GROUP BY l_partkey)
SELECT CASE WHEN coalesce(m, 0) < 3 THEN 'low' WHEN coalesce(m, 0) < 15 THEN 'medium' ELSE 'high' END AS tier,
  CAST(coalesce(m, 0) >= 10 AS INT) AS is_high_demand, count(*) AS n_rows, avg(coalesce(m, 0)) AS product_avg
FROM check_lines c LEFT JOIN a ON a.part = c.part GROUP BY 1, 2""")
def volume_tiers(t):
    from tillstream.operators.filters import train_test
    from tillstream.sources.testdata import check_lines
    lines = check_lines(t).withColumn("demand", F.col("qty") / 2).withColumn("product", F.col("part"))
    train = train_test(lines, 90)[0].filter(F.col("event_type") == "sale")
    return tg.volume_tiers(train, lines).groupBy("tier", "is_high_demand").agg(
        F.count("*").alias("n_rows"), F.avg("product_avg").alias("product_avg"))
