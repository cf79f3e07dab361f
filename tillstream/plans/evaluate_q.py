"""E: forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import aggregates as agg, evaluate as ev, joins
from tillstream.plans.forecasts import MODELS, long_forecasts, wide_forecasts
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.plans.series_q import DENSE_SQL
from tillstream.sources.testdata import daily, stock_daily

R2 = """CASE WHEN count({e}) >= 2 AND max({y}) - min({y}) > 1e-8 + 1e-5 * abs(min({y}))
  THEN 1 - sum({e} * {e}) / nullif(sum({y} * {y}) - sum({y}) * sum({y}) / count({y}), 0) END"""
_E = "(fact - prediction)"
_R2 = R2.format(e=_E, y="(CASE WHEN prediction IS NOT NULL THEN fact END)")
_WM = f"sum(abs{_E}) / (sum(CASE WHEN prediction IS NOT NULL THEN fact END) + 1e-8) * 100"
_ALL = (f"count{_E} AS n_rows, avg(abs{_E}) AS mae, avg({_E} * {_E}) AS mse, sqrt(avg({_E} * {_E})) AS rmse, "
        f"{_WM} AS wmape, avg{_E} AS bias, {_R2} AS r2")
_ALL_SPEC = "n_rows:i mae:f6 mse:f6 rmse:f6 wmape:f6 bias:f6 r2:f6"


@register("e01_overall_metrics", f"model:s {_ALL_SPEC}", f"SELECT model, {_ALL} FROM long_preds GROUP BY model")
def overall_metrics(t):
    return ev.score(long_forecasts(t), ["model"])



add_base("sku_metrics", f"""
SELECT store, product, model, n_test_rows, n_test_days, floor(r2 * 1e4 + 0.50001e0) / 1e4 AS r2, floor(mse * 1e4 + 0.50001e0) / 1e4 AS mse,
  floor(mae * 1e4 + 0.50001e0) / 1e4 AS mae, floor(wmape * 100 + 0.50001e0) / 100 AS wmape
FROM (SELECT store, product, model, count(*) AS n_test_rows, count(DISTINCT date) AS n_test_days, {_R2} AS r2,
      avg({_E} * {_E}) AS mse, avg(abs{_E}) AS mae, {_WM} AS wmape
      FROM long_preds WHERE prediction IS NOT NULL GROUP BY store, product, model)""")
_ORDER = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS))
_WIDE = ", ".join(f"max(CASE WHEN model = '{m}' THEN {v} END) AS {m}_{v}" for m in MODELS for v in ev.METRICS)
add_base("best_sku", f"""
SELECT w.*, b.model AS best_model, b.r2 AS best_r2, b.mse AS best_mse, b.mae AS best_mae, b.wmape AS best_wmape
FROM (SELECT store, product, {_WIDE} FROM sku_metrics GROUP BY store, product) w
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, product
      ORDER BY coalesce(r2, CAST('-Infinity' AS DOUBLE)) DESC, CASE model {_ORDER} END) AS rn FROM sku_metrics) WHERE rn = 1) b
  ON w.store = b.store AND w.product = b.product""")


def sku_metrics(t):
    return ev.score_per_sku(long_forecasts(t))


def best_sku(t):
    return ev.best_by_sku(sku_metrics(t), MODELS)


@register("e02_sku_metrics", "store:i product:s model:s n_test_rows:i n_test_days:i r2:f mse:f mae:f wmape:f2",
          "SELECT * FROM sku_metrics")
def sku_metric_table(t):
    return sku_metrics(t)


@register("e03_metrics_by_category", f"category:s {_ALL_SPEC}",
          f"SELECT category, {_ALL} FROM long_preds WHERE model = 'avg14' GROUP BY category")
def metrics_by_category(t):
    return ev.score(long_forecasts(t, ("avg14",)), ["category"])


@register("e03_metrics_by_weekday", f"model:s dow:i {_ALL_SPEC}",
          f"SELECT model, isodow(date) - 1 AS dow, {_ALL} FROM long_preds GROUP BY model, isodow(date)")
def metrics_by_weekday(t):
    return ev.score(long_forecasts(t).withColumn("dow", F.weekday("date")), ["model", "dow"])


@register("e03_metrics_by_store", f"model:s store:i {_ALL_SPEC}",
          f"SELECT model, store, {_ALL} FROM long_preds GROUP BY model, store")
def metrics_by_store(t):
    return ev.score(long_forecasts(t), ["model", "store"])


@register("e04_metrics_by_threshold", "model:s mae_15:f6 n_15:i mae_50:f6 n_50:i mae_100:f6 n_100:i mae_200:f6 n_200:i",
          "SELECT model, " + ", ".join(f"avg(abs{_E}) FILTER (fact >= {x}) AS mae_{x}, count(*) FILTER (fact >= {x}) AS n_{x}"
                                       for x in (15, 50, 100, 200)) + " FROM long_preds GROUP BY model")
def metrics_by_threshold(t):
    return ev.score_by_threshold(long_forecasts(t))


@register("e05_percentage_errors", "model:s mape:f6 weighted_mape:f6", f"""
SELECT model, avg(abs{_E} / fact) FILTER (fact > 0) * 100 AS mape,
  sum(abs{_E}) FILTER (fact > 0) * 100 / sum(fact) FILTER (fact > 0) AS weighted_mape FROM long_preds GROUP BY model""")
def percentage_errors(t):
    return ev.percentage_errors(long_forecasts(t))


_PB = ", ".join(f"avg(greatest((fact - {c}) * {a}e0, (fact - {c}) * ({a}e0 - 1))) AS pinball_{c}"
                for c, a in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))


@register("e06_interval_report", "n_rows:i pinball_p10:f6 pinball_p50:f6 pinball_p90:f6 coverage_pct:f6 width_mean:f6 width_median:f6 "
          "width_p90:f6 crossing_low_pct:f6 crossing_high_pct:f6 crossing_any_pct:f6 asymmetry:f6", f"""
WITH i AS (SELECT fact, avg14 * 0.5e0 AS p10, avg14 AS p50, dow_mean4 * 1.5e0 AS p90 FROM wide_preds)
SELECT count(*) AS n_rows, {_PB}, avg(CAST(fact >= p10 AND fact <= p90 AS INT)) * 100 AS coverage_pct, avg(p90 - p10) AS width_mean,
  median(p90 - p10) AS width_median, quantile_cont(p90 - p10, 0.9) AS width_p90, avg(CAST(p10 > p50 AS INT)) * 100 AS crossing_low_pct,
  avg(CAST(p50 > p90 AS INT)) * 100 AS crossing_high_pct, avg(CAST(p10 > p50 OR p50 > p90 AS INT)) * 100 AS crossing_any_pct,
  avg((p90 - p50) - (p50 - p10)) AS asymmetry FROM i""")
def interval_report(t):
    df = wide_forecasts(t).select("fact", (F.col("avg14") * 0.5).alias("p10"), F.col("avg14").alias("p50"),
                                  (F.col("dow_mean4") * 1.5).alias("p90"))
    return ev.interval_report(df)


@register("e07_model_summary", "model:s n_pairs:i avg_r2:f9 median_r2:f6 avg_mae:f9 median_mae:f6 avg_mse:f9 avg_wmape:f9 win_count:i", """
SELECT m.model, count(r2) AS n_pairs, avg(r2) AS avg_r2, median(r2) AS median_r2, avg(mae) AS avg_mae, median(mae) AS median_mae,
  avg(mse) AS avg_mse, avg(wmape) AS avg_wmape, coalesce(max(w.n), 0) AS win_count
FROM sku_metrics m LEFT JOIN (SELECT best_model, count(*) AS n FROM best_sku GROUP BY best_model) w ON w.best_model = m.model
GROUP BY m.model""")
def model_summary(t):
    m = sku_metrics(t)
    return ev.model_summary(m, ev.best_by_sku(m, MODELS))


_BEST_SPEC = "store:i product:s best_model:s best_r2:f best_mse:f best_mae:f best_wmape:f2"


@register("e08_best_by_sku", f"{_BEST_SPEC} " + " ".join(f"{m}_r2:f" for m in MODELS), "SELECT * FROM best_sku")
def best_by_sku(t):
    return best_sku(t)


@register("j09_models_wide", "store:i product:s " + " ".join(f"{m}_{v}:f" for m in MODELS for v in ev.METRICS),
          "SELECT * FROM best_sku")
def models_wide(t):
    return joins.pivot_models(sku_metrics(t), MODELS, ev.METRICS)


@register("j13_predictions_wide", "store:i product:s date:d fact:f " + " ".join(f"pred_{m}:f" for m in MODELS),
          "SELECT store, product, date, fact, " + ", ".join(f"{m} AS pred_{m}" for m in MODELS) + " FROM wide_preds")
def predictions_wide(t):
    return joins.predictions_wide(long_forecasts(t), MODELS)


_COMMON = f"""c AS (SELECT date FROM long_preds WHERE prediction IS NOT NULL GROUP BY date HAVING count(DISTINCT model) = {len(MODELS)}),
h AS (SELECT p.* FROM long_preds p JOIN best_sku b ON p.store = b.store AND p.product = b.product AND p.model = b.best_model
      WHERE date IN (SELECT date FROM c))"""


def _hybrid(t):
    preds = long_forecasts(t)
    return ev.hybrid_rows(preds, ev.best_by_sku(ev.score_per_sku(preds), MODELS), len(MODELS))


@register("e09_hybrid_metrics", f"n_pairs:i {_ALL_SPEC}", f"""
WITH {_COMMON} SELECT count(DISTINCT (store, product)) AS n_pairs, {_ALL} FROM h""")
def hybrid_metrics(t):
    cols = ev.metric_columns()
    return _hybrid(t).agg(F.countDistinct("store", "product").alias("n_pairs"),
                          *[c.alias(n) for n, c in cols.items()])


@register("e09_hybrid_usage", "model:s n_rows:i n_pairs:i", f"""
WITH {_COMMON} SELECT model, count(*) AS n_rows, count(DISTINCT (store, product)) AS n_pairs FROM h GROUP BY model""")
def hybrid_usage(t):
    return ev.model_usage(_hybrid(t))


@register("e10_challenger", f"{_BEST_SPEC} source_model:s winner_source:s", """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY coalesce(r2, CAST('-Infinity' AS DOUBLE)) DESC,
           CASE model WHEN 'avg14' THEN 0 ELSE 1 END) AS rn FROM sku_metrics WHERE model IN ('avg14', 'dow_last')) WHERE rn = 1),
c AS (SELECT * FROM sku_metrics WHERE model = 'lag_filled'),
j AS (SELECT s.store, s.product, s.model AS source_model, c.r2 IS NOT NULL AND (s.r2 IS NULL OR c.r2 > s.r2) AS w,
      s.r2, s.mse, s.mae, s.wmape, c.r2 AS r2c, c.mse AS msec, c.mae AS maec, c.wmape AS wmapec
      FROM s LEFT JOIN c ON s.store = c.store AND s.product = c.product)
SELECT store, product, source_model, CASE WHEN w THEN 'lag_filled' ELSE 'source' END AS winner_source,
  CASE WHEN w THEN 'lag_filled' ELSE source_model END AS best_model, CASE WHEN w THEN r2c ELSE r2 END AS best_r2,
  CASE WHEN w THEN msec ELSE mse END AS best_mse, CASE WHEN w THEN maec ELSE mae END AS best_mae,
  CASE WHEN w THEN wmapec ELSE wmape END AS best_wmape FROM j""")
def challenger(t):
    m = sku_metrics(t)
    source = ev.best_by_sku(m, ("avg14", "dow_last"))
    return ev.challenge(source, m.filter(F.col("model") == "lag_filled"), "lag_filled")


def _cmp(tag, p):
    e, y = f"(fact - {p})", f"(CASE WHEN {p} IS NOT NULL THEN fact END)"
    return (f"avg(abs{e}) AS {tag}_mae, sum(abs{e}) / (sum({y}) + 1e-8) * 100 AS {tag}_wmape, {R2.format(e=e, y=y)} AS {tag}_r2, "
            f"avg{e} AS {tag}_bias, count{e} / count(*)::DOUBLE AS {tag}_coverage")


@register("e11_compare_pair", "store:i product:s n_rows:i main_mae:f6 main_wmape:f6 main_r2:f6 main_bias:f6 main_coverage:f6 other_mae:f6 "
          "other_wmape:f6 other_r2:f6 other_bias:f6 other_coverage:f6 delta_mae:f6", f"""
SELECT *, main_mae - other_mae AS delta_mae FROM (SELECT store, product, count(*) AS n_rows, {_cmp('main', 'dow_mean4')}, {_cmp('other', 'lag_core')}
FROM wide_preds GROUP BY store, product)""")
def compare_pair(t):
    return ev.compare_pair(wide_forecasts(t), "dow_mean4", "lag_core", ["store", "product"])


add_base("backtest", f"""
WITH {DENSE_SQL},
c AS (SELECT (SELECT max(date) FROM dense) - 30 * k AS cutoff FROM (VALUES (1), (2), (3)) v(k)),
hst AS (SELECT d.*, cutoff, row_number() OVER (PARTITION BY store, product, cutoff ORDER BY date DESC) AS back
        FROM dense d JOIN c ON date <= cutoff AND date > cutoff - 30),
per AS (SELECT store, product, cutoff, max(date) AS last_date, avg(sold) AS window_average FROM hst GROUP BY store, product, cutoff),
f AS (SELECT per.store, per.product, per.cutoff, last_date + CAST(s AS INT) AS date, window_average, h.sold AS seasonal_naive
      FROM per CROSS JOIN (SELECT unnest(range(1, 31)) AS s) LEFT JOIN hst h ON h.store = per.store AND h.product = per.product
       AND h.cutoff = per.cutoff AND h.back = 31 - s),
j AS (SELECT f.*, d.sold AS fact FROM f JOIN dense d ON d.store = f.store AND d.product = f.product AND d.date = f.date
      WHERE f.date <= cutoff + 30)
SELECT store, product, cutoff, date, fact, 'window_average' AS model, window_average AS prediction FROM j
UNION ALL SELECT store, product, cutoff, date, fact, 'seasonal_naive', seasonal_naive FROM j""")


def backtest(t):
    return ev.rolling_origin(joins.dense_calendar(daily(t), "sold"), "sold")


@register("e12_rolling_origin", f"cutoff:d model:s {_ALL_SPEC}", f"SELECT cutoff, model, {_ALL} FROM backtest GROUP BY cutoff, model")
def rolling_origin(t):
    return ev.score(backtest(t), ["cutoff", "model"])


_RD = "(floor(prediction + 0.5e0) - fact)"


@register("e13_error_signs", "model:s n_rows:i n_over:i n_under:i n_exact:i over_pct:f6 under_pct:f6 mean_over:f6 mean_under:f6 total_over:f2 "
          "total_under:f2 waste_cost:f2 lost_sale_cost:f2 n_days:i over_per_day:f6 under_per_day:f6", f"""
SELECT *, total_over * 60 AS waste_cost, total_under * 100 AS lost_sale_cost, total_over / n_days AS over_per_day,
  total_under / n_days AS under_per_day FROM (
SELECT model, count(prediction) AS n_rows, count(*) FILTER ({_RD} > 0) AS n_over, count(*) FILTER ({_RD} < 0) AS n_under,
  count(*) FILTER ({_RD} = 0) AS n_exact, count(*) FILTER ({_RD} > 0) * 100e0 / count(*) AS over_pct,
  count(*) FILTER ({_RD} < 0) * 100e0 / count(*) AS under_pct, avg({_RD}) FILTER ({_RD} > 0) AS mean_over,
  avg(-{_RD}) FILTER ({_RD} < 0) AS mean_under, coalesce(sum({_RD}) FILTER ({_RD} > 0), 0) AS total_over,
  coalesce(sum(-{_RD}) FILTER ({_RD} < 0), 0) AS total_under, count(DISTINCT date) AS n_days FROM long_preds GROUP BY model)""")
def error_signs(t):
    return ev.error_signs(long_forecasts(t))


add_base("behaviour", """
SELECT store, product, count(DISTINCT date) AS n_days, avg(demand) AS mean_demand, median(demand) AS median_demand,
  stddev_samp(demand) AS std_demand, avg(CAST(demand = 0 AS INT)) AS share_zero, avg(is_censored) AS share_censored,
  avg(lost_qty) AS lost_mean, avg(demand_trend) AS demand_trend_mean, avg(cv_7d) AS cv_7d_mean,
  coalesce(stddev_samp(demand), 0) / (abs(avg(demand)) + 1e-8) AS cv_demand FROM trend_daily GROUP BY store, product""")
add_base("sku_profile", """
SELECT b.*, best_model, best_r2, best_mae, best_wmape, s.* EXCLUDE (store, product) FROM best_sku k
JOIN behaviour b ON b.store = k.store AND b.product = k.product JOIN stability s ON s.store = k.store AND s.product = k.product""")
add_base("reasons", """
SELECT *, CAST(coalesce(best_r2 < 0, FALSE) AS INT) AS is_bad_r2,
  CASE WHEN n_days <= 54 THEN 'data_poor' WHEN mean_demand <= 2.874891e0 AND cv_demand >= 0.608539e0 THEN 'low_signal_sparse'
    WHEN share_censored >= 0.649029e0 OR lost_mean >= 1.620777e0 THEN 'censored_heavy'
    WHEN mean_shift_norm_30_60 >= 0.16568e0 OR variance_shift_norm_7_30 >= 0.343036e0 OR trend_abs_60 >= 0.005659e0 THEN 'regime_shift'
    WHEN seasonal_strength_7 >= 0.402863e0 AND acf_lag7 >= 0.154432e0 AND mean_demand >= 9.315062e0 AND cv_demand <= 0.608539e0
      THEN 'regular_seasonal' ELSE 'mixed_or_other' END AS primary_reason FROM sku_profile""")


def sku_profile(t):
    from tillstream.operators import series
    from tillstream.plans.series_q import trend_frame
    df = trend_frame(t)
    behaviour = agg.sku_behaviour(df)
    best = best_sku(t).select("store", "product", "best_model", "best_r2", "best_mae", "best_wmape")
    pair = ["store", "product"]
    return best.join(behaviour, pair).join(series.stability_features(df), pair)


_BIN = "CASE WHEN best_r2 IS NULL THEN 'unknown' WHEN best_r2 < 0 THEN 'R2 < 0' WHEN best_r2 < 0.2e0 THEN '0..0.2' WHEN best_r2 < 0.5e0 THEN '0.2..0.5' ELSE '>= 0.5' END"
_PROF = ("best_mae", "best_wmape", "mean_demand", "cv_demand", "acf_lag1", "seasonal_strength_7", "trend_abs_60")


@register("e14_bin_profile", "r2_bin:s n_sku:i mean_r2:f9 median_r2:f6 " + " ".join(f"mean_{c}:f9" for c in _PROF),
          f"SELECT {_BIN} AS r2_bin, count(*) AS n_sku, avg(best_r2) AS mean_r2, median(best_r2) AS median_r2, "
          + ", ".join(f"avg({c}) AS mean_{c}" for c in _PROF) + " FROM sku_profile GROUP BY 1")
def bin_profile(t):
    return ev.bin_profile(sku_profile(t), _PROF)


@register("e14_wins_by_bin", "best_model:s bin_negative:i bin_low:i bin_mid:i bin_high:i", """
SELECT best_model, count(*) FILTER (best_r2 < 0) AS bin_negative, count(*) FILTER (best_r2 >= 0 AND best_r2 < 0.2e0) AS bin_low,
  count(*) FILTER (best_r2 >= 0.2e0 AND best_r2 < 0.5e0) AS bin_mid, count(*) FILTER (best_r2 >= 0.5e0) AS bin_high
FROM best_sku GROUP BY best_model""")
def wins_by_bin(t):
    return ev.wins_by_bin(best_sku(t))


@register("e15_failure_reasons", "store:i product:s primary_reason:s is_bad_r2:i n_days:i", "SELECT * FROM reasons")
def failure_reasons(t):
    return ev.failure_reasons(sku_profile(t))


@register("e15_reason_summary", "primary_reason:s n_sku:i bad_r2_share:f9 avg_r2:f9 median_r2:f6 avg_mean_demand:f9 avg_cv_demand:f9 "
          "avg_share_censored:f9 avg_lost_mean:f9", """
SELECT primary_reason, count(*) AS n_sku, avg(is_bad_r2) AS bad_r2_share, avg(best_r2) AS avg_r2, median(best_r2) AS median_r2,
  avg(mean_demand) AS avg_mean_demand, avg(cv_demand) AS avg_cv_demand, avg(share_censored) AS avg_share_censored,
  avg(lost_mean) AS avg_lost_mean FROM reasons GROUP BY primary_reason""")
def reason_summary(t):
    return ev.reason_summary(ev.failure_reasons(sku_profile(t)))


@register("e16_predictability_map", "store:i product:s n_windows:i share_negative:f6 winner_stability:f6 avg_mae:f9 predictability:s", f"""
WITH m AS (SELECT store, product, cutoff, model, floor(({_R2}) * 1e4 + 0.5e0) / 1e4 AS r2, floor(avg(abs{_E}) * 1e4 + 0.5e0) / 1e4 AS mae
           FROM backtest WHERE prediction IS NOT NULL GROUP BY store, product, cutoff, model),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY store, product, cutoff ORDER BY coalesce(r2, CAST('-Infinity' AS DOUBLE)) DESC, model) = 1),
w AS (SELECT store, product, model, count(*) AS n, sum(CAST(coalesce(r2 < 0, TRUE) AS INT)) AS neg, sum(mae) AS mae FROM b GROUP BY store, product, model),
g AS (SELECT store, product, sum(n) AS n_windows, sum(neg) / sum(n)::DOUBLE AS share_negative, max(n) / sum(n)::DOUBLE AS winner_stability,
      sum(mae) / sum(n) AS avg_mae FROM w GROUP BY store, product)
SELECT *, CASE WHEN share_negative <= 0.34e0 AND winner_stability >= 0.66e0 THEN 'stable' WHEN share_negative < 1 THEN 'borderline'
  ELSE 'unpredictable' END AS predictability FROM g""")
def predictability_map(t):
    return ev.predictability_map(backtest(t))


@register("e17_last_week_summary", "store:i product:s sales:f demand:f days:i", """
SELECT store, product, sum(sold) AS sales, sum(demand) AS demand, count(*) AS days FROM stock_daily
WHERE date BETWEEN (SELECT max(date) - 13 FROM stock_daily) AND (SELECT max(date) - 7 FROM stock_daily) GROUP BY store, product""")
def last_week_summary(t):
    return ev.last_week_summary(stock_daily(t))


@register("e18_network_totals", "model:s date:d fact:f forecast:f6", """
SELECT model, date, sum(fact) AS fact, sum(prediction) AS forecast FROM long_preds GROUP BY model, date""")
def network_totals(t):
    return ev.network_totals(long_forecasts(t))


@register("e19_leaderboard", "run_id:s mae:f6 wmape:f6 delta_mae:f6 status:s", f"""
WITH m AS (SELECT model AS run_id, avg(abs{_E}) AS mae, {_WM} AS wmape FROM long_preds GROUP BY model)
SELECT *, mae - (SELECT mae FROM m WHERE run_id = 'avg14') AS delta_mae, CASE WHEN run_id = 'avg14' THEN 'baseline'
  WHEN mae < (SELECT mae FROM m WHERE run_id = 'avg14') THEN 'better' WHEN mae > (SELECT mae FROM m WHERE run_id = 'avg14') THEN 'worse'
  ELSE 'same' END AS status FROM m""")
def leaderboard(t):
    runs = ev.score(long_forecasts(t), ["model"]).withColumnRenamed("model", "run_id")
    return ev.leaderboard(runs, "avg14")


@register("e20_models_by_regime", "regime:s n_sku:i " + " ".join(f"mae_{m}:f9" for m in MODELS), """
WITH r AS (SELECT store, product, CASE WHEN share_censored > 0.5e0 THEN 'high_censoring' WHEN n_days < 30 THEN 'sparse'
  WHEN share_zero > 0.3e0 THEN 'intermittent' WHEN seasonal_strength_7 >= 0.4e0 AND acf_lag7 >= 0.15e0 THEN 'seasonal'
  WHEN cv_demand > 0.6e0 THEN 'volatile' ELSE 'stable' END AS regime FROM sku_profile)
SELECT regime, count(DISTINCT (r.store, r.product)) AS n_sku, """
          + ", ".join(f"avg(CASE WHEN model = '{m}' THEN mae END) AS mae_{m}" for m in MODELS) + """
FROM sku_metrics m JOIN r ON r.store = m.store AND r.product = m.product GROUP BY regime""")
def models_by_regime(t):
    regimes = ev.demand_regime(sku_profile(t))
    return ev.models_by_regime(regimes, sku_metrics(t), MODELS)
