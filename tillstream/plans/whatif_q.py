"""V: business what-if reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import filters as flt, series, whatif as wi
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.sources.testdata import stock_daily

_P = "PARTITION BY store, product ORDER BY date"
add_base("stock_preds", f"""
SELECT *, floor(prediction + 0.5e0) AS plan FROM (SELECT date, store, product, category, sold AS fact, stock, produced,
  coalesce(avg(sold) OVER ({_P} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), (SELECT avg(sold) FROM stock_daily)) AS prediction
  FROM stock_daily) WHERE date >= (SELECT max(date) - 89 FROM stock_daily)""")


def stock_preds(t):
    df = series.trailing_average(stock_daily(t), "sold", 14, "prediction").withColumn("fact", F.col("sold"))
    return flt.last_days(df, 90)


def _sweep(expr, top):
    return f"""SELECT b AS buffer, avg(greatest(d, 0)) AS mean_stock, sum(greatest(d, 0)) AS total_stock, avg(greatest(-d, 0)) AS mean_deficit,
  sum(greatest(-d, 0)) AS total_deficit, avg(CAST(d < 0 AS INT)) * 100 AS pct_under, avg(CAST(d > 0 AS INT)) * 100 AS pct_over,
  avg(CAST(d = 0 AS INT)) * 100 AS pct_exact, avg(abs(d)) AS mae
FROM (SELECT b, floor({expr} + 0.5e0) - fact AS d FROM stock_preds, (SELECT unnest(range({top} + 1)) AS b)) GROUP BY b"""


_SPEC = "buffer:i mean_stock:f6 total_stock:f mean_deficit:f6 total_deficit:f pct_under:f6 pct_over:f6 pct_exact:f6 mae:f6"


@register("v01_buffer_percent", _SPEC, _sweep("prediction * (100 + b) / 100", 100))
def buffer_percent(t):
    return wi.buffer_sweep(stock_preds(t))


@register("v01_buffer_pieces", _SPEC, _sweep("prediction + b", 10))
def buffer_pieces(t):
    return wi.buffer_sweep(stock_preds(t), "pieces")


@register("v01_parity_buffer", _SPEC, f"""
WITH s AS ({_sweep("prediction * (100 + b) / 100", 100)}) SELECT * FROM s
ORDER BY abs(mean_stock - (SELECT avg(stock) FROM stock_daily)), buffer LIMIT 1""")
def parity_buffer(t):
    return wi.parity_buffer(wi.buffer_sweep(stock_preds(t)), stock_daily(t).agg(F.avg("stock")).scalar())


@register("v02_shortfall", "demand_known:s n_rows:i n_short:i units:f mean_short:f6 n_days:i revenue:f units_per_day:f6 units_per_month:f6", """
WITH s AS (SELECT *, greatest(fact - plan, 0) AS s, CASE WHEN stock > 0 THEN 'known' ELSE 'unknown' END AS k FROM stock_preds),
g AS (SELECT coalesce(k, 'all') AS demand_known, count(*) AS n_rows, count(*) FILTER (s > 0) AS n_short, sum(s) AS units,
      avg(s) FILTER (s > 0) AS mean_short, (SELECT count(DISTINCT date) FROM stock_preds) AS n_days FROM s GROUP BY ROLLUP (k))
SELECT *, units * 100 AS revenue, units / n_days AS units_per_day, units / n_days * 30 AS units_per_month FROM g""")
def shortfall(t):
    return wi.shortfall_report(stock_preds(t))


_SIG = "SELECT *, greatest(plan - fact, 0) AS u FROM stock_preds WHERE stock <= 0"


@register("v03_stockout_signal", "level:i category:s date:d n_rows:i n_signal:i units:f signal_pct:f6 mean_units:f6", f"""
SELECT grouping(category) * 2 + grouping(date) AS level, category, date, count(*) AS n_rows, count(*) FILTER (u > 0) AS n_signal,
  sum(u) AS units, count(*) FILTER (u > 0) * 100e0 / count(*) AS signal_pct, sum(u) / (count(*) FILTER (u > 0) + 1e-8) AS mean_units
FROM ({_SIG}) GROUP BY ROLLUP (category, date)""")
def stockout_signal(t):
    return wi.stockout_signal(stock_preds(t))


@register("v03_stockout_products", "product:s n_signal:i units:f mean_units:f6", f"""
SELECT product, count(*) AS n_signal, sum(u) AS units, avg(u) AS mean_units FROM ({_SIG}) WHERE u > 0 GROUP BY product
ORDER BY units DESC, product LIMIT 10""")
def stockout_products(t):
    return wi.stockout_products(stock_preds(t))


_WASTE = """SELECT {c} count(*) AS n_rows, sum(stock) AS real_waste, sum(greatest(plan - fact, 0)) AS model_waste,
  sum(stock) - sum(greatest(plan - fact, 0)) AS saved,
  (sum(stock) - sum(greatest(plan - fact, 0))) / (sum(stock) + 1e-8) * 100 AS saved_pct,
  (sum(stock) - sum(greatest(plan - fact, 0))) * 60 AS saved_money FROM stock_preds WHERE stock > 0 {g}"""
_WASTE_SPEC = "n_rows:i real_waste:f model_waste:f saved:f saved_pct:f6 saved_money:f2"


@register("v04_waste_saved", _WASTE_SPEC, _WASTE.format(c="", g=""))
def waste_saved(t):
    return wi.waste_saved(stock_preds(t))


@register("v04_waste_saved_by_category", f"category:s {_WASTE_SPEC}", _WASTE.format(c="category,", g="GROUP BY category"))
def waste_saved_by_category(t):
    return wi.waste_saved(stock_preds(t), ("category",))


@register("v04_waste_saved_by_day", f"date:d {_WASTE_SPEC}", _WASTE.format(c="date,", g="GROUP BY date"))
def waste_saved_by_day(t):
    return wi.waste_saved(stock_preds(t), ("date",))


@register("v05_store_plan", "store:i date:d product:s level:i forecast:f6 plan:f fact:f abs_error:f n_rows:i", """
SELECT store, date, product, grouping(product) AS level, sum(prediction) AS forecast, sum(plan) AS plan, sum(fact) AS fact,
  sum(abs(plan - fact)) AS abs_error, count(*) AS n_rows FROM stock_preds GROUP BY GROUPING SETS ((store, date, product), (store, date))""")
def store_plan(t):
    return wi.store_plan(stock_preds(t))
