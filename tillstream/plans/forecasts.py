"""Deterministic forecasts of the dense daily series, shared by evaluation and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillstream.operators import filters as flt, joins, series
from tillstream.plans.oracle_base import add_base
from tillstream.sources.testdata import Tables, daily

MODELS = ("avg14", "dow_last", "dow_mean4", "lag_filled")
TEST_DAYS = 90

_P = "PARTITION BY store, product ORDER BY date"
_W = "PARTITION BY store, product, isodow(date) ORDER BY date"
_PAST = f"avg(sold) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

add_base("all_preds", f"""
SELECT *, coalesce(lag_core, avg14) AS lag_filled FROM (
  SELECT d.*, CASE WHEN a.sold IS NULL THEN b.sold WHEN b.sold IS NULL THEN a.sold ELSE (a.sold + b.sold) / 2 END AS lag_core FROM (
    SELECT date, store, product, category, city, sold, sold AS fact,
      coalesce(avg(sold) OVER ({_P} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), (SELECT avg(sold) FROM daily)) AS avg14,
      coalesce(lag(sold) OVER ({_W}), {_PAST}) AS dow_last,
      coalesce(avg(sold) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), {_PAST}) AS dow_mean4 FROM daily) d
  LEFT JOIN daily a ON a.store = d.store AND a.product = d.product AND a.date = d.date - 7
  LEFT JOIN daily b ON b.store = d.store AND b.product = d.product AND b.date = d.date - 14)""")
add_base("wide_preds", "SELECT * FROM all_preds WHERE date >= (SELECT max(date) - 89 FROM daily)")
add_base("long_preds", " UNION ALL ".join(
    f"SELECT date, store, product, category, fact, '{m}' AS model, {m} AS prediction FROM wide_preds" for m in MODELS))


def all_forecasts(t: Tables) -> DataFrame:
    """Every day with the forecasts made from its past, the whole history through."""
    return (daily(t).transform(series.trailing_average, "sold").transform(series.weekday_naive, "sold")
            .transform(joins.lag_mean, "sold")
            .withColumn("lag_filled", F.coalesce("lag_core", "avg14"))
            .withColumn("fact", F.col("sold")))


def wide_forecasts(t: Tables) -> DataFrame:
    """The 90-day hold-out."""
    return flt.last_days(all_forecasts(t), TEST_DAYS)


def long_forecasts(t: Tables, models=MODELS) -> DataFrame:
    pairs = F.create_map(*[x for m in models for x in (F.lit(m), F.col(m))])
    return wide_forecasts(t).select("date", "store", "product", "category", "fact",
                                    F.explode(pairs).alias("model", "prediction"))
