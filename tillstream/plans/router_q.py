"""R: model routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import router as rt
from tillstream.plans.evaluate_q import best_sku
from tillstream.plans.forecasts import MODELS
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register

# The four simple forecasts stand in for the trained candidates.
ROLES = {"simple": "avg14", "censoring": "dow_last", "assortment": "dow_mean4", "cluster": "lag_filled", "local": "dow_mean4"}

add_base("router_base", """
SELECT k.*, n_days, mean_demand, median_demand, std_demand, share_zero, share_censored, lost_mean, demand_trend_mean, cv_7d_mean, cv_demand
FROM best_sku k JOIN behaviour b ON b.store = k.store AND b.product = k.product""")
_D = """(CASE WHEN mean_demand < 4 THEN 1.2e0 WHEN mean_demand < 8 THEN 0.6e0 ELSE 0 END
  + CASE WHEN cv_demand > 1.2e0 THEN 1.2e0 WHEN cv_demand > 0.9e0 THEN 0.7e0 ELSE 0 END
  + CASE WHEN share_censored > 0.7e0 THEN 1.1e0 WHEN share_censored > 0.5e0 THEN 0.6e0 ELSE 0 END
  + CASE WHEN n_days < 30 THEN 1e0 WHEN n_days < 60 THEN 0.4e0 ELSE 0 END
  + CASE WHEN cv_7d_mean > 0.45e0 THEN 0.2e0 ELSE 0 END
  + CASE WHEN demand_trend_mean < 0.85e0 AND demand_trend_mean <> 0 OR demand_trend_mean > 1.15e0 THEN 0.25e0 ELSE 0 END)"""
add_base("ruled", f"""
SELECT *, 'lag_filled' AS single,
  CASE WHEN cv_demand > 1 THEN 'avg14' WHEN mean_demand < 5 THEN 'avg14' WHEN share_censored > 0.5e0 THEN 'dow_last'
    WHEN cv_demand < 0.6e0 AND mean_demand > 10 THEN 'lag_filled' WHEN share_censored > 0.35e0 THEN 'dow_mean4'
    WHEN mean_demand > 8 AND cv_demand < 0.8e0 THEN 'dow_mean4' ELSE 'lag_filled' END AS rule_v0,
  CASE WHEN cv_demand > 1.25e0 AND mean_demand < 8 THEN 'avg14' WHEN mean_demand < 4 AND cv_demand > 0.8e0 THEN 'avg14'
    WHEN share_censored > 0.65e0 AND mean_demand < 15 THEN 'dow_last' WHEN share_censored > 0.45e0 AND mean_demand < 12 THEN 'dow_mean4'
    WHEN cv_demand < 0.7e0 AND mean_demand > 8 THEN 'lag_filled' WHEN mean_demand > 12 AND cv_demand < 0.85e0 THEN 'lag_filled'
    WHEN mean_demand > 6 AND cv_demand < 1 THEN 'dow_mean4' ELSE 'lag_filled' END AS rule_v1,
  CASE WHEN n_days < 14 THEN 'avg14' WHEN cv_demand > 1.35e0 AND mean_demand < 6 THEN 'avg14' WHEN difficulty >= 3 AND mean_demand < 8 THEN 'avg14'
    WHEN share_censored > 0.7e0 AND mean_demand < 18 THEN 'dow_last' WHEN share_censored > 0.5e0 AND mean_demand < 12 THEN 'dow_mean4'
    WHEN mean_demand > 14 AND cv_demand < 0.75e0 AND share_censored < 0.6e0 THEN 'lag_filled'
    WHEN mean_demand > 8 AND cv_demand < 0.9e0 AND share_censored < 0.55e0 THEN 'lag_filled'
    WHEN mean_demand > 6 AND cv_demand < 0.8e0 AND n_days > 90 THEN 'dow_mean4' ELSE 'lag_filled' END AS rule_v2,
  CASE WHEN avg14_r2 = g THEN 'avg14' WHEN dow_last_r2 = g THEN 'dow_last' WHEN dow_mean4_r2 = g THEN 'dow_mean4'
    WHEN lag_filled_r2 = g THEN 'lag_filled' END AS oracle
FROM (SELECT *, {_D} AS difficulty, greatest(avg14_r2, dow_last_r2, dow_mean4_r2, lag_filled_r2) AS g FROM router_base)""")


def router_base(t):
    from tillstream.operators import aggregates as agg
    from tillstream.plans.series_q import trend_frame
    return best_sku(t).join(agg.sku_behaviour(trend_frame(t)), ["store", "product"])


def ruled(t):
    return rt.oracle_model(rt.add_rules(router_base(t), ROLES), MODELS)


@register("r01_rules", "store:i product:s difficulty:f rule_v0:s rule_v1:s rule_v2:s", "SELECT * FROM ruled")
def rules(t):
    return ruled(t)


def _pick(s, v):
    return "CASE " + " ".join(f"WHEN {s} = '{m}' THEN {m}_{v}" for m in MODELS) + " END"


@register("r02_chosen_metrics", "store:i product:s oracle:s oracle_r2:f oracle_mae:f rule_v2_r2:f rule_v2_mae:f rule_v2_wmape:f2",
          f"SELECT store, product, oracle, {_pick('oracle', 'r2')} AS oracle_r2, {_pick('oracle', 'mae')} AS oracle_mae, "
          f"{_pick('rule_v2', 'r2')} AS rule_v2_r2, {_pick('rule_v2', 'mae')} AS rule_v2_mae, {_pick('rule_v2', 'wmape')} AS rule_v2_wmape FROM ruled")
def chosen_metrics(t):
    df = rt.chosen_metrics(ruled(t), "oracle", MODELS, "oracle")
    return rt.chosen_metrics(df, "rule_v2", MODELS, "rule_v2")


_SCHEMES = ("oracle", "rule_v0", "rule_v1", "rule_v2", "single")


@register("r02_scheme_summary", "scheme:s avg_r2:f9 median_r2:f6 avg_mae:f9 avg_mse:f9 avg_wmape:f9 positive_r2_share:f6 n_rows:i",
          " UNION ALL ".join(f"""SELECT '{s}' AS scheme, avg(r2) AS avg_r2, median(r2) AS median_r2, avg(mae) AS avg_mae, avg(mse) AS avg_mse,
  avg(wmape) AS avg_wmape, avg(CAST(coalesce(r2 > 0, FALSE) AS INT)) AS positive_r2_share, count(*) AS n_rows
  FROM (SELECT {", ".join(f"{_pick(s, v)} AS {v}" for v in ("r2", "mae", "mse", "wmape"))} FROM ruled)""" for s in _SCHEMES))
def scheme_summary(t):
    return rt.scheme_summary(ruled(t), _SCHEMES, MODELS)


@register("r02_win_counts", "model:s win_count:i", "SELECT oracle AS model, count(*) AS win_count FROM ruled GROUP BY oracle")
def win_counts(t):
    return rt.win_counts(ruled(t), "oracle")


_GATE = f"""
x AS (SELECT *, rule_v1 AS router_model, CASE WHEN n_days >= 150 THEN 1e0 ELSE n_days / 150e0 END AS conf FROM ruled),
g AS (SELECT x.*, f AS fallback, (30 + 5 * i) / 100e0 AS threshold, CASE WHEN conf >= (30 + 5 * i) / 100e0 THEN router_model ELSE f END AS m
      FROM x, (SELECT unnest(range(11)) AS i), (VALUES ('lag_filled'), ('avg14')) v(f)),
s AS (SELECT fallback, threshold, count(*) AS n_rows, avg(CAST(conf >= threshold AS INT)) AS gate_coverage,
  avg({_pick('m', 'r2')}) AS avg_r2, avg({_pick('m', 'mae')}) AS avg_mae, avg({_pick('m', 'mse')}) AS avg_mse, avg({_pick('m', 'wmape')}) AS avg_wmape,
  avg(CAST(coalesce(({_pick('m', 'r2')}) > 0, FALSE) AS INT)) AS positive_r2_share FROM g GROUP BY fallback, threshold)"""
_GATE_SPEC = "fallback:s threshold:f2 n_rows:i gate_coverage:f6 avg_r2:f9 avg_mae:f9 avg_mse:f9 avg_wmape:f9 positive_r2_share:f6"


def _gate(t):
    scored = ruled(t).withColumns({"router_model": F.col("rule_v1"), "router_confidence": F.least(F.col("n_days") / 150, F.lit(1.0))})
    return rt.gate_sweep(scored, MODELS, ("lag_filled", "avg14"))


@register("r03_gate_sweep", _GATE_SPEC, f"WITH {_GATE} SELECT * FROM s")
def gate_sweep(t):
    return _gate(t)


@register("r03_best_gate", _GATE_SPEC, f"""
WITH {_GATE} SELECT * FROM s ORDER BY floor(avg_wmape * 100 + 0.5e0), -floor(avg_r2 * 1e4 + 0.5e0), floor(avg_mae * 1e4 + 0.5e0),
  CASE fallback WHEN 'lag_filled' THEN 0 ELSE 1 END, threshold LIMIT 1""")
def best_gate(t):
    return rt.best_gate(_gate(t))


@register("r04_learned_router", "store:i product:s oracle:s fold:i router_model:s router_confidence:f router_margin:f status:s")
def learned_router(t):
    return rt.learned_router(ruled(t))
