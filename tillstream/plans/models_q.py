"""G and B: clusters, models, per-series fits, future rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tillstream.functions import weather as wx
from tillstream.operators import aggregates as agg, arima as am, clusters as cl, evaluate as ev, filters as flt
from tillstream.operators import features as ft, linear_models as lin, local_models as lm, model_store as ms, models as md, targets as tg
from tillstream.plans import features_q as ftq
from tillstream.plans.features_q import feature_table
from tillstream.plans.registry import register
from tillstream.session import cut_lineage, ensure_checkpoint_dir
from tillstream.sources.testdata import daily, stock_daily, weather

_M = "n_rows:i mae:f wmape:f r2:f"


def _frames(t):
    """(train, test, features) of the written feature table."""
    return ft.split(feature_table(t))


def _store(t):
    return ms.ModelStore(t.spark, f"{ensure_checkpoint_dir(t.spark)}/models")


def _fit_global(t, loss="squared"):
    """Fit the global model and keep it as a new version, under the name of the feature table's version."""
    table = feature_table(t)
    train, test, f = ft.split(table)
    model = md.gbt(f, loss=loss).fit(train)
    error = md.predict(model, test).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    _store(t).save(f"{loss}_{ftq.table_version(t)}", model, train, f, {} if error is None else {"mae": error})
    return model


def _global(t, loss="squared"):
    """The saved global model of these files, fitted if there is none yet."""
    name = f"{loss}_{ftq.table_version(t)}"
    return _store(t).load(name, rows=feature_table(t))[0] if _store(t).versions(name) else _fit_global(t, loss)


def _with_base(t):
    """(train, test) with the global model's forecast as `base`, each scored once."""
    train, test, _ = _frames(t)
    model = _global(t)
    return [cut_lineage(md.predict(model, rows, "base")) for rows in (train, test)]


# Features of the linear models: level, recent course, price, weather and calendar.
LINEAR = ("demand_lag1", "demand_lag2", "demand_lag7", "demand_lag14", "demand_roll_mean7", "demand_roll_mean30", "demand_roll_std7",
          "demand_dow_mean", "pct_censored_7d", "lost_qty_lag1", "demand_trend", "items_in_store_today", "stock_lag1", "price_vs_median",
          "price_change_7d", "temp_mean", "is_bad_weather", "is_weekend", "is_holiday", "pair_mean", "product_cv")
SEGMENT = ("base", *LINEAR)  # segment models correct the global one


def _score(df, *by, col="prediction"):
    named = df.withColumn("fact", F.col("label")).withColumn("prediction", F.col(col))
    return ev.score(named, by, ("n_rows", "mae", "wmape", "r2"))


@register("g01_sku_clusters", "store:i product:s cluster:i k:i silhouette:f")
def sku_clusters(t):
    train, _ = flt.train_test(stock_daily(t), 90)
    fit = cl.fit_sku_clusters(train)
    return fit.assign(cl.sku_cluster_rows(train)).withColumns({"k": F.lit(fit.k), "silhouette": F.lit(fit.silhouette)})


def _locations(t):
    """Store attributes: a supplier's balance (unknown if negative), its traffic, price level and rivals."""
    sup = t("supplier")
    traffic = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").cast("double").alias("traffic"), F.avg("l_extendedprice").alias("rent"))
    rivals = sup.groupBy("s_nationkey").agg(F.count("*").cast("double").alias("competitors"))
    return (sup.join(traffic, "s_suppkey", "left").join(rivals, "s_nationkey").select(
        F.col("s_suppkey").alias("store"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("area"),
        "traffic", "rent", "competitors"))


_LOC = ("area", "traffic", "rent", "competitors")


@register("g02_store_locatiohas_clusters", "store:i cluster:i k:i silhouette:f")
def store_locatiohas_clusters(t):
    rows = _locations(t)
    fit = cl.fit_store_clusters(rows, _LOC)
    return fit.assign(rows).withColumns({"k": F.lit(fit.k), "silhouette": F.lit(fit.silhouette)})


@register("g03_store_sales_clusters", "store:i cluster:i k:i silhouette:f")
def store_sales_clusters(t):
    city = daily(t).groupBy("store").agg(F.min("city").alias("city"))
    code = F.dense_rank().over(Window.orderBy("city"))  # a row per store
    rows = agg.store_profile(daily(t)).join(city, "store").withColumns(
        {"n_products": F.col("n_products").cast("double"), "city_code": code.cast("double")})
    fit = cl.fit_clusters(rows, ("mean", "std", "cv", "n_products", "city_code"), (5, 6, 7, 8))
    return fit.assign(rows).withColumns({"k": F.lit(fit.k), "silhouette": F.lit(fit.silhouette)})


def _stored_clusters(t):
    """(reloaded pipeline, clustering that was saved) of the SKU clusters, by way of the model store."""
    train = cl.sku_cluster_rows(flt.train_test(stock_daily(t), 90)[0])
    fit = cl.fit_clusters(train, cl.CLUSTER_FEATURES, (3, 5, 7, 9))
    store = _store(t)
    store.save("sku_clusters", fit.model, train, cl.CLUSTER_FEATURES, {"k": fit.k, "silhouette": fit.silhouette})
    rows = cl.sku_cluster_rows(stock_daily(t))
    model, saved = store.load("sku_clusters", rows=rows)
    return cl.Clustering(model, int(saved.metrics["k"]), saved.metrics["silhouette"], {}), fit, rows


@register("g04_assign_and_summarise", "cluster:i n_rows:i demand_mean_mean:f cv_mean:f trend_mean:f")
def assign_and_summarise(t):
    """All rows assigned by the pipeline that was saved and loaded again."""
    saved, _, rows = _stored_clusters(t)
    return cl.cluster_summary(saved.assign(rows), "cluster", ("demand_mean", "cv", "trend"))


@register("g04_reloaded_clusters", "n_rows:i has_clusters:i n_reassigned:i n_not_nearest:i", """
SELECT count(*) AS n_rows, 1 AS has_clusters, 0 AS n_reassigned, 0 AS n_not_nearest FROM (SELECT DISTINCT store, product FROM stock_daily)""")
def reloaded_clusters(t):
    """The reloaded pipeline assigns as the fitted one, each row to the nearest of the stored centres."""
    saved, fit, rows = _stored_clusters(t)
    nearest = cl.nearest_centre(saved, rows).select("store", "product", F.col("cluster").alias("nearest"))
    both = saved.assign(rows).join(fit.assign(rows).select("store", "product", F.col("cluster").alias("fitted")), ["store", "product"]).join(nearest, ["store", "product"])
    return both.agg(F.count("*").alias("n_rows"), (F.countDistinct("cluster") > 1).cast("int").alias("has_clusters"),
                    F.count_if(F.col("cluster") != F.col("fitted")).alias("n_reassigned"), F.count_if(F.col("cluster") != F.col("nearest")).alias("n_not_nearest"))


@register("b01_global_squared", f"category:s {_M}")
def global_squared(t):
    _, test, _ = _frames(t)
    return _score(md.predict(_fit_global(t), test), "category")


@register("b01_saved_model", f"category:s {_M}")
def saved_model(t):
    """Scores of the global model as it was saved and loaded again."""
    _, test, _ = _frames(t)
    return _score(md.predict(_global(t), test), "category")


@register("b02_global_median", f"category:s {_M}")
def global_median(t):
    train, test, f = _frames(t)
    return _score(md.fit_predict(md.gbt(f, loss="absolute"), train, test), "category")


_B03 = "n_rows:i coverage_pct:f coverage50_pct:f crossing_any_pct:f width_mean:f width_median:f width_p90:f pinball_p10:f pinball_p50:f pinball_p90:f"


def _interval(df):
    inner = F.avg(((F.col("fact") >= F.col("p25")) & (F.col("fact") <= F.col("p75"))).cast("int")) * 100
    return ev.interval_report(df).withColumn("coverage50_pct", df.agg(inner).scalar())


@register("b03_intervals", _B03)
def intervals(t):
    """P10 to P90 by quantile regression on the features and the median model, on rows that this has not seen."""
    train, test, f = _frames(t)
    out = md.quantile_intervals(md.gbt(f, loss="absolute"), train, test, LINEAR)
    return _interval(out.withColumn("fact", F.col("label")))


@register("b03_residual_intervals", _B03)
def residual_intervals(t):
    """Residual quantiles per category around the median model."""
    train, test, f = _frames(t)
    out = md.residual_intervals(md.gbt(f, loss="absolute"), train, test, "category")
    return _interval(out.withColumn("fact", F.col("label")))


@register("b04_tweedie", f"category:s {_M}")
def tweedie(t):
    train, test, f = _frames(t)
    return _score(md.fit_predict(md.tweedie(f), train, test), "category")


@register("b05_log_target", f"category:s {_M}")
def log_target(t):
    train, test, f = _frames(t)
    return _score(md.log_forecast(train, test, f), "category")


@register("b05_log_residual", f"category:s {_M}")
def log_residual(t):
    train, test, f = _frames(t)
    return _score(md.log_residual_forecast(train, test, f), "category")


@register("b06_weighted_models", f"weights:s {_M}")
def weighted_models(t):
    train, test, f = _frames(t)
    weak = train.groupBy("store", "product").agg((F.stddev_samp("label") > F.avg("label") * 0.6).cast("int").alias("is_weak_sku"))
    rows = tg.sample_weights(train.join(weak, ["store", "product"]), "label")
    out = None
    for w in [c for c in rows.columns if c.startswith("w_")]:
        part = _score(md.fit_predict(md.gbt(f, weight=w), rows, test)).withColumn("weights", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return out


@register("b07_segment_models", f"model_scope:s {_M}")
def segment_models(t):
    train, test = _with_base(t)
    return _score(lin.segmented_forecast(train, test, "category", SEGMENT), "model_scope")


@register("b07_segment_coefficients", "segment:s n_rows:i slope:f intercept:f", """
SELECT store || '/' || product AS segment, count(*) AS n_rows, regr_slope(demand, demand_roll_mean7) AS slope,
  regr_intercept(demand, demand_roll_mean7) AS intercept
FROM feature_table WHERE is_test = 0 GROUP BY store, product HAVING count(*) >= 5""")
def segment_coefficients(t):
    """One feature, one model per pair of five rows and more: the same sums as the slope and intercept of SQL."""
    train, _, _ = _frames(t)
    scale, models, _ = lin.segment_regression(train.withColumn("segment", F.concat_ws("/", "store", "product")), "segment", ["demand_roll_mean7"], ridge=0.0)
    slope = F.col("beta")[1] / F.lit(scale.deviations[0])
    return models.filter("n_rows >= 5").select("segment", "n_rows", slope.alias("slope"), (F.col("beta")[0] - slope * F.lit(scale.means[0])).alias("intercept"))


@register("b07_tier_models", f"tier:s {_M}")
def tier_models(t):
    train, test = _with_base(t)
    tiered = tg.volume_tiers(train, train, "label"), tg.volume_tiers(train, test, "label")
    return _score(lin.segmented_forecast(*tiered, "tier", SEGMENT), "tier")


@register("b07_cluster_routed", f"model_scope:s {_M}")
def cluster_routed(t):
    from tillstream.operators import joins
    train, test = _with_base(t)
    fit = cl.fit_sku_clusters(train)
    groups = cut_lineage(fit.assign(cl.sku_cluster_rows(train)).select("store", "product", "cluster"))
    rows = [joins.attach_cluster(x, groups, "cluster") for x in (train, test)]
    return _score(lin.segmented_forecast(*rows, "cluster", SEGMENT), "model_scope")


@register("b07_high_demand_routed", f"is_high_demand:i {_M}")
def high_demand_routed(t):
    train, test = _with_base(t)
    mean = F.col("pair_mean") >= tg.HIGH_DEMAND
    rows = [x.withColumn("is_high_demand", mean.cast("int")) for x in (train, test)]
    return _score(lin.segmented_forecast(*rows, "is_high_demand", SEGMENT), "is_high_demand")


@register("b11_stacking", f"category:s {_M}")
def stacking(t):
    train, test, f = _frames(t)
    return _score(md.stacked_forecast(train, test, f, trees=20), "category")


@register("b11_temporal_stacking", f"category:s {_M}")
def temporal_stacking(t):
    train, test, f = _frames(t)
    return _score(md.stacked_forecast(train, test, f, temporal=True, trees=20), "category")


@register("b11_window_ensemble", f"category:s {_M}")
def window_ensemble(t):
    train, test, f = _frames(t)
    return _score(md.window_ensemble(train, test, f, trees=20), "category")


@register("b11_residual_chain", f"category:s {_M}")
def residual_chain(t):
    train, test, f = _frames(t)
    known = ("encodings", "calendar")
    stages = [list(ft.GROUPS["encodings"]), [c for g, cs in ft.GROUPS.items() if g not in known for c in cs], list(ft.GROUPS["calendar"])]
    return _score(md.residual_chain(train, test, stages, 20), "category")


@register("b12_two_stage", f"routing:s {_M}")
def two_stage(t):
    train, test, f = _frames(t)
    out = md.two_stage_forecast(train, test, f)
    hard = _score(out, col="prediction_hard").withColumn("routing", F.lit("hard"))
    return hard.unionByName(_score(out, col="prediction_soft").withColumn("routing", F.lit("soft")))


@register("b15_search", "rung:i depth:i step:f n_folds:i history_days:i trees:i mae:f is_kept:i test_mae:f")
def search(t):
    """Trials by rung; the winner's row has its error on the test days, fitted again on all training rows."""
    train, test, f = _frames(t)
    trials, winner = md.search(train, f)
    error = md.predict(winner, test).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] if winner else None
    last = trials.agg(F.max("rung")).scalar()
    return trials.withColumn("test_mae", F.when((F.col("rung") == last) & (F.col("is_kept") == 1), F.lit(error).cast("double")))


@register("b16_feature_importance", "feature:s importance:f6")
def feature_importance(t):
    train, _, f = _frames(t)
    return md.feature_importance(_global(t), f, train)


@register("b17_learning_curve", "history_days:i mae:f exponent:f fitted_mae:f")
def learning_curve(t):
    train, test, f = _frames(t)
    return md.learning_curve(train, test, f)


def _local(t):
    return flt.label_split(stock_daily(t), 90)


def _local_score(df, *by):
    return _score(df.withColumn("label", F.col("demand")), *by)


@register("b08_local_models", f"status:s {_M}")
def local_models(t):
    from tillstream.operators import series
    rows = _local(t).transform(series.add_series_features, "demand", "demand")
    return _local_score(lm.local_forecast(rows, series.feature_columns(rows, ["demand"])), "status")


@register("b09_trend_season", f"variant:s {_M}")
def trend_season(t):
    rows, out = _local(t), None
    for v in lm.VARIANTS:
        part = _local_score(lm.trend_season_forecast(rows, v)).withColumn("variant", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


@register("b09_trend_breaks", f"status:s n_breaks:i {_M}")
def trend_breaks(t):
    """Trend with change points per series, by how many there are."""
    found = lm.trend_break_forecast(_local(t)).withColumn("n_breaks", F.size("breaks"))
    return _local_score(found, "status", "n_breaks")


@register("b10_store_totals", f"family:s {_M}")
def store_totals(t):
    from tillstream.operators import series
    totals = agg.store_totals(stock_daily(t), ["demand"]).withColumn("product", F.lit("all")).withColumn("category", F.lit("all"))
    train, test, f = md.training_frames(totals, 90, "demand")
    glob = _score(md.fit_predict(md.gbt(f), train, test)).withColumn("family", F.lit("global"))
    rows = flt.label_split(totals, 90).transform(series.add_series_features, "demand", "demand")
    local = _local_score(lm.local_forecast(rows, series.feature_columns(rows, ["demand"]), keys=("store",)))
    season = _local_score(lm.trend_season_forecast(flt.label_split(totals, 90), keys=("store",)))
    return (glob.unionByName(local.withColumn("family", F.lit("per_store")))
                .unionByName(season.withColumn("family", F.lit("per_store_trend"))))


@register("b18_stationarity", "store:i product:s adf_stat:f adf_pvalue:f kpss_stat:f kpss_pvalue:f stationary_adf:i stationary_kpss:i")
def stationarity(t):
    return lm.stationarity(stock_daily(t))


@register("b18_kpss", "store:i product:s kpss_stat:f stationary_kpss:i", """
WITH e AS (SELECT store, product, row_number() OVER w AS i, count(*) OVER p AS n, demand - avg(demand) OVER p AS e,
  stddev_pop(demand) OVER p AS sd FROM stock_daily WINDOW p AS (PARTITION BY store, product), w AS (PARTITION BY store, product ORDER BY date)),
c AS (SELECT *, sum(e) OVER (PARTITION BY store, product ORDER BY i) AS s FROM e),
a AS (SELECT x.store, x.product, x.i - y.i AS k, sum(x.e * y.e) AS acv FROM c x JOIN c y
      ON x.store = y.store AND x.product = y.product AND x.i > y.i AND x.i - y.i <= 80 GROUP BY x.store, x.product, x.i - y.i),
g AS (SELECT store, product, max(n) AS n, max(sd) AS sd, sum(s * s) AS ss, sum(e * e) AS ee FROM c GROUP BY store, product),
b AS (SELECT g.store, g.product, g.ee / g.n + coalesce(sum(2e0 * acv / n) FILTER (k <= floor(pow(n, 2e0 / 9))), 0) AS level,
        coalesce(sum(k * 2e0 * acv / n) FILTER (k <= floor(pow(n, 2e0 / 9))), 0) AS slope
      FROM g LEFT JOIN a USING (store, product) GROUP BY g.store, g.product, g.ee, g.n),
l AS (SELECT store, product, CASE WHEN level = 0 THEN 0 ELSE least(floor(1.1447e0 * pow(pow(slope / nullif(level, 0), 2), 1e0 / 3) * pow(n, 1e0 / 3)), n - 1) END AS l
      FROM g JOIN b USING (store, product)),
v AS (SELECT g.store, g.product, any_value(g.n) AS n, any_value(sd) AS sd, any_value(ss) AS ss,
        (any_value(ee) + 2 * coalesce(sum((1 - k / (l + 1)) * acv) FILTER (k <= l), 0)) / any_value(g.n) AS s2
      FROM g JOIN l USING (store, product) LEFT JOIN a USING (store, product) GROUP BY g.store, g.product),
k AS (SELECT store, product, CASE WHEN n < 8 OR sd < 1e-8 OR s2 <= 0 THEN 0 ELSE ss / (n * n * s2) END AS kpss_stat FROM v)
SELECT *, CAST(kpss_stat < 0.463e0 AS INT) AS stationary_kpss FROM k""")
def kpss(t):
    return lm.stationarity(stock_daily(t))


_FUT = " ".join(f"sold_lag{k}:f" for k in (1, 2, 3, 7, 14, 30))


@register("b19_future_rows", f"store:i product:s date:d category:s last_sale:d dow:i is_holiday:i is_payday_week:i {_FUT} temp_mean:f is_rainy:i",
          """
WITH m AS (SELECT max(date) AS last FROM daily),
p AS (SELECT store, product, max(category) AS category, max(city) AS city, max(date) AS last_sale FROM daily GROUP BY store, product),
f AS (SELECT p.*, last + CAST(k AS INT) AS date FROM p, m, (SELECT unnest(range(1, 15)) AS k))
SELECT f.*, isodow(f.date) - 1 AS dow, CAST(month(f.date) * 100 + day(f.date) IN (101,102,103,104,105,106,107,108,223,308,501,509,612,1104) AS INT) AS is_holiday,
  CAST(day(f.date) IN (4,5,6,19,20,21) AS INT) AS is_payday_week, """
          + ", ".join(f"l{k}.sold AS sold_lag{k}" for k in (1, 2, 3, 7, 14, 30))
          + ", w.temp_mean, w.is_rainy FROM f "
          + " ".join(f"LEFT JOIN daily l{k} ON l{k}.store = f.store AND l{k}.product = f.product AND l{k}.date = f.date - {k}"
                     for k in (1, 2, 3, 7, 14, 30))
          + " LEFT JOIN weather_full w ON w.city = f.city AND w.date = f.date")
def future_rows(t):
    forecast = weather(t).transform(wx.add_weather_flags)
    return md.future_rows(daily(t), "sold", forecast)


@register("b20_autoregressive", f"exog:s origin:i {_M}")
def autoregressive(t):
    rows = stock_daily(t)
    plain = _local_score(lm.recursive_forecast(rows), "origin").withColumn("exog", F.lit("none"))
    cal = _local_score(lm.recursive_forecast(rows, exog=("is_weekend", "is_holiday", "is_payday_week")), "origin")
    return plain.unionByName(cal.withColumn("exog", F.lit("calendar")))


@register("b20_arima_families", f"family:s origin:i status:s {_M}")
def arima_families(t):
    """Rolling-origin errors of the four families: with and without weekly terms, with and without regressors."""
    return _local_score(am.arima_forecast(stock_daily(t)), "family", "origin", "status")


@register("b20_arima_orders", "orders:s n_series:i n_rows:i sigma:f")
def arima_orders(t):
    """Which seasonal orders the search takes, over how many series."""
    models = am.arima_models(stock_daily(t))
    return models.groupBy("orders").agg(F.count("*").alias("n_series"), F.sum("n_rows").alias("n_rows"), F.avg("sigma").alias("sigma"))


# Both regressions in sums: a long autoregression of one lag gives e, then w on its own lag and that of e.
@register("b20_two_step", "store:i product:s n_rows:i ar1:f ma1:f", """
WITH y AS (SELECT store, product, count(*) OVER p AS n, row_number() OVER w - 8 AS t, demand - lag(demand, 7) OVER w AS w FROM stock_daily
  WINDOW p AS (PARTITION BY store, product), w AS (PARTITION BY store, product ORDER BY date)),
l AS (SELECT *, lag(w) OVER (PARTITION BY store, product ORDER BY t) AS w1 FROM y WHERE t >= 0),
f AS (SELECT store, product, sum(w * w1) / nullif(sum(w1 * w1), 0) AS phi, stddev_pop(w) AS sd FROM l GROUP BY store, product),
e AS (SELECT l.*, sd, lag(w - phi * w1) OVER (PARTITION BY l.store, l.product ORDER BY t) AS e1 FROM l JOIN f USING (store, product)),
g AS (SELECT store, product, max(sd) AS sd, sum(w1 * w1) AS aa, sum(w1 * e1) AS ab, sum(e1 * e1) AS bb, sum(w1 * w) AS aw, sum(e1 * w) AS bw
  FROM e WHERE t >= 2 GROUP BY store, product),
c AS (SELECT *, (aw * bb - bw * ab) / nullif(aa * bb - ab * ab, 0) AS a, (bw * aa - aw * ab) / nullif(aa * bb - ab * ab, 0) AS b FROM g)
SELECT store, product, n AS n_rows, CASE WHEN good THEN a END AS ar1, CASE WHEN good THEN b END AS ma1
FROM (SELECT DISTINCT store, product, n FROM y) LEFT JOIN c USING (store, product)
  CROSS JOIN LATERAL (SELECT n >= 21 AND sd >= 1e-8 AND abs(a) < 0.995e0 AND abs(b) < 0.995e0 AS good)""")
def two_step(t):
    """Fixed orders (1,0,1)(0,1,0)[7] without the refinement, which plain sums can follow."""
    models = am.arima_models(stock_daily(t), orders=am.Orders(p=1, q=1, sd=1), long_order=1, refine=False)
    return models.select("store", "product", "n_rows", F.col("ar")[1].alias("ar1"), F.col("ma")[1].alias("ma1"))
