"""Scoring, comparing and profiling forecasts.

Metrics are sums over rows, so every grouping combines map-side; several models are one
long table with a `model` column and are scored in a single aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.maths import bucket, ratio, round_half_up
from tillstream.operators.common import DATE, PAIR, max_date
from tillstream.operators.joins import pivot_models
from tillstream.operators.quantiles import exact_quantiles
from tillstream.operators.ranking import common_dates
from tillstream.operators.series import horizon_forecast
from tillstream.session import cut_lineage

METRICS = ("r2", "mse", "mae", "wmape")


def r_squared(y: Column, p: Column) -> Column:
    """1 - SSE / SST over rows with both values; null below two rows or for a constant truth."""
    ok = y.isNotNull() & p.isNotNull()
    y, e = F.when(ok, y), F.when(ok, y - p)
    n = F.count(y)
    sst = F.var_pop(y) * n  # exact also for large totals, unlike sum(y^2) - sum(y)^2 / n
    flat = F.max(y) - F.min(y) <= F.abs(F.min(y)) * 1e-5 + 1e-8
    return F.when((n >= 2) & ~flat, 1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0)))


def metric_columns(y: str = "fact", p: str = "prediction") -> dict[str, Column]:
    y, p = F.col(y), F.col(p)
    ok = y.isNotNull() & p.isNotNull()
    err = F.when(ok, y - p)
    return {
        "n_rows": F.count(err), "mae": F.avg(F.abs(err)), "mse": F.avg(err * err),
        "rmse": F.sqrt(F.avg(err * err)), "wmape": F.sum(F.abs(err)) / (F.sum(F.when(ok, y)) + 1e-8) * 100,
        "bias": F.avg(err), "r2": r_squared(y, p),
    }


def score(preds: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    cols = metric_columns()
    return preds.groupBy(*by).agg(*[cols[n].alias(n) for n in (names or cols)])


def score_per_sku(preds: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rounded metrics per (key, model); rounding comes before any model is compared."""
    raw = preds.filter(F.col("prediction").isNotNull()).groupBy(*keys, "model").agg(
        F.count("*").alias("n_test_rows"), F.countDistinct(DATE).alias("n_test_days"),
        *[metric_columns()[m].alias(m) for m in METRICS])
    digits = {"r2": 4, "mse": 4, "mae": 4, "wmape": 2}
    return raw.withColumns({m: round_half_up(F.col(m), d, 0.50001) for m, d in digits.items()})


def score_by_threshold(preds: DataFrame, thresholds: Sequence[int] = (15, 50, 100, 200)) -> DataFrame:
    """MAE and rows with demand at or above each threshold, in one pass."""
    err = F.abs(F.col("fact") - F.col("prediction"))
    aggs = []
    for x in thresholds:
        big = F.col("fact") >= x
        aggs += [F.avg(F.when(big, err)).alias(f"mae_{x}"), F.count_if(big & err.isNotNull()).alias(f"n_{x}")]
    return preds.groupBy("model").agg(*aggs)


def percentage_errors(preds: DataFrame) -> DataFrame:
    """MAPE over positive facts and the sales-weighted MAPE."""
    err = F.abs(F.col("fact") - F.col("prediction"))
    pos = F.col("fact") > 0
    weighted = F.sum(F.when(pos, err)) * 100
    return preds.groupBy("model").agg(
        (F.avg(F.when(pos, err / F.nullif("fact", F.lit(0.0)))) * 100).alias("mape"),
        ratio(weighted, F.sum(F.when(pos, F.col("fact")))).alias("weighted_mape"))


def pinball(y: Column, q: Column, alpha: float) -> Column:
    e = y - q
    return F.greatest(e * alpha, e * (alpha - 1))


def interval_report(df: DataFrame, y: str = "fact", low: str = "p10", mid: str = "p50", high: str = "p90",
                    alphas: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Pinball losses, coverage, width and crossing of a prediction interval.

    Width quantiles cover all rows at once and are found in bands."""
    y, lo, md, hi = F.col(y), F.col(low), F.col(mid), F.col(high)
    width = df.select((hi - lo).alias("width"))
    q = exact_quantiles(width, [], "width", [0.5, 0.9]).select(F.struct("q0", "q1")).scalar()

    def pct(cond: Column) -> Column:
        return F.avg(cond.cast("int")) * 100

    one = df.agg(
        F.count("*").alias("n_rows"),
        *[F.avg(pinball(y, c, a)).alias(f"pinball_{n}") for c, a, n in zip((lo, md, hi), alphas, (low, mid, high))],
        pct((y >= lo) & (y <= hi)).alias("coverage_pct"), F.avg(hi - lo).alias("width_mean"),
        pct(lo > md).alias("crossing_low_pct"), pct(md > hi).alias("crossing_high_pct"),
        pct((lo > md) | (md > hi)).alias("crossing_any_pct"), F.avg((hi - md) - (md - lo)).alias("asymmetry"))
    return one.withColumn("_q", q).select("*", F.col("_q.q0").alias("width_median"),
                                          F.col("_q.q1").alias("width_p90")).drop("_q")


def best_by_sku(metrics: DataFrame, models: Sequence[str], keys: Sequence[str] = PAIR) -> DataFrame:
    """Wide metrics plus the model with the highest R2; ties and all-missing go to the
    model that comes first in the list."""
    wide = pivot_models(metrics, models, METRICS, keys)
    low = F.lit(float("-inf"))
    scores = {m: F.coalesce(F.col(f"{m}_r2"), low) for m in models}
    best = F.greatest(*scores.values()) if len(models) > 1 else scores[models[0]]
    choice = F
    for m, s in scores.items():
        choice = choice.when(s == best, m)
    out = wide.withColumn("best_model", choice)

    def chosen(metric: str) -> Column:
        pick = F
        for m in models:
            pick = pick.when(F.col("best_model") == m, F.col(f"{m}_{metric}"))
        return pick.alias(f"best_{metric}")

    return out.select("*", *[chosen(m) for m in METRICS])


def model_summary(metrics: DataFrame, best: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Means, medians and wins per model over all SKUs.

    The metric table (one row per SKU and model) is read three times and so written once."""
    metrics = cut_lineage(metrics)
    base = metrics.groupBy("model").agg(
        F.count("r2").alias("n_pairs"), F.avg("r2").alias("avg_r2"), F.avg("mae").alias("avg_mae"),
        F.avg("mse").alias("avg_mse"), F.avg("wmape").alias("avg_wmape"))
    r2 = exact_quantiles(metrics, ["model"], "r2", [0.5]).withColumnRenamed("q0", "median_r2")
    mae = exact_quantiles(metrics, ["model"], "mae", [0.5]).withColumnRenamed("q0", "median_mae")
    wins = best.groupBy(F.col("best_model").alias("model")).agg(F.count("*").alias("win_count"))
    return (base.join(r2, "model", "left").join(mae, "model", "left").join(wins, "model", "left")
                .fillna(0, subset=["win_count"]))


def hybrid_rows(preds: DataFrame, best: DataFrame, n_models: int) -> DataFrame:
    """Predictions of each SKU's best model on the dates all models share."""
    shared = preds.join(common_dates(preds, n_models), DATE, "left_semi")
    return shared.join(best.select(*PAIR, "best_model"), list(PAIR)).filter(F.col("model") == F.col("best_model"))


def model_usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(F.count("*").alias("n_rows"),
                                     F.countDistinct(*PAIR).alias("n_pairs"))


def challenge(best: DataFrame, challenger: DataFrame, name: str) -> DataFrame:
    """The challenger replaces the source winner where its R2 is higher or the source has none."""
    c = challenger.select(*PAIR, *[F.col(m).alias(f"_{m}") for m in METRICS])
    joined = best.join(c, list(PAIR), "left")
    wins = F.col("_r2").isNotNull() & (F.col("best_r2").isNull() | (F.col("_r2") > F.col("best_r2")))
    cols = {"source_model": F.col("best_model"), "winner_source": F.when(wins, name).otherwise("source"),
            "best_model": F.when(wins, name).otherwise(F.col("best_model"))}
    cols |= {f"best_{m}": F.when(wins, F.col(f"_{m}")).otherwise(F.col(f"best_{m}")) for m in METRICS}
    return joined.withColumn("_wins", wins).select(
        *[c for c in best.columns if c not in cols],
        *[v.alias(k) for k, v in cols.items()])


def compare_pair(wide: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Metrics of two prediction columns side by side, their coverage and MAE difference."""
    aggs = [F.count("*").alias("n_rows")]
    for tag, col in (("main", a), ("other", b)):
        m = metric_columns("fact", col)
        aggs += [m[x].alias(f"{tag}_{x}") for x in ("mae", "wmape", "r2", "bias")]
        aggs.append((m["n_rows"] / F.count("*")).alias(f"{tag}_coverage"))
    return wide.groupBy(*by).agg(*aggs).withColumn("delta_mae", F.col("main_mae") - F.col("other_mae"))


def rolling_origin(dense: DataFrame, col: str, n_windows: int = 3, horizon: int = 30) -> DataFrame:
    """Back-test rows: window-average and seasonal-naive forecasts made at n cutoffs, each
    `horizon` days apart, against the days that followed.

    Input is the zero-filled calendar, so one row is one day. Only the last 30 days
    before each cutoff take part, not the whole history once per cutoff.
    """
    cutoffs = F.array(*[F.date_sub("_last", horizon * k) for k in range(1, n_windows + 1)])
    near = F.filter(cutoffs, lambda c: (F.col(DATE) <= c) & (F.col(DATE) > F.date_sub(c, horizon)))
    history = dense.withColumn("_last", max_date(dense)).withColumn("cutoff", F.explode(near)).drop("_last")
    made = horizon_forecast(history, col, horizon, horizon, horizon, (*PAIR, "cutoff"))
    truth = dense.select(*PAIR, DATE, F.col(col).alias("fact"))
    rows = made.join(truth, [*PAIR, DATE]).filter(F.col(DATE) <= F.date_add("cutoff", horizon))
    return rows.select(*PAIR, DATE, "cutoff", "fact", F.explode(F.create_map(
        F.lit("window_average"), F.col("window_average"),
        F.lit("seasonal_naive"), F.col("seasonal_naive"))).alias("model", "prediction"))


def error_signs(preds: DataFrame, price: float = 100.0, waste_share: float = 0.6) -> DataFrame:
    """Over-, under- and exact forecasts, and what surplus and shortage cost."""
    err = round_half_up(F.col("prediction")) - F.col("fact")
    over, under = F.when(err > 0, err), F.when(err < 0, -err)
    n = F.count(err)
    return preds.groupBy("model").agg(
        n.alias("n_rows"), F.count(over).alias("n_over"), F.count(under).alias("n_under"),
        F.count_if(err == 0).alias("n_exact"), (F.count(over) * 100 / n).alias("over_pct"),
        (F.count(under) * 100 / n).alias("under_pct"), F.avg(over).alias("mean_over"), F.avg(under).alias("mean_under"),
        F.coalesce(F.sum(over), F.lit(0.0)).alias("total_over"), F.coalesce(F.sum(under), F.lit(0.0)).alias("total_under"),
        F.countDistinct(DATE).alias("n_days"),
    ).withColumns({
        "waste_cost": F.col("total_over") * price * waste_share, "lost_sale_cost": F.col("total_under") * price,
        "over_per_day": F.col("total_over") / F.col("n_days"), "under_per_day": F.col("total_under") / F.col("n_days")})


# Score buckets of the SKU list and of the predictability report.
R2_BUCKETS = [(0.0, "R2 <= 0"), (0.1, "0 < R2 <= 0.1"), (0.2, "0.1 < R2 <= 0.2"), (0.4, "0.2 < R2 <= 0.4")]
R2_BINS = [(0.0, "R2 < 0"), (0.2, "0..0.2"), (0.5, "0.2..0.5")]


def r2_bucket(col: str = "best_r2") -> Column:
    return bucket(F.col(col), R2_BUCKETS, "R2 > 0.4", "unknown", closed_right=True)


def r2_bin(col: str = "best_r2") -> Column:
    return bucket(F.col(col), R2_BINS, ">= 0.5", "unknown")


def bin_profile(skus: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, median score and column means per R2 bin; the medians are found in bands.

    The SKU table (one row per pair) is written once, as both parts read it."""
    binned = cut_lineage(skus.select(*PAIR, "best_r2", *[c for c in cols if c != "best_r2"], r2_bin().alias("r2_bin")))
    base = binned.groupBy("r2_bin").agg(F.count("*").alias("n_sku"), F.avg("best_r2").alias("mean_r2"),
                                        *[F.avg(c).alias(f"mean_{c}") for c in cols])
    med = exact_quantiles(binned, ["r2_bin"], "best_r2", [0.5]).withColumnRenamed("q0", "median_r2")
    return base.join(med, "r2_bin", "left")


def wins_by_bin(skus: DataFrame) -> DataFrame:
    names = [label for _, label in R2_BINS] + [">= 0.5"]
    wide = skus.withColumn("r2_bin", r2_bin()).groupBy("best_model").pivot("r2_bin", names).agg(F.count(F.lit(1)))
    return wide.fillna(0).withColumnsRenamed(dict(zip(names, ("bin_negative", "bin_low", "bin_mid", "bin_high"))))


# Thresholds of the failure reasons.
REASON_LIMITS = {
    "n_days": 54, "low_demand": 2.874891, "cv": 0.608539, "censored": 0.649029, "lost": 1.620777,
    "level": 0.165680, "volatility": 0.343036, "trend": 0.005659, "seasonal": 0.402863, "acf7": 0.154432,
    "regular_demand": 9.315062,
}


def failure_reasons(skus: DataFrame, limits: dict[str, float] = REASON_LIMITS) -> DataFrame:
    """Flags per SKU and the first that applies as its primary reason."""
    c, x = F.col, limits
    flags = {
        "data_poor": c("n_days") <= x["n_days"],
        "low_signal_sparse": (c("mean_demand") <= x["low_demand"]) & (c("cv_demand") >= x["cv"]),
        "censored_heavy": (c("share_censored") >= x["censored"]) | (c("lost_mean") >= x["lost"]),
        "regime_shift": (c("mean_shift_norm_30_60") >= x["level"]) | (c("variance_shift_norm_7_30") >= x["volatility"])
                        | (c("trend_abs_60") >= x["trend"]),
        "regular_seasonal": (c("seasonal_strength_7") >= x["seasonal"]) & (c("acf_lag7") >= x["acf7"])
                            & (c("mean_demand") >= x["regular_demand"]) & (c("cv_demand") <= x["cv"]),
    }
    reason = F
    for name, cond in flags.items():
        reason = reason.when(cond, name)
    return skus.withColumns({
        **{f"is_{n}": F.coalesce(cond, F.lit(False)).cast("int") for n, cond in flags.items()},
        "is_bad_r2": F.coalesce(c("best_r2") < 0, F.lit(False)).cast("int"),
        "primary_reason": reason.otherwise("mixed_or_other")})


def reason_summary(flagged: DataFrame) -> DataFrame:
    """Size, scores and behaviour per primary reason; the SKU table is written once."""
    flagged = cut_lineage(flagged.select(*PAIR, "primary_reason", "is_bad_r2", "best_r2", "mean_demand", "cv_demand",
                                         "share_censored", "lost_mean"))
    base = flagged.groupBy("primary_reason").agg(
        F.count("*").alias("n_sku"), F.avg("is_bad_r2").alias("bad_r2_share"), F.avg("best_r2").alias("avg_r2"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("mean_demand", "cv_demand", "share_censored", "lost_mean")])
    med = exact_quantiles(flagged, ["primary_reason"], "best_r2", [0.5]).withColumnRenamed("q0", "median_r2")
    return base.join(med, "primary_reason", "left")


def predictability_map(backtest: DataFrame) -> DataFrame:
    """Per SKU over the back-test windows: share with R2 < 0, winner stability, and a class."""
    per = score_per_sku(backtest, (*PAIR, "cutoff"))
    first = Window.partitionBy(*PAIR, "cutoff").orderBy(
        F.coalesce("r2", F.lit(float("-inf"))).desc(), "model")  # one row per model
    best = per.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
    wins = best.groupBy(*PAIR, "model").agg(
        F.count("*").alias("_w"), F.sum(F.coalesce(F.col("r2") < 0, F.lit(True)).cast("int")).alias("_neg"),
        F.sum("mae").alias("_mae"))
    out = wins.groupBy(*PAIR).agg(
        F.sum("_w").alias("n_windows"), (F.sum("_neg") / F.sum("_w")).alias("share_negative"),
        (F.max("_w") / F.sum("_w")).alias("winner_stability"), (F.sum("_mae") / F.sum("_w")).alias("avg_mae"))
    kind = F.when((F.col("share_negative") <= 0.34) & (F.col("winner_stability") >= 0.66), "stable").when(
        F.col("share_negative") < 1, "borderline")
    return out.withColumn("predictability", kind.otherwise("unpredictable"))


def last_week_summary(df: DataFrame, until: Column | None = None) -> DataFrame:
    """Sales and demand of days -13 .. -7 before the given date (the table's last by default)."""
    day = max_date(df) if until is None else until
    week = df.filter(F.col(DATE).between(F.date_sub(day, 13), F.date_sub(day, 7)))
    return week.groupBy(*PAIR).agg(F.sum("sold").alias("sales"), F.sum("demand").alias("demand"),
                                   F.count("*").alias("days"))


def network_totals(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model", DATE).agg(F.sum("fact").alias("fact"), F.sum("prediction").alias("forecast"))


def leaderboard(runs: DataFrame, baseline: str) -> DataFrame:
    """Runs by MAE with the change against the baseline run."""
    base = runs.filter(F.col("run_id") == baseline).agg(F.max("mae")).scalar()
    out = runs.withColumn("delta_mae", F.col("mae") - base)
    status = F.when(F.col("run_id") == baseline, "baseline").when(F.col("delta_mae") < 0, "better").when(
        F.col("delta_mae") > 0, "worse").otherwise("same")
    return out.withColumn("status", status).orderBy("mae", "run_id")


def demand_regime(skus: DataFrame) -> DataFrame:
    """First matching regime of a pair from its behaviour and stability descriptors."""
    c = F.col
    regime = (F.when(c("share_censored") > 0.5, "high_censoring")
               .when(c("n_days") < 30, "sparse")
               .when(c("share_zero") > 0.3, "intermittent")
               .when((c("seasonal_strength_7") >= 0.4) & (c("acf_lag7") >= 0.15), "seasonal")
               .when(c("cv_demand") > 0.6, "volatile"))
    return skus.withColumn("regime", regime.otherwise("stable"))


def models_by_regime(regimes: DataFrame, metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean MAE of every model within each regime."""
    rows = metrics.join(regimes.select(*PAIR, "regime"), list(PAIR))
    return rows.groupBy("regime").agg(
        F.countDistinct(*PAIR).alias("n_sku"),
        *[F.avg(F.when(F.col("model") == m, F.col("mae"))).alias(f"mae_{m}") for m in models])
