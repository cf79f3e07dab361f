"""Ordered-window features of daily series.

All operators over (store, product) share one hash partitioning and one sort by
date, so a chain of them plans a single exchange. Input is one row per pair and
date; a lag or a window counts rows (days with sales), not calendar days, unless
`mode="calendar"` is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.calendar import day_number
from tillstream.functions.maths import pct_change, safe_corr
from tillstream.operators.common import DATE, PAIR, before, by_date
from tillstream.operators.quantiles import exact_quantiles

LAGS = (1, 2, 3, 7, 14, 30)
WINDOWS = (3, 7, 14, 30)


def add_lags(df: DataFrame, col: str, lags: Sequence[int] = LAGS, prefix: str | None = None,
             keys: Sequence[str] = PAIR, date: str = DATE) -> DataFrame:
    prefix = prefix or col
    w = by_date(keys, date)
    return df.withColumns({f"{prefix}_lag{k}": F.lag(col, k).over(w) for k in lags})


def default_min_periods(window: int) -> int:
    return max(1, window // 2)


def _frame(n: int, keys: Sequence[str], date: str, mode: str):
    if mode == "calendar":
        return Window.partitionBy(*keys).orderBy(day_number(F.col(date))).rangeBetween(-n, -1)
    return before(n, keys, date)


def add_rolling(df: DataFrame, col: str, windows: Sequence[int] = WINDOWS, stat: str = "mean",
                min_periods: dict[int, int] | None = None, prefix: str | None = None,
                keys: Sequence[str] = PAIR, date: str = DATE, mode: str = "rows") -> DataFrame:
    """Mean, sample std or median of the previous `n` rows; null below the minimum count."""
    prefix, out = prefix or col, {}
    for n in windows:
        frame = _frame(n, keys, date, mode)
        if min_periods is not None:
            need = min_periods[n]
        else:
            need = {"std": 2, "median": 1}.get(stat, default_min_periods(n))
        value = {"mean": F.avg(col), "std": F.stddev_samp(col),
                 "median": F.percentile(col, 0.5)}[stat].over(frame)
        out[f"{prefix}_roll_{stat}{n}"] = F.when(F.count(col).over(frame) >= need, value)
    return df.withColumns(out)


def add_series_features(df: DataFrame, col: str, prefix: str, lags: Sequence[int] = LAGS,
                        windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Lags, rolling means and the 7-row std: one exchange, one sort."""
    return (df.transform(add_lags, col, lags, prefix)
              .transform(add_rolling, col, windows, "mean", None, prefix)
              .transform(add_rolling, col, (7,), "std", None, prefix))


def feature_columns(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(c.startswith((f"{p}_lag", f"{p}_roll")) for p in prefixes)]


def lag_set(n_days: int) -> list[int]:
    """Longer lags only where the history can fill them."""
    return [1, 2, 3, 7] + ([14] if n_days >= 21 else []) + ([30] if n_days >= 37 else [])


# Minimum counts of the short-history feature set.
SHORT_MIN_PERIODS = {3: 1, 7: 1, 14: 7, 30: 14}


def add_adaptive_features(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Lag and rolling set chosen by the number of days in the table (a one-row action)."""
    n_days = df.agg(F.countDistinct(DATE)).first()[0]
    lags = lag_set(n_days)
    windows = [3, 7] + [k for k in (14, 30) if k in lags]
    return (df.transform(add_lags, col, lags, prefix)
              .transform(add_rolling, col, windows, "mean", SHORT_MIN_PERIODS, prefix)
              .transform(add_rolling, col, (7,), "std", {7: 2}, prefix))


def add_same_weekday_mean(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Mean of all earlier rows on the same weekday; 0 before the first one."""
    keyed = df.withColumn("_dow", F.weekday(DATE))
    frame = before(None, (*PAIR, "_dow"))
    return keyed.withColumns({
        out: F.coalesce(F.avg(col).over(frame), F.lit(0.0)) for out, col in cols.items()}).drop("_dow")


def add_censoring_history(df: DataFrame) -> DataFrame:
    w, week = by_date(), before(7)
    return df.withColumns({
        "is_censored_lag1": F.coalesce(F.lag("is_censored").over(w), F.lit(0)),
        "lost_qty_lag1": F.coalesce(F.lag("lost_qty").over(w), F.lit(0.0)),
        "pct_censored_7d": F.coalesce(F.avg("is_censored").over(week) * 100, F.lit(0.0)),
    })


def add_trend(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "demand_trend": F.col("demand_roll_mean7") / (F.col("demand_roll_mean30") + 1e-8),
        "cv_7d": F.col("sales_roll_std7") / (F.col("sales_roll_mean7") + 1),
    })


def _breadth(df: DataFrame, keys: Sequence[str], today: str, lag: str | None, change: str) -> DataFrame:
    """Distinct products per group and day with the change against its previous day."""
    per_day = df.groupBy(*keys, DATE).agg(F.countDistinct("product").alias(today))
    w = by_date(keys)
    out = per_day.withColumn("_prev", F.lag(today).over(w)).withColumn(change, F.col(today) - F.col("_prev"))
    names = [today, change]
    if lag:
        out, names = out.withColumn(lag, F.col("_prev")), [today, lag, change]
    return out.select(*keys, DATE, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def add_store_breadth(df: DataFrame) -> DataFrame:
    """The per-day table is small against the fact; its join is left to Catalyst."""
    per_day = _breadth(df, ("store",), "items_in_store_today", "items_in_store_lag1", "items_change")
    return df.join(per_day, ["store", DATE], "left")


def add_category_breadth(df: DataFrame) -> DataFrame:
    per_day = _breadth(df, ("store", "category"), "items_in_category_today", None, "category_items_change")
    return df.join(per_day, ["store", "category", DATE], "left")


def add_stale_lag(stale: DataFrame) -> DataFrame:
    """Previous row's stale ratio, computed on the compact daily table before any join."""
    return stale.withColumn("stale_ratio_lag1", F.lag("stale_ratio").over(by_date()))


def add_stock_features(df: DataFrame) -> DataFrame:
    w = by_date()
    lagged = df.withColumn("stock_lag1", F.lag("stock").over(w)).withColumn("sales_lag1", F.lag("sold").over(w))
    return lagged.withColumns({
        "stock_to_sales": F.col("stock_lag1") / (F.col("sales_lag1") + 1),
        "stock_deficit": F.greatest(F.col("sales_lag1") - F.col("stock_lag1"), F.lit(0.0)),
    })


def add_price_features(prices: DataFrame) -> DataFrame:
    """Price against the product median, 7-row lag and change, shifted 7-row mean and std.

    The product median spans every store and day, so it is found by `exact_quantiles`
    and not by one task per product.
    """
    medians = (exact_quantiles(prices, ["product"], "avg_price", [0.5])
               .select("product", F.col("q0").alias("_median")))
    w = by_date()
    out = (prices.withColumn("price_lag7", F.lag("avg_price", 7).over(w))
                 .transform(add_rolling, "avg_price", (7,), "mean", {7: 1}, "price")
                 .transform(add_rolling, "avg_price", (7,), "std", {7: 2}, "price"))
    return (out.withColumn("price_change_7d", pct_change(F.col("avg_price"), F.col("price_lag7")))
               .join(medians, "product", "left")
               .withColumn("price_vs_median", F.col("avg_price") / F.col("_median")).drop("_median"))


def add_intraday_share(hourly: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Share of the day and running share by hour; days with no total are dropped."""
    day = Window.partitionBy(*keys, DATE)
    run = day.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return (hourly.withColumn("day_total", F.sum("qty").over(day))
                  .filter(F.col("day_total") > 0)
                  .withColumn("share", F.col("qty") / F.col("day_total"))
                  .withColumn("cum_share", F.sum("share").over(run)))


def forward_fill(df: DataFrame, col: str, keys: Sequence[str] = PAIR, order: str = "hour") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def trailing_average(df: DataFrame, col: str, n: int = 14, out: str = "avg14",
                     keys: Sequence[str] = PAIR) -> DataFrame:
    """Mean of the previous n rows; the table's mean where a series has no past."""
    overall = df.agg(F.avg(col)).scalar()
    return df.withColumn(out, F.coalesce(F.avg(col).over(before(n, keys)), overall))


def weekday_naive(df: DataFrame, col: str, keys: Sequence[str] = PAIR, last: str = "dow_last",
                  mean4: str = "dow_mean4") -> DataFrame:
    """Last value and mean of the last four on the same weekday, else the past mean."""
    keyed = df.withColumn("_dow", F.weekday(DATE))
    same = (*keys, "_dow")
    past = F.avg(col).over(before(None, keys))
    return keyed.withColumns({
        last: F.coalesce(F.lag(col).over(by_date(same)), past),
        mean4: F.coalesce(F.avg(col).over(before(4, same)), past),
    }).drop("_dow")


def value_days_ago(col: str, days: int, keys: Sequence[str] = PAIR, date: str = DATE) -> Column:
    """Value exactly `days` calendar days earlier: a one-day range frame instead of a self join."""
    w = Window.partitionBy(*keys).orderBy(day_number(F.col(date)))
    return F.max(col).over(w.rangeBetween(-days, -days))


def horizon_forecast(df: DataFrame, col: str, horizon: int = 30, window: int = 30,
                     season: int = 30, keys: Sequence[str] = PAIR) -> DataFrame:
    """Window-average and seasonal-naive forecasts for steps 1..horizon of every series.

    Each series keeps its last max(window, season) rows; the steps are generated per row.
    """
    keep = max(window, season)
    w = Window.partitionBy(*keys).orderBy(F.col(DATE).desc())
    tail = df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= keep)
    last = F.collect_list(F.when(F.col("_back") <= season, F.struct("_back", F.col(col).alias("v"))))
    per = tail.groupBy(*keys).agg(
        F.max(DATE).alias("last_date"), F.count("*").alias("_n"),
        F.avg(F.when(F.col("_back") <= window, F.col(col))).alias("window_average"),
        F.map_from_entries(last).alias("_season"))
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    out = per.withColumn("step", step)
    back = F.lit(season) - F.pmod(F.col("step") - 1, F.lit(season))
    return out.select(
        *keys, "step", F.date_add("last_date", F.col("step")).alias(DATE), "window_average",
        F.try_element_at("_season", back.cast("int")).alias("seasonal_naive"))


def neighbour_sum(df: DataFrame, col: str, keys: Sequence[str], order: str = "hour") -> Column:
    """Sum over previous, current and next row; 0 where one of the three is missing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)
    return F.when(F.count(col).over(w) == 3, F.sum(col).over(w)).otherwise(0.0)


def _ranked(df: DataFrame, col: str, keys: Sequence[str], lags: Sequence[int] = ()) -> DataFrame:
    """Rows with what the descriptors below need, from one exchange and one sort by date:
    value, position, position from the end, length, lags, and zeros up to this row."""
    w = by_date(keys)
    x = F.coalesce(F.col(col), F.lit(0.0))
    base = df.withColumns({
        "_raw": F.col(col), "_x": x, "_rn": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)),
        **{f"_l{k}": F.lag(x, k).over(w) for k in lags}})
    sold = F.max(F.when(F.col("_x") != 0, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return base.withColumns({"_back": F.col("_n") - F.col("_rn") + 1,
                             "_zeros": F.col("_rn") - F.coalesce(sold, F.lit(0))})


def _acf(k: int) -> Column:
    r = F.coalesce(safe_corr(F.col("_x"), F.col(f"_l{k}")), F.lit(0.0))
    return F.when(F.count("*") <= k + 1, 0.0).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _trend(n: int) -> Column:
    tail = F.when(F.col("_back") <= n, F.col("_x"))
    slope = F.regr_slope(tail, -F.col("_back").cast("double"))
    flat = (F.max("_n") < 5) | (F.stddev_pop(tail) < 1e-8)
    return F.when(flat, 0.0).otherwise(F.coalesce(F.abs(slope) / (F.abs(F.avg(tail)) + 1), F.lit(0.0)))


def _shift(recent: int, prior: int, stat: str) -> Column:
    back, n = F.col("_back"), F.col("_n")
    usual = (F.least(F.greatest(n - recent, F.lit(0)), F.lit(prior)) >= 3) & (F.least(n, F.lit(recent)) >= 3)
    newer = n - F.floor(n / 2)
    in_recent = F.when(usual, back <= recent).otherwise(back <= newer)
    in_prior = F.when(usual, (back > recent) & (back <= recent + prior)).otherwise(back > newer)
    fn = F.avg if stat == "level" else F.stddev_pop
    a = F.coalesce(fn(F.when(in_recent, F.col("_x"))), F.lit(0.0))
    b = F.coalesce(fn(F.when(in_prior, F.col("_x"))), F.lit(0.0))
    scale = F.abs(b) + 1 if stat == "level" else b + 1
    return F.when(F.max("_n") < 4, 0.0).otherwise(F.abs((a - b) / scale))


def _seasonal() -> Column:
    """Std of the weekday means present over the std of the series."""
    means = F.array_compact(F.array(*[F.avg(F.when(F.weekday(DATE) == d, F.col("_raw"))) for d in range(7)]))
    n = F.size(means)
    mean = F.aggregate(means, F.lit(0.0), lambda acc, m: acc + m) / n
    spread = F.sqrt(F.aggregate(means, F.lit(0.0), lambda acc, m: acc + (m - mean) * (m - mean)) / n)
    sd = F.stddev_pop("_raw")
    return F.when((F.count("*") < 8) | sd.isNull() | (sd < 1e-8), 0.0).otherwise(F.least(spread / sd, F.lit(5.0)))


def longest_zero_run(df: DataFrame, col: str, keys: Sequence[str] = PAIR) -> DataFrame:
    """Length of the longest run of zeros and its share of the series."""
    return _ranked(df, col, keys).groupBy(*keys).agg(
        F.max("_zeros").alias("zero_run_max"), (F.max("_zeros") / F.count("*")).alias("zero_run_ratio"))


def autocorrelation(df: DataFrame, col: str, lags: Sequence[int] = (1, 7),
                    keys: Sequence[str] = PAIR) -> DataFrame:
    """Correlation with the value k rows earlier, in [-1, 1]; 0 for short or flat series."""
    return _ranked(df, col, keys, lags).groupBy(*keys).agg(*[_acf(k).alias(f"acf_lag{k}") for k in lags])


def trend_strength(df: DataFrame, col: str, n: int = 60, keys: Sequence[str] = PAIR) -> DataFrame:
    """|OLS slope| over the last n rows, scaled by |mean| + 1; 0 below five rows."""
    return _ranked(df, col, keys).groupBy(*keys).agg(_trend(n).alias(f"trend_abs_{n}"))


def window_shift(df: DataFrame, col: str, recent: int, prior: int, stat: str, out: str,
                 keys: Sequence[str] = PAIR) -> DataFrame:
    """|recent - prior| / (scale + 1) of the mean (`level`) or population std (`volatility`).

    The prior block holds the `prior` rows before the last `recent` ones. If either has
    fewer than three rows the series is cut in half; below four rows the shift is 0.
    """
    return _ranked(df, col, keys).groupBy(*keys).agg(_shift(recent, prior, stat).alias(out))


def seasonal_strength(df: DataFrame, col: str, keys: Sequence[str] = PAIR) -> DataFrame:
    """Std of weekday means over the std of the series, in [0, 5]; 0 below eight rows."""
    return df.withColumn("_raw", F.col(col)).groupBy(*keys).agg(_seasonal().alias("seasonal_strength_7"))


def stability_features(df: DataFrame, col: str = "demand", keys: Sequence[str] = PAIR) -> DataFrame:
    """All stability descriptors of a series in one pass: one exchange by key, one sort, and
    one aggregation on the same partitioning."""
    return _ranked(df, col, keys, (1, 7)).groupBy(*keys).agg(
        _acf(1).alias("acf_lag1"), _acf(7).alias("acf_lag7"), _trend(60).alias("trend_abs_60"),
        _shift(30, 30, "level").alias("mean_shift_norm_30_60"),
        _shift(7, 30, "volatility").alias("variance_shift_norm_7_30"),
        _seasonal().alias("seasonal_strength_7"), F.max("_zeros").alias("zero_run_max"),
        (F.max("_zeros") / F.count("*")).alias("zero_run_ratio"))


def decompose(df: DataFrame, col: str, period: int = 7, keys: Sequence[str] = PAIR) -> DataFrame:
    """Additive trend (centred moving average), seasonal and residual parts.

    The phase is the row's position modulo the period; seasonal means are centred to 0.
    """
    half = period // 2
    w = by_date(keys)
    centred = w.rowsBetween(-half, half)
    pos = F.row_number().over(w) - 1
    base = df.withColumns({
        "_phase": F.pmod(pos, F.lit(period)),
        "trend": F.when(F.count(col).over(centred) == period, F.avg(col).over(centred)),
    }).withColumn("_detrended", F.col(col) - F.col("trend"))
    per = base.groupBy(*keys, "_phase").agg(F.avg("_detrended").alias("_m"))
    seasonal = per.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys)))
    return (base.join(seasonal.drop("_m"), [*keys, "_phase"], "left")
                .withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal"))
                .drop("_phase", "_detrended"))


def keep_latest(df: DataFrame, keys: Sequence[str], priority: Column) -> DataFrame:
    """One row per key: the one with the highest priority."""
    w = Window.partitionBy(*keys).orderBy(priority.desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def sparse_baselines(dense: DataFrame, col: str, keys: Sequence[str] = PAIR) -> DataFrame:
    """Forecasts for series with many zeros, from the dense calendar grid.

    zero_aware = sale probability x mean positive size; interval_rate = mean positive
    size / mean gap between sales (positive days are counted from the grid's first day).
    """
    past = before(None, keys)
    positive = F.when(F.col(col) > 0, F.col(col))
    idx = F.row_number().over(by_date(keys))
    base = dense.withColumn("_i", idx).withColumn("_pos", positive)
    n_pos, n = F.count("_pos").over(past), F.count("*").over(past)
    size = F.avg("_pos").over(past)
    last_pos = F.max(F.when(F.col("_pos").isNotNull(), F.col("_i"))).over(past)
    return base.withColumns({
        "zero_aware": F.when(n > 0, F.coalesce(n_pos / n * size, F.lit(0.0))),
        "interval_rate": F.when(n > 0, F.coalesce(size / (last_pos / n_pos), F.lit(0.0))),
    }).drop("_i", "_pos")
