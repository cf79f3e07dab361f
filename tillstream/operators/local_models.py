"""One small model per series, run by Spark as a grouped Arrow exchange.

A group is one daily series, bounded by the number of days. Only the least-squares step
is Python; lags, calendar columns and scoring stay in SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tillstream.functions.calendar import add_calendar
from tillstream.operators.common import DATE, PAIR
from tillstream.operators.series import add_lags


def _solve(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge coefficients; the last column is the intercept and is not shrunk."""
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 0.0
    return np.linalg.lstsq(x.T @ x + penalty, x.T @ y, rcond=None)[0]


def _design(frame: pd.DataFrame, features: Sequence[str], mean: pd.Series, scale: pd.Series) -> np.ndarray:
    x = (frame[list(features)].astype(float) - mean) / scale
    return np.column_stack([x.to_numpy(), np.ones(len(frame))])


def local_forecast(rows: DataFrame, features: Sequence[str], label: str = "demand", test_flag: str = "is_test",
                   keys: Sequence[str] = PAIR, min_rows: int = 30, ridge: float = 1.0) -> DataFrame:
    """Test-row forecasts from a ridge model of the series' own training rows.

    Series with fewer than `min_rows` complete rows forecast their training mean. Input
    holds training and test rows of a series together, so one shuffle serves both.
    """
    names = list(features)
    keep = [*keys, DATE, label, test_flag, *names]
    schema = T.StructType([f for f in rows.select(*keys, DATE, label).schema]
                          + [T.StructField("prediction", T.DoubleType()), T.StructField("status", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_test = pdf[test_flag].astype(bool)
        train, test = pdf[~is_test].dropna(subset=[label]), pdf[is_test]
        out = test[[*keys, DATE, label]].copy()
        full = train.dropna(subset=names)
        mean_y = float(train[label].mean()) if len(train) else 0.0
        varying = [c for c in names if full[c].nunique() > 1]
        if len(full) < min_rows or not varying:
            return out.assign(prediction=mean_y, status="mean")
        mean, scale = full[varying].astype(float).mean(), full[varying].astype(float).std().replace(0.0, 1.0)
        coef = _solve(_design(full, varying, mean, scale), full[label].to_numpy(float), ridge)
        usable = test.copy()
        usable[varying] = usable[varying].astype(float).fillna(mean)
        pred = np.clip(_design(usable, varying, mean, scale) @ coef, 0.0, None)
        return out.assign(prediction=pred, status="ridge")

    return rows.select(*keep).groupBy(*keys).applyInPandas(run, schema)


# Regressors of the five trend-and-season variants.
CALENDAR_REGRESSORS = ("is_payday_week", "is_month_start", "is_month_end")
HOLIDAY_REGRESSORS = ("is_holiday", "is_pre_holiday", "is_post_holiday")
VARIANTS = {
    "base": (), "holidays": HOLIDAY_REGRESSORS, "calendar": CALENDAR_REGRESSORS,
    "calendar_holidays": CALENDAR_REGRESSORS + HOLIDAY_REGRESSORS, "weekend": ("is_weekend",),
}


def trend_season_forecast(rows: DataFrame, variant: str = "calendar_holidays", label: str = "demand",
                          keys: Sequence[str] = PAIR, min_rows: int = 30) -> DataFrame:
    """Linear trend, weekday effects and the variant's regressors, per series."""
    dated = rows.transform(add_calendar).withColumn("trend_t", F.unix_date(DATE).cast("double"))
    weekdays = {f"dow_{d}": (F.col("dow") == d).cast("double") for d in range(6)}
    features = ["trend_t", *weekdays, *VARIANTS[variant]]
    return local_forecast(dated.withColumns(weekdays), features, label, keys=keys, min_rows=min_rows)


def _lasso(gram: np.ndarray, corr: np.ndarray, penalty: float, rounds: int = 200) -> np.ndarray:
    """Coefficients of unit columns under an L1 penalty, by coordinate descent on their products."""
    beta = np.zeros(len(corr))
    left = corr.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(beta)):
            raw = left[j] + beta[j]
            new = np.sign(raw) * max(abs(raw) - penalty, 0.0)
            if new != beta[j]:
                left -= gram[:, j] * (new - beta[j])
                moved = max(moved, abs(new - beta[j]))
                beta[j] = new
        if moved < 1e-6 * max(1.0, np.abs(corr).max()):
            break
    return beta


def find_breaks(t: np.ndarray, y: np.ndarray, base: np.ndarray, every: int = 7) -> np.ndarray:
    """Days (values of t) at which the slope of y changes, given the columns `base` that stay unpenalised.

    Hinges max(0, t - c) at every `every`-th day go through an L1 fit of what `base` leaves; of neighbours that are taken
    together the strongest stays, and those that do not lower the Bayesian information criterion go one by one.
    """
    span = t[-1] - t[0]
    places = np.arange(t[0] + max(every, span * 0.05), t[-1] - max(every, span * 0.1), every)
    if len(places) < 1 or len(y) < base.shape[1] + 10:
        return np.empty(0)
    hinges = np.maximum(0.0, t[:, None] - places)
    q, _ = np.linalg.qr(base)
    rest, cols = y - q @ (q.T @ y), hinges - q @ (q.T @ hinges)
    norm = np.linalg.norm(cols, axis=0)
    cols = cols / np.where(norm > 1e-9, norm, np.inf)
    noise = 1.4826 * np.median(np.abs(np.diff(rest))) / np.sqrt(2)  # slow courses cancel between neighbours
    beta = _lasso(cols.T @ cols, cols.T @ rest, max(noise, 1e-9) * np.sqrt(2 * np.log(len(places) + 1)))
    kept: list[int] = []
    for j in sorted(np.flatnonzero(beta), key=lambda j: -abs(beta[j])):
        if all(abs(places[j] - places[k]) > 3 * every for k in kept):
            kept.append(int(j))

    def criterion(chosen: list[int]) -> float:
        x = np.column_stack([base, hinges[:, chosen]])
        error = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
        return len(y) * np.log(max(error, 1e-12) / len(y)) + 2 * len(chosen) * np.log(len(y))
    best, moving = criterion(kept), True
    while moving:  # a step moves one break by a place, or drops it
        moving = False
        options = [kept[:i] + kept[i + 1:] for i in range(len(kept))]
        options += [kept[:i] + [j] + kept[i + 1:] for i in range(len(kept)) for j in (kept[i] - 1, kept[i] + 1) if 0 <= j < len(places) and j not in kept]
        scored = min(((criterion(o), o) for o in options), default=(best, kept))
        if scored[0] < best - 1e-9:
            best, kept, moving = *scored, True
    return np.sort(places[kept])


def trend_break_forecast(rows: DataFrame, variant: str = "calendar_holidays", label: str = "demand", test_flag: str = "is_test",
                         keys: Sequence[str] = PAIR, min_rows: int = 30, every: int = 7) -> DataFrame:
    """Trend with change points, weekday effects and the variant's regressors, per series; the last slope goes on.

    `breaks` has the dates of the change points, none for a series with fewer than `min_rows` training rows, which
    forecasts its mean.
    """
    dated = rows.transform(add_calendar)
    names = list(VARIANTS[variant])
    schema = T.StructType([f for f in dated.select(*keys, DATE, label).schema] + [
        T.StructField("prediction", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("breaks", T.ArrayType(T.DateType()))])
    epoch = pd.Timestamp("1970-01-01")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        is_test = pdf[test_flag].astype(bool)
        train, test = pdf[~is_test].dropna(subset=[label]), pdf[is_test]
        out = test[[*keys, DATE, label]].copy()
        out["breaks"] = pd.Series([[]] * len(out), out.index, object)
        if len(train) < min_rows:
            return out.assign(prediction=float(train[label].mean()) if len(train) else 0.0, status="mean")[schema.names]

        def days(frame: pd.DataFrame) -> np.ndarray:
            return (pd.to_datetime(frame[DATE]) - epoch).dt.days.to_numpy(float)

        def design(frame: pd.DataFrame) -> np.ndarray:
            dow = frame["dow"].to_numpy()
            return np.column_stack([(dow[:, None] == np.arange(6)).astype(float), frame[names].to_numpy(float), days(frame) - start, np.ones(len(frame))])
        t, y = days(train), train[label].to_numpy(float)
        start = t[0]
        found = find_breaks(t, y, design(train), every)
        x, ahead = (np.column_stack([design(f), np.maximum(0.0, days(f)[:, None] - found)]) for f in (train, test))
        coef = np.linalg.lstsq(x.T @ x + 1e-6 * np.eye(x.shape[1]), x.T @ y, rcond=None)[0]
        dates = [(epoch + pd.Timedelta(days=int(c))).date() for c in found]
        out["breaks"] = pd.Series([dates] * len(out), out.index, object)
        return out.assign(prediction=np.clip(ahead @ coef, 0.0, None), status="trend")[schema.names]

    return dated.select(*keys, DATE, label, test_flag, "dow", *names).groupBy(*keys).applyInPandas(run, schema)


def recursive_forecast(rows: DataFrame, label: str = "demand", order: int = 7, exog: Sequence[str] = (),
                       horizon: int = 30, origins: int = 3, keys: Sequence[str] = PAIR, min_rows: int = 30,
                       ridge: float = 1.0) -> DataFrame:
    """AR(order) forecasts of the `horizon` rows after each of `origins` cut-offs, per series.

    The last origin lies `horizon` rows before the end of the series, each earlier one another
    `horizon` rows before. A forecast reads forecasts where its lags reach beyond the origin. A series with
    fewer than `min_rows` complete rows before an origin forecasts their mean.
    """
    dated = rows.transform(add_calendar)
    names = list(exog)
    schema = T.StructType([f for f in dated.select(*keys, DATE, label).schema] + [
        T.StructField("origin", T.IntegerType()), T.StructField("step", T.IntegerType()),
        T.StructField("prediction", T.DoubleType()), T.StructField("status", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE).reset_index(drop=True)
        y = pdf[label].fillna(0.0).to_numpy(float)
        extra = pdf[names].astype(float).to_numpy()
        parts = []
        for origin in range(1, origins + 1):
            start = len(y) - horizon * (origins - origin + 1)
            if start < 1:
                continue
            test = pdf.loc[start:start + horizon - 1, [*keys, DATE, label]].copy()
            predicted, status = _recursive(y, extra, start, len(test), order, min_rows, ridge)
            parts.append(test.assign(origin=np.int32(origin), step=np.arange(1, len(test) + 1, dtype=np.int32), prediction=predicted, status=status))
        return pd.concat(parts) if parts else pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})

    return dated.select(*keys, DATE, label, *names).groupBy(*keys).applyInPandas(run, schema)


def _recursive(y: np.ndarray, extra: np.ndarray, start: int, steps: int, order: int, min_rows: int,
               ridge: float) -> tuple[np.ndarray, str]:
    """Forecasts of y[start:start + steps] from y[:start], and how they were made."""
    seen = y[:start]
    if start - order < min_rows:
        return np.full(steps, seen.mean()), "mean"
    lags = np.column_stack([seen[order - k:start - k] for k in range(1, order + 1)])
    x = np.column_stack([lags, extra[order:start]])
    mean, scale = x.mean(0), x.std(0, ddof=1)
    varying = scale > 0
    if not varying.any():
        return np.full(steps, seen.mean()), "mean"
    coef = _solve(np.column_stack([(x[:, varying] - mean[varying]) / scale[varying], np.ones(len(x))]), seen[order:], ridge)
    path = list(seen)
    for i in range(steps):
        row = np.concatenate([path[:-order - 1:-1], extra[start + i]])
        row = (row[varying] - mean[varying]) / scale[varying]
        path.append(max(0.0, float(row @ coef[:-1] + coef[-1])))
    return np.array(path[start:]), "ridge"


def autoregressive_forecast(rows: DataFrame, label: str = "demand", order: int = 7,
                            exog: Sequence[str] = (), keys: Sequence[str] = PAIR, min_rows: int = 30) -> DataFrame:
    """AR(order) with optional calendar regressors; each test day uses the values before it."""
    lagged = rows.transform(add_lags, label, range(1, order + 1), label, keys).transform(add_calendar)
    features = [*[f"{label}_lag{k}" for k in range(1, order + 1)], *exog]
    return local_forecast(lagged, features, label, keys=keys, min_rows=min_rows)


# Published critical values of the KPSS level test and the p-values they stand for, and the
# published response surface of Dickey-Fuller p-values with a constant: where it begins, bends and ends,
# and its polynomials (constant term first) below and above the bend.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
ADF_RANGE = (-18.83, -1.61, 2.74)
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def _interpolate(x: float, table: Sequence[tuple[float, float]]) -> float:
    return float(np.interp(x, [s for s, _ in table], [p for _, p in table]))


def _adf_pvalue(x: float) -> float:
    least, bend, most = ADF_RANGE
    if x <= least or x >= most:
        return 0.0 if x <= least else 1.0
    z = sum(c * x ** i for i, c in enumerate(ADF_LOW if x <= bend else ADF_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _bandwidth(e: np.ndarray) -> int:
    """Lags of the long-run variance chosen from the data (Newey and West's rule for the Bartlett kernel)."""
    n = len(e)
    level, slope = float(e @ e) / n, 0.0
    for k in range(1, int(n ** (2.0 / 9.0)) + 1):
        both = 2.0 * float(e[k:] @ e[:-k]) / n
        level, slope = level + both, slope + k * both
    if level == 0:
        return 0
    return min(int(1.1447 * ((slope / level) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)


def kpss_level(y: np.ndarray) -> float:
    """KPSS level statistic with a Bartlett long-run variance of data-dependent bandwidth."""
    n = len(y)
    e = y - y.mean()
    lags = _bandwidth(e)
    s2 = e @ e / n
    for k in range(1, lags + 1):
        s2 += 2.0 / n * (1.0 - k / (lags + 1.0)) * (e[k:] @ e[:-k])
    return float((np.cumsum(e) ** 2).sum() / (n * n * s2)) if s2 > 0 else 0.0


def _level_regression(y: np.ndarray, p: int, first: int) -> tuple[float, float]:
    """t statistic of the lagged level and AIC, with p lagged differences, from difference `first` on."""
    diff = np.diff(y)
    dep = diff[first:]
    x = np.column_stack([y[first:-1], np.ones(len(dep))] + [diff[first - k: len(diff) - k] for k in range(1, p + 1)])
    coef = np.linalg.lstsq(x, dep, rcond=None)[0]
    resid = dep - x @ coef
    sse, free = float(resid @ resid), len(dep) - x.shape[1]
    if sse <= 0 or free <= 0:
        return 0.0, np.inf
    spread = np.linalg.pinv(x.T @ x)[0, 0] * sse / free
    return (float(coef[0] / np.sqrt(spread)) if spread > 0 else 0.0), len(dep) * np.log(sse / len(dep)) + 2 * x.shape[1]


def _adf(y: np.ndarray) -> float:
    """t statistic of the lagged level. The number of lagged differences minimises AIC over the rows that
    all candidates share; the chosen regression is then fitted again on all the rows it can use."""
    n = len(y)
    top = max(0, min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))
    best = min(range(top + 1), key=lambda p: _level_regression(y, p, top)[1])
    return _level_regression(y, best, best)[0]


def stationarity(df: DataFrame, col: str = "demand", keys: Sequence[str] = PAIR) -> DataFrame:
    """ADF and KPSS statistics, p-values by table and 0/1 verdicts, per series."""
    schema = T.StructType([f for f in df.select(*keys).schema] + [
        T.StructField(c, T.DoubleType()) for c in ("adf_pvalue", "adf_stat", "kpss_pvalue", "kpss_stat")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(DATE)[col].fillna(0.0).to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys}
        if len(y) < 8 or y.std() < 1e-8:
            return pd.DataFrame([{**row, "adf_pvalue": 1.0, "adf_stat": 0.0, "kpss_pvalue": 0.1, "kpss_stat": 0.0}])
        a, k = _adf(y), kpss_level(y)
        return pd.DataFrame([{**row, "adf_pvalue": _adf_pvalue(a), "adf_stat": a,
                              "kpss_pvalue": _interpolate(k, KPSS_CRITICAL), "kpss_stat": k}])

    out = df.select(*keys, DATE, col).groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({"stationary_adf": (F.col("adf_pvalue") < 0.05).cast("int"),
                            "stationary_kpss": (F.col("kpss_pvalue") > 0.05).cast("int")})
