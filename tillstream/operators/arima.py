"""Seasonal ARIMA per series by the two-step regression of Hannan and Rissanen, with one Gauss-Newton step after it.

A group is one daily series, bounded by the number of days; Spark shuffles the series, Python solves the small
least-squares problems of one. With differences d and D over season s, w the differenced values and x the
differenced regressors, the model is

    w[t] = c + sum a[i] w[t-i] + sum A[i] w[t-s*i] + sum b[j] e[t-j] + sum B[j] e[t-s*j] + g x[t] + e[t]

Step one fits a long autoregression, whose residuals stand for e; step two regresses w on its own lags, lags of these
residuals and x. Every candidate order solves a part of the same normal equations, so a search costs one pass over
the series. The constant c is left out where the series is differenced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tillstream.functions.calendar import add_calendar
from tillstream.operators.common import DATE, PAIR
from tillstream.operators.local_models import KPSS_CRITICAL, kpss_level

SEASONAL_STRENGTH = 0.64  # fixed value: published limit from which a season is differenced
ROOT_LIMIT = 0.995        # largest modulus of an inverse root that counts as stable


@dataclass(frozen=True)
class Orders:
    """Orders of a model; capital letters in the usual notation are `sp`, `sd` and `sq` here."""
    p: int = 0
    d: int = 0
    q: int = 0
    sp: int = 0
    sd: int = 0
    sq: int = 0

    def ar_lags(self, season: int) -> list[int]:
        return sorted({*range(1, self.p + 1), *(season * i for i in range(1, self.sp + 1))})

    def ma_lags(self, season: int) -> list[int]:
        return sorted({*range(1, self.q + 1), *(season * j for j in range(1, self.sq + 1))})


@dataclass
class Fitted:
    orders: Orders
    ar: dict[int, float]
    ma: dict[int, float]
    exog: np.ndarray
    constant: float
    sigma: float
    aicc: float
    residuals: np.ndarray = field(repr=False)


def differences(d: int, sd: int, season: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^season)^sd, that of B^0 first."""
    out = np.ones(1)
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(sd):
        out = np.convolve(out, np.concatenate([[1.0], np.zeros(season - 1), [-1.0]]))
    return out


def _differenced(y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values of a column (or of each column) after the difference operator, shorter by its degree."""
    n = len(y) - len(by) + 1
    return sum(c * y[len(by) - 1 - k: len(by) - 1 - k + n] for k, c in enumerate(by) if c)


def _lagged(v: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """One column per lag; what lies before the first value is 0."""
    out = np.zeros((len(v), len(lags)))
    for c, k in enumerate(lags):
        out[k:, c] = v[:max(len(v) - k, 0)]
    return out


def is_stable(lags: dict[int, float]) -> bool:
    """Whether 1 - sum c[k] z^k has all its roots outside the unit circle."""
    if not lags or not any(lags.values()):
        return True
    top = max(lags)
    poly = np.array([1.0, *(-lags.get(k, 0.0) for k in range(1, top + 1))])
    return bool(np.abs(np.roots(poly)).max() < ROOT_LIMIT)


def seasonal_strength(y: np.ndarray, season: int) -> float:
    """1 - var(rest) / var(rest + season), after a centred average over one season; 0 for less than three seasons."""
    if len(y) < 3 * season:
        return 0.0
    weights = np.ones(season) / season if season % 2 else np.concatenate([[0.5], np.ones(season - 1), [0.5]]) / season
    half = len(weights) // 2
    level = y[half:len(y) - half] - np.convolve(y, weights, "valid")
    place = np.arange(half, half + len(level)) % season
    means = np.array([level[place == s].mean() for s in range(season)])
    rest = level - means[place]
    whole = level.var()
    return max(0.0, 1.0 - rest.var() / whole) if whole > 1e-12 else 0.0


def choose_differences(y: np.ndarray, season: int, seasonal: bool) -> tuple[int, int]:
    """(d, D): one seasonal difference where the season is strong, then one plain one where KPSS rejects a level."""
    sd = int(seasonal and seasonal_strength(y, season) >= SEASONAL_STRENGTH)
    w = _differenced(y, differences(0, sd, season))
    limit = next(s for s, p in KPSS_CRITICAL if p == 0.05)
    return int(len(w) >= 8 and w.std() > 1e-8 and kpss_level(w) > limit), sd


def long_residuals(w: np.ndarray, x: np.ndarray, order: int, constant: bool) -> np.ndarray:
    """Residuals of an autoregression of `order` lags with regressors x; 0 for the first `order` values."""
    design = np.column_stack([_lagged(w, range(1, order + 1)), x, np.ones((len(w), int(constant)))])[order:]
    out = np.zeros(len(w))
    out[order:] = w[order:] - design @ np.linalg.lstsq(design, w[order:], rcond=None)[0] if design.shape[1] else w[order:]
    return out


def _unrolled(ma: dict[int, float], n: int) -> np.ndarray:
    """The first n weights of 1 / (1 + sum c[k] B^k), cut where they have died out."""
    out, top = [1.0], max(ma, default=0)
    while len(out) < n and top and any(abs(v) > 1e-14 for v in out[-top:]):
        t = len(out)
        out.append(-sum(c * out[t - k] for k, c in ma.items() if k <= t))
    return np.array(out)


def _convolved(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each column run through the filter, from its first value on."""
    n = len(columns)
    size = n + len(weights)
    return np.fft.irfft(np.fft.rfft(columns, size, axis=0) * np.fft.rfft(weights, size)[:, None], size, axis=0)[:n]


def _recursed(w: np.ndarray, design: np.ndarray, coef: np.ndarray, ma: dict[int, float], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals by the model's own recursion from row `first` on (0 before), and their derivatives by each coefficient.

    `design` has the columns that do not depend on residuals, those of the residual lags follow. Both obey
    v[t] = u[t] - sum c[k] v[t-k], which is one filter over all columns."""
    base = (w - design @ coef[:design.shape[1]])[:, None]
    base[:first] = 0.0
    weights = _unrolled(ma, len(w))
    e = _convolved(base, weights)[:, 0]
    drivers = -np.column_stack([design, _lagged(e, sorted(ma))])
    drivers[:first] = 0.0
    return e, _convolved(drivers, weights) if drivers.shape[1] else drivers


def fit(y: np.ndarray, x: np.ndarray, candidates: Sequence[Orders], season: int = 7, long_order: int | None = None,
        refine: bool = True) -> Fitted | None:
    """The stable candidate of the least corrected information criterion; all must share their differences.

    None where the series is too short, or constant after differencing. A Gauss-Newton step on the recursion's
    sum of squares follows the two regressions where it lowers the sum and stays stable.
    """
    first = candidates[0]
    by = differences(first.d, first.sd, season)
    if len(y) < len(by) + 10:
        return None
    w, x = _differenced(y, by), _differenced(x, by)
    x = x[:, (x.std(0) > 1e-9)] if x.shape[1] else x
    constant = first.d + first.sd == 0
    ar_all = sorted({k for c in candidates for k in c.ar_lags(season)})
    ma_all = sorted({k for c in candidates for k in c.ma_lags(season)})
    order = long_order or min(max([*ar_all, *ma_all, 1]) + season, len(w) // 4)
    start = max([*ar_all, *(k + order for k in ma_all), 0])
    n = len(w) - start
    fixed = np.column_stack([x, np.ones((len(w), int(constant)))])
    if n < 2 * (len(ar_all) + len(ma_all) + fixed.shape[1]) + 8 or w.std() < 1e-8:
        return None
    e = long_residuals(w, x, order, constant) if ma_all else np.zeros(len(w))
    full = np.column_stack([_lagged(w, ar_all), _lagged(e, ma_all), fixed])[start:]
    target = w[start:]
    gram, corr, square = full.T @ full, full.T @ target, float(target @ target)
    tail = list(range(len(ar_all) + len(ma_all), full.shape[1]))
    scored = []
    for c in candidates:
        cols = ([ar_all.index(k) for k in c.ar_lags(season)] + [len(ar_all) + ma_all.index(k) for k in c.ma_lags(season)] + tail)
        coef = np.linalg.lstsq(gram[np.ix_(cols, cols)], corr[cols], rcond=None)[0] if cols else np.zeros(0)
        sse = max(square - 2 * float(coef @ corr[cols]) + float(coef @ gram[np.ix_(cols, cols)] @ coef), 1e-12 * max(square, 1e-12))
        k = len(cols) + 1
        scored.append((n * np.log(sse / n) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1), c, coef))
    for aicc, c, coef in sorted(scored, key=lambda s: s[0]):
        out = _as_fitted(c, coef, w, x, season, constant, aicc, refine)
        if out is not None:
            return out
    return None


def _as_fitted(orders: Orders, coef: np.ndarray, w: np.ndarray, x: np.ndarray, season: int, constant: bool, aicc: float,
               refine: bool) -> Fitted | None:
    """The model with its own residuals, after the Gauss-Newton step; None where it is not stable."""
    ar_lags, ma_lags = orders.ar_lags(season), orders.ma_lags(season)
    n_ar, n_ma = len(ar_lags), len(ma_lags)
    design = np.column_stack([_lagged(w, ar_lags), x, np.ones((len(w), int(constant)))])
    split = n_ar + n_ma

    def parts(v: np.ndarray) -> tuple[dict[int, float], dict[int, float]]:
        """AR and MA coefficients of a vector in the order of `design`, then the residual lags."""
        return dict(zip(ar_lags, v[:n_ar], strict=True)), dict(zip(ma_lags, v[design.shape[1]:], strict=True))

    def stable(v: np.ndarray) -> bool:
        ar, ma = parts(v)
        return is_stable(ar) and is_stable({k: -c for k, c in ma.items()})
    beta = np.concatenate([coef[:n_ar], coef[split:], coef[n_ar:split]])
    if not stable(beta):
        return None
    begin = max([*ar_lags, 0])
    e, slope = _recursed(w, design, beta, parts(beta)[1], begin)
    if refine and ma_lags:
        moved = beta - np.linalg.lstsq(slope, e, rcond=None)[0]
        if stable(moved):
            again, _ = _recursed(w, design, moved, parts(moved)[1], begin)
            if again @ again < e @ e:
                beta, e = moved, again
    ar, ma = parts(beta)
    n_x = x.shape[1]
    return Fitted(orders, ar, ma, beta[n_ar:n_ar + n_x], float(beta[n_ar + n_x]) if constant else 0.0,
                  float(np.sqrt(e[begin:] @ e[begin:] / max(len(e) - begin - len(beta), 1))), float(aicc), e)


def forecast(model: Fitted, y: np.ndarray, x: np.ndarray, ahead: np.ndarray, steps: int, season: int = 7) -> np.ndarray:
    """`steps` values after y: unknown errors are 0, forecasts stand in for lags beyond the end, differences are undone."""
    by = differences(model.orders.d, model.orders.sd, season)
    w = list(_differenced(y, by))
    e = list(model.residuals)
    path = list(y)
    both = _differenced(np.concatenate([x, ahead]), by)
    used = both[:len(w)].std(0) > 1e-9 if both.shape[1] else np.zeros(0, bool)
    both = both[:, used]
    for i in range(steps):
        t = len(w)
        value = model.constant + float(both[t] @ model.exog) + sum(c * w[t - k] for k, c in model.ar.items()) + sum(
            c * e[t - k] for k, c in model.ma.items())
        w.append(value)
        e.append(0.0)
        path.append(value - sum(c * path[-k] for k, c in enumerate(by) if k and c))
    return np.array(path[len(y):])


def candidate_orders(seasonal: bool, d: int, sd: int, p: int = 3, q: int = 2) -> list[Orders]:
    """All orders up to p and q, with up to one seasonal term of each kind where `seasonal`."""
    season = range(2 if seasonal else 1)
    return [Orders(i, d, j, k, sd, m) for i, j, k, m in product(range(p + 1), range(q + 1), season, season)]


# The four families of the rolling-origin table; whether they have seasonal terms and regressors.
FAMILIES = {"arima": (False, False), "sarima7": (True, False), "arima_exog": (False, True), "sarima7_exog": (True, True)}
EXOG = ("is_weekend", "is_holiday", "is_payday_week")

_MODEL = [T.StructField("orders", T.StringType()), T.StructField("n_rows", T.IntegerType()),
          T.StructField("ar", T.MapType(T.IntegerType(), T.DoubleType())), T.StructField("ma", T.MapType(T.IntegerType(), T.DoubleType())),
          T.StructField("exog", T.ArrayType(T.DoubleType())), T.StructField("constant", T.DoubleType()),
          T.StructField("sigma", T.DoubleType()), T.StructField("aicc", T.DoubleType())]


def _name(o: Orders, season: int) -> str:
    return f"({o.p},{o.d},{o.q})({o.sp},{o.sd},{o.sq})[{season}]"


def _search(y: np.ndarray, x: np.ndarray, seasonal: bool, season: int, orders: Orders | None, **options) -> Fitted | None:
    if orders is not None:
        return fit(y, x, [orders], season, **options)
    if len(y) < 8:
        return None
    return fit(y, x, candidate_orders(seasonal, *choose_differences(y, season, seasonal)), season, **options)


def arima_models(rows: DataFrame, label: str = "demand", seasonal: bool = True, exog: Sequence[str] = (), season: int = 7,
                 orders: Orders | None = None, keys: Sequence[str] = PAIR, long_order: int | None = None, refine: bool = True) -> DataFrame:
    """One row per series with the orders, coefficients by lag, residual deviation and criterion of its model.

    `orders` fixes what is searched otherwise. A missing label counts as 0, rows without a date are left out. Series that
    allow no model (too short, constant, no stable candidate) have nulls in all but `n_rows`.
    """
    dated = rows.filter(F.col(DATE).isNotNull()).transform(add_calendar) if exog else rows.filter(F.col(DATE).isNotNull())
    schema = T.StructType([*dated.select(*keys).schema, *_MODEL])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        y = pdf[label].fillna(0.0).to_numpy(float)
        x = pdf[list(exog)].astype(float).fillna(0.0).to_numpy().reshape(len(y), len(exog))
        m = _search(y, x, seasonal, season, orders, long_order=long_order, refine=refine)
        cells = ([None] * 7 if m is None else
                 [_name(m.orders, season), m.ar, m.ma, [float(v) for v in m.exog], m.constant, m.sigma, m.aicc])
        row = {**{k: pdf[k].iloc[0] for k in keys}, "n_rows": len(y), **dict(zip([f.name for f in _MODEL if f.name != "n_rows"], cells, strict=True))}
        return pd.DataFrame([row])[schema.names]

    return dated.select(*keys, DATE, label, *exog).groupBy(*keys).applyInPandas(run, schema)


def arima_forecast(rows: DataFrame, label: str = "demand", families: Sequence[str] = tuple(FAMILIES), exog: Sequence[str] = EXOG,
                   season: int = 7, horizon: int = 30, origins: int = 3, keys: Sequence[str] = PAIR, min_rows: int = 60) -> DataFrame:
    """Forecasts of the `horizon` rows after each of `origins` cut-offs, by family, floored at 0.

    The last origin lies `horizon` rows before the end, each earlier one another `horizon` rows before; models see the
    rows before their origin alone. All families of a series are fitted in one visit, so the series is shuffled once. Where
    fewer than `min_rows` rows lie before an origin, or no candidate is stable, the mean of these rows is the
    forecast (`status` = mean).
    """
    dated = rows.filter(F.col(DATE).isNotNull()).transform(add_calendar)
    names = list(exog)
    schema = T.StructType([*dated.select(*keys, DATE, label).schema, T.StructField("family", T.StringType()),
                           T.StructField("origin", T.IntegerType()), T.StructField("step", T.IntegerType()),
                           T.StructField("prediction", T.DoubleType()), T.StructField("orders", T.StringType()),
                           T.StructField("status", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE).reset_index(drop=True)
        y = pdf[label].fillna(0.0).to_numpy(float)
        extra = pdf[names].astype(float).fillna(0.0).to_numpy().reshape(len(y), len(names))
        parts = []
        for origin in range(1, origins + 1):
            start = len(y) - horizon * (origins - origin + 1)
            if start < 1:
                continue
            test = pdf.loc[start:start + horizon - 1, [*keys, DATE, label]]
            for family in families:
                seasonal, with_exog = FAMILIES[family]
                x = extra if with_exog else extra[:, :0]
                m = _search(y[:start], x[:start], seasonal, season, None) if start >= min_rows else None
                path = (np.full(len(test), y[:start].mean()) if m is None else
                        forecast(m, y[:start], x[:start], x[start:start + len(test)], len(test), season))
                parts.append(test.assign(
                    family=family, origin=np.int32(origin), step=np.arange(1, len(test) + 1, dtype=np.int32), prediction=np.clip(path, 0.0, None),
                    orders=None if m is None else _name(m.orders, season), status="mean" if m is None else "arima"))
        return pd.concat(parts)[schema.names] if parts else pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})

    return dated.select(*keys, DATE, label, *names).groupBy(*keys).applyInPandas(run, schema)
