"""Two-step ARIMA: planted coefficients, differences undone, families and odd series."""

import datetime as dt

import numpy as np
import pytest

from tillstream.operators import arima as ar

NONE = np.zeros((0, 0))


def planted(n, seed, ar_lags=None, ma_lags=None, level=0.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n + 200)
    w = np.zeros(n + 200)
    for t in range(30, len(w)):
        w[t] = e[t] + sum(c * w[t - k] for k, c in (ar_lags or {}).items()) + sum(c * e[t - k] for k, c in (ma_lags or {}).items())
    return w[200:] + level


def no_x(y):
    return np.zeros((len(y), 0))


@pytest.mark.parametrize("theta", [0.6, -0.5])
def test_planted_moving_average_is_recovered(theta):
    y = planted(3000, 1, ma_lags={1: theta}, level=20.0)
    m = ar.fit(y, no_x(y), [ar.Orders(q=1)])
    assert m.ma[1] == pytest.approx(theta, abs=0.05) and m.sigma == pytest.approx(1.0, abs=0.05)
    assert m.constant == pytest.approx(20.0, abs=0.2)


def test_planted_weekly_terms_are_recovered():
    y = planted(4000, 2, ar_lags={1: 0.4, 7: 0.3}, ma_lags={7: 0.5}, level=50.0)
    m = ar.fit(y, no_x(y), [ar.Orders(p=1, sp=1, sq=1)])
    assert (m.ar[1], m.ar[7], m.ma[7]) == (pytest.approx(0.4, abs=0.06), pytest.approx(0.3, abs=0.06), pytest.approx(0.5, abs=0.06))


def test_refinement_lowers_the_sum_of_squares():
    y = planted(400, 3, ma_lags={1: 0.8})
    plain, fine = (ar.fit(y, no_x(y), [ar.Orders(q=1)], refine=r) for r in (False, True))
    assert fine.residuals @ fine.residuals < plain.residuals @ plain.residuals


def test_filter_equals_the_plain_recursion():
    y = planted(120, 4, ar_lags={1: 0.3}, ma_lags={1: 0.5, 7: 0.3})
    design, ma, coef = ar._lagged(y, [1]), {1: 0.5, 7: 0.3}, np.array([0.3, 0.5, 0.3])
    e, slope = ar._recursed(y, design, coef, ma, 1)
    plain = np.zeros(len(y))
    for t in range(1, len(y)):
        plain[t] = y[t] - 0.3 * y[t - 1] - sum(c * plain[t - k] for k, c in ma.items() if t >= k)
    assert np.allclose(e, plain, atol=1e-9)
    for i in range(3):
        moved = coef.copy()
        moved[i] += 1e-6
        other, _ = ar._recursed(y, design, moved, {1: moved[1], 7: moved[2]}, 1)
        assert np.allclose((other - e) / 1e-6, slope[:, i], atol=1e-3)


def test_differences_are_undone():
    """A line with a weekly pattern and no noise goes on as it was."""
    t = np.arange(140.0)
    y = 5 + 0.5 * t + np.tile([0, 3, 1, 8, 2, 9, 4], 20)
    noisy = y + np.random.default_rng(5).normal(0, 1e-3, len(y))
    m = ar.fit(noisy[:112], no_x(noisy[:112]), [ar.Orders(d=1, sd=1, q=1)])
    path = ar.forecast(m, noisy[:112], no_x(noisy[:112]), np.zeros((28, 0)), 28)
    assert np.abs(path - y[112:]).max() < 0.2
    assert list(ar.differences(1, 1, 3)) == [1, -1, 0, -1, 1]


def test_moving_average_reaches_as_far_as_its_order():
    y = planted(600, 6, ma_lags={1: 0.7}, level=10.0)
    m = ar.fit(y, no_x(y), [ar.Orders(q=1)])
    path = ar.forecast(m, y, no_x(y), np.zeros((5, 0)), 5)
    assert path[0] == pytest.approx(m.constant + m.ma[1] * m.residuals[-1])
    assert np.allclose(path[1:], m.constant)


def test_regressor_is_recovered_and_used_ahead():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2, 900).astype(float)[:, None]
    y = planted(900, 8, ma_lags={1: 0.5}, level=30.0) + 6 * x[:, 0]
    m = ar.fit(y[:870], x[:870], [ar.Orders(q=1)])
    assert m.exog[0] == pytest.approx(6.0, abs=0.3)
    path = ar.forecast(m, y[:870], x[:870], x[870:], 30)
    assert np.abs(path - y[870:]).mean() < 1.3


def test_search_takes_season_and_differences_from_the_data():
    rng = np.random.default_rng(9)
    weekly = np.tile([0, 3, 1, 8, 2, 9, 14], 60) + rng.normal(0, 1, 420) + 20
    walk = np.cumsum(rng.normal(0, 1, 420))
    assert ar.choose_differences(weekly, 7, True) == (0, 1)
    assert ar.choose_differences(weekly, 7, False)[1] == 0
    assert ar.choose_differences(walk, 7, True) == (1, 0)
    assert ar.choose_differences(rng.normal(0, 1, 420), 7, True) == (0, 0)


def test_unstable_candidates_are_passed_over():
    assert ar.is_stable({1: 0.5, 7: 0.3}) and not ar.is_stable({1: 1.02}) and not ar.is_stable({7: 1.0})
    y = 1.05 ** np.arange(80) + np.random.default_rng(1).normal(0, .01, 80)
    assert ar.fit(y, no_x(y), [ar.Orders(p=1)]) is None


@pytest.mark.parametrize("y", [[], [1.0] * 100, [1.0, 2.0, 3.0]])
def test_short_and_constant_series_have_no_model(y):
    y = np.array(y)
    assert ar.fit(y, no_x(y), [ar.Orders(p=1, q=1)]) is None


def _rows(name, values):
    return [("s", name, (dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(), v) for i, v in enumerate(values)]


def test_families_by_rolling_origin(frame):
    """Families with a season beat those without on a weekly series; short ones forecast their mean, null days count as 0."""
    rng = np.random.default_rng(10)
    weekly = [float(v) for v in np.tile([2, 3, 1, 8, 2, 9, 14], 40) + rng.normal(0, 1, 280) + 20]
    rows = _rows("weekly", weekly) + _rows("short", [4.0, None] * 20) + _rows("tiny", [1.0]) + [("s", "weekly", None, 9.0)]
    df = frame("store string, product string, date date, demand double", rows)
    out = ar.arima_forecast(df).toPandas()
    assert set(out.family) == set(ar.FAMILIES) and set(out[out["product"] == "weekly"].origin) == {1, 2, 3}
    assert len(out[out["product"] == "weekly"]) == 4 * 90 and (out[out["product"] == "weekly"].status == "arima").all()
    error = out[out["product"] == "weekly"].assign(e=lambda d: (d.demand - d.prediction).abs()).groupby("family").e.mean()
    assert error["sarima7"] < 1.3 and error["sarima7_exog"] < 1.4 and error["arima"] > 1.5 * error["sarima7"]
    short = out[out["product"] == "short"]
    assert (short.status == "mean").all() and short.prediction.unique() == pytest.approx([2.0]) and set(short.origin) == {3}
    assert "tiny" not in set(out["product"])
    models = {r["product"]: r for r in ar.arima_models(df).collect()}
    assert models["tiny"].orders is None and models["tiny"].n_rows == 1 and models["weekly"].sigma == pytest.approx(1.0, abs=0.3)
    assert ar.arima_forecast(df.limit(0)).count() == 0 and ar.arima_models(df.limit(0)).count() == 0


def test_one_shuffle_serves_all_families(frame):
    df = frame("store string, product string, date date, demand double", _rows("a", [1.0] * 5))
    plan = ar.arima_forecast(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
