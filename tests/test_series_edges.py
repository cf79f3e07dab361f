"""Hand-computed cases: gaps, nulls, short series, ties."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstream.operators import aggregates as agg, evaluate as ev, filters as flt, joins, ranking, series

PAIR = "store string, product string, date date, sold double"


def day(n):
    return (dt.date(2024, 1, 1) + dt.timedelta(days=n)).isoformat()


def by_day(df, col):
    return [r[col] for r in df.orderBy("date").collect()]


def test_row_lag_and_calendar_mean_differ_over_a_gap(frame):
    df = frame(PAIR, [("s", "p", day(i), float(i)) for i in (0, 1, 7, 8)])
    assert by_day(series.add_lags(df, "sold", (1,)), "sold_lag1") == [None, 0.0, 1.0, 7.0]
    rows = series.add_rolling(df, "sold", (3,), min_periods={3: 1})
    assert by_day(rows, "sold_roll_mean3") == [None, 0.0, 0.5, 8 / 3]
    cal = series.add_rolling(df, "sold", (3,), min_periods={3: 1}, mode="calendar")
    assert by_day(cal, "sold_roll_mean3") == [None, 0.0, None, 7.0]


def test_null_inside_window_and_min_periods(frame):
    df = frame(PAIR, [("s", "p", day(i), v) for i, v in enumerate([1.0, None, 3.0, 4.0])])
    assert by_day(series.add_rolling(df, "sold", (3,), min_periods={3: 2}), "sold_roll_mean3") == [None, None, None, 2.0]


def test_std_needs_two_rows(frame):
    df = frame(PAIR, [("s", "p", day(i), v) for i, v in enumerate([1.0, 3.0, 5.0])])
    got = by_day(series.add_rolling(df, "sold", (7,), "std"), "sold_roll_std7")
    assert got[:2] == [None, None] and got[2] == pytest.approx(math.sqrt(2))


def test_null_keys_are_dropped_before_grouping(frame):
    lines = frame("date date, store string, category string, product string, qty double",
                  [(day(0), "s", None, "p", 1.0), (day(0), "s", "c", "p", 2.0)])
    assert [r.sold for r in agg.daily_sales(lines).collect()] == [2.0]


def test_lag_exact_days_and_as_of(frame):
    df = frame(PAIR, [("s", "p", day(i), float(i)) for i in (0, 3, 7, 14, 20)])
    assert by_day(joins.lag_mean(df, "sold"), "lag_core") == [None, None, 0.0, 3.5, None]
    assert by_day(joins.as_of(df, df, "sold", 7, "prev"), "prev") == [None, None, 0.0, 7.0, 7.0]


def test_one_to_one_rejects_repeats(frame):
    a = frame("k int, v int", [(1, 1), (1, 2)])
    b = frame("k int, w int", [(1, 1)])
    with pytest.raises(ValueError):
        joins.one_to_one(a, b, ["k"])
    with pytest.raises(ValueError):
        joins.one_to_one(b, a, ["k"])


@pytest.mark.parametrize("n", [1, 2, 4, 7, 9])
def test_short_and_flat_series(frame, n):
    flat = frame("store string, product string, date date, demand double", [("s", "p", day(i), 2.0) for i in range(n)])
    row = series.stability_features(flat).first()
    assert row.acf_lag1 == 0 and row.acf_lag7 == 0 and row.trend_abs_60 == 0 and row.seasonal_strength_7 == 0
    assert row.mean_shift_norm_30_60 == 0 and row.zero_run_max == 0


def test_stability_against_numpy(frame):
    rng = np.random.default_rng(0)
    y = rng.poisson(5, 90).astype(float)
    df = frame("store string, product string, date date, demand double", [("s", "p", day(i), float(v)) for i, v in enumerate(y)])
    row = series.stability_features(df).first()
    assert row.acf_lag7 == pytest.approx(np.corrcoef(y[7:], y[:-7])[0, 1])
    last = y[-60:]
    assert row.trend_abs_60 == pytest.approx(abs(np.polyfit(np.arange(60.0), last, 1)[0]) / (abs(last.mean()) + 1))
    recent, prior = y[-30:].mean(), y[-60:-30].mean()
    assert row.mean_shift_norm_30_60 == pytest.approx(abs(recent - prior) / (abs(prior) + 1))
    a, b = y[-7:].std(), y[-37:-7].std()
    assert row.variance_shift_norm_7_30 == pytest.approx(abs(a - b) / (b + 1))


def test_window_shift_halves_short_series(frame):
    y = [1.0, 1.0, 4.0, 4.0, 4.0]
    df = frame("store string, product string, date date, demand double", [("s", "p", day(i), float(v)) for i, v in enumerate(y)])
    got = series.window_shift(df, "demand", 30, 30, "level", "x").first().x
    assert got == pytest.approx((4.0 - 1.0) / 2.0)  # newer half has 3 rows, older 2


def test_longest_zero_run(frame):
    y = [0, 1, 0, 0, 0, 2, 0, 0]
    df = frame("store string, product string, date date, demand double", [("s", "p", day(i), float(v)) for i, v in enumerate(y)])
    row = series.longest_zero_run(df, "demand").first()
    assert (row.zero_run_max, row.zero_run_ratio) == (3, 3 / 8)


def test_keep_latest_prefers_new_rows(frame):
    df = frame("k int, v int, src int", [(1, 10, 0), (1, 20, 1), (2, 30, 0)])
    got = {r.k: r.v for r in series.keep_latest(df, ["k"], F.col("src")).collect()}
    assert got == {1: 20, 2: 30}


def test_horizon_forecast(frame):
    df = frame(PAIR, [("s", "p", day(i), float(i)) for i in range(40)])
    got = {r.step: (r.window_average, r.seasonal_naive) for r in series.horizon_forecast(df, "sold", 3, 30, 30).collect()}
    assert got[1] == (24.5, 10.0) and got[3] == (24.5, 12.0)


def test_r2_guards_and_ties(frame):
    rows = [("s", "flat", day(i), 5.0, m, 4.0) for i in range(3) for m in ("a", "b")]
    rows += [("s", "one", day(0), 5.0, m, 4.0) for m in ("a", "b")]
    rows += [("s", "tie", day(i), float(i), m, 1.0) for i in range(3) for m in ("a", "b")]
    rows += [("s", "win", day(i), float(i), m, float(i) + (m == "a")) for i in range(3) for m in ("a", "b")]
    preds = frame("store string, product string, date date, fact double, model string, prediction double", rows)
    best = {r["product"]: r for r in ev.best_by_sku(ev.score_per_sku(preds), ("a", "b")).collect()}
    assert best["flat"].best_r2 is None and best["flat"].best_model == "a" and best["flat"].best_mae == 1.0
    assert best["one"].best_r2 is None and best["one"].best_model == "a"
    assert best["tie"].best_model == "a" and best["tie"].best_r2 == 0.0
    assert best["win"].best_model == "b" and best["win"].best_r2 == 1.0


def test_split_is_inclusive(frame):
    df = frame(PAIR, [("s", "p", day(i), 1.0) for i in range(10)])
    train, test = flt.train_test(df, 3)
    assert (train.count(), test.count()) == (7, 3)


def test_nearest_row_breaks_ties_low(frame):
    df = frame("buffer int, x double", [(2, 1.0), (1, 3.0), (3, 9.0)])
    assert ranking.nearest_row(df, "x", F.lit(2.0), "buffer").first().buffer == 1


def test_salted_join_equals_plain_join(frame):
    big = frame("k int, d int", [(1, i) for i in range(50)] + [(2, 1), (3, 1)])
    small = frame("k int, v int", [(1, 10), (1, 11), (2, 20)])
    want = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, joins.salted_join(big, small, ["k"], ["d"], 4).collect())) == want and len(want) == 101
