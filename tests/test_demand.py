"""Restoration rules, masks, baskets and their invariants."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillstream.operators import demand as dem
from tillstream.sources.testdata import Tables, hourly

HOURLY = "store string, product string, date date, hour int, qty double"


def day(n):
    return (dt.date(2024, 1, 1) + dt.timedelta(days=n)).isoformat()


def full(n, hours=((9, 1.0), (12, 1.0), (18, 2.0)), product="p"):
    return [("s", product, day(i), h, q) for i in range(n) for h, q in hours]


def test_five_full_days_are_needed(frame):
    assert dem.build_profiles(frame(HOURLY, full(4))).count() == 0
    prof = {r.hour: r.cum_share for r in dem.build_profiles(frame(HOURLY, full(5))).collect()}
    assert min(prof) == 9 and max(prof) == 23
    assert (prof[9], prof[11], prof[12], prof[17], prof[18], prof[23]) == (0.25, 0.25, 0.5, 0.5, 1.0, 1.0)


def test_stored_profile_stops_at_last_hour(frame):
    prof = dem.build_profiles(frame(HOURLY, full(5)), until=None)
    assert prof.agg(F.max("hour")).first()[0] == 18


def test_estimate_rules(frame):
    rows = full(5) + [
        ("s", "p", day(10), 12, 3.0),  # stopped at noon: 3 / 0.5
        ("s", "p", day(11), 8, 3.0),   # before the profile's first hour: no match
        ("s", "p", day(12), 18, 3.0),  # full day
    ]
    df = frame(HOURLY, rows)
    got = {r.date.isoformat(): r for r in dem.estimate_demand(df, dem.build_profiles(df)).collect()}
    assert (got[day(10)].demand_estimated, got[day(10)].lost_qty, got[day(10)].is_censored) == (6.0, 3.0, 1)
    assert (got[day(11)].demand_estimated, got[day(11)].is_censored) == (3.0, 0)
    assert (got[day(12)].demand_estimated, got[day(12)].is_censored) == (3.0, 0)


@pytest.mark.parametrize("cum, want, flag", [(0.04, 2.0, 0), (0.05, 10.0, 1), (0.1, 10.0, 1), (0.8, 2.5, 1), (1.2, 2.0, 1)])
def test_floor_cap_and_lower_bound(frame, cum, want, flag):
    df = frame("sold double, last_hour int, cum_at_stop double", [(2.0, 10, cum)])
    row = dem.restore(df).first()
    assert (row.demand_estimated, row.is_censored) == (want, flag)


def test_zero_total_day_is_skipped_but_counts_as_full(frame):
    rows = full(4) + [("s", "p", day(20), 18, 0.0)]
    prof = {r.hour: r.cum_share for r in dem.build_profiles(frame(HOURLY, rows)).collect()}
    assert prof[9] == 0.25 and prof[18] == 1.0


def test_fallback_levels(frame):
    rows = [("s", "p", day(i), h, 1.0, "c") for i in range(5) for h in (9, 18)]
    rows += [("t", "p", day(0), 9, 1.0, "c"), ("t", "q", day(0), 9, 1.0, "c"), ("s", "z", day(0), 9, 1.0, "d"),
             ("u", "z", day(0), 9, 1.0, "e"), ("u", "z", day(1), 3, 1.0, "e")]
    df = frame(HOURLY + ", category string", rows)
    got = {(r["store"], r["product"], r.date.isoformat()): r.level for r in dem.estimate_with_fallback(df).collect()}
    assert got[("s", "p", day(0))] == "pair" and got[("t", "p", day(0))] == "product"
    assert got[("t", "q", day(0))] == "category" and got[("s", "z", day(0))] == "store"
    assert got[("u", "z", day(0))] == "global" and got[("u", "z", day(1))] == "none"


def test_invariants_on_the_tables(spark):
    h = hourly(Tables(spark, SF))
    prof = dem.build_profiles(h)
    est = dem.estimate_demand(h, prof)
    row = est.agg(F.min(F.col("demand_estimated") - F.col("sold")).alias("low"),
                  F.max(F.col("demand_estimated") / F.col("sold")).alias("high"), F.sum("sold").alias("sold")).first()
    assert row.low >= 0 and row.high <= 5 and row.sold == h.agg(F.sum("qty")).first()[0]
    assert prof.filter((F.col("cum_share") < 0) | (F.col("cum_share") > 1)).count() == 0
    mono = dem.build_profiles(h, monotone=True).groupBy("store", "product").agg(F.max_by("cum_share", "hour").alias("x"))
    assert mono.agg(F.min("x")).first()[0] == pytest.approx(1.0)


def test_result_does_not_depend_on_partitions(spark):
    h = hourly(Tables(spark, SF))
    first = {tuple(r) for r in dem.estimate_demand(h, dem.build_profiles(h)).collect()}
    other = h.repartition(13)
    assert first == {tuple(r) for r in dem.estimate_demand(other, dem.build_profiles(other)).collect()}


def test_basket_affinity_with_a_hot_check(spark):
    """One check holds a third of all lines; counts equal brute force."""
    rng = np.random.default_rng(3)
    lines = [(int(c), f"p{int(p)}", float(q)) for c, p, q in
             zip(rng.integers(1, 60, 400), rng.integers(0, 8, 400), rng.integers(1, 4, 400))]
    lines += [(0, f"p{i % 8}", 1.0) for i in range(200)]
    df = spark.createDataFrame(lines, "check_id long, product string, qty double")
    got = {(r.item_a, r.item_b): (r.pair_count, r.lift) for r in dem.basket_affinity(df, 5).collect()}
    totals = {}
    for _, p, q in lines:
        totals[p] = totals.get(p, 0) + q
    top = [p for p, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:5]]
    baskets = {}
    for c, p, _ in lines:
        baskets.setdefault(c, set()).add(p)
    n = len(baskets)
    for a, b in itertools.combinations(sorted(top), 2):
        both = sum(a in s and b in s for s in baskets.values())
        na, nb = (sum(x in s for s in baskets.values()) for x in (a, b))
        assert got[(a, b)][0] == both and got[(a, b)][1] == pytest.approx(both / n / (na / n * nb / n))


def _em(obs, steps=25):
    """Plain EM for a Poisson rate with lower-bound observations."""
    rate = max(sum(x for x, _ in obs) / len(obs), 1e-6)
    for _ in range(steps):
        total = 0.0
        for x, cens in obs:
            if not cens:
                total += x
                continue
            def at_least(k):
                return max(1 - sum(math.exp(-rate) * rate ** j / math.factorial(j) for j in range(k)), 1e-12)
            total += max(rate * (at_least(x - 1) if x > 0 else 1.0) / at_least(x), x)
        rate = total / len(obs)
    return rate


def test_censored_rate_equals_plain_em(frame):
    obs = [(0, 1), (0, 1), (1, 1), (2, 0), (3, 0), (4, 1), (2, 0)]
    df = frame("store string, product string, hour int, qty double, strict int", [("s", "p", 9, float(x), c) for x, c in obs])
    row = dem.censored_rates(df).first()
    assert row.rate == pytest.approx(_em(obs)) and row.rate > row.observed_rate


MASKED = "store string, product string, hour int, qty double, strict int"


def _log_likelihood(obs, rate):
    total = 0.0
    for x, cens in obs:
        if cens:
            total += math.log(math.fsum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(x, x + 400)))
        else:
            total += x * math.log(rate) - rate
    return total


@pytest.mark.parametrize("obs", [
    [(0, 1), (0, 1), (1, 1), (2, 0), (3, 0), (4, 1), (2, 0)],
    [(9, 1), (8, 1), (1, 0)],  # far in the tail: most of what is known are lower bounds
    [(40, 1), (35, 0), (38, 0), (60, 1)], [(5, 0)], [(0, 0), (0, 0), (3, 1)]])
def test_rate_interval_equals_a_search_of_the_likelihood(frame, obs):
    row = dem.censored_rate_interval(frame(MASKED, [("s", "p", 9, float(x), c) for x, c in obs])).first()
    grid = [row.rate * f for f in (0.99, 0.999, 1.001, 1.01)]
    best = _log_likelihood(obs, row.rate)
    assert all(_log_likelihood(obs, r) < best for r in grid)
    for limit in (row.rate_low, row.rate_high):
        assert 2 * (best - _log_likelihood(obs, limit)) == pytest.approx(2.705543, abs=1e-4)
    assert row.rate_low < row.rate < row.rate_high


def test_rate_interval_without_sales_or_without_open_days(frame):
    rows = [("s", "none", 9, 0.0, 0)] * 4 + [("s", "closed", 9, 1.0, 1)] * 3
    out = {r["product"]: r for r in dem.censored_rate_interval(frame(MASKED, rows)).collect()}
    assert (out["none"].rate, out["none"].rate_low) == (0.0, 0.0)
    assert out["none"].rate_high == pytest.approx(2.705543 / 8)
    assert [out["closed"][c] for c in ("rate", "rate_low", "rate_high", "n_censored")] == [None, None, None, 3]
    assert dem.censored_rate_interval(frame(MASKED, [])).count() == 0


def test_rate_interval_covers_the_true_rate(frame):
    """Counts that a sell-out cut off: the interval holds the true rate about nine times in ten, the plain mean rarely does."""
    rng = np.random.default_rng(5)
    rows = []
    for series in range(300):
        made = rng.integers(2, 8, 40)
        wanted = rng.poisson(4.0, 40)
        rows += [("s", str(series), 9, float(min(w, m)), int(w >= m)) for w, m in zip(wanted, made, strict=True)]
    out = dem.censored_rate_interval(frame(MASKED, rows)).collect()
    share = np.mean([r.rate_low <= 4.0 <= r.rate_high for r in out])
    assert 0.85 <= share <= 0.95
    assert np.mean([r.rate for r in out]) == pytest.approx(4.0, abs=0.1)


def test_plan_shares_use_one_source_per_pair(frame):
    rows = full(7) + [("s", "new", day(0), 9, 1.0)]
    df = frame(HOURLY, rows)
    shares = dem.hour_plan_shares(df, dem.build_profiles(df))
    src = {(r["product"], r.source) for r in shares.collect()}
    assert src == {("p", "recent"), ("new", "even")}
    total = {r["product"]: r.t for r in shares.groupBy("product").agg(F.sum("share").alias("t")).collect()}
    assert total["p"] == pytest.approx(1.0, abs=1e-3) and total["new"] == pytest.approx(1.0, abs=1e-3)


def test_share_expectation_keeps_totals(spark):
    h = hourly(Tables(spark, SF))
    out = dem.share_expectations(h).agg(F.sum("actual").alias("a"), F.sum("expected").alias("e")).first()
    assert out.a == h.agg(F.sum("qty")).first()[0] and out.e > 0
