"""The registered D04 and D21 rules on frames that reach lag 30 and five other stock-outs."""

import datetime
import statistics

import pytest

from tillstream.operators import demand as dem
from tillstream.plans import demand_q


def test_attach_demand_keeps_rows_with_the_whole_history(frame, monkeypatch):
    first = datetime.date(2024, 1, 1)
    rows = [(s, "a", str(first + datetime.timedelta(i)), float((i * 7 + s) % 11), 0.0, 0) for s, n in ((1, 40), (2, 30)) for i in range(n)]
    daily = frame("store int, product string, date date, demand double, lost_qty double, is_censored int", rows)
    monkeypatch.setattr(demand_q.dem, "attach_demand", lambda *a: daily)
    monkeypatch.setattr(demand_q, "sold_daily", lambda t: None)
    monkeypatch.setattr(demand_q, "sold_estimates", lambda t: None)
    df = demand_q.attach_demand(None)
    features = {f"demand_lag{k}" for k in (1, 2, 3, 7, 14, 30)} | {f"demand_roll_mean{k}" for k in (3, 7, 14, 30)} | {"demand_roll_std7"}
    assert features <= set(df.columns)
    got, values = sorted(df.collect(), key=lambda r: r.date), [r[3] for r in rows[:40]]
    assert [(r.store, (r.date - first).days) for r in got] == [(1, i) for i in range(30, 40)]
    for r in got:
        i = (r.date - first).days
        assert [r[f"demand_lag{k}"] for k in (1, 2, 3, 7, 14, 30)] == [values[i - k] for k in (1, 2, 3, 7, 14, 30)]
        assert [r[f"demand_roll_mean{k}"] for k in (3, 7, 14, 30)] == pytest.approx([statistics.mean(values[i - k:i]) for k in (3, 7, 14, 30)])
        assert r.demand_roll_std7 == pytest.approx(statistics.stdev(values[i - 7:i]))


def test_substitution_by_category_compares_none_with_five(frame, monkeypatch):
    rows = [(1, f"p{i}", f"2024-01-0{d}", "c", 1.0 + i + d, int(i >= out)) for d, out in ((1, 0), (2, 1), (3, 4), (4, 5), (5, 6)) for i in range(9)]
    effect = dem.substitution_effect(frame("store int, product string, date date, category string, sold double, stock int", rows))
    monkeypatch.setattr(demand_q, "weekly_fine", lambda t: None)
    monkeypatch.setattr(demand_q, "_stocked", lambda rows: effect)
    got = demand_q.substitution_by_category(None).collect()
    # Every product sells d + a constant, so a day's delta is d - 3: none out on day 1, five and six on days 4 and 5.
    assert [tuple(r) for r in got] == [("c", -2.0, 9, pytest.approx((4 * 1 + 3 * 2) / 7), 7, pytest.approx(10 / 7 + 2))]


def test_attach_demand_restores_both_kinds_of_series(frame):
    first, days = datetime.date(2024, 1, 1), range(40)
    # One sale at 10 and one at 20 o'clock, but only the first of them on every fourth day: 10 o'clock has half of a day.
    stopped = {i for i in days if i % 4 == 3}
    day = {i: str(first + datetime.timedelta(i)) for i in days}
    events = [(7, "click", f"{day[i]} {h}:30:00", 1.0) for i in days for h in (10, 20) if h == 10 or i not in stopped]
    lines = [(h - 9, 1, 1, 3.0, 30.0, "N", "O", day[i]) for i in days for h in (10, 20) if h == 10 or i not in stopped]
    tables = {
        "events": frame("user_id long, event_type string, ts timestamp, value double", events),
        "nation": frame("n_nationkey int, n_name string", [(2, "x")]),
        "supplier": frame("s_suppkey long, s_nationkey int", [(1, 2)]),
        "part": frame("p_partkey long, p_brand string, p_type string", [(1, "Brand#11", "SMALL")]),
        "lineitem": frame("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp", lines)}
    got = demand_q.attach_demand(tables.__getitem__).collect()
    for store, product, unit in ((7, "click", 1.0), (2, "SMALL", 3.0)):
        rows = sorted((r for r in got if (r.store, r.product) == (store, product)), key=lambda r: r.date)
        assert [(r.date - first).days for r in rows] == list(range(30, 40))
        for r in rows:
            out = (r.date - first).days in stopped
            assert (r.sold, r.demand, r.lost_qty, r.is_censored) == (unit * (1 if out else 2), unit * 2, unit * out, out)
            assert r.demand_lag30 == unit * 2 and r.demand_roll_mean30 == unit * 2 and r.demand_roll_std7 == 0
    assert len(got) == 20
