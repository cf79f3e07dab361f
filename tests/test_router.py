"""Routing rules and the confidence gate on hand-made SKUs."""

import pytest

from tillstream.operators import router as rt

COLS = ("store string, product string, n_days int, mean_demand double, cv_demand double, share_censored double, "
        "cv_7d_mean double, demand_trend_mean double")


def rules(frame, *row):
    return rt.add_rules(frame(COLS, [("s", "p", *row)])).first()


def test_rules_and_difficulty(frame):
    hard = rules(frame, 20, 3.0, 1.4, 0.8, 0.5, 1.3)
    assert hard.difficulty == pytest.approx(1.2 + 1.2 + 1.1 + 1.0 + 0.25 + 0.2)
    assert (hard.rule_v0, hard.rule_v1, hard.rule_v2) == ("two_week_avg",) * 3
    easy = rules(frame, 200, 20.0, 0.4, 0.1, 0.2, 1.0)
    assert easy.difficulty == 0 and (easy.rule_v0, easy.rule_v1, easy.rule_v2) == ("clustered",) * 3
    cens = rules(frame, 100, 11.0, 0.7, 0.6, 0.2, 1.0)
    assert (cens.rule_v0, cens.rule_v1, cens.rule_v2) == ("censoring", "assortment", "assortment")


def test_unknown_descriptors(frame):
    row = rules(frame, 50, None, None, None, None, None)
    assert row.rule_v2 == "clustered" and row.rule_v0 == "clustered" and row.mean_demand is None
    assert row.difficulty == pytest.approx(0.4)
    nan = float("nan")
    none = rules(frame, None, nan, nan, nan, nan, nan)
    assert none.difficulty == 0 and (none.rule_v0, none.rule_v1, none.rule_v2) == ("clustered",) * 3
    assert rules(frame, None, 20.0, 0.4, 0.1, 0.2, 0.0).rule_v2 == "clustered"


def test_gate_falls_back_below_the_threshold(frame):
    cols = "store string, product string, router_model string, router_confidence double, " + ", ".join(
        f"{m}_{v} double" for m in ("a", "b") for v in ("r2", "mae", "mse", "wmape"))
    df = frame(cols, [("s", "p", "a", 0.9, 0.5, 1.0, 1.0, 10.0, 0.1, 2.0, 4.0, 20.0),
                      ("s", "q", "a", 0.4, 0.5, 1.0, 1.0, 10.0, 0.9, 0.5, 1.0, 5.0),
                      ("s", "r", "a", None, 0.5, 1.0, 1.0, 10.0, 0.9, 0.5, 1.0, 5.0)])
    got = {r.threshold: r for r in rt.gate_sweep(df, ("a", "b"), ("b",), (0.3, 0.5)).collect()}
    assert got[0.3].gate_coverage == pytest.approx(2 / 3) and got[0.3].avg_wmape == pytest.approx(25 / 3)
    assert got[0.5].gate_coverage == pytest.approx(1 / 3) and got[0.5].avg_wmape == pytest.approx(20 / 3)
    best = rt.best_gate(rt.gate_sweep(df, ("a", "b"), ("b",), (0.3, 0.5))).first()
    assert best.threshold == 0.5


def test_the_first_listed_setting_wins_a_tie(frame):
    cols = "fallback string, threshold double, position int, avg_wmape double, avg_r2 double, avg_mae double"
    df = frame(cols, [("a", 0.3, 2, 5.0, 0.1, 1.0), ("b", 0.4, 1, 5.0, 0.1, 1.0), ("b", 0.3, 0, 5.01, 0.1, 1.0)])
    assert rt.best_gate(df).first().position == 1


def test_learned_router_says_how_it_was_scored(frame):
    cols = "store string, product string, oracle string, x double"
    few = frame(cols, [("s", "p", "a", 1.0), ("s", "q", "b", 2.0), ("s", "r", "b", 3.0)])
    assert {r.status for r in rt.learned_router(few, ("x",)).collect()} == {"in_sample"}
    many = frame(cols, [("s", f"p{i}", "ab"[i % 2], float(i % 2)) for i in range(12)])
    assert {r.status for r in rt.learned_router(many, ("x",)).collect()} == {"out_of_fold"}
    assert rt.learned_router(few.filter("oracle is null"), ("x",)).count() == 0
