"""Fitted models on a small synthetic panel with known structure."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstream.operators import clusters as cl, linear_models as lin, local_models as lm, models as md, router as rt, targets as tg


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        for p in range(3):
            level = 4 + 3 * s + 6 * p
            for i in range(140):
                d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
                y = level + 3 * (d.weekday() >= 5) + rng.normal(0, 0.5)
                rows.append((f"s{s}", f"p{p}", f"c{p}", "city", d, float(max(y, 0)), float(max(y, 0)), 0.0, 0))
    return spark.createDataFrame(rows, "store string, product string, category string, city string, date date, "
                                       "sold double, demand double, lost_qty double, is_censored int")


@pytest.fixture(scope="module")
def frames(panel):
    return md.training_frames(panel, 14, "demand", (1, 2, 3, 7))


def mae(df, col="prediction", label="label"):
    return df.agg(F.avg(F.abs(F.col(label) - F.col(col)))).first()[0]


def test_global_models_learn_the_level(frames):
    train, test, features = frames
    assert mae(md.fit_predict(md.gbt(features), train, test)) < 1.5
    assert mae(md.fit_predict(md.tweedie(features), train, test)) < 2.0
    assert test.count() == 12 * 14


def test_segments_fall_back_to_the_global_model(frames):
    train, test, features = frames
    few = train.filter((F.col("category") != "c0") | (F.col("date") > F.lit("2024-04-25").cast("date")))
    out = lin.segmented_forecast(few, test, "category", features, 200)
    scopes = {(r.category, r.model_scope) for r in out.select("category", "model_scope").distinct().collect()}
    assert scopes == {("c0", "global"), ("c1", "segment"), ("c2", "segment")} and out.count() == test.count()
    assert out.columns == [*test.columns, "prediction", "model_scope"]


def test_unknown_features(frames):
    train, test, features = frames
    gaps = test.withColumn(features[0], F.when(F.pmod(F.dayofmonth("date"), F.lit(3)) > 0, F.col(features[0])))
    assert gaps.filter(F.col(features[0]).isNull()).count() > 0
    for pipe in (md.gbt(features, trees=3), md.tweedie(features)):
        scored = md.fit_predict(pipe, train, gaps)
        assert scored.count() == test.count() and scored.filter("prediction is null").count() == 0
    assert scored.columns == [*test.columns, "prediction"]


def test_intervals_cover_the_middle(frames):
    train, test, features = frames
    out = md.residual_intervals(md.gbt(features, trees=10), train, test, "category", calibration_days=30)
    row = out.agg(F.avg(((F.col("label") >= F.col("p10")) & (F.col("label") <= F.col("p90"))).cast("int")).alias("cover"),
                  F.min(F.col("p90") - F.col("p10")).alias("width")).first()
    assert 0.5 < row.cover <= 1.0 and row.width >= 0


def test_two_stage_and_stack_return_every_row(frames):
    train, test, features = frames
    assert md.two_stage_forecast(train, test, features, 3).filter("prediction_soft is not null").count() == test.count()
    assert md.stacked_forecast(train, test, features, 2, trees=3).count() == test.count()


def test_local_ridge_and_trend(panel):
    from tillstream.operators import filters as flt
    rows = flt.label_split(panel, 14)
    out = lm.trend_season_forecast(rows)
    assert out.count() == 12 * 14 and mae(out, label="demand") < 1.0
    short = flt.label_split(panel.filter(F.col("date") > F.lit("2024-05-01").cast("date")), 7)
    assert {r.status for r in lm.trend_season_forecast(short).select("status").distinct().collect()} == {"mean"}
    assert mae(lm.autoregressive_forecast(rows, exog=("is_weekend",)), label="demand") < 1.2


def test_kpss_and_adf_tell_noise_from_a_walk(spark):
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(0, 1, 300), np.cumsum(rng.normal(0, 1, 300))
    rows = [(n, "p", dt.date(2023, 1, 1) + dt.timedelta(days=i), float(v))
            for n, ys in (("noise", noise), ("walk", walk), ("flat", np.ones(50))) for i, v in enumerate(ys)]
    got = {r.store: r for r in lm.stationarity(spark.createDataFrame(rows, "store string, product string, date date, demand double")).collect()}
    assert got["noise"].stationary_adf == 1 and got["noise"].stationary_kpss == 1
    assert got["walk"].stationary_adf == 0 and got["walk"].stationary_kpss == 0
    assert (got["flat"].adf_pvalue, got["flat"].kpss_pvalue) == (1.0, 0.1)


def test_clusters_choose_k_and_assign_new_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{c}_{i}", float(c * 10 + rng.normal()), float(-c * 5 + rng.normal()) if i or c else None)
            for c in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "store string, a double, b double")
    fit = cl.fit_store_clusters(df, ("a", "b"), (2, 3, 5))
    assert fit.k == 3 and fit.silhouette == max(fit.tried.values())
    out = fit.assign(df.filter(F.col("b").isNull()))
    assert out.columns == ["store", "a", "b", "cluster"] and out.filter("cluster is null").count() == 0


def test_learned_router_is_out_of_fold_and_complete(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        x = rng.normal(0, 1)
        rows.append((f"s{i}", "p", "a" if x > 0 else "b", *[float(x + rng.normal(0, 0.2)) for _ in rt.ROUTER_FEATURES]))
    df = spark.createDataFrame(rows, "store string, product string, oracle string, "
                               + ", ".join(f"{f} double" for f in rt.ROUTER_FEATURES))
    out = rt.learned_router(df).collect()
    assert len(out) == 120 and sum(r.router_model == r.oracle for r in out) > 100
    assert all(0.5 <= r.router_confidence <= 1.0 and -1e-9 <= r.router_margin <= 1.0 for r in out)


def test_weights_have_mean_one(panel):
    w = tg.sample_weights(panel.withColumn("is_weak_sku", (F.col("store") == "s0").cast("int")))
    row = w.agg(*[F.avg(c).alias(c) for c in ("w_std", "w_inverse_std", "w_weak_025", "w_weak_050")]).first()
    assert all(v == pytest.approx(1.0) for v in row)


def test_search_folds_go_by_date(frames):
    train, _, _ = frames
    days = []
    for seen, judged in md.rolling_origins(train, 3, 10):
        a, b = seen.agg(F.max("date")).first()[0], judged.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        assert a < b.a and (b.b - b.a).days == 9 and (b.a - a).days == 1
        days.append((b.a, b.b))
    assert days == sorted(days, reverse=True) and all(x[0] > y[1] for x, y in zip(days, days[1:]))


def test_search_halves_and_refits_the_winner(frames):
    train, test, features = frames
    trials, winner = md.search(train, features, (1, 4), (0.05, 0.3), trees=8, folds=2, fold_days=10, history_days=60)
    rows = sorted(trials.collect(), key=lambda r: (r.rung, r.mae))
    assert [r.rung for r in rows] == [0] * 4 + [1] * 2
    assert {(r.n_folds, r.history_days, r.trees) for r in rows if r.rung == 0} == {(1, 30, 4)}
    assert {(r.n_folds, r.history_days, r.trees) for r in rows if r.rung == 1} == {(2, 60, 8)}
    assert [r.is_kept for r in rows] == [1, 1, 0, 0, 1, 0]
    assert {(r.depth, r.step) for r in rows if r.rung == 1} == {(r.depth, r.step) for r in rows[:2]}
    best = winner.stages[-1]
    assert (best.getOrDefault("maxDepth"), best.getOrDefault("stepSize")) == (rows[4].depth, rows[4].step)
    assert mae(md.predict(winner, test)) < 2.5
    none, nothing = md.search(train.limit(0), features)
    assert none.count() == 0 and nothing is None


def test_planted_breaks_are_found_within_a_week(spark):
    rng, rows, planted = np.random.default_rng(8), [], {}
    for s in range(12):
        at = sorted(rng.choice([(70,), (150,), (60, 160), ()][s % 4], size=len([(70,), (150,), (60, 160), ()][s % 4]), replace=False).tolist())
        planted[f"s{s}"] = at
        for i in range(280):
            d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            level = 60 + 0.1 * i + sum((0.6 if k % 2 == 0 else -0.9) * max(0, i - c) for k, c in enumerate(at)) + 4 * (d.weekday() == 5)
            rows.append((f"s{s}", "p", d, float(max(0.0, level + rng.normal(0, 2))), i >= 250))
    df = spark.createDataFrame(rows, "store string, product string, date date, demand double, is_test boolean")
    out = lm.trend_break_forecast(df)
    got = {r.store: [(b - dt.date(2024, 1, 1)).days for b in r.breaks] for r in out.select("store", "breaks").distinct().collect()}
    for store, at in planted.items():
        assert len(got[store]) == len(at) and all(abs(a - b) <= 7 for a, b in zip(got[store], at)), (store, got[store], at)
    line = lm.trend_season_forecast(df)
    assert out.count() == line.count() == 12 * 30 and mae(out, label="demand") < 0.5 * mae(line, label="demand")


def test_breaks_of_odd_series(spark):
    first = dt.date(2024, 1, 1)
    rows = [("flat", 5.0, i) for i in range(60)] + [("short", 2.0, i) for i in range(20)] + [("gaps", None if i % 3 else float(i), i) for i in range(120)]
    rows += [("untested", 1.0, i) for i in range(40)]
    df = spark.createDataFrame([(s, "p", first + dt.timedelta(days=i), v, i % 60 >= 50 or (s == "short" and i > 15)) for s, v, i in rows],
                               "store string, product string, date date, demand double, is_test boolean")
    got = lm.trend_break_forecast(df).collect()
    assert all(r.prediction is not None and r.prediction >= 0 for r in got)
    assert {r.status for r in got if r.store == "short"} == {"mean"} and all(abs(r.prediction - 5) < 0.01 for r in got if r.store == "flat")
