"""Segment regressions and quantile fits on panels of known structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstream.operators import evaluate as ev, linear_models as lin
from tillstream.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def many(spark):
    """10,000 segments of 20 rows: label = a + b x + c z, its own a, b, c in every segment."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr("id", "id % 10000 AS segment", "pmod(xxhash64(id), 1000) / 100.0D AS x", "pmod(xxhash64(id, 1), 777) / 50.0D AS z")
    return rows.withColumn("label", F.col("segment") % 13 + (F.col("segment") % 7 - 3) * F.col("x") + (F.col("segment") % 5) * F.col("z"))


def jobs(spark, work):
    """Number of jobs that `work` starts."""
    sc, group = spark.sparkContext, f"group-{np.random.default_rng().integers(1 << 40)}"
    sc.setJobGroup(group, "")
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def test_ten_thousand_segments(spark, many):
    scale, models, overall = lin.segment_regression(many, "segment", ["x", "z"], ridge=0.0)
    rows = models.collect()
    assert len(rows) == 10_000 and all(r.n_rows == 20 for r in rows) and overall.first().n_rows == 200_000
    for r in rows[:500]:
        s = int(r.segment)
        b, c = r.beta[1] / scale.deviations[0], r.beta[2] / scale.deviations[1]
        assert (b, c) == (pytest.approx(s % 7 - 3, abs=1e-6), pytest.approx(s % 5, abs=1e-6))
        assert r.beta[0] - b * scale.means[0] - c * scale.means[1] == pytest.approx(s % 13, abs=1e-5)


def test_jobs_do_not_grow_with_segments(spark, many):
    def run(rows):
        return lambda: lin.segmented_forecast(rows, rows, "segment", ["x", "z"], 10).write.format("noop").mode("overwrite").save()
    few = many.filter("segment < 3")
    assert jobs(spark, run(many)) <= jobs(spark, run(few)) + 2


def test_every_row_comes_back_once(spark, many):
    train = many.filter("segment < 50")
    test = many.filter("segment < 60").withColumn("segment", F.when(F.col("segment") != 7, F.col("segment")))
    test = test.withColumn("x", F.when(F.col("id") % 3 > 0, F.col("x")))
    out = lin.segmented_forecast(train, test, "segment", ["x", "z"], 10)
    assert out.count() == test.count() and out.filter("prediction IS NULL OR prediction < 0").count() == 0
    assert out.filter("model_scope = 'global'").select("segment").distinct().count() == 11  # 50 to 59 and null


def test_odd_training_rows(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", float("nan"), 2.0), ("a", 3.0, 4.0), (None, 2.0, 2.0), ("b", None, 1.0)], "segment string, x double, label double")
    _, models, overall = lin.segment_regression(rows, "segment", ["x"])
    assert {r.segment: r.n_rows for r in models.collect()} == {"a": 2, "b": 1} and overall.first().n_rows == 4
    empty = lin.segmented_forecast(rows.limit(0), rows, "segment", ["x"])
    assert empty.count() == 5


@pytest.fixture(scope="module")
def spread(spark):
    """Label whose deviation grows with x, in two halves."""
    rng = np.random.default_rng(11)
    x, z = rng.uniform(1, 10, 12_000), rng.normal(0, 1, 12_000)
    y = 50 + 3 * x + 2 * z + x * rng.normal(0, 1, 12_000)
    rows = spark.createDataFrame([(float(a), float(b), float(c), int(i % 2), "all") for i, (a, b, c) in enumerate(zip(x, z, y))],
                                 "x double, z double, label double, half int, category string").repartition(4)
    return rows.filter("half = 0"), rows.filter("half = 1")


def test_quantiles_cover_and_never_cross(spread):
    train, test = spread
    model = lin.fit_quantiles(train, ["x", "z"])
    out = model.predict(test).withColumn("fact", F.col("label"))
    share = out.agg(*[F.avg((F.col("label") <= F.col(f"p{p}")).cast("int")).alias(f"p{p}") for p in (10, 25, 50, 75, 90)]).first()
    assert all(abs(share[f"p{p}"] - p / 100) < 0.03 for p in (10, 25, 50, 75, 90))
    assert out.filter("p10 > p25 OR p25 > p50 OR p50 > p75 OR p75 > p90").count() == 0
    # Against the quantiles of a straight line's residuals, which are as wide everywhere.
    scale, _, overall = lin.segment_regression(train, "category", ["x", "z"])
    beta = overall.first().beta
    line = lin.dot(scale.column(), F.array(*[F.lit(b) for b in beta]))
    q = exact_quantiles(train.select((F.col("label") - line).alias("r")), [], "r", list(lin.LEVELS)).first()
    plain = test.withColumns({f"p{round(p * 100)}": line + F.lit(q[f"q{i}"]) for i, p in enumerate(lin.LEVELS)}).withColumn("fact", F.col("label"))
    mine, other = ev.interval_report(out).first(), ev.interval_report(plain).first()
    assert mine.pinball_p10 < other.pinball_p10 and mine.pinball_p90 < other.pinball_p90
    # The deviation is x times a normal one: slopes of the outer levels differ by twice 1.2816.
    slope = [b[1] / model.scale.deviations[0] for b in model.betas]
    assert slope[4] - slope[0] == pytest.approx(2 * 1.2816, abs=0.25) and slope[2] == pytest.approx(3, abs=0.15)


def test_levels_equal_the_sample_quantiles_without_features(spark):
    values = [(float(v * v % 101),) for v in range(400)]
    rows = spark.createDataFrame(values, "label double").withColumn("constant", F.lit(1.0))
    model = lin.fit_quantiles(rows, ["constant"])
    got = model.predict(rows.limit(1)).first()
    want = np.quantile([v for v, in values], lin.LEVELS)
    assert [got[f"p{round(p * 100)}"] for p in lin.LEVELS] == pytest.approx(want, abs=2.0)
