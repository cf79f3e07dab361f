import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tillstream.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.2, 0.5, 0.9, 1.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-50, 50).map(lambda x: round(x, 2))), min_size=1, max_size=60))
def test_equals_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: [r[f"q{i}"] for i in range(len(PROBS))] for r in exact_quantiles(df, ["g"], "x", PROBS).collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g], PROBS), abs=1e-9)


def test_hot_group_and_ungrouped(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(10, 20000), np.full(10000, 3.0)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    row = exact_quantiles(df, [], "x", PROBS).first()
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(x, PROBS)))


def test_weights_stand_for_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "x double, n int")
    assert exact_quantiles(df, [], "x", [0.5], "n").first().q0 == np.median([1, 1, 1, 2, 10, 10, 10, 10])


def test_nulls_are_ignored(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, x double")
    assert [(r.g, r.q0) for r in exact_quantiles(df, ["g"], "x", [0.5]).collect()] == [("a", 1.0)]
