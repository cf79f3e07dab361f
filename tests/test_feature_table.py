"""The bucketed feature table and what reads it."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillstream.operators import features as ft, models as md
from tillstream.plans.features_q import feature_table
from tillstream.sources.testdata import Tables


@pytest.fixture(scope="module")
def table(spark):
    return feature_table(Tables(spark, SF))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_whole(table):
    train, test, features = ft.split(table)
    assert len(features) == len(set(features)) >= 58 and set(features) <= set(table.columns)
    assert train.count() + test.count() == table.count() > 0
    assert table.filter(" OR ".join(f"{c} IS NULL" for c in (*ft.GROUPS["sales"], *ft.GROUPS["demand"], *ft.GROUPS["encodings"]))).count() == 0
    assert table.groupBy("store", "product", "date").count().filter("count > 1").count() == 0


def test_no_exchange_between_table_and_fit(spark, table):
    train, test, features = ft.split(table)
    assert "Exchange" not in plan(train.select("label", *features))
    assert "Exchange" not in plan(train.groupBy("store", "product").agg(F.avg("label")))
    with_join = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_join}
    try:
        for k, v in with_join.items():
            spark.conf.set(k, v)
        level = ft.write_bucketed(train.groupBy("store", "product").agg(F.avg("label").alias("level")), "levels_of_pairs", order=())
        joined = feature_table(Tables(spark, SF)).join(level, ["store", "product"])
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_second_reader_builds_nothing(spark, table):
    files = sorted(table.inputFiles())
    assert sorted(feature_table(Tables(spark, SF)).inputFiles()) == files


def test_version_follows_the_files(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    first = ft.version_of(spark, [str(tmp_path / "a")])
    assert first == ft.version_of(spark, [str(tmp_path / "a")])
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert first != ft.version_of(spark, [str(tmp_path / "a")])


def test_history_only(table):
    """Lags and encodings come from earlier rows and training days."""
    rows = table.orderBy("store", "product", "date").limit(60).collect()
    for a, b in zip(rows, rows[1:]):
        if (a.store, a.product) == (b.store, b.product):
            assert b.sales_lag1 == a.sold and b.demand_lag1 == a.demand and b.is_censored_lag1 == a.is_censored
    train = table.filter("NOT is_test")
    want = {(r.store, r.product): r.m for r in train.groupBy("store", "product").agg(F.avg("demand").alias("m")).collect()}
    for r in rows:
        if (r.store, r.product) in want:
            assert r.pair_mean == pytest.approx(want[r.store, r.product])


def test_models_read_it(table):
    train, test, features = ft.split(table)
    out = md.fit_predict(md.gbt(features, trees=2), train, test)
    assert out.count() == test.count() and out.filter("prediction IS NULL OR prediction < 0").count() == 0
