"""Saved pipelines: versions, the pointer, what is refused."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from tillstream.operators.model_store import ModelStore, schema_hash


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + i % 3) for i in range(30)], "a double, b double, label double")


def fitted(rows, reg=0.0):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="x"), LinearRegression(featuresCol="x", regParam=reg)]).fit(rows)


def test_round_trip_and_latest(spark, rows, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    first = store.save("m", fitted(rows), rows, ["a", "b"], {"mae": 0.25})
    second = store.save("m", fitted(rows, 5.0), rows, ["a", "b"])
    assert store.versions("m") == sorted([first, second]) and store.latest("m") == second
    model, saved = store.load("m", first, rows)
    assert saved.features == ("a", "b") and saved.metrics == {"mae": 0.25} and saved.schema_hash == schema_hash(rows, ["a", "b"])
    want = [r.prediction for r in fitted(rows).transform(rows).collect()]
    assert [r.prediction for r in model.transform(rows).collect()] == pytest.approx(want)
    store.use("m", first)
    assert store.latest("m") == first and store.load("m")[1].version == first
    assert not list((tmp_path / "models" / "m").glob(".latest-????????????????????????????????"))


def test_unknown_versions_and_schemas_fail_clearly(spark, rows, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    assert store.versions("m") == []
    with pytest.raises(FileNotFoundError, match="no version of model 'm'"):
        store.load("m")
    known = store.save("m", fitted(rows), rows, ["a", "b"])
    with pytest.raises(ValueError, match=f"known: {known}"):
        store.load("m", "yesterday")
    with pytest.raises(ValueError, match="known"):
        store.use("m", "yesterday")
    with pytest.raises(ValueError, match="lack the features b"):
        store.load("m", rows=rows.drop("b"))
    with pytest.raises(ValueError, match="other types"):
        store.load("m", rows=rows.selectExpr("cast(a AS int) AS a", "b"))
    assert store.load("m", rows=rows.selectExpr("b", "a", "label AS other"))[1].version == known


def test_unfinished_versions_are_not_seen(spark, rows, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    known = store.save("m", fitted(rows), rows, ["a", "b"])
    fitted(rows).write().save(str(tmp_path / "m" / "zzz" / "model"))  # no meta: the writer was lost
    assert store.versions("m") == [known] and store.latest("m") == known
    with pytest.raises(ValueError):
        store.use("m", "zzz")
