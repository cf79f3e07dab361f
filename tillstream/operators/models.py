"""Global and segmented forecasting models on `pyspark.ml`.

High-cardinality keys enter as target encodings (means learnt on the training rows), so
no tree needs a bin per store or product and training stays distributed over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tillstream.functions.calendar import add_calendar
from tillstream.functions.maths import clip
from tillstream.operators.aggregates import ENCODINGS, profile_encodings
from tillstream.operators.common import DATE, PAIR, max_date
from tillstream.operators.filters import train_test
from tillstream.operators.linear_models import LEVELS, fit_quantiles
from tillstream.operators.quantiles import exact_quantiles
from tillstream.operators.series import add_series_features, feature_columns
from tillstream.operators.targets import volume_class
from tillstream.session import cut_lineage

CALENDAR = ("dow", "day", "is_weekend", "month", "week", "is_holiday", "is_pre_holiday", "is_post_holiday",
            "is_payday_week", "is_month_start", "is_month_end")
SEED = 42
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def training_frames(df: DataFrame, test_days: int, value: str = "demand",
                    lags: Sequence[int] = (1, 2, 3, 7, 14, 30)) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, feature names) without warm-up rows, each written once.

    Every fit reads the rows many times, so both frames are cut from their lineage.
    """
    windows = [n for n in (3, 7, 14, 30) if n <= max(lags)]
    rows = df.transform(add_series_features, value, value, lags, windows).transform(add_calendar)
    rows = rows.dropna(subset=feature_columns(rows, [value]))
    features = feature_columns(rows, [value]) + list(CALENDAR) + list(ENCODINGS)
    train, _ = train_test(rows, test_days)
    start = F.date_sub(max_date(rows), test_days - 1)
    full = cut_lineage(profile_encodings(train, rows, value)
                       .withColumn("is_test", F.col(DATE) >= start)
                       .withColumn("label", F.col(value).cast("double")))
    return full.filter(~F.col("is_test")), full.filter("is_test"), features


UNKNOWN = -1000.0  # stands for a missing feature, below what known ones reach


def _inputs(features: Sequence[str], out: str = "features") -> list[SQLTransformer | VectorAssembler]:
    """Stages that assemble the features, a missing one as `UNKNOWN`: no row is dropped."""
    known = ", ".join(f"coalesce(nanvl(cast(`{c}` as double), null), {UNKNOWN}D) as `_x{i}`" for i, c in enumerate(features))
    return [SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol=out)]


def _without_inputs(rows: DataFrame) -> DataFrame:
    """Drop what a fitted pipeline adds beside its prediction."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_x") and c[2:].isdigit()], "raw_prediction", "features", "_raw")


def gbt(features: Sequence[str], label: str = "label", loss: str = "squared", weight: str | None = None,
        trees: int = 20, depth: int = 5, step: float = 0.2) -> Pipeline:
    """Boosted trees; `absolute` loss aims at the median."""
    model = GBTRegressor(labelCol=label, lossType=loss, maxIter=trees, maxDepth=depth, stepSize=step,
                         seed=SEED, subsamplingRate=0.8, predictionCol="raw_prediction")
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[*_inputs(features), model])


def tweedie(features: Sequence[str], label: str = "label", power: float = 1.5) -> Pipeline:
    """Log-link Tweedie regression on standardised features."""
    return Pipeline(stages=[
        *_inputs(features, "_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=label,
                                    regParam=0.01, maxIter=25, predictionCol="raw_prediction")])


def predict(model: PipelineModel, rows: DataFrame, out: str = "prediction",
            inverse: Callable[[Column], Column] | None = None) -> DataFrame:
    """Predictions bounded below by 0."""
    raw = F.col("raw_prediction") if inverse is None else inverse(F.col("raw_prediction"))
    scored = model.transform(rows)
    return _without_inputs(scored.withColumn(out, clip(raw, 0.0)))


def fit_predict(pipe: Pipeline, train: DataFrame, test: DataFrame, out: str = "prediction") -> DataFrame:
    return predict(pipe.fit(train), test, out)


# ---- B03: intervals --------------------------------------------------------------

def residual_intervals(model_fit: Pipeline, train: DataFrame, test: DataFrame, group: str,
                       probs: Sequence[float] = (0.1, 0.25, 0.75, 0.9), calibration_days: int = 60) -> DataFrame:
    """Point forecast plus residual quantiles of its group.

    The residuals come from a calibration slice that the model has not seen."""
    fit_rows, calib = train_test(train, calibration_days)
    model = model_fit.fit(fit_rows)
    resid = predict(model, calib).select(group, (F.col("label") - F.col("prediction")).alias("residual"))
    q = exact_quantiles(resid, [group], "residual", probs)
    overall = exact_quantiles(resid, [], "residual", probs).select(
        F.struct(*[f"q{i}" for i in range(len(probs))])).scalar()
    out = predict(model, test, "p50").join(q, group, "left").withColumn("_o", overall)
    cols = {f"p{round(p * 100)}": clip(F.col("p50") + F.coalesce(F.col(f"q{i}"), F.col(f"_o.q{i}")), 0.0)
            for i, p in enumerate(probs)}
    return out.withColumns(cols).drop("_o", *[f"q{i}" for i in range(len(probs))])


def quantile_intervals(model_fit: Pipeline, train: DataFrame, test: DataFrame, features: Sequence[str],
                       levels: Sequence[float] = LEVELS, calibration_days: int = 365) -> DataFrame:
    """Quantiles of the label by a linear quantile regression on the features and a median model's forecast.

    The regression is fitted on a calibration slice that the model has not seen (the whole history, if that is no
    longer than twice the slice, is halved by date)."""
    span = train.agg(F.datediff(F.max(DATE), F.min(DATE))).first()[0] or 0
    fit_rows, calib = train_test(train, max(1, min(calibration_days, span // 2)))
    model = model_fit.fit(fit_rows)
    quantiles = fit_quantiles(predict(model, calib, "base"), (*features, "base"), levels)
    return quantiles.predict(predict(model, test, "base"))


# ---- B05: log target and second stage -------------------------------------------

def log_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 20) -> DataFrame:
    model = gbt(features, "log_label", trees=trees).fit(train.withColumn("log_label", F.log1p("label")))
    return predict(model, test, "prediction", F.expm1)


def log_residual_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 20) -> DataFrame:
    """Log-target model plus a second model of what it misses."""
    first = gbt(features, "log_label", trees=trees).fit(train.withColumn("log_label", F.log1p("label")))
    base_train = cut_lineage(predict(first, train, "base", F.expm1))
    second = gbt([*features, "base"], "residual", trees=trees).fit(
        base_train.withColumn("residual", F.col("label") - F.col("base")))
    base_test = predict(first, test, "base", F.expm1)
    return _without_inputs(second.transform(base_test).withColumn(
        "prediction", clip(F.col("base") + F.col("raw_prediction"), 0.0)))


# ---- B11: ensembles ---------------------------------------------------------------

def stacked_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], folds: int = 3,
                     temporal: bool = False, trees: int = 10) -> DataFrame:
    """Three base learners, out-of-fold predictions, linear combination.

    Folds are a column: a hash of the row key, or successive date blocks where each block
    is predicted from the blocks before it. Fold predictions are written once.
    """
    bases = {"squared": gbt(features, trees=trees), "absolute": gbt(features, loss="absolute", trees=trees),
             "tweedie": tweedie(features)}
    if temporal:
        span = train.agg(F.struct(F.min(DATE).alias("a"), F.max(DATE).alias("b"))).scalar()
        rows = train.withColumn("_s", span)
        pos = F.datediff(DATE, F.col("_s.a")) / (F.datediff(F.col("_s.b"), F.col("_s.a")) + 1)
        rows = rows.withColumn("fold", F.floor(pos * (folds + 1)).cast("int")).drop("_s")
    else:
        rows = train.withColumn("fold", F.pmod(F.xxhash64(*PAIR, DATE), F.lit(folds)).cast("int"))
    rows = cut_lineage(rows)
    parts = []
    for k in range(1, folds + 1) if temporal else range(folds):
        seen = rows.filter(F.col("fold") < k) if temporal else rows.filter(F.col("fold") != k)
        out = rows.filter(F.col("fold") == k)
        for name, pipe in bases.items():
            out = fit_predict(pipe, seen, out, name)
        parts.append(out.select("label", *bases))
    meta_rows = cut_lineage(reduce(DataFrame.unionByName, parts))
    meta = Pipeline(stages=[VectorAssembler(inputCols=list(bases), outputCol="features", handleInvalid="error"),
                            LinearRegression(labelCol="label", predictionCol="raw_prediction", regParam=0.01)])
    fitted = meta.fit(meta_rows)
    scored = test
    for name, pipe in bases.items():
        scored = fit_predict(pipe, rows, scored, name)
    return predict(fitted, scored)


def window_ensemble(train: DataFrame, test: DataFrame, features: Sequence[str],
                    windows: Sequence[int | None] = (30, 90, None), trees: int = 10) -> DataFrame:
    """Mean of models fitted on the last 30 days, the last 90 days and all days."""
    last, out, names = max_date(train), test, []
    for n in windows:
        part = train if n is None else train.filter(F.col(DATE) > F.date_sub(last, n))
        names.append(f"window_{n or 'all'}")
        out = fit_predict(gbt(features, trees=trees), part, out, names[-1])
    return out.withColumn("prediction", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names))


def residual_chain(train: DataFrame, test: DataFrame, stages: Sequence[Sequence[str]], trees: int = 10) -> DataFrame:
    """Each stage models what the stages before it leave, with its own features."""
    tr, te = train.withColumn("_sum", F.lit(0.0)), test.withColumn("_sum", F.lit(0.0))
    for features in stages:
        model = gbt(features, "_left", trees=trees).fit(tr.withColumn("_left", F.col("label") - F.col("_sum")))

        def add(rows: DataFrame) -> DataFrame:
            return _without_inputs(model.transform(rows).withColumn("_sum", F.col("_sum") + F.col("raw_prediction")))
        tr, te = cut_lineage(add(tr)), add(te)
    return te.withColumn("prediction", clip(F.col("_sum"), 0.0)).drop("_sum")


# ---- B12: class first, then a model per class -----------------------------------

def two_stage_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 20,
                       min_rows: int = 1) -> DataFrame:
    """Volume class by random forest, then a regression per class.

    `prediction_hard` follows the likeliest class; `prediction_soft` weights the class
    models by probability. A class with fewer than `min_rows` training rows (none by default) uses the
    model of all rows."""
    classes = ("low", "medium", "high")
    labelled = cut_lineage(train.withColumn("volume_class", volume_class(F.col("label"))))
    index = StringIndexer(inputCol="volume_class", outputCol="class_index", stringOrderType="alphabetAsc").fit(labelled)
    names = index.labelsArray[0]
    forest = Pipeline(stages=[*_inputs(features), RandomForestClassifier(
        labelCol="class_index", numTrees=20, maxDepth=6, seed=SEED, probabilityCol="class_probability",
        rawPredictionCol="class_raw", predictionCol="class_prediction")]).fit(index.transform(labelled))
    out = _without_inputs(forest.transform(test).withColumn("_p", vector_to_array("class_probability"))).drop(
        "class_raw", "class_probability")
    sizes = {r[0]: r[1] for r in labelled.groupBy("volume_class").count().collect()}  # three rows
    fallback = gbt(features, trees=trees).fit(labelled)
    for c in classes:
        rows = labelled.filter(F.col("volume_class") == c)
        model = gbt(features, trees=trees).fit(rows) if sizes.get(c, 0) >= min_rows else fallback
        out = predict(model, out, f"pred_{c}")
    chosen, soft = F, F.lit(0.0)
    for i, c in enumerate(names):
        chosen = chosen.when(F.col("class_prediction") == i, F.col(f"pred_{c}"))
        soft = soft + F.element_at("_p", i + 1) * F.col(f"pred_{c}")
    label_of = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("class_prediction") + 1).cast("int"))
    return out.withColumns({"prediction_hard": chosen, "prediction_soft": soft, "predicted_class": label_of}).drop("_p")


# ---- B15-B17: search, importance, learning curve ---------------------------------

def rolling_origins(train: DataFrame, folds: int, fold_days: int) -> list[tuple[DataFrame, DataFrame]]:
    """(seen, judged) per fold, latest first: `fold_days` days and all rows before them. No row is judged by one of its future."""
    last, out = max_date(train), []
    for k in range(folds):
        start, end = F.date_sub(last, (k + 1) * fold_days - 1), F.date_sub(last, k * fold_days)
        out.append((train.filter(F.col(DATE) < start), train.filter((F.col(DATE) >= start) & (F.col(DATE) <= end))))
    return out


SEARCH = "rung int, depth int, step double, n_folds int, history_days int, trees int, mae double, is_kept int"


def search(train: DataFrame, features: Sequence[str], depths: Sequence[int] = (3, 5), steps: Sequence[float] = (0.1, 0.3), trees: int = 20,
           folds: int = 3, fold_days: int = 30, history_days: int = 180, parallelism: int = 4) -> tuple[DataFrame, PipelineModel | None]:
    """(every trial, the winner fitted on all rows): successive halving over folds by date.

    The first rung tries all settings on one fold, a short history and few trees; each further rung doubles these and takes
    the better half of the settings, until one is left. Ties go to the smaller depth, then the smaller step. A
    fold without rows on either side is left out; without any fold there is no winner.
    """
    cuts = [(seen, judged) for seen, judged in rolling_origins(train, folds, fold_days) if not seen.isEmpty() and not judged.isEmpty()]
    alive = sorted((d, float(s)) for d in set(depths) for s in set(steps)) if cuts else []
    rungs = max(1, (len(alive) - 1).bit_length())
    trials: list[tuple] = []

    def mae(setting: tuple[int, float], rung: int) -> tuple[float, tuple[int, float], int, int, int]:
        left = rungs - 1 - rung
        n_folds, n_trees, days = max(1, len(cuts) >> left), max(1, trees >> left), max(1, history_days >> left)
        parts = []
        for seen, judged in cuts[:n_folds]:
            recent = seen.filter(F.col(DATE) > F.date_sub(max_date(seen), days))
            scored = fit_predict(gbt(features, trees=n_trees, depth=setting[0], step=setting[1]), recent, judged)
            parts.append(scored.select(F.abs(F.col("label") - F.col("prediction")).alias("e")))
        return reduce(DataFrame.unionByName, parts).agg(F.avg("e")).first()[0], setting, n_folds, days, n_trees

    for rung in range(rungs if alive else 0):
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            found = sorted(pool.map(lambda s: mae(s, rung), alive))
        alive = [f[1] for f in found[:-(-len(found) // 2)]] if rung < rungs - 1 else [found[0][1]]
        trials += [(rung, s[0], s[1], n, days, t, float(e), int(s in alive)) for e, s, n, days, t in found]
    table = train.sparkSession.createDataFrame(trials, SEARCH)
    winner = gbt(features, trees=trees, depth=alive[0][0], step=alive[0][1]).fit(train) if alive else None
    return table, winner


def feature_importance(model: PipelineModel, features: Sequence[str], train: DataFrame) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    out = train.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature")


def learning_curve(train: DataFrame, test: DataFrame, features: Sequence[str],
                   histories: Sequence[int] = (90, 180, 365, 730), trees: int = 20) -> DataFrame:
    """MAE by length of the training history, with the power-law fit log(mae) ~ log(days).

    The few curve points are fitted with `regr_slope`."""
    last, parts = max_date(train), []
    for n in histories:
        rows = train.filter(F.col(DATE) > F.date_sub(last, n))
        scored = fit_predict(gbt(features, loss="absolute", trees=trees), rows, test)
        parts.append(scored.agg(F.lit(n).alias("history_days"), F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae")))
    points = cut_lineage(reduce(DataFrame.unionByName, parts))
    fit = points.agg(F.struct(F.regr_slope(F.log("mae"), F.log("history_days")).alias("b"),
                              F.regr_intercept(F.log("mae"), F.log("history_days")).alias("a"))).scalar()
    return (points.withColumn("_f", fit).withColumns({
        "exponent": F.col("_f.b"), "fitted_mae": F.exp(F.col("_f.a") + F.col("_f.b") * F.log("history_days"))}).drop("_f"))


# ---- B19: feature rows for days that have not happened ---------------------------

def future_rows(daily: DataFrame, value: str, weather: DataFrame, days: int = 14,
                lags: Sequence[int] = (1, 2, 3, 7, 14, 30)) -> DataFrame:
    """One row per pair and future day with calendar, date-keyed lags and weather.

    Future days are stacked under the history and read it through one-day range frames, so
    a lag that reaches into the future is null and nothing is joined to itself.
    """
    from tillstream.operators.series import value_days_ago
    last = max_date(daily)
    pairs = daily.groupBy(*PAIR).agg(F.max("category").alias("category"), F.max("city").alias("city"),
                                     F.max(DATE).alias("last_sale"))
    ahead = (pairs.withColumn("_last", last)
                  .withColumn(DATE, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days),
                                                         F.expr("interval 1 day"))))
                  .drop("_last").withColumn(value, F.lit(None).cast("double")).withColumn("_future", F.lit(True)))
    recent = daily.filter(F.col(DATE) > F.date_sub(last, max(lags))).select(*PAIR, DATE, value).withColumn("_future", F.lit(False))
    both = ahead.unionByName(recent, allowMissingColumns=True)
    lagged = both.withColumns({f"{value}_lag{k}": value_days_ago(value, k) for k in lags})
    rows = lagged.filter("_future").drop("_future", value).transform(add_calendar)
    return rows.join(weather, ["city", DATE], "left")
