"""Choosing a model per SKU: hand-written rules, oracle, confidence gate, learned router."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.maths import arg_max, pick_by_name, round_half_up
from tillstream.operators.common import PAIR
from tillstream.operators.quantiles import exact_quantiles
from tillstream.session import cut_lineage

# Descriptors the learned router is trained on.
ROUTER_FEATURES = ("n_days", "mean_demand", "median_demand", "std_demand", "share_zero", "share_censored",
                   "lost_mean", "demand_trend_mean", "cv_7d_mean", "cv_demand")

# The candidate model that plays each role in the rules.
ROLES = {"simple": "two_week_avg", "censoring": "censoring", "assortment": "assortment",
         "cluster": "clustered", "local": "local"}

# The three rule sets, (role, condition) in order; the first that holds wins.
RULES = {
    "rule_v0": [
        ("simple", "cv_demand > 1.0"),
        ("simple", "mean_demand < 5"),
        ("censoring", "share_censored > 0.5"),
        ("cluster", "cv_demand < 0.6 and mean_demand > 10"),
        ("assortment", "share_censored > 0.35"),
        ("local", "mean_demand > 8 and cv_demand < 0.8"),
    ],
    "rule_v1": [
        ("simple", "cv_demand > 1.25 and mean_demand < 8"),
        ("simple", "mean_demand < 4 and cv_demand > 0.8"),
        ("censoring", "share_censored > 0.65 and mean_demand < 15"),
        ("assortment", "share_censored > 0.45 and mean_demand < 12"),
        ("cluster", "cv_demand < 0.7 and mean_demand > 8"),
        ("cluster", "mean_demand > 12 and cv_demand < 0.85"),
        ("local", "mean_demand > 6 and cv_demand < 1.0"),
    ],
    "rule_v2": [
        ("simple", "n_days < 14"),
        ("simple", "cv_demand > 1.35 and mean_demand < 6"),
        ("simple", "difficulty >= 3.0 and mean_demand < 8"),
        ("censoring", "share_censored > 0.7 and mean_demand < 18"),
        ("assortment", "share_censored > 0.5 and mean_demand < 12"),
        ("cluster", "mean_demand > 14 and cv_demand < 0.75 and share_censored < 0.6"),
        ("cluster", "mean_demand > 8 and cv_demand < 0.9 and share_censored < 0.55"),
        ("local", "mean_demand > 6 and cv_demand < 0.8 and n_days > 90"),
    ],
}
DEFAULT_ROLE = "cluster"

# Points added up into the difficulty of a pair; of the conditions on one
# descriptor only the first that holds counts.
DIFFICULTY = {
    "mean_demand": [("mean_demand < 4", 1.2), ("mean_demand < 8", 0.6)],
    "cv_demand": [("cv_demand > 1.2", 1.2), ("cv_demand > 0.9", 0.7)],
    "share_censored": [("share_censored > 0.7", 1.1), ("share_censored > 0.5", 0.6)],
    "n_days": [("n_days < 30", 1.0), ("n_days < 60", 0.4)],
    "demand_trend_mean": [("demand_trend_mean < 0.85 or demand_trend_mean > 1.15", 0.25)],
    "cv_7d_mean": [("cv_7d_mean > 0.45", 0.2)],
}

_c = F.col


def _first(table: Sequence[tuple[str, object]], default: object) -> Column:
    out = F
    for value, cond in table:
        out = out.when(F.expr(cond), F.lit(value))
    return out.otherwise(F.lit(default))


def difficulty() -> Column:
    """How hard a pair is to forecast: the points of all descriptors added up."""
    parts = [_first([(points, cond) for cond, points in steps], 0.0) for steps in DIFFICULTY.values()]
    return sum(parts[1:], parts[0])


def _choose(name: str, roles: dict[str, str]) -> Column:
    return _first([(roles[role], cond) for role, cond in RULES[name]], roles[DEFAULT_ROLE])


def add_rules(skus: DataFrame, roles: dict[str, str] = ROLES) -> DataFrame:
    """Difficulty, the choice of every rule set, and the single-model baseline.

    An unknown descriptor (null or NaN) fails every condition on it, so it adds no difficulty and
    fires no rule. A trend of 0 counts as 1 in the difficulty; the descriptors stay as they came.
    """
    raw = skus.withColumn("_given", F.struct(*DIFFICULTY)).withColumns(
        {c: F.nanvl(_c(c).cast("double"), F.lit(None)) for c in DIFFICULTY if dict(skus.dtypes)[c] in ("double", "float")})
    chosen = raw.withColumns({n: _choose(n, roles) for n in ("rule_v0", "rule_v1")}).withColumn(
        "demand_trend_mean", F.when(_c("demand_trend_mean") == 0, F.lit(1.0)).otherwise(_c("demand_trend_mean")))
    scored = chosen.withColumn("difficulty", difficulty())
    return (scored.withColumns({"rule_v2": _choose("rule_v2", roles), "single": F.lit(roles[DEFAULT_ROLE])})
                  .withColumns({c: F.col(f"_given.{c}") for c in DIFFICULTY}).drop("_given"))


def oracle_model(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Best model per SKU skipping missing scores; null where all are missing."""
    return wide.withColumn("oracle", arg_max({m: _c(f"{m}_r2") for m in models}))


def chosen_metrics(wide: DataFrame, choice: str, models: Sequence[str], prefix: str) -> DataFrame:
    """Metrics of the model named by the choice column."""
    return wide.withColumns({f"{prefix}_{v}": pick_by_name({m: _c(f"{m}_{v}") for m in models}, _c(choice))
                             for v in ("r2", "mae", "mse", "wmape")})


def scheme_summary(wide: DataFrame, schemes: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per routing scheme: means, median R2 and share of positive R2 over all SKUs.

    All schemes are scored in one pass over a long (scheme, metrics) table, written once as
    the means and the medians both read it.
    """
    metric = {v: {m: _c(f"{m}_{v}") for m in models} for v in ("r2", "mae", "mse", "wmape")}
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("scheme"), *[pick_by_name(metric[v], _c(s)).alias(v) for v in metric])
        for s in schemes])).alias("x")).select("x.*")
    rows = cut_lineage(rows)
    base = rows.groupBy("scheme").agg(
        *[F.avg(v).alias(f"avg_{v}") for v in metric], F.count("*").alias("n_rows"),
        F.avg(F.coalesce(F.col("r2") > 0, F.lit(False)).cast("int")).alias("positive_r2_share"))
    med = exact_quantiles(rows, ["scheme"], "r2", [0.5]).withColumnRenamed("q0", "median_r2")
    return base.join(med, "scheme", "left")


def win_counts(wide: DataFrame, choice: str) -> DataFrame:
    return wide.groupBy(_c(choice).alias("model")).agg(F.count("*").alias("win_count"))


# Confidence thresholds of the gate.
GATE_THRESHOLDS = tuple(round(0.3 + 0.05 * i, 2) for i in range(11))


def gate_sweep(scored: DataFrame, models: Sequence[str], fallbacks: Sequence[str],
               thresholds: Sequence[float] = GATE_THRESHOLDS) -> DataFrame:
    """Every (fallback, threshold) setting of the confidence gate, scored over all SKUs.

    `scored` has one row per SKU with `router_model`, `router_confidence` and the models'
    metrics. Each row yields one small row per setting, which the aggregation combines
    before its exchange.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("fallback"), F.lit(float(x)).alias("threshold"), F.lit(i).alias("position"))
                               for i, (f, x) in enumerate((f, x) for f in fallbacks for x in thresholds)]))
    rows = scored.withColumn("_g", grid).select("*", "_g.*")
    passed = F.coalesce(_c("router_confidence") >= _c("threshold"), F.lit(False))
    model = F.when(passed, _c("router_model")).otherwise(_c("fallback"))
    picked = rows.withColumn("_m", model).withColumn("_ok", passed.cast("int"))
    value = {v: pick_by_name({m: _c(f"{m}_{v}") for m in models}, _c("_m")) for v in ("r2", "mae", "mse", "wmape")}
    return picked.groupBy("fallback", "threshold", "position").agg(
        F.count("*").alias("n_rows"), F.avg("_ok").alias("gate_coverage"),
        *[F.avg(x).alias(f"avg_{v}") for v, x in value.items()],
        F.avg(F.coalesce(value["r2"] > 0, F.lit(False)).cast("int")).alias("positive_r2_share"))


def best_gate(sweep: DataFrame) -> DataFrame:
    """Setting with the lowest rounded (wmape, -r2, mae); the first listed wins a tie."""
    key = F.struct(round_half_up(_c("avg_wmape"), 2).alias("a"), (-round_half_up(_c("avg_r2"), 4)).alias("b"),
                   round_half_up(_c("avg_mae"), 4).alias("c"), F.col("position").alias("d"))
    row = F.struct(*sweep.columns)
    return sweep.agg(F.min_by(row, key).alias("_r")).select("_r.*")


def learned_router(skus: DataFrame, features: Sequence[str] = ROUTER_FEATURES, label: str = "oracle",
                   folds: int = 5, keys: Sequence[str] = PAIR) -> DataFrame:
    """Out-of-fold class, confidence and margin of a class-balanced logistic model.

    A row's fold is its rank within its class modulo the fold count, so every fold holds
    every class. The number of folds is bounded by the smallest class; with fewer than
    two rows in it the model is scored in sample, which `status` says. Without labelled rows the
    result is empty.
    """
    known = skus.filter(F.col(label).isNotNull() & F.coalesce(*[F.col(c) for c in features]).isNotNull())
    order = F.xxhash64(*keys)
    # The rank only spreads rows over folds, so it is taken within 64 hash slots per class.
    slot = F.pmod(order, F.lit(64))
    spread = Window.partitionBy(label, slot).orderBy(order, *keys)
    rows = cut_lineage(known.select(
        *keys, label, *[F.col(c).cast("double").alias(c) for c in features],
        F.pmod(F.row_number().over(spread) + slot, F.lit(folds)).alias("fold")))
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one per model
    if not sizes:
        return rows.select(*keys, label, "fold", F.lit(None).cast("string").alias("router_model"),
                           F.lit(None).cast("double").alias("router_confidence"), F.lit(None).cast("double").alias("router_margin"),
                           F.lit("empty").alias("status"))
    n_folds = max(1, min(folds, min(sizes.values())))
    total, n_class = sum(sizes.values()), len(sizes)
    weight = F.try_element_at(F.create_map(*[x for k, n in sizes.items()
                                             for x in (F.lit(k), F.lit(total / (n_class * n)))]), F.col(label))
    weighted = rows.withColumn("weight", weight).withColumn("fold", F.pmod("fold", F.lit(n_folds)))
    indexed = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    names = indexed.labelsArray[0]
    filled = [f"{c}_f" for c in features]
    steps = Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol="label", weightCol="weight", maxIter=50, regParam=1e-3)])
    data, parts = indexed.transform(weighted), []
    for k in range(n_folds):
        train = data.filter(F.col("fold") != k) if n_folds > 1 else data
        valid = data.filter(F.col("fold") == k)
        parts.append(steps.fit(train).transform(valid).select(*keys, label, "fold", "probability", "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = F.sort_array(vector_to_array("probability"), asc=False)
    second = F.when(F.size(ranked) > 1, F.element_at(ranked, 2)).otherwise(0.0)
    return out.select(
        *keys, label, "fold",
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("prediction") + 1).cast("int")).alias("router_model"),
        F.element_at(ranked, 1).alias("router_confidence"),
        (F.element_at(ranked, 1) - second).alias("router_margin"),
        F.lit("out_of_fold" if n_folds > 1 else "in_sample").alias("status"))
