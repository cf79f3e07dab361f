"""Business what-if reports on a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.functions.maths import clip, round_half_up
from tillstream.operators.common import DATE
from tillstream.operators.ranking import nearest_row

PRICE = 100.0
COST_RATIO = 0.6


def buffer_sweep(preds: DataFrame, kind: str = "percent") -> DataFrame:
    """Stock, deficit and error if production were the forecast plus a buffer.

    `percent` tries +0..100 %, `pieces` +0..10. Each row yields its buffer levels inside
    the task and the levels are summed up there, so one row per level leaves a task.
    """
    top = 100 if kind == "percent" else 10
    rows = preds.select("fact", "prediction", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("buffer"))
    p, y = F.col("prediction"), F.col("fact")
    planned = round_half_up(p * (100 + F.col("buffer")) / 100 if kind == "percent" else p + F.col("buffer"))
    diff = planned - y
    over, under = F.greatest(diff, F.lit(0.0)), F.greatest(-diff, F.lit(0.0))
    return rows.groupBy("buffer").agg(
        F.avg(over).alias("mean_stock"), F.sum(over).alias("total_stock"),
        F.avg(under).alias("mean_deficit"), F.sum(under).alias("total_deficit"),
        *[(F.avg(cond.cast("int")) * 100).alias(n) for n, cond in
          (("pct_under", diff < 0), ("pct_over", diff > 0), ("pct_exact", diff == 0))],
        F.avg(F.abs(diff)).alias("mae"))


def parity_buffer(sweep: DataFrame, target_stock: Column) -> DataFrame:
    """The buffer whose mean stock comes closest to the target."""
    return nearest_row(sweep, "mean_stock", target_stock, "buffer")


def shortfall_report(preds: DataFrame) -> DataFrame:
    """Units short if production followed the forecast: a lower bound, split by whether
    demand is known (stock left) or may have been higher (sold out)."""
    short = F.greatest(F.col("fact") - round_half_up(F.col("prediction")), F.lit(0.0))
    group = F.when(F.col("stock") > 0, "known").otherwise("unknown")
    days = preds.agg(F.countDistinct(DATE)).scalar()
    per = preds.withColumn("_s", short).rollup(group.alias("demand_known")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_s") > 0).alias("n_short"), F.sum("_s").alias("units"),
        F.avg(F.when(F.col("_s") > 0, F.col("_s"))).alias("mean_short"))
    out = per.withColumn("n_days", days).withColumn("revenue", F.col("units") * PRICE)
    return out.withColumns({
        "demand_known": F.coalesce("demand_known", F.lit("all")), "units_per_day": F.col("units") / F.col("n_days"),
        "units_per_month": F.col("units") / F.col("n_days") * 30})


def _signal(preds: DataFrame) -> DataFrame:
    """Sold-out rows with the units by which the forecast exceeds what was sold."""
    units = F.greatest(round_half_up(F.col("prediction")) - F.col("fact"), F.lit(0.0))
    return preds.filter(F.col("stock") <= 0).withColumn("units", units)


def stockout_signal(preds: DataFrame, dims: tuple[str, ...] = ("category", DATE)) -> DataFrame:
    """Missed demand on sold-out rows overall, by the first and by both dimensions."""
    hit = F.col("units") > 0
    return _signal(preds).rollup(*dims).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_rows"), F.count_if(hit).alias("n_signal"),
        F.sum("units").alias("units"), (F.count_if(hit) * 100 / F.count("*")).alias("signal_pct"),
        (F.sum("units") / (F.count_if(hit) + 1e-8)).alias("mean_units"))


def stockout_products(preds: DataFrame, n: int = 10) -> DataFrame:
    """Products with the largest signal."""
    per = _signal(preds).filter(F.col("units") > 0).groupBy("product").agg(
        F.count("*").alias("n_signal"), F.sum("units").alias("units"), F.avg("units").alias("mean_units"))
    return per.orderBy(F.desc("units"), "product").limit(n)


def waste_saved(preds: DataFrame, dims: tuple[str, ...] = ()) -> DataFrame:
    """Real stock left against the forecast's, on rows whose demand is fully known."""
    known = preds.filter(F.col("stock") > 0).withColumn(
        "model_stock", clip(round_half_up(F.col("prediction")) - F.col("fact"), 0.0))
    grouped = known.groupBy(*dims).agg(
        F.count("*").alias("n_rows"), F.sum("stock").alias("real_waste"), F.sum("model_stock").alias("model_waste"))
    saved = F.col("real_waste") - F.col("model_waste")
    return grouped.withColumns({
        "saved": saved, "saved_pct": saved / (F.col("real_waste") + 1e-8) * 100,
        "saved_money": saved * PRICE * COST_RATIO})


def store_plan(preds: DataFrame) -> DataFrame:
    """All products of a store and day with forecast, fact and error, plus the day's total
    (product null)."""
    plan = round_half_up(F.col("prediction"))
    return (preds.withColumn("_plan", plan).rollup("store", DATE, "product").agg(
        F.grouping_id().alias("level"), F.sum("prediction").alias("forecast"), F.sum("_plan").alias("plan"),
        F.sum("fact").alias("fact"), F.sum(F.abs(F.col("_plan") - F.col("fact"))).alias("abs_error"),
        F.count("*").alias("n_rows")).filter(F.col("level") <= 1))


