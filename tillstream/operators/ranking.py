"""Top-k, nearest row, unions and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.maths import round_half_up
from tillstream.operators.common import DATE, PAIR


def top_n(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """n largest totals; ties go to the smaller key. Each task keeps n rows only."""
    per = df.groupBy(key).agg(F.sum(value).alias(value))
    return per.orderBy(F.desc(value), key).limit(n)


def top_n_per_group(df: DataFrame, group: str, key: str, value: str, n: int) -> DataFrame:
    """The n largest totals per group; Spark filters ranks per task before the exchange."""
    per = df.groupBy(group, key).agg(F.sum(value).alias(value))
    w = Window.partitionBy(group).orderBy(F.desc(value), key)
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def extreme_predictions(preds: DataFrame, n: int, worst: bool, ties: Sequence[str]) -> DataFrame:
    """Smallest or largest errors; errors equal to six digits are ordered by `ties`."""
    err = round_half_up(F.abs(F.col("fact") - F.col("prediction")), 6)
    scored = preds.filter(F.col("prediction").isNotNull()).withColumn("abs_error", err)
    order = F.desc("abs_error") if worst else F.asc("abs_error")
    return scored.orderBy(order, *ties).limit(n)


def tail_rows(df: DataFrame, n: int, keys: Sequence[str] = PAIR, date: str = DATE) -> DataFrame:
    """Last n rows of every series."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sku_list(best: DataFrame, bucket: str | None = None) -> DataFrame:
    """SKUs of one score bucket (or all), best score first, unknown scores last."""
    rows = best if bucket is None else best.filter(F.col("r2_bucket") == bucket)
    return rows.orderBy("store", F.desc_nulls_last("best_r2"), "product")


def nearest_row(df: DataFrame, value: str, target: Column, tie: str) -> DataFrame:
    """The row whose value is closest to the target; the smaller `tie` wins."""
    gap = F.struct(F.abs(F.col(value) - target).alias("gap"), F.col(tie).alias("tie"))
    row = F.struct(*df.columns)
    return df.agg(F.min_by(row, gap).alias("_r")).select("_r.*")


def union_models(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack per-model tables by column name and label them."""
    out = None
    for name, df in tables.items():
        named = df.withColumn("model", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def common_dates(preds: DataFrame, n_models: int, date: str = DATE) -> DataFrame:
    """Dates for which every model has a prediction."""
    ok = preds.filter(F.col("prediction").isNotNull())
    return (ok.groupBy(date).agg(F.countDistinct("model").alias("_m"))
              .filter(F.col("_m") == n_models).select(date))


def column_difference(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c not in b.columns]


def distinct_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and removed copies, counted by grouping whole rows."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return per.agg(F.sum("_copies").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn(
        "n_removed", F.col("n_rows") - F.col("n_distinct"))
