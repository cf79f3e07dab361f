"""Keyed joins.

Nothing here is hinted: Catalyst broadcasts a side whose size estimate is below
`spark.sql.autoBroadcastJoinThreshold` (AQE re-checks it with measured sizes), and
sort-merges beyond it, where AQE splits hot partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.calendar import add_calendar
from tillstream.functions.maths import mean_ignoring_nulls
from tillstream.operators.common import DATE, PAIR
from tillstream.operators.series import value_days_ago


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str],
                salts: int = 32) -> DataFrame:
    """Inner join whose hot keys are spread by the columns `by` of the larger side.

    For joins that multiply rows (a store's days with a store's products) a hot key is hot in
    its output, which AQE cannot see from the input sizes. The smaller side is repeated once
    per salt inside its own tasks.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def with_last_hour(hourly: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Last sale hour of the day on every hourly row; a window instead of a self join."""
    return hourly.withColumn("last_hour", F.max("hour").over(Window.partitionBy(*keys, DATE)))


def matched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def unmatched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of `df` that `other` lacks."""
    return df.select(*keys).distinct().join(other.select(*keys), list(keys), "left_anti")


def lookup_profile(daily: DataFrame, profile: DataFrame, hour: str = "last_hour") -> DataFrame:
    """Cumulative share at the hour in which the day's sales stopped."""
    at = profile.select(*PAIR, F.col("hour").alias(hour), F.col("cum_share").alias("cum_at_stop"))
    return daily.join(at, [*PAIR, hour], "left")


def attach_filled(df: DataFrame, dim: DataFrame, keys: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Left join on a key that is unique in `dim`; missing numbers become `fill`.

    `is_matched` tells which rows found a partner.
    """
    values = [c for c in dim.columns if c not in keys]
    out = df.join(dim.withColumn("is_matched", F.lit(1)), list(keys), "left")
    return out.fillna(fill, subset=values).fillna(0, subset=["is_matched"])


def match_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.sum("is_matched").alias("n_matched"),
                  F.avg(F.col("is_matched").cast("double")).alias("match_rate"))


def attach_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar columns by date; columns the fact already has are replaced."""
    new = [c for c in calendar.columns if c != DATE]
    return df.drop(*new).join(calendar, DATE, "left")


def calendar_table(df: DataFrame) -> DataFrame:
    """One row per distinct date with all calendar columns."""
    return df.select(DATE).distinct().transform(add_calendar)


def attach_price(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Idempotent: price columns from an earlier call are dropped first."""
    keys = ["store", "product", DATE]
    new = [c for c in prices.columns if c not in keys]
    return df.drop(*new).join(prices, keys, "left")


def lag_mean(df: DataFrame, col: str, offsets: Sequence[int] = (7, 14), out: str = "lag_core",
             fallback: str | None = None) -> DataFrame:
    """Mean of the values exactly 7 and 14 days ago; optionally another column where both lack."""
    lags = {f"_ago{k}": value_days_ago(col, k) for k in offsets}
    base = df.withColumns(lags)
    value = mean_ignoring_nulls([F.col(c) for c in lags])
    if fallback:
        value = F.coalesce(value, F.col(fallback))
    return base.withColumn(out, value).drop(*lags)


def as_of(df: DataFrame, history: DataFrame, value: str, days_back: int, out: str,
          keys: Sequence[str] = PAIR) -> DataFrame:
    """Last `value` on or before date - days_back, per key.

    Both sides are stacked and read in time order, so the cost is one exchange and is
    linear in the rows; history comes first within a day.
    """
    names = df.columns
    left = (df.withColumn("_at", F.date_sub(DATE, days_back)).withColumn("_side", F.lit(1))
              .withColumn("_v", F.lit(None).cast("double")))
    right = history.select(*keys, F.col(DATE).alias("_at"), F.lit(0).alias("_side"),
                           F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return (both.withColumn(out, F.last("_v", ignorenulls=True).over(w))
                .filter(F.col("_side") == 1).select(*names, out))


def pivot_models(long: DataFrame, models: Sequence[str], values: Sequence[str],
                 keys: Sequence[str] = PAIR) -> DataFrame:
    """Long (key, model, metrics) -> one row per key with `<model>_<metric>` columns.

    Equals an outer merge of the models' tables, in one aggregation.
    """
    aggs = [F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{m}_{v}") for m in models for v in values]
    return long.groupBy(*keys).agg(*aggs)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails if a key occurs twice on either side (checked before the join)."""
    for side, df in (("left", left), ("right", right)):
        doubled = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
        if not doubled.isEmpty():
            raise ValueError(f"{side} side repeats a key of {list(keys)}")
    return left.join(right, list(keys), how)


def hour_grid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with hours 0..23, generated per key (no cross join)."""
    return df.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def complete_hours(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hour_grid(df, keys).join(df, [*keys, "hour"], "left")


def dense_calendar(df: DataFrame, value: str, keys: Sequence[str] = PAIR,
                   until: Column | None = None) -> DataFrame:
    """Every day between a series' first and last date (or `until`), 0 where nothing sold."""
    span = df.groupBy(*keys).agg(F.min(DATE).alias("_a"), F.max(DATE).alias("_b"))
    last = F.col("_b") if until is None else until
    days = span.select(*keys, F.explode(F.sequence("_a", last, F.expr("interval 1 day"))).alias(DATE))
    return days.join(df, [*keys, DATE], "left").fillna(0, subset=[value])


def predictions_wide(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """Predictions of many models next to the fact, one row per key and date."""
    return long.groupBy(*PAIR, DATE).agg(
        F.max("fact").alias("fact"),
        *[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"pred_{m}") for m in models])


def attach_cluster(df: DataFrame, clusters: DataFrame, col: str, keys: Sequence[str] = PAIR) -> DataFrame:
    out = df.join(clusters.select(*keys, col), list(keys), "left")
    return out.withColumn(col, F.coalesce(col, F.lit(-1)))
