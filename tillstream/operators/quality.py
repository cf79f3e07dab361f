"""Input checks and drift of served predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.operators.common import DATE, max_date

ROW_FLOOR = 1000
DAY_FLOOR = 14
DRIFT_LIMIT = 2.0
MIN_RECENT = 10


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """A schema check: it reads no rows."""
    return [c for c in required if c not in df.columns]


def column_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(c, int(c in df.columns)) for c in required], "column_name string, present int")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls per present column, in one pass."""
    present = [c for c in cols if c in df.columns]
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_null")).alias(f"_{i}")
                   for i, c in enumerate(present)])
    return one.select(F.inline(F.array(*[f"_{i}" for i in range(len(present))])))


def floors(df: DataFrame, target: str = "sold") -> DataFrame:
    return df.agg(F.count_if(F.col(target) < 0).alias("n_negative"), F.count("*").alias("n_rows"),
                  F.countDistinct(DATE).alias("n_days"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; counted by grouping, so null keys count as well."""
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.sum(F.col("_n") - 1).alias("n_duplicates"),
                   F.count_if(F.col("_n") > 1).alias("n_repeated_keys"))


def issue_table(df: DataFrame, required: Sequence[str], keys: Sequence[str], target: str = "sold") -> DataFrame:
    """One row per broken rule: rule, severity, value.

    Absent columns are reported and skipped by the other rules, which share one scan."""
    absent = missing_columns(df, required)
    present = [c for c in required if c in df.columns]
    rules: list[tuple[str, str, Column, Column]] = [
        (f"null:{c}", "warning", F.count_if(F.col(c).isNull()), F.lit(0)) for c in present]
    one = df.agg(
        *[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), v.cast("double").alias("value"),
                   (v > bad).alias("broken")).alias(f"_{i}") for i, (r, s, v, bad) in enumerate(rules)],
        *([F.struct(F.lit("negative_target").alias("rule"), F.lit("error").alias("severity"),
                    F.count_if(F.col(target) < 0).cast("double").alias("value"),
                    (F.count_if(F.col(target) < 0) > 0).alias("broken")).alias("_neg")] if target in df.columns else []),
        F.struct(F.lit("row_floor").alias("rule"), F.lit("error").alias("severity"),
                 F.count("*").cast("double").alias("value"), (F.count("*") < ROW_FLOOR).alias("broken")).alias("_rows"),
        *([F.struct(F.lit("day_floor").alias("rule"), F.lit("error").alias("severity"),
                    F.countDistinct(DATE).cast("double").alias("value"),
                    (F.countDistinct(DATE) < DAY_FLOOR).alias("broken")).alias("_days")] if DATE in df.columns else []))
    checks = one.select(F.inline(F.array(*one.columns)))
    if not [k for k in keys if k not in df.columns]:
        dup = duplicate_keys(df, keys).select(
            F.lit("duplicate_keys").alias("rule"), F.lit("error").alias("severity"),
            F.col("n_duplicates").cast("double").alias("value"), (F.col("n_duplicates") > 0).alias("broken"))
        checks = checks.unionByName(dup)
    out = checks.filter("broken").drop("broken")
    if absent:
        gone = df.sparkSession.createDataFrame(
            [(f"missing:{c}", "error", 1.0) for c in absent], "rule string, severity string, value double")
        out = out.unionByName(gone)
    return out


def prediction_drift(log: DataFrame, history: DataFrame, target: str = "sold", days: int = 7,
                     ts: str = "timestamp") -> DataFrame:
    """Distance of recent predictions from the historical mean, in historical std units.

    Empty below ten recent rows. Both sides are one-row aggregates."""
    last = max_date(log, ts)
    recent = log.filter(F.col(ts) >= last - F.expr(f"interval {days} days"))
    hist = history.agg(F.struct(F.avg(target).alias("m"), F.stddev_samp(target).alias("s"))).scalar()
    one = recent.agg(F.count("*").alias("n_recent"), F.avg("prediction").alias("recent_mean"),
                     F.stddev_samp("prediction").alias("recent_std")).withColumn("_h", hist)
    out = one.select("*", F.col("_h.m").alias("hist_mean"), F.col("_h.s").alias("hist_std")).drop("_h")
    return (out.filter(F.col("n_recent") >= MIN_RECENT)
               .withColumn("drift_ratio", F.abs(F.col("recent_mean") - F.col("hist_mean")) / (F.col("hist_std") + 1e-8))
               .withColumn("is_drift", (F.col("drift_ratio") > DRIFT_LIMIT).cast("int")))
