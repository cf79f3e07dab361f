"""Corrections of the training target and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.functions.maths import bucket, clip, round_half_up
from tillstream.operators.common import DATE, PAIR
from tillstream.operators.quantiles import exact_quantiles


def stockout_targets(df: DataFrame) -> DataFrame:
    """Targets raised on stock-out days, and a flag for leaving such days out.

    Needs `sold`, `stock`, `sales_roll_mean7` and `stock_deficit`."""
    out, sold = F.col("stock") == 0, F.col("sold")
    return df.withColumns({
        "target_rolled": F.when(out, F.greatest(sold, F.coalesce("sales_roll_mean7", F.lit(0.0)))).otherwise(sold),
        "target_deficit": F.when(out, sold + 0.5 * F.coalesce("stock_deficit", F.lit(0.0))).otherwise(sold),
        "keep_uncensored": (~out).cast("int"),
    })


# Volume buckets of the correction table, upper bounds inclusive.
VOLUME_BUCKETS = [(2, "0-2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50")]


def volume_bucket(x: Column) -> Column:
    return bucket(x, VOLUME_BUCKETS, "51+", closed_right=True)


LOOKUP_KEYS = ("category", "volume", "out_of_stock")


def _with_lookup_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"volume": volume_bucket(F.col("sold")),
                           "out_of_stock": (F.col("stock") == 0).cast("int")})


def lost_lookup(df: DataFrame) -> DataFrame:
    """Mean and median loss per (category, volume bucket, stock-out flag)."""
    keyed = _with_lookup_keys(df)
    mean = keyed.groupBy(*LOOKUP_KEYS).agg(F.avg("lost_qty").alias("lost_mean"), F.count("*").alias("n_rows"))
    median = exact_quantiles(keyed, LOOKUP_KEYS, "lost_qty", [0.5]).withColumnRenamed("q0", "lost_median")
    return mean.join(median, list(LOOKUP_KEYS), "left")


def apply_lookup(df: DataFrame, lookup: DataFrame, use: str = "lost_mean", scale: float = 1.0,
                 censored_only: bool = False) -> DataFrame:
    """sold + scale x looked-up loss; the table has one row per bucket combination."""
    out = _with_lookup_keys(df).join(lookup.select(*LOOKUP_KEYS, F.col(use).alias("_loss")), list(LOOKUP_KEYS), "left")
    applies = F.col("_loss") > 0
    if censored_only:
        applies = applies & (F.col("out_of_stock") == 1)
    return out.withColumn("target", F.col("sold") + F.when(applies, F.col("_loss") * scale).otherwise(0.0)).withColumn(
        "is_adjusted", F.coalesce(applies, F.lit(False)).cast("int")).drop("_loss")


def category_bias(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test predictions plus the mean training residual of their category, at least 0."""
    bias = train.groupBy("category").agg(F.avg(F.col("fact") - F.col("prediction")).alias("bias"))
    return (test.join(bias, "category", "left")
                .withColumn("corrected", clip(F.col("prediction") + F.coalesce("bias", F.lit(0.0)), 0.0)))


def clip_targets(train: DataFrame, value: str = "sold") -> DataFrame:
    """Target clipped at the overall p95 and p99 and at its category's p95.

    The overall and category quantiles cover unbounded groups and are found in bands."""
    overall = exact_quantiles(train, [], value, [0.95, 0.99]).select(F.struct("q0", "q1")).scalar()
    per_cat = exact_quantiles(train, ["category"], value, [0.95]).withColumnRenamed("q0", "_c95")
    x = F.col(value)
    return (train.join(per_cat, "category", "left").withColumn("_q", overall)
                 .withColumns({"clip_p95": F.least(x, F.col("_q.q0")), "clip_p99": F.least(x, F.col("_q.q1")),
                               "clip_category_p95": F.least(x, F.coalesce("_c95", F.col("_q.q0")))})
                 .drop("_q", "_c95"))


def weekday_expectation(train: DataFrame, rows: DataFrame, value: str = "sold") -> DataFrame:
    """expected = pair mean x product's weekday ratio, learnt on the training rows only.

    The product's weekday means are sums over one small row per (product, weekday)."""
    dow = F.weekday(DATE)
    per = train.groupBy("product", dow.alias("_dow")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    overall = per.groupBy("product").agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    weekday = per.join(overall, "product").select(
        "product", "_dow", (F.col("_s") / F.col("_n") / F.nullif("_all", F.lit(0.0))).alias("dow_ratio"))
    pair = train.groupBy(*PAIR).agg(F.avg(value).alias("pair_mean"), F.stddev_samp(value).alias("pair_std"))
    out = (rows.withColumn("_dow", dow).join(weekday, ["product", "_dow"], "left")
               .join(pair, list(PAIR), "left").drop("_dow"))
    return out.withColumn("expected", F.col("pair_mean") * F.col("dow_ratio")).withColumn(
        "residual", F.col(value) - F.col("expected"))


def winsorise(expected: DataFrame, value: str = "sold", k: float = 2.0, replace: bool = False,
              categories: Sequence[str] | None = None) -> DataFrame:
    """Pull values further than k std from the expectation back to the bound, or replace
    them by the expectation. Holidays and the days around them are left alone."""
    spread = F.greatest(F.coalesce("pair_std", F.lit(1.0)), F.lit(1.0)) * k
    special = (F.col("is_holiday") == 1) | (F.col("is_pre_holiday") == 1) | (F.col("is_post_holiday") == 1)
    odd = ~special & (F.abs("residual") > spread)
    if categories is not None:
        odd = odd & F.col("category").isin(list(categories))
    odd = F.coalesce(odd, F.lit(False))
    x, exp = F.col(value), F.col("expected")
    upper, lower = exp + spread, F.greatest(exp - spread, F.lit(0.0))
    if replace:
        new = round_half_up(F.greatest(exp, F.lit(0.0)))
    else:
        new = F.when(x > upper, round_half_up(upper)).when(x < lower, round_half_up(lower)).otherwise(x)
    return expected.withColumns({"is_outlier": odd.cast("int"), "target": F.when(odd, new).otherwise(x)})


def smooth_weak(df: DataFrame, value: str = "sold", roll: str = "sales_roll_mean7", alpha: float = 0.7) -> DataFrame:
    """Weak SKUs' targets blended with their rolling mean."""
    x = F.col(value)
    mixed = alpha * x + (1 - alpha) * F.coalesce(F.col(roll), x)
    return df.withColumn("target", F.when(F.col("is_weak_sku") == 1, mixed).otherwise(x))


def sample_weights(train: DataFrame, value: str = "sold") -> DataFrame:
    """Weights with mean 1: product std, its inverse, weak SKUs at 0.25 and 0.5, demand size."""
    std = train.groupBy("product").agg(F.coalesce(F.stddev_samp(value), F.lit(1.0)).alias("product_std"))
    weak = F.coalesce(F.col("is_weak_sku"), F.lit(0)) == 1
    raw = train.join(std, "product").withColumns({
        "w_std": F.col("product_std"), "w_inverse_std": 1 / (F.col("product_std") + 0.1),
        "w_weak_025": F.when(weak, 0.25).otherwise(1.0), "w_weak_050": F.when(weak, 0.5).otherwise(1.0),
        "w_size": F.greatest(F.col(value), F.lit(1.0))})
    names = ["w_std", "w_inverse_std", "w_weak_025", "w_weak_050", "w_size"]
    means = raw.agg(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    return (raw.withColumn("_m", means)
               .withColumns({n: F.col(n) / F.col(f"_m.{n}") for n in names if n != "w_size"}).drop("_m"))


# Mean-demand bounds of the volume tiers and of the high-demand model.
TIER_BOUNDS = [(3, "low"), (15, "medium")]
HIGH_DEMAND = 10


def volume_tiers(train: DataFrame, rows: DataFrame, value: str = "demand") -> DataFrame:
    """Tier by the product's mean in training; unseen products count as 0."""
    mean = train.groupBy("product").agg(F.avg(value).alias("product_avg"))
    out = rows.join(mean, "product", "left").withColumn("product_avg", F.coalesce("product_avg", F.lit(0.0)))
    return out.withColumn("tier", bucket(F.col("product_avg"), TIER_BOUNDS, "high")).withColumn(
        "is_high_demand", (F.col("product_avg") >= HIGH_DEMAND).cast("int"))


# Demand classes of the two-stage model.
CLASS_BOUNDS = [(2, "low"), (11, "medium")]


def volume_class(x: Column) -> Column:
    """Up to 2 is low, below 11 medium (11 itself is high)."""
    return F.when(x <= CLASS_BOUNDS[0][0], CLASS_BOUNDS[0][1]).when(x < CLASS_BOUNDS[1][0], CLASS_BOUNDS[1][1]).when(x.isNotNull(), "high")
