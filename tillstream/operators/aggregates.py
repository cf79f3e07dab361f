"""Grouped summaries. Sums, counts and moments combine map-side, so a hot key costs
one partial row per task; distinct counts are split by value before they are counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.maths import clip, ratio, safe_corr
from tillstream.operators.common import DATE, PAIR, drop_null_keys
from tillstream.operators.quantiles import exact_quantiles
from tillstream.session import cut_lineage

HOURS = range(24)


def daily_sales(lines: DataFrame, keys: Sequence[str] = (DATE, "store", "category", "product")) -> DataFrame:
    return drop_null_keys(lines, keys).groupBy(*keys).agg(F.sum("qty").alias("sold"))


def hourly_sales(lines: DataFrame, ts: str = "check_ts") -> DataFrame:
    """Hourly mart: quantity plus the extra sums that price, stale and last-sale reports need,
    so that raw lines are scanned once."""
    keys = ["store", "product", DATE]
    return (drop_null_keys(lines, keys).groupBy(*keys, F.hour(ts).alias("hour"))
            .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"),
                 F.sum(F.when(F.col("freshness") == "yesterday", F.col("qty")).otherwise(0.0)).alias("stale_qty"),
                 F.count("*").alias("n_lines"), F.max(ts).alias("last_ts")))


def average_price(lines: DataFrame, keys: Sequence[str] = ("store", "product", DATE)) -> DataFrame:
    """Price weighted by quantity over positive sale quantities."""
    ok = lines.filter((F.col("qty") > 0) & F.col("price").isNotNull())
    return drop_null_keys(ok, keys).groupBy(*keys).agg((F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("avg_price"))


def last_sale(hourly: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return drop_null_keys(hourly, [*keys, DATE]).groupBy(*keys, DATE).agg(F.max("hour").alias("last_hour"))


def stale_share(lines: DataFrame, keys: Sequence[str] = ("store", "product", DATE)) -> DataFrame:
    stale = F.sum(F.when(F.col("freshness") == "yesterday", F.col("qty")).otherwise(0.0))
    return drop_null_keys(lines, keys).groupBy(*keys).agg(stale.alias("stale_qty"), F.sum("qty").alias("total_qty")).withColumn(
        "stale_ratio", F.col("stale_qty") / (F.col("total_qty") + 1e-8))


def store_totals(daily: DataFrame, values: Sequence[str], dims: Sequence[str] = ("city",)) -> DataFrame:
    """Store-day totals; `dims` are constant per store, so any value will do."""
    return drop_null_keys(daily, ["store", DATE]).groupBy("store", DATE).agg(
        *[F.sum(v).alias(v) for v in values], *[F.min(d).alias(d) for d in dims],
        F.countDistinct("product").alias("n_products"))


def check_totals(lines: DataFrame) -> DataFrame:
    return drop_null_keys(lines, ["check_id"]).groupBy("check_id").agg(F.count("*").alias("items"), F.sum("qty").alias("qty"),
                                         F.sum("amount").alias("total"))


def check_summary(checks: DataFrame) -> DataFrame:
    """Mean basket and its median; the median over all checks is found in bands."""
    median = exact_quantiles(checks, [], "total", [0.5]).select("q0").scalar()
    return checks.agg(F.count("*").alias("n_checks"), F.avg("total").alias("mean_total"),
                      F.avg("items").alias("mean_items"), F.avg("qty").alias("mean_qty")).withColumn(
        "median_total", median)


def period_kpis(lines: DataFrame, period: Column, name: str) -> DataFrame:
    return lines.groupBy(period.alias(name)).agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("revenue"),
        F.countDistinct("check_id").alias("checks"), F.count("*").alias("lines"),
        F.countDistinct("product").alias("products"), F.countDistinct(DATE).alias("days"),
    ).withColumn("avg_check", F.col("revenue") / F.col("checks"))


def weekday_index(per_day: DataFrame, value: str) -> DataFrame:
    """Weekday mean and std, and the mean as percent of the mean of weekday means (7 rows)."""
    per = per_day.groupBy(F.weekday(DATE).alias("dow")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n_days"))
    return per.withColumn("index_pct", F.col("mean") / F.avg("mean").over(Window.partitionBy()) * 100)


def hour_pattern(hourly: DataFrame) -> DataFrame:
    """Quantity per hour on an average workday and weekend day."""
    weekend = F.weekday(DATE) >= 5
    days = hourly.select(DATE).distinct().agg(
        F.struct(F.count_if(~weekend).alias("wd"), F.count_if(weekend).alias("we"))).scalar()
    per = hourly.groupBy("hour").agg(
        F.sum(F.when(~weekend, F.col("qty")).otherwise(0.0)).alias("_wd"),
        F.sum(F.when(weekend, F.col("qty")).otherwise(0.0)).alias("_we")).withColumn("_d", days)
    return per.select("hour", ratio(F.col("_wd"), F.col("_d.wd")).alias("workday_qty"),
                      ratio(F.col("_we"), F.col("_d.we")).alias("weekend_qty"))


def weekday_hour_matrix(hourly: DataFrame, hours: Sequence[int] = HOURS) -> DataFrame:
    """Average quantity by weekday (rows) and hour (columns h0..h23).

    Hours fold into conditional sums over one row per (weekday, hour)."""
    per = hourly.groupBy(F.weekday(DATE).alias("dow"), "hour").agg(F.sum("qty").alias("qty"))
    days = hourly.groupBy(F.weekday(DATE).alias("dow")).agg(F.countDistinct(DATE).alias("n_days"))
    wide = per.groupBy("dow").pivot("hour", list(hours)).agg(F.sum("qty"))
    return wide.join(days, "dow").select(
        "dow", "n_days", *[(F.coalesce(F.col(str(h)), F.lit(0.0)) / F.col("n_days")).alias(f"h{h}") for h in hours])


def freshness_by_hour(lines: DataFrame) -> DataFrame:
    per = lines.groupBy("hour").pivot("freshness", ["fresh", "yesterday"]).agg(F.sum("qty")).fillna(0.0)
    total = F.col("fresh") + F.col("yesterday")
    return per.withColumn("stale_pct", ratio(F.col("yesterday") * 100, total))


def top_stale(lines: DataFrame, n: int = 10) -> DataFrame:
    stale = F.sum(F.when(F.col("freshness") == "yesterday", F.col("qty")).otherwise(0.0))
    per = drop_null_keys(lines, ["product"]).groupBy("product").agg(stale.alias("stale_qty"), F.sum("qty").alias("total_qty"))
    return (per.withColumn("stale_pct", ratio(F.col("stale_qty") * 100, F.col("total_qty")))
               .filter(F.col("stale_qty") > 0).orderBy(F.desc("stale_qty"), "product").limit(n))


def seller_stats(lines: DataFrame) -> DataFrame:
    per = drop_null_keys(lines, ["seller"]).groupBy("seller").agg(
        F.count("*").alias("checks"), F.sum("qty").alias("qty"), F.sum("amount").alias("revenue"),
        F.countDistinct(DATE).alias("days"), F.avg("hour").alias("avg_hour"),
        F.min("hour").alias("min_hour"), F.max("hour").alias("max_hour"))
    return per.withColumn("rev_per_day", F.col("revenue") / F.col("days")).withColumn(
        "qty_per_day", F.col("qty") / F.col("days"))


def early_stop(hourly: DataFrame, keys: Sequence[str] = ("product",), stop_hour: int = 14,
               closing_hour: int = 19) -> DataFrame:
    """How often a product's last sale of the day is early."""
    per = drop_null_keys(hourly, [*keys, DATE]).groupBy(*keys, DATE).agg(F.max("hour").alias("last_hour"))
    early = F.sum((F.col("last_hour") <= stop_hour).cast("int"))
    return per.groupBy(*keys).agg(
        F.count("*").alias("total_days"), F.avg("last_hour").alias("mean_last_hour"),
        early.alias("early_stop_days"),
        F.avg(F.lit(closing_hour) - F.col("last_hour")).alias("mean_hours_before_close"),
    ).withColumn("early_stop_pct", F.col("early_stop_days") * 100 / F.col("total_days"))


def metric_rollup(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Overall, by first dimension, and by both; `level` is the grouping id."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *aggs)


def store_profile(daily: DataFrame, value: str = "sold") -> DataFrame:
    per = drop_null_keys(daily, ["store"]).groupBy("store").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.sum(value).alias("total"),
        F.countDistinct("product").alias("n_products"), F.countDistinct(DATE).alias("n_days"))
    medians = exact_quantiles(daily, ["store"], value, [0.5]).select("store", F.col("q0").alias("median"))
    return per.join(medians, "store").withColumn("cv", F.col("std") / (F.col("mean") + 1e-8))


ENCODINGS = ("store_mean", "product_mean", "product_cv", "category_mean", "pair_mean", "store_products")


def profile_encodings(train: DataFrame, rows: DataFrame, value: str = "sold") -> DataFrame:
    """Means learnt on `train`, attached to `rows`; unseen keys get the column's median.

    The encodings meet in a table of the rows' distinct (store, product, category), so the
    rows are joined once, and the medians over all rows are medians of that table weighted
    by its row counts.
    """
    store = train.groupBy("store").agg(F.avg(value).alias("store_mean"),
                                       F.countDistinct("product").alias("store_products"))
    product = train.groupBy("product").agg(
        F.avg(value).alias("product_mean"),
        (F.stddev_samp(value) / (F.avg(value) + 1e-8)).alias("product_cv"))
    category = train.groupBy("category").agg(F.avg(value).alias("category_mean"))
    pair = train.groupBy(*PAIR).agg(F.avg(value).alias("pair_mean"))
    keys = ["store", "product", "category"]
    seen = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = (seen.join(store, "store", "left").join(product, "product", "left")
                  .join(category, "category", "left").join(pair, list(PAIR), "left"))
    table = cut_lineage(joined.select(*keys, "_n", *[F.col(c).cast("double").alias(c) for c in ENCODINGS]))
    long = table.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ENCODINGS])).alias("e")).select("_n", "e.*")
    medians = exact_quantiles(long, ["name"], "v", [0.5], "_n")
    fill = medians.agg(F.map_from_entries(F.collect_list(F.struct("name", "q0")))).scalar()  # one entry a column
    return (rows.join(table.drop("_n"), keys, "left").withColumn("_m", fill)
                .withColumns({c: F.coalesce(c, F.try_element_at("_m", F.lit(c))) for c in ENCODINGS}).drop("_m"))


def sku_behaviour(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Per pair: history length, level, spread, share of zero and censored days.

    A pair holds one row per day, so its exact median is bounded by the calendar."""
    out = df.groupBy(*keys).agg(
        F.countDistinct(DATE).alias("n_days"), F.avg("demand").alias("mean_demand"),
        F.median("demand").alias("median_demand"), F.stddev_samp("demand").alias("std_demand"),
        F.avg((F.col("demand") == 0).cast("int")).alias("share_zero"),
        F.avg("is_censored").alias("share_censored"), F.avg("lost_qty").alias("lost_mean"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("demand_trend", "cv_7d") if c in df.columns])
    return out.withColumn("cv_demand", F.coalesce("std_demand", F.lit(0.0)) / (F.abs("mean_demand") + 1e-8))


CLUSTER_FEATURES = ("demand_mean", "cv", "trend", "dow_std", "n_days", "lost_mean", "censored_pct")


def cluster_features(train: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Seven descriptors per pair from the training rows only.

    One row per (pair, weekday) carries the sums; the pair totals come from those rows.
    """
    last_week = F.col(DATE) >= F.date_sub(train.agg(F.max(DATE)).scalar(), 7)
    per = train.groupBy(*keys, F.weekday(DATE).alias("_dow")).agg(F.sum("sold").alias("_s"))
    weekday_std = per.groupBy(*keys).agg(F.stddev_samp("_s").alias("dow_std"))
    base = train.groupBy(*keys).agg(
        F.avg("demand").alias("demand_mean"), F.stddev_samp("demand").alias("demand_std"),
        F.median("demand").alias("demand_median"), F.avg("sold").alias("sales_mean"),
        F.stddev_samp("sold").alias("sales_std"), F.count(DATE).alias("n_days"),
        F.avg("lost_qty").alias("lost_mean"), F.avg("is_censored").alias("censored_pct"),
        F.avg(F.when(last_week, F.col("demand"))).alias("_last"))
    joined = base.join(weekday_std, list(keys)).fillna(0.0, subset=["demand_std", "sales_std", "dow_std"])
    recent = F.coalesce("_last", "demand_mean") / (F.col("demand_mean") + 1e-8)
    return (joined.withColumn("cv", F.col("demand_std") / (F.col("demand_mean") + 1e-8))
                  .withColumn("trend", clip(recent, 0.5, 2.0)).drop("_last"))


def distribution(df: DataFrame, label: Column) -> DataFrame:
    """Rows per bucket and their share in percent; the share runs over the few bucket rows."""
    per = df.groupBy(label.alias("bucket")).agg(F.count("*").alias("n_rows"))
    return per.withColumn("share_pct", F.col("n_rows") * 100 / F.sum("n_rows").over(Window.partitionBy()))


def correlations(df: DataFrame, target: str, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Correlation of each column with the target, all in one pass; 0 where it is undefined."""
    src = df if where is None else df.filter(where)
    one = src.agg(*[F.struct(F.lit(c).alias("feature"),
                             F.coalesce(safe_corr(F.col(target), F.col(c)), F.lit(0.0)).alias("corr")).alias(f"_{i}")
                    for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, std, min and max per numeric column, in one pass."""
    parts = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("feature"), F.count(x).alias("n_values"), F.count_if(x.isNull()).alias("n_null"),
            (F.count_if(x.isNull()) * 100 / F.count("*")).alias("null_pct"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(f"_{i}"))
    return df.agg(*parts).select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n_rows")).orderBy(
        F.desc("n_rows"), "value").limit(n)


def assortment_lists(df: DataFrame) -> DataFrame:
    """Sorted product list per store; it is as long as the assortment, not as the history."""
    return (df.select("store", "product").distinct().groupBy("store")
              .agg(F.array_sort(F.collect_list("product")).alias("products")))


def pair_defaults(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = PAIR) -> DataFrame:
    """Median of each feature per pair, used where a request has no row."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in cols])


def hour_presence(hourly: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Days with a sale in each hour, and their share of the pair's sale days."""
    per = hourly.groupBy(*keys, "hour").agg(F.countDistinct(DATE).alias("n_days"))
    total = hourly.groupBy(*keys).agg(F.countDistinct(DATE).alias("all_days"))
    return per.join(total, list(keys)).withColumn("share", F.col("n_days") / F.col("all_days"))


