"""The wide feature table of the forecasting models, written bucketed by pair.

One row per (store, product, date) with everything that is known before the day, or planned for it: lags and
rolling values of sales and demand, weekday means, censoring, trend, breadth of the assortment, stale share, stock, price,
weather, calendar, and encodings learnt on the training days. Rows without a whole history of 30 rows are left out.

`write_bucketed` keeps it as a table bucketed and sorted by pair: what reads it later by pair (windows, sums per
pair, joins with another such table) plans no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillstream.functions.calendar import add_calendar
from tillstream.functions.weather import add_weather_category, add_weather_flags
from tillstream.operators import series
from tillstream.operators.aggregates import ENCODINGS, profile_encodings
from tillstream.operators.common import DATE, PAIR, max_date
from tillstream.operators.filters import train_test
from tillstream.operators.joins import attach_filled, attach_price
from tillstream.session import cut_lineage, ensure_checkpoint_dir

GROUPS: dict[str, tuple[str, ...]] = {
    "sales": (*[f"sales_lag{k}" for k in series.LAGS], *[f"sales_roll_mean{k}" for k in series.WINDOWS], "sales_roll_std7"),
    "demand": (*[f"demand_lag{k}" for k in series.LAGS], *[f"demand_roll_mean{k}" for k in series.WINDOWS], "demand_roll_std7"),
    "weekday": ("sales_dow_mean", "demand_dow_mean"),
    "censoring": ("is_censored_lag1", "lost_qty_lag1", "pct_censored_7d"),
    "trend": ("demand_trend", "cv_7d"),
    "breadth": ("items_in_store_today", "items_in_store_lag1", "items_change", "items_in_category_today", "category_items_change"),
    "stale": ("stale_ratio_lag1",),
    "stock": ("stock_lag1", "stock_to_sales", "stock_deficit"),
    "price": ("avg_price", "price_vs_median", "price_lag7", "price_change_7d", "price_roll_mean7", "price_roll_std7"),
    "weather": ("temp_max", "temp_min", "temp_mean", "precipitation", "rain", "snowfall", "windspeed_max", "is_bad_weather", "weather_cat_code"),
    "calendar": ("dow", "day", "is_weekend", "month", "week", "is_holiday", "is_pre_holiday", "is_post_holiday",
                 "is_payday_week", "is_month_start", "is_month_end"),
    "encodings": ENCODINGS,
}
FEATURES = tuple(c for group in GROUPS.values() for c in group)
KEYS = (*PAIR, "category", "city", DATE)
VALUES = ("sold", "demand", "lost_qty", "is_censored")


def build(daily: DataFrame, prices: DataFrame, stale: DataFrame, weather: DataFrame, test_days: int, value: str = "demand") -> DataFrame:
    """The table of `daily` (store, product, category, city, date, sold, demand, lost_qty, is_censored, stock).

    `prices` has avg_price and `stale` stale_ratio per pair and date, `weather` the raw columns per city and date; each
    has one row per key at most. `is_test` marks the last `test_days` days; encodings are learnt on the days before.
    """
    rows = (daily.transform(series.add_series_features, "sold", "sales")
                 .transform(series.add_series_features, "demand", "demand")
                 .transform(series.add_censoring_history)
                 .transform(series.add_trend)
                 .transform(series.add_stock_features)
                 .transform(series.add_same_weekday_mean, {"sales_dow_mean": "sold", "demand_dow_mean": "demand"}))
    # The breadth of a day counts all its products, so it comes before the warm-up rows go.
    rows = rows.transform(series.add_store_breadth).transform(series.add_category_breadth)
    rows = rows.dropna(subset=[*GROUPS["sales"], *GROUPS["demand"]])
    history = series.add_stale_lag(stale).select(*PAIR, DATE, "stale_ratio_lag1")
    rows = rows.transform(attach_price, series.add_price_features(prices).select(*PAIR, DATE, *GROUPS["price"]))
    rows = rows.join(history, [*PAIR, DATE], "left")
    dim = weather.transform(add_weather_flags).transform(add_weather_category).select("city", DATE, *GROUPS["weather"])
    rows = cut_lineage(attach_filled(rows, dim, ["city", DATE]).drop("is_matched").transform(add_calendar))
    train, _ = train_test(rows, test_days)
    start = F.date_sub(max_date(rows), test_days - 1)
    return (profile_encodings(train, rows, value)
            .withColumn("is_test", F.col(DATE) >= start).withColumn("label", F.col(value).cast("double"))
            .select(*KEYS, *VALUES, *[F.col(c).cast("double").alias(c) for c in FEATURES], "is_test", "label"))


def write_bucketed(df: DataFrame, name: str, buckets: int | None = None, keys: Sequence[str] = PAIR, order: Sequence[str] = (DATE,)) -> DataFrame:
    """Write `df` as table `name`, one sorted file per bucket, below the shared folder; returns the table.

    `buckets` should give files of some hundred megabytes; the default is the session's number of shuffle partitions.
    Tables with the same number are joined by `keys` without an exchange.
    """
    spark = df.sparkSession
    many = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(many, *keys).write.mode("overwrite").format("parquet").option("path", f"{ensure_checkpoint_dir(spark)}/tables/{name}")
       .bucketBy(many, *keys).sortBy(*keys, *order).saveAsTable(name))
    return spark.table(name)


def version_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """A name for what the files below `paths` hold: their places, sizes and times of change."""
    files = None
    for path in paths:
        found = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = found if files is None else files.unionByName(found)
    return format(files.agg(F.bit_xor(F.xxhash64("*"))).first()[0] & (1 << 64) - 1, "016x")


def split(table: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, feature names) of a written table."""
    return table.filter(~F.col("is_test")), table.filter("is_test"), list(FEATURES)
