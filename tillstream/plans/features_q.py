"""The feature table that the model queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillstream.operators import aggregates as agg, features as ft
from tillstream.plans import demand_q, joins_q, series_q  # noqa: F401  their shared SQL comes first
from tillstream.plans.demand_q import series_sql
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.sources.testdata import daily_prices, sales, stock_daily, weather

TEST_DAYS = 90
TABLES = ("lineitem", "part", "supplier", "nation", "orders", "customer")


def table_version(t) -> str:
    return ft.version_of(t.spark, [f"{t.sf_dir}/{n}.parquet" for n in TABLES])


def feature_table(t) -> DataFrame:
    """The table for these files; built once a session and read by every model after that."""
    spark, name = t.spark, f"features_{table_version(t)}"
    if not spark.catalog.tableExists(name):
        stale = agg.stale_share(sales(t).withColumn("product", F.col("category")))
        ft.write_bucketed(ft.build(stock_daily(t), daily_prices(t), stale, weather(t), TEST_DAYS), name)
    return spark.table(name)


_P = "PARTITION BY store, product ORDER BY date"
_HOL = "(101,102,103,104,105,106,107,108,223,308,501,509,612,1104)"
_SEVEN = f"({_P} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
_DOW = "(PARTITION BY store, product, isodow(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _md(shift: str) -> str:
    day = f"CAST(date {shift} AS DATE)"
    return f"CAST(month({day}) * 100 + day({day}) IN {_HOL} AS INT)"


# Names of their own: the whole table must not depend on the operators it is compared with.
add_base("feature_series", f"""
SELECT *, demand_roll_mean7 / (demand_roll_mean30 + 1e-8) AS demand_trend, sales_roll_std7 / (sales_roll_mean7 + 1) AS cv_7d,
  stock_lag1 / (sales_lag1 + 1) AS stock_to_sales, greatest(sales_lag1 - stock_lag1, 0) AS stock_deficit
FROM (SELECT *, {series_sql("sold", "sales")}, {series_sql("demand", "demand")}, lag(stock, 1) OVER p AS stock_lag1,
  coalesce(lag(is_censored) OVER p, 0) AS is_censored_lag1, coalesce(lag(lost_qty) OVER p, 0) AS lost_qty_lag1,
  coalesce(avg(is_censored) OVER {_SEVEN} * 100, 0) AS pct_censored_7d,
  coalesce(avg(sold) OVER {_DOW}, 0) AS sales_dow_mean, coalesce(avg(demand) OVER {_DOW}, 0) AS demand_dow_mean
  FROM stock_daily WINDOW p AS ({_P}))""")
add_base("feature_breadth", """
SELECT *, coalesce(prev, 0) AS items_in_store_lag1, coalesce(items_in_store_today - prev, 0) AS items_change
FROM (SELECT *, lag(items_in_store_today) OVER (PARTITION BY store ORDER BY date) AS prev
      FROM (SELECT store, date, count(DISTINCT product) AS items_in_store_today FROM stock_daily GROUP BY store, date))""")
add_base("feature_category_breadth", """
SELECT *, coalesce(items_in_category_today - lag(items_in_category_today) OVER (PARTITION BY store, category ORDER BY date), 0) AS category_items_change
FROM (SELECT store, category, date, count(DISTINCT product) AS items_in_category_today FROM stock_daily GROUP BY store, category, date)""")
add_base("feature_stale", f"""
SELECT store, product, date, lag(ratio) OVER ({_P}) AS stale_ratio_lag1
FROM (SELECT store, category AS product, date, sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) / (sum(qty) + 1e-8) AS ratio
      FROM sales s GROUP BY s.store, s.category, s.date)""")
add_base("feature_price", f"""
SELECT p.*, avg_price / med AS price_vs_median, (avg_price - price_lag7) / (price_lag7 + 1e-8) * 100 AS price_change_7d
FROM (SELECT *, lag(avg_price, 7) OVER ({_P}) AS price_lag7, avg(avg_price) OVER {_SEVEN} AS price_roll_mean7,
        stddev_samp(avg_price) OVER {_SEVEN} AS price_roll_std7 FROM daily_prices) p
JOIN (SELECT product, median(avg_price) AS med FROM daily_prices GROUP BY product) m ON m.product = p.product""")
_WEATHER = ", ".join(f"coalesce(w.{c}, 0) AS {c}" for c in ft.GROUPS["weather"])
_WARM = " AND ".join(f"f.{c} IS NOT NULL" for c in (*ft.GROUPS["sales"], *ft.GROUPS["demand"]))
add_base("feature_rows", f"""
SELECT f.*, b.items_in_store_today, b.items_in_store_lag1, b.items_change, k.items_in_category_today, k.category_items_change,
  s.stale_ratio_lag1, {", ".join(f"p.{c}" for c in ft.GROUPS["price"])}, {_WEATHER}
FROM feature_series f JOIN feature_breadth b ON b.store = f.store AND b.date = f.date
JOIN feature_category_breadth k ON k.store = f.store AND k.category = f.category AND k.date = f.date
LEFT JOIN feature_stale s ON s.store = f.store AND s.product = f.product AND s.date = f.date
LEFT JOIN feature_price p ON p.store = f.store AND p.product = f.product AND p.date = f.date
LEFT JOIN weather_full w ON w.city = f.city AND w.date = f.date WHERE {_WARM}""")
add_base("feature_train", f"SELECT * FROM feature_rows WHERE date < (SELECT max(date) FROM feature_rows) - {TEST_DAYS - 1}")
add_base("feature_encoded", """
SELECT r.*, e.store_mean AS e_store_mean, p.product_mean AS e_product_mean, p.product_cv AS e_product_cv, k.category_mean AS e_category_mean,
  b.pair_mean AS e_pair_mean, e.store_products AS e_store_products
FROM feature_rows r
LEFT JOIN (SELECT store, avg(demand) AS store_mean, count(DISTINCT product) AS store_products FROM feature_train GROUP BY store) e ON e.store = r.store
LEFT JOIN (SELECT product, avg(demand) AS product_mean, stddev_samp(demand) / (avg(demand) + 1e-8) AS product_cv FROM feature_train GROUP BY product) p ON p.product = r.product
LEFT JOIN (SELECT category, avg(demand) AS category_mean FROM feature_train GROUP BY category) k ON k.category = r.category
LEFT JOIN (SELECT store, product, avg(demand) AS pair_mean FROM feature_train GROUP BY store, product) b ON b.store = r.store AND b.product = r.product""")
add_base("feature_table", f"""
SELECT *, {", ".join(f"coalesce(e_{c}, (SELECT median(e_{c}) FROM feature_encoded)) AS {c}" for c in ft.ENCODINGS)},
  isodow(date) - 1 AS dow, day(date) AS day, CAST(isodow(date) > 5 AS INT) AS is_weekend, month(date) AS month, week(date) AS week,
  {_md("")} AS is_holiday, {_md("+ 1")} AS is_pre_holiday, {_md("- 1")} AS is_post_holiday,
  CAST(day(date) IN (4,5,6,19,20,21) AS INT) AS is_payday_week, CAST(day(date) <= 5 AS INT) AS is_month_start, CAST(day(date) >= 25 AS INT) AS is_month_end,
  CAST(date >= (SELECT max(date) FROM feature_rows) - {TEST_DAYS - 1} AS INT) AS is_test, demand AS label
FROM feature_encoded""")

_SPEC = "store:i product:s category:s city:s date:d sold:f demand:f lost_qty:f is_censored:i " + " ".join(f"{c}:f" for c in ft.FEATURES) + " is_test:i label:f"


@register("b01_feature_table", _SPEC, "SELECT * FROM feature_table")
def feature_rows(t):
    return feature_table(t)


@register("b01_feature_means", "store:i product:s n_rows:i " + " ".join(f"{c}:f" for c in ft.FEATURES), f"""
SELECT store, product, count(*) AS n_rows, {", ".join(f"avg({c}) AS {c}" for c in ft.FEATURES)} FROM feature_table GROUP BY store, product""")
def feature_means(t):
    """Means per pair: a bucketed read without an exchange."""
    return feature_table(t).groupBy("store", "product").agg(F.count("*").alias("n_rows"), *[F.avg(c).alias(c) for c in ft.FEATURES])
