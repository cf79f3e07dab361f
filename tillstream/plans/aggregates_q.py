"""A: grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import aggregates as agg, filters as flt
from tillstream.functions.maths import bucket
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.sources.testdata import daily, hourly, sale_events, sales, stock_daily

add_base("sale_events", """
SELECT event_id AS check_id, user_id AS store, event_type AS product, user_id AS seller, ts AS check_ts,
       CAST(ts AS DATE) AS date, hour(ts) AS hour, 1e0 AS qty, value AS amount,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN 'fresh' ELSE 'yesterday' END AS freshness
FROM events""")


@register("a01_daily_sales", "date:d store:i category:s product:s sold:f", """
SELECT date, store, category, product, sum(qty) AS sold FROM check_lines WHERE event_type = 'sale'
GROUP BY date, store, category, product""")
def daily_sales(t):
    return agg.daily_sales(sales(t))


@register("a02_hourly_sales", "store:i product:s date:d hour:i qty:f amount:f stale_qty:f n_lines:i last_minute:i", """
SELECT store, product, date, hour, sum(qty) AS qty, sum(amount) AS amount,
  sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) AS stale_qty, count(*) AS n_lines,
  minute(max(check_ts)) AS last_minute FROM sale_events GROUP BY store, product, date, hour""")
def hourly_sales(t):
    return agg.hourly_sales(sale_events(t)).withColumn("last_minute", F.minute("last_ts"))


@register("a03_average_price", "store:i product:s date:d avg_price:f", """
SELECT store, product, date, sum(price * qty) / sum(qty) AS avg_price FROM sales GROUP BY store, product, date""")
def average_price(t):
    return agg.average_price(sales(t))


@register("a04_last_sale", "store:i product:s date:d last_hour:i", """
SELECT store, product, date, max(hour) AS last_hour FROM hourly GROUP BY store, product, date""")
def last_sale(t):
    return agg.last_sale(hourly(t))


@register("a05_stale_share", "store:i product:s date:d stale_qty:f total_qty:f stale_ratio:f", """
SELECT store, product, date, sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) AS stale_qty,
  sum(qty) AS total_qty, sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) / (sum(qty) + 1e-8) AS stale_ratio
FROM sales GROUP BY store, product, date""")
def stale_share(t):
    return agg.stale_share(sales(t))


@register("a06_store_totals", "store:i date:d sold:f demand:f city:s n_products:i", """
SELECT store, date, sum(sold) AS sold, sum(demand) AS demand, min(city) AS city, count(DISTINCT product) AS n_products
FROM stock_daily GROUP BY store, date""")
def store_totals(t):
    return agg.store_totals(stock_daily(t), ["sold", "demand"])


@register("a07_check_totals", "check_id:i items:i qty:f total:f2", """
SELECT check_id, count(*) AS items, sum(qty) AS qty, sum(amount) AS total FROM sales GROUP BY check_id""")
def check_totals(t):
    return agg.check_totals(sales(t))


@register("a07_check_summary", "n_checks:i mean_total:f6 median_total:f2 mean_items:f mean_qty:f", """
WITH c AS (SELECT check_id, count(*) AS items, sum(qty) AS qty, sum(amount) AS total FROM sales GROUP BY check_id)
SELECT count(*) AS n_checks, avg(total) AS mean_total, median(total) AS median_total, avg(items) AS mean_items,
       avg(qty) AS mean_qty FROM c""")
def check_summary(t):
    return agg.check_summary(agg.check_totals(sales(t)))


_KPI = """SELECT {p} AS {n}, sum(qty) AS qty, sum(amount) AS revenue, count(DISTINCT check_id) AS checks,
  count(*) AS lines, count(DISTINCT product) AS products, count(DISTINCT date) AS days,
  sum(amount) / count(DISTINCT check_id) AS avg_check FROM sales GROUP BY 1"""
_KPI_SPEC = "qty:f revenue:f2 checks:i lines:i products:i days:i avg_check:f6"


@register("a08_daily_kpis", f"date:d {_KPI_SPEC}", _KPI.format(p="date", n="date"))
def daily_kpis(t):
    return agg.period_kpis(sales(t), F.col("date"), "date")


@register("a08_weekly_kpis", f"week:d {_KPI_SPEC}", _KPI.format(p="date_trunc('week', date)", n="week"))
def weekly_kpis(t):
    return agg.period_kpis(sales(t), F.trunc("date", "week"), "week")


@register("a09_weekday_index", "dow:i mean:f6 std:f2 n_days:i index_pct:f", """
WITH d AS (SELECT date, sum(amount) AS revenue FROM sales GROUP BY date),
w AS (SELECT isodow(date) - 1 AS dow, avg(revenue) AS mean, stddev_samp(revenue) AS std, count(*) AS n_days FROM d GROUP BY 1)
SELECT *, mean / (SELECT avg(mean) FROM w) * 100 AS index_pct FROM w""")
def weekday_index(t):
    return agg.weekday_index(sales(t).groupBy("date").agg(F.sum("amount").alias("revenue")), "revenue")


@register("a10_hour_pattern", "hour:i workday_qty:f weekend_qty:f", """
WITH d AS (SELECT count(DISTINCT date) FILTER (isodow(date) < 6) AS wd,
                  count(DISTINCT date) FILTER (isodow(date) >= 6) AS we FROM hourly)
SELECT hour, sum(CASE WHEN isodow(date) < 6 THEN qty ELSE 0 END) / (SELECT wd FROM d) AS workday_qty,
       sum(CASE WHEN isodow(date) >= 6 THEN qty ELSE 0 END) / (SELECT we FROM d) AS weekend_qty
FROM hourly GROUP BY hour""")
def hour_pattern(t):
    return agg.hour_pattern(hourly(t))


_HOURS = " ".join(f"h{h}:f" for h in range(24))
_HSUM = ", ".join(f"sum(CASE WHEN hour = {h} THEN qty ELSE 0 END) / count(DISTINCT date) AS h{h}" for h in range(24))


@register("a11_weekday_hour_matrix", f"dow:i n_days:i {_HOURS}", f"""
SELECT isodow(date) - 1 AS dow, count(DISTINCT date) AS n_days, {_HSUM} FROM hourly GROUP BY 1""")
def weekday_hour_matrix(t):
    return agg.weekday_hour_matrix(hourly(t))


@register("a12_freshness_by_hour", "hour:i fresh:f yesterday:f stale_pct:f", """
SELECT hour, sum(CASE freshness WHEN 'fresh' THEN qty ELSE 0 END) AS fresh,
  sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) AS yesterday,
  sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) * 100 / sum(qty) AS stale_pct
FROM sale_events GROUP BY hour""")
def freshness_by_hour(t):
    return agg.freshness_by_hour(sale_events(t))


@register("a12_top_stale", "product:s stale_qty:f total_qty:f stale_pct:f", """
WITH p AS (SELECT part AS product, sum(CASE freshness WHEN 'yesterday' THEN qty ELSE 0 END) AS stale_qty,
           sum(qty) AS total_qty FROM sales GROUP BY part)
SELECT *, stale_qty * 100 / total_qty AS stale_pct FROM p WHERE stale_qty > 0
ORDER BY stale_qty DESC, product LIMIT 10""")
def top_stale(t):
    return agg.top_stale(sales(t).withColumn("product", F.col("part")))


@register("a13_seller_stats", "seller:i checks:i qty:f revenue:f2 days:i avg_hour:f min_hour:i max_hour:i rev_per_day:f6 qty_per_day:f", """
SELECT seller, count(*) AS checks, sum(qty) AS qty, sum(amount) AS revenue, count(DISTINCT date) AS days,
  avg(hour) AS avg_hour, min(hour) AS min_hour, max(hour) AS max_hour,
  sum(amount) / count(DISTINCT date) AS rev_per_day, sum(qty) / count(DISTINCT date) AS qty_per_day
FROM sale_events GROUP BY seller""")
def seller_stats(t):
    return agg.seller_stats(sale_events(t))


@register("a14_early_stop", "store:i product:s total_days:i mean_last_hour:f early_stop_days:i mean_hours_before_close:f early_stop_pct:f", """
WITH l AS (SELECT store, product, date, max(hour) AS last_hour FROM hourly GROUP BY store, product, date)
SELECT store, product, count(*) AS total_days, avg(last_hour) AS mean_last_hour,
  count(*) FILTER (last_hour <= 14) AS early_stop_days, avg(19 - last_hour) AS mean_hours_before_close,
  count(*) FILTER (last_hour <= 14) * 100e0 / count(*) AS early_stop_pct FROM l GROUP BY store, product""")
def early_stop(t):
    return agg.early_stop(hourly(t), ("store", "product"))


@register("a15_metric_rollup", "level:i category:s month:s n_rows:i sold:f lost_qty:f censored_pct:f", """
SELECT grouping(category) * 2 + grouping(month) AS level, category, month, count(*) AS n_rows, sum(sold) AS sold,
  sum(lost_qty) AS lost_qty, avg(is_censored) * 100 AS censored_pct
FROM (SELECT *, strftime(date, '%Y-%m') AS month FROM stock_daily) GROUP BY ROLLUP (category, month)""")
def metric_rollup(t):
    df = stock_daily(t).withColumn("month", F.date_format("date", "yyyy-MM"))
    return agg.metric_rollup(df, ["category", "month"], [
        F.count("*").alias("n_rows"), F.sum("sold").alias("sold"), F.sum("lost_qty").alias("lost_qty"),
        (F.avg("is_censored") * 100).alias("censored_pct")])


@register("a16_store_profile", "store:i mean:f std:f total:f n_products:i n_days:i median:f cv:f", """
SELECT store, avg(sold) AS mean, stddev_samp(sold) AS std, sum(sold) AS total, count(DISTINCT product) AS n_products,
  count(DISTINCT date) AS n_days, median(sold) AS median, stddev_samp(sold) / (avg(sold) + 1e-8) AS cv
FROM daily GROUP BY store""")
def store_profile(t):
    return agg.store_profile(daily(t))


@register("a17_profile_encodings", "date:d store:i product:s store_mean:f product_mean:f product_cv:f category_mean:f pair_mean:f store_products:f", """
WITH cut AS (SELECT max(date) - 89 AS c FROM daily), tr AS (SELECT * FROM daily, cut WHERE date < c),
s AS (SELECT store, avg(sold) AS store_mean, count(DISTINCT product) AS store_products FROM tr GROUP BY store),
p AS (SELECT product, avg(sold) AS product_mean, stddev_samp(sold) / (avg(sold) + 1e-8) AS product_cv FROM tr GROUP BY product),
k AS (SELECT category, avg(sold) AS category_mean FROM tr GROUP BY category),
b AS (SELECT store, product, avg(sold) AS pair_mean FROM tr GROUP BY store, product),
j AS (SELECT date, d.store, d.product, store_mean, product_mean, product_cv, category_mean, pair_mean, store_products
      FROM daily d LEFT JOIN s ON d.store = s.store LEFT JOIN p ON d.product = p.product
      LEFT JOIN k ON d.category = k.category LEFT JOIN b ON d.store = b.store AND d.product = b.product, cut WHERE date >= c)
SELECT date, store, product, coalesce(store_mean, (SELECT median(store_mean) FROM j)) AS store_mean,
  coalesce(product_mean, (SELECT median(product_mean) FROM j)) AS product_mean,
  coalesce(product_cv, (SELECT median(product_cv) FROM j)) AS product_cv,
  coalesce(category_mean, (SELECT median(category_mean) FROM j)) AS category_mean,
  coalesce(pair_mean, (SELECT median(pair_mean) FROM j)) AS pair_mean,
  coalesce(store_products, (SELECT median(store_products) FROM j)) AS store_products FROM j""")
def profile_encodings(t):
    train, test = flt.train_test(daily(t), 90)
    return agg.profile_encodings(train, test)


@register("a18_sku_behaviour", "store:i product:s n_days:i mean_demand:f median_demand:f std_demand:f share_zero:f share_censored:f lost_mean:f cv_demand:f", """
SELECT store, product, count(DISTINCT date) AS n_days, avg(demand) AS mean_demand, median(demand) AS median_demand,
  stddev_samp(demand) AS std_demand, avg(CAST(demand = 0 AS INT)) AS share_zero, avg(is_censored) AS share_censored,
  avg(lost_qty) AS lost_mean, coalesce(stddev_samp(demand), 0) / (abs(avg(demand)) + 1e-8) AS cv_demand
FROM stock_daily GROUP BY store, product""")
def sku_behaviour(t):
    return agg.sku_behaviour(stock_daily(t))


CLUSTER_SQL = """
SELECT store, product, demand_mean, sd_d AS demand_std, demand_median, sales_mean, sd_s AS sales_std,
       coalesce(dow_std, 0) AS dow_std, n_days, lost_mean, censored_pct,
       sd_d / (demand_mean + 1e-8) AS cv,
       least(greatest(coalesce(lw, demand_mean) / (demand_mean + 1e-8), 0.5e0), 2e0) AS trend
FROM (SELECT store, product, avg(demand) AS demand_mean, coalesce(stddev_samp(demand), 0) AS sd_d,
             median(demand) AS demand_median, avg(sold) AS sales_mean, coalesce(stddev_samp(sold), 0) AS sd_s,
             count(date) AS n_days, avg(lost_qty) AS lost_mean, avg(is_censored) AS censored_pct,
             avg(CASE WHEN date >= m - 7 THEN demand END) AS lw
      FROM tr, (SELECT max(date) AS m FROM tr) GROUP BY store, product)
JOIN (SELECT store, product, stddev_samp(s) AS dow_std FROM
      (SELECT store, product, isodow(date) AS dow, sum(sold) AS s FROM tr GROUP BY 1, 2, 3) GROUP BY store, product)
  USING (store, product)"""


@register("a19_cluster_features", "store:i product:s demand_mean:f demand_std:f demand_median:f sales_mean:f sales_std:f dow_std:f n_days:i lost_mean:f censored_pct:f cv:f trend:f", f"""
WITH tr AS (SELECT * FROM stock_daily WHERE date < (SELECT max(date) - 89 FROM stock_daily)) {CLUSTER_SQL}""")
def cluster_features(t):
    return agg.cluster_features(flt.train_test(stock_daily(t), 90)[0])


@register("a20_distribution", "bucket:s n_rows:i share_pct:f", """
WITH b AS (SELECT CASE WHEN sold < 10 THEN '[0,10)' WHEN sold < 20 THEN '[10,20)' WHEN sold < 30 THEN '[20,30)'
  WHEN sold < 50 THEN '[30,50)' ELSE '50+' END AS bucket FROM daily)
SELECT bucket, count(*) AS n_rows, count(*) * 100e0 / (SELECT count(*) FROM b) AS share_pct FROM b GROUP BY bucket""")
def distribution(t):
    label = bucket(F.col("sold"), [(10, "[0,10)"), (20, "[10,20)"), (30, "[20,30)"), (50, "[30,50)")], "50+")
    return agg.distribution(daily(t), label)


@register("a21_correlations", "scope:s feature:s corr:f", """
SELECT 'all' AS scope, 'produced' AS feature, corr(sold, produced) AS corr FROM stock_daily
UNION ALL SELECT 'all', 'stock', corr(sold, stock) FROM stock_daily
UNION ALL SELECT 'all', 'flat', 0 UNION ALL SELECT 'high', 'flat', 0
UNION ALL SELECT 'high', 'produced', corr(sold, produced) FROM stock_daily WHERE sold >= 30
UNION ALL SELECT 'high', 'stock', corr(sold, stock) FROM stock_daily WHERE sold >= 30""")
def correlations(t):
    df = stock_daily(t).withColumn("flat", F.lit(1.0))
    cols = ["produced", "stock", "flat"]
    whole = agg.correlations(df, "sold", cols).withColumn("scope", F.lit("all"))
    high = agg.correlations(df, "sold", cols, F.col("sold") >= 30).withColumn("scope", F.lit("high"))
    return whole.unionByName(high)


@register("a22_column_profile", "feature:s n_values:i n_null:i null_pct:f mean:f2 std:f2 min:f2 max:f2", """
SELECT 'o_totalprice' AS feature, count(o_totalprice) AS n_values, count(*) - count(o_totalprice) AS n_null,
  (count(*) - count(o_totalprice)) * 100e0 / count(*) AS null_pct, avg(o_totalprice) AS mean,
  stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
UNION ALL SELECT 'big', count(b), count(*) - count(b), (count(*) - count(b)) * 100e0 / count(*), avg(b), stddev_samp(b), min(b), max(b)
FROM (SELECT CASE WHEN o_totalprice >= 200000 THEN o_totalprice END AS b FROM orders)""")
def column_profile(t):
    df = t("orders").withColumn("big", F.when(F.col("o_totalprice") >= 200000, F.col("o_totalprice")))
    return agg.column_profile(df, ["o_totalprice", "big"])


@register("a22_top_values", "value:s n_rows:i", """
SELECT lang AS value, count(*) AS n_rows FROM documents GROUP BY lang ORDER BY n_rows DESC, value LIMIT 3""")
def top_values(t):
    return agg.top_values(t("documents"), "lang", 3)


@register("a23_assortment_lists", "store:i n_products:i products:s", """
SELECT store, count(DISTINCT part) AS n_products,
       string_agg(DISTINCT CAST(part AS VARCHAR), ',' ORDER BY CAST(part AS VARCHAR)) AS products FROM sales GROUP BY store""")
def assortment_lists(t):
    lists = agg.assortment_lists(sales(t).select("store", F.col("part").cast("string").alias("product")))
    return lists.select("store", F.size("products").alias("n_products"),
                        F.array_join("products", ",").alias("products"))


@register("a23_pair_defaults", "store:i product:s sold:f stock:f", """
SELECT store, product, median(sold) AS sold, median(stock) AS stock FROM stock_daily GROUP BY store, product""")
def pair_defaults(t):
    return agg.pair_defaults(stock_daily(t), ["sold", "stock"])


@register("a24_hour_presence", "store:i product:s hour:i n_days:i all_days:i share:f", """
WITH a AS (SELECT store, product, count(DISTINCT date) AS all_days FROM hourly GROUP BY store, product)
SELECT store, product, hour, count(DISTINCT date) AS n_days, all_days, count(DISTINCT date) / all_days::DOUBLE AS share
FROM hourly JOIN a USING (store, product) GROUP BY store, product, hour, all_days""")
def hour_presence(t):
    return agg.hour_presence(hourly(t))
