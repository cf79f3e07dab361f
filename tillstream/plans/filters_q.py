"""P: filters, projections, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.functions import text
from tillstream.operators import filters as flt, joins, series
from tillstream.plans.registry import register
from tillstream.sources.testdata import check_lines, daily, daily_fine, sales, stock_daily


@register("p01_keep_sales", "store:i n_lines:i qty:f", """
SELECT store, count(*) AS n_lines, sum(qty) AS qty FROM check_lines WHERE event_type = 'sale' GROUP BY store""")
def keep_sales(t):
    return flt.keep_sales(check_lines(t)).groupBy("store").agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("qty"))


_NET = """net AS (SELECT date, store, product,
  sum(CASE event_type WHEN 'sale' THEN qty WHEN 'return' THEN -qty ELSE 0 END) AS sold
  FROM check_lines GROUP BY date, store, product)"""


def _net(t):
    signed = F.when(F.col("event_type") == "sale", F.col("qty")).when(
        F.col("event_type") == "return", -F.col("qty")).otherwise(0.0)
    return check_lines(t).groupBy("date", "store", "product").agg(F.sum(signed).alias("sold"))


@register("p02_clip_at_zero", "store:i sold:f n_rows:i", f"""
WITH {_NET} SELECT store, sum(greatest(sold, 0)) AS sold, count(*) AS n_rows FROM net GROUP BY store""")
def clip_at_zero(t):
    return flt.clip_at_zero(_net(t), ["sold"]).groupBy("store").agg(
        F.sum("sold").alias("sold"), F.count("*").alias("n_rows"))


@register("p02_clip_fixes", "sold_fixed:i", f"""
WITH {_NET} SELECT count(*) FILTER (sold < 0) AS sold_fixed FROM net""")
def clip_fixes(t):
    return flt.count_negative(_net(t), ["sold"])


@register("p03_city_from_store", "city:s n_stores:i", """
SELECT CASE s_suppkey % 6 WHEN 0 THEN 'Казань' WHEN 1 THEN 'Набережные Челны' WHEN 2 THEN 'Чебоксары'
       WHEN 3 THEN 'Набережные Челны' ELSE 'Казань' END AS city, count(*) AS n_stores
FROM supplier GROUP BY 1""")
def city_from_store(t):
    tails = F.array(*[F.lit(x) for x in ("Казань", "Наб Челны", "Новочебоксарск", "Челны 2", "Куюки", "Север")])
    name = F.concat(F.col("s_name"), F.lit(" "), F.element_at(tails, (F.col("s_suppkey") % 6 + 1).cast("int")))
    return t("supplier").groupBy(text.city_from_store(name).alias("city")).agg(F.count("*").alias("n_stores"))


@register("p04_merge_store_copies", "store:s sold:f", """
SELECT n_name AS store, sum(l_quantity) AS sold FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'N' GROUP BY n_name""")
def merge_store_copies(t):
    raw = sales(t).select(
        F.concat(F.col("city"), F.lit(" "), (F.col("supplier") % 4).cast("string"), F.lit(" ("),
                 (F.col("supplier") % 3).cast("string"), F.lit(")")).alias("store"), F.col("qty").alias("sold"))
    return flt.merge_store_copies(raw, "sold", [])


@register("p05_first_category", "category:s n_products:i sold:f", """
WITH f AS (SELECT product, category FROM (
  SELECT product, category, row_number() OVER (PARTITION BY product ORDER BY date, category) AS rn
  FROM daily_fine) WHERE rn = 1)
SELECT coalesce(f.category, 'other') AS category, count(DISTINCT d.product) AS n_products, sum(sold) AS sold
FROM daily_fine d LEFT JOIN f ON d.product = f.product GROUP BY 1""")
def first_category(t):
    d = daily_fine(t)
    known = flt.first_category(d)
    return flt.attach_category(d, known).groupBy("category").agg(
        F.countDistinct("product").alias("n_products"), F.sum("sold").alias("sold"))


@register("p06_always_sold", "product:s n_days:i sold:f", """
WITH d AS (SELECT user_id AS product, CAST(ts AS DATE) AS date, value AS sold FROM events WHERE user_id IS NOT NULL),
s AS (SELECT product, count(DISTINCT date) AS n_days, sum(sold) AS sold FROM d GROUP BY product)
SELECT * FROM s WHERE n_days / (SELECT count(DISTINCT date) FROM d)::DOUBLE >= 0.98e0""")
def always_sold(t):
    """The whole rule of 98 % over the event days, on which only few keys meet it."""
    rows = t("events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("product"), F.to_date("ts").alias("date"), F.col("value").alias("sold"))
    return flt.always_sold(rows).groupBy("product").agg(F.countDistinct("date").alias("n_days"), F.sum("sold").alias("sold"))


@register("p07_exclude_words", "p_brand:s n_products:i", """
SELECT p_brand, count(*) AS n_products FROM part WHERE NOT regexp_matches(p_name, 'RING|bolt', 'i')
GROUP BY p_brand""")
def exclude_words(t):
    return flt.exclude_words(t("part"), "p_name", ["RING", "bolt"]).groupBy("p_brand").agg(
        F.count("*").alias("n_products"))


@register("p08_last_days", "date:d store:i product:s sold:f", """
SELECT date, store, product, sold FROM daily WHERE date >= (SELECT max(date) FROM daily) - 89""")
def last_days(t):
    return flt.last_days(daily(t), 90)


@register("p09_drop_warmup", "date:d store:i product:s sold_lag30:f sold_roll_mean30:f", """
SELECT * FROM (SELECT date, store, product, lag(sold, 30) OVER w AS sold_lag30,
  CASE WHEN count(sold) OVER f >= 15 THEN avg(sold) OVER f END AS sold_roll_mean30
  FROM daily WINDOW w AS (PARTITION BY store, product ORDER BY date),
  f AS (PARTITION BY store, product ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
WHERE sold_lag30 IS NOT NULL AND sold_roll_mean30 IS NOT NULL""")
def drop_warmup(t):
    df = daily(t).transform(series.add_series_features, "sold", "sold")
    return flt.drop_warmup(df, series.feature_columns(df, ["sold"]))


@register("p10_train_test_split", "is_test:i n_rows:i first_date:d last_date:d", """
SELECT CASE WHEN date >= (SELECT max(date) FROM daily) - 89 THEN 1 ELSE 0 END AS is_test,
       count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY 1""")
def train_test_split(t):
    return flt.label_split(daily(t), 90).groupBy("is_test").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("p11_drop_false_zeros", "store:i product:s n_rows:i n_zero:i", """
WITH span AS (SELECT store, product, min(date) AS a, max(date) AS b FROM daily GROUP BY store, product),
grid AS (SELECT store, product, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
dense AS (SELECT g.store, g.product, g.date, coalesce(sold, 0) AS sold,
          coalesce(sold, (dayofyear(g.date) + g.store) % 3) AS produced
          FROM grid g LEFT JOIN daily d ON g.store = d.store AND g.product = d.product AND g.date = d.date)
SELECT store, product, count(*) AS n_rows, count(*) FILTER (sold = 0) AS n_zero FROM dense
WHERE NOT (sold = 0 AND produced = 0) GROUP BY store, product""")
def drop_false_zeros(t):
    dense = joins.dense_calendar(daily(t).withColumn("produced", F.col("sold")), "sold")
    made = dense.withColumn("produced", F.coalesce("produced", (F.dayofyear("date") + F.col("store")) % 3))
    return flt.drop_false_zeros(made).groupBy("store", "product").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("sold") == 0).alias("n_zero"))


@register("p12_long_series", "store:i product:s n_rows:i sold:f", """
SELECT store, product, count(*) AS n_rows, sum(sold) AS sold FROM daily_fine GROUP BY store, product
HAVING count(*) >= 30""")
def long_series(t):
    return flt.long_series(daily_fine(t), 30).groupBy("store", "product").agg(
        F.count("*").alias("n_rows"), F.sum("sold").alias("sold"))


@register("p13_usable_features", "feature:s n_values:i usable:i", """
WITH x AS (SELECT sold, produced, stock, is_censored, lost_qty, sold - sold AS flat,
           CAST(NULL AS DOUBLE) AS empty FROM stock_daily)
SELECT 'sold' AS feature, count(sold) AS n_values, CAST(count(DISTINCT sold) > 1 AS INT) AS usable FROM x
UNION ALL SELECT 'produced', count(produced), CAST(count(DISTINCT produced) > 1 AS INT) FROM x
UNION ALL SELECT 'stock', count(stock), CAST(count(DISTINCT stock) > 1 AS INT) FROM x
UNION ALL SELECT 'is_censored', count(is_censored), CAST(count(DISTINCT is_censored) > 1 AS INT) FROM x
UNION ALL SELECT 'lost_qty', count(lost_qty), CAST(count(DISTINCT lost_qty) > 1 AS INT) FROM x
UNION ALL SELECT 'flat', count(flat), CAST(count(DISTINCT flat) > 1 AS INT) FROM x
UNION ALL SELECT 'empty', count(empty), CAST(count(DISTINCT empty) > 1 AS INT) FROM x""")
def usable_features(t):
    df = stock_daily(t).withColumn("flat", F.col("sold") - F.col("sold")).withColumn(
        "empty", F.lit(None).cast("double"))
    return flt.usable_features(df, ["sold", "produced", "stock", "is_censored", "lost_qty", "flat", "empty"])


@register("p15_messy_text", "o_orderkey:i yes_no:i premise:i number:f", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0
       WHEN 4 THEN 1 WHEN 5 THEN NULL ELSE NULL END AS yes_no,
       CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS premise,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey + 0.5e0 END AS number FROM orders""")
def messy_text(t):
    k = F.col("o_orderkey")
    pick = lambda n, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    number = F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return t("orders").select(
        "o_orderkey", text.parse_yes_no(pick(7, [" Да ", "нет", "YES", "0", "12", "?", None])).alias("yes_no"),
        text.parse_premise(pick(4, ["Стрит", "стрит в ТЦ", "ТЦ", None])).alias("premise"),
        number.try_cast("double").alias("number"))


@register("p16_routable", "status:s n_rows:i", """
SELECT o_orderstatus AS status, count(*) AS n_rows FROM orders
WHERE left(o_orderpriority, 1) IN ('1', '2', '3') AND o_totalprice >= 50000 AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY o_orderstatus""")
def routable(t):
    level = F.substring("o_orderpriority", 1, 1)
    words = {"1": "True", "2": " yes ", "3": "1", "4": "no"}
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    df = t("orders").select(
        F.col("o_orderstatus").alias("status"),
        F.try_element_at(table, level).alias("has_model_metrics"),
        F.when(F.col("o_totalprice") < 50000, "Y").otherwise("n").alias("all_model_metrics_missing"),
        F.when(F.to_date("o_orderdate") >= F.lit("1999-01-01").cast("date"), "TRUE").alias("is_short_history"))
    return flt.routable(df).groupBy("status").agg(F.count("*").alias("n_rows"))


@register("p17_number_text", "o_orderkey:i value:f2", """
SELECT o_orderkey, floor(o_totalprice * 100 + 0.5e0) / 100 AS value FROM orders""")
def number_text(t):
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    whole = F.floor(cents / 100)
    raw = F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"),
                   F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" руб."))
    return t("orders").select("o_orderkey", text.parse_number(raw).alias("value"))


@register("p18_keyword_category", "category:s n_products:i", """
SELECT CASE WHEN lower(p_name) LIKE '%bolt%' THEN 'fastener' WHEN lower(p_name) LIKE '%ring%' THEN 'round'
       WHEN lower(p_name) LIKE '%red%' THEN 'red' ELSE 'other' END AS category, count(*) AS n_products
FROM part GROUP BY 1""")
def keyword_category(t):
    rules = [("Bolt", "fastener"), ("ring", "round"), ("red", "red")]
    return t("part").groupBy(text.category_by_keyword(F.col("p_name"), rules).alias("category")).agg(
        F.count("*").alias("n_products"))
