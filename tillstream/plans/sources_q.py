"""S: scans, merges, marts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillstream.plans.registry import register
from tillstream.session import ensure_checkpoint_dir
from tillstream.sources import readers, sinks
from tillstream.sources.testdata import Tables, check_lines, daily, hourly


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/marts/{name}-{uuid.uuid4().hex}"


def _number_text(x):
    """12345.6 -> `12 345,60`, as the till export writes numbers."""
    cents = F.round(x * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    grouped = F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "),
                       F.lpad((whole % 1000).cast("string"), 3, "0"))
    return F.concat(F.when(whole >= 1000, grouped).otherwise(whole.cast("string")), F.lit(","),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def _raw_text_lines(t: Tables) -> DataFrame:
    """lineitem written the way the till export writes it: text cells, source codes."""
    event = F.when(F.col("l_returnflag") == "N", "Продажа").when(F.col("l_returnflag") == "R", "Возврат")
    return t("lineitem").select(
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("Дата продажи"),
        F.date_format("l_shipdate", "dd.MM.yyyy HH:mm:ss").alias("Дата время чека"),
        event.otherwise("Отмена").alias("Вид события по кассе"),
        F.col("l_suppkey").cast("string").alias("Касса.Торговая точка"),
        F.lit(None).cast("string").alias("Категория"),
        F.col("l_partkey").cast("string").alias("Номенклатура"),
        F.when(F.col("l_linestatus") == "O", "Свежий").otherwise("Вчерашний").alias("Свежесть"),
        F.lit(None).cast("string").alias("Цена"),
        _number_text(F.col("l_quantity")).alias("Кол-во"),
        _number_text(F.col("l_extendedprice")).alias("Сумма"),
        F.lit(None).cast("string").alias("Продавец"))


@register("s01_typed_check_lines", "event_type:s freshness:s year:i n_lines:i qty:f amount:f2 first_date:d", """
SELECT CASE l_returnflag WHEN 'N' THEN 'sale' WHEN 'R' THEN 'return' ELSE 'cancel' END AS event_type,
       CASE l_linestatus WHEN 'O' THEN 'fresh' ELSE 'yesterday' END AS freshness,
       year(l_shipdate) AS year, count(*) AS n_lines, sum(l_quantity) AS qty,
       sum(round(l_extendedprice * 100) / 100) AS amount, min(CAST(l_shipdate AS DATE)) AS first_date
FROM lineitem GROUP BY l_returnflag, l_linestatus, year(l_shipdate)""")
def typed_check_lines(t):
    path = _scratch(t.spark, "lines")
    _raw_text_lines(t).write.option("header", True).csv(path)
    lines = readers.read_check_lines(t.spark, path)
    return lines.groupBy("event_type", "freshness", F.year("date").alias("year")).agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount"),
        F.min("date").alias("first_date"))


@register("s02_union_drops", "status:s n_rows:i total:f2", """
SELECT o_orderstatus AS status, count(*) AS n_rows, sum(o_totalprice) AS total
FROM (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')
      UNION SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')) GROUP BY o_orderstatus""")
def union_drops(t):
    o = t("orders")
    first, second = o.filter(F.col("o_orderstatus").isin("F", "O")), o.filter(F.col("o_orderstatus").isin("O", "P"))
    path = _scratch(t.spark, "drops")
    for folder, part in (("early/a", first), ("b", second)):
        part.write.option("header", True).csv(f"{path}/{folder}")
    good, _ = readers.split_drops(readers.read_drops(t.spark, path, o.schema))
    return good.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n_rows"), F.sum("o_totalprice").alias("total"))


@register("s03_merge_at_cutoff", "date:d store:i product:s sold:f", """
SELECT date, store, product, sold FROM daily WHERE date < DATE '1999-01-01'
UNION ALL
SELECT date, store, category, sum(qty) FROM check_lines
WHERE event_type <> 'sale' AND date >= DATE '1999-01-01' GROUP BY date, store, category""")
def merge_at_cutoff(t):
    new = check_lines(t).filter(F.col("event_type") != "sale").groupBy(
        "date", "store", F.col("category").alias("product")).agg(F.sum("qty").alias("sold"))
    return readers.merge_at_cutoff(daily(t), new, "1999-01-01")


@register("s04_star_extract", "date:d store_name:s city_id:i product_name:s brand:s", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, s_name AS store_name, s_nationkey AS city_id,
       p_name AS product_name, p_brand AS brand
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'N'""")
def star_extract(t):
    fact = t("lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"),
                                F.to_date("l_shipdate").alias("date"), "l_returnflag")
    stores = t("supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"),
                                  F.col("s_nationkey").alias("city_id"))
    products = t("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                                F.col("p_brand").alias("brand"))
    sold = fact.filter(F.col("l_returnflag") == "N").drop("l_returnflag")
    return readers.star_extract(sold.distinct(), stores, products).drop("store_id", "product_id").distinct()


@register("s05_full_months", "month:d n_days:i", """
SELECT date_trunc('month', date) AS month, count(DISTINCT date) AS n_days FROM check_lines
GROUP BY 1 HAVING count(DISTINCT date) = day(last_day(min(date)))""")
def full_months(t):
    return readers.full_months(check_lines(t))


@register("s05_last_full_month", "month:d", """
SELECT max(month) AS month FROM (
  SELECT date_trunc('month', date) AS month FROM check_lines
  GROUP BY 1 HAVING count(DISTINCT date) = day(last_day(min(date))))""")
def last_full_month(t):
    return readers.last_full_month(check_lines(t))


@register("s06_month_slice", "date:d store:i category:s product:s n_lines:i qty:f", """
WITH m AS (SELECT max(month) AS month FROM (
  SELECT date_trunc('month', date) AS month FROM check_lines
  GROUP BY 1 HAVING count(DISTINCT date) = day(last_day(min(date)))))
SELECT date, store, category, product, count(*) AS n_lines, sum(qty) AS qty
FROM sales, m WHERE date_trunc('month', date) = month GROUP BY date, store, category, product""")
def month_slice(t):
    lines = check_lines(t)
    cut = readers.month_slice(lines, readers.last_full_month(lines).scalar())
    return cut.groupBy("date", "store", "category", "product").agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("qty"))


@register("s07_daily_mart", "month:s n_rows:i sold:f", """
SELECT strftime(date, '%Y-%m') AS month, count(*) AS n_rows, sum(sold) AS sold FROM daily GROUP BY 1""")
def daily_mart(t):
    path = _scratch(t.spark, "daily")
    sinks.write_mart(daily(t), path)
    return t.spark.read.parquet(path).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_rows"), F.sum("sold").alias("sold"))


@register("s07_mart_if_changed", "n_rows:i first_write:i second_write:i", """
SELECT count(*) AS n_rows, 1 AS first_write, 0 AS second_write FROM hourly""")
def mart_if_changed(t):
    path, state = _scratch(t.spark, "hourly"), _scratch(t.spark, "state")
    source = f"{t.sf_dir}/events.parquet"
    done = [sinks.write_mart_if_changed(hourly(t), path, source, state) for _ in range(2)]
    return t.spark.read.parquet(path).agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(int(done[0])).alias("first_write"), F.lit(int(done[1])).alias("second_write"))


@register("s09_run_log", "run_id:s n_rows:i total:f", """
SELECT r AS run_id, count(*) AS n_rows, sum(sold) AS total
FROM daily, (VALUES ('a'), ('b')) v(r) GROUP BY r""")
def run_log(t):
    root = _scratch(t.spark, "runs")
    d = daily(t)
    metrics = d.groupBy("store").agg(F.sum("sold").alias("sold"))
    for run_id in ("a", "b", "b"):  # the repeated id replaces its rows
        sinks.write_run(metrics, d.select("date", "store", "product", "sold"), root, run_id)
    return t.spark.read.parquet(f"{root}/predictions").groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.sum("sold").alias("total"))


@register("s10_prediction_log", "served_on:d n_rows:i prediction:f", """
SELECT CAST(ts AS DATE) AS served_on, 2 * count(*) AS n_rows, 2 * sum(value) AS prediction
FROM events GROUP BY 1""")
def prediction_log(t):
    path = _scratch(t.spark, "log")
    served = t("events").select(
        F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("store"),
        F.col("event_type").alias("product"), F.to_date("ts").alias("date"),
        F.col("value").alias("prediction"), F.lit(None).cast("double").alias("fact"),
        F.lit(1.0).alias("response_time_ms"))
    for _ in range(2):
        sinks.append_prediction_log(served, path)
    return t.spark.read.parquet(path).groupBy("served_on").agg(
        F.count("*").alias("n_rows"), F.sum("prediction").alias("prediction"))


@register("s11_canonical_columns", "store:s event_type:s qty:f", """
SELECT CAST(l_suppkey AS VARCHAR) AS store,
       CASE l_returnflag WHEN 'N' THEN 'Продажа' WHEN 'R' THEN 'Возврат' ELSE 'Отмена' END AS event_type,
       sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def canonical_columns(t):
    df = readers.canonicalise_columns(_raw_text_lines(t), required=["store", "product", "qty", "sale_date"])
    return df.groupBy("store", "event_type").agg(
        F.sum(F.regexp_replace("qty", ",", ".").cast("double")).alias("qty"))
