"""K and U: top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import evaluate as ev, ranking as rk
from tillstream.plans.registry import register
from tillstream.sources.testdata import check_lines, daily, daily_fine, sales, weather


@register("k01_top_products", "part:i qty:f", """
SELECT part, sum(qty) AS qty FROM sales GROUP BY part ORDER BY qty DESC, part LIMIT 10""")
def top_products(t):
    return rk.top_n(sales(t), "part", "qty", 10)


@register("k02_top_per_store", "store:i part:i qty:f rank:i", """
SELECT * FROM (SELECT store, part, sum(qty) AS qty, row_number() OVER (PARTITION BY store ORDER BY sum(qty) DESC, part) AS rank
FROM sales GROUP BY store, part) WHERE rank <= 5""")
def top_per_store(t):
    return rk.top_n_per_group(sales(t), "store", "part", "qty", 5)


def _long(t):
    from tillstream.plans.forecasts import long_forecasts
    return long_forecasts(t)


_EXT = """SELECT *, abs(fact - prediction) AS abs_error FROM long_preds WHERE prediction IS NOT NULL
ORDER BY floor(abs(fact - prediction) * 1e6 + 0.5e0) {o}, date, store, product, model LIMIT 20"""
_EXT_SPEC = "date:d store:i product:s model:s abs_error:f6"


@register("k03_worst_predictions", _EXT_SPEC, _EXT.format(o="DESC"))
def worst_predictions(t):
    return rk.extreme_predictions(_long(t), 20, True, ["date", "store", "product", "model"])


@register("k03_best_predictions", _EXT_SPEC, _EXT.format(o="ASC"))
def best_predictions(t):
    return rk.extreme_predictions(_long(t), 20, False, ["date", "store", "product", "model"])


@register("k04_tail_rows", "store:i product:s date:d sold:f", """
SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY store, product ORDER BY date DESC) <= 30""")
def tail_rows(t):
    return rk.tail_rows(daily(t), 30)


@register("k05_sku_list", "store:i product:s best_model:s best_r2:f r2_bucket:s", """
SELECT store, product, best_model, best_r2, CASE WHEN best_r2 IS NULL THEN 'unknown' WHEN best_r2 <= 0 THEN 'R2 <= 0'
  WHEN best_r2 <= 0.1e0 THEN '0 < R2 <= 0.1' WHEN best_r2 <= 0.2e0 THEN '0.1 < R2 <= 0.2' WHEN best_r2 <= 0.4e0 THEN '0.2 < R2 <= 0.4'
  ELSE 'R2 > 0.4' END AS r2_bucket FROM best_sku""")
def sku_list(t):
    from tillstream.plans.evaluate_q import best_sku
    return rk.sku_list(best_sku(t).withColumn("r2_bucket", ev.r2_bucket()))


@register("k06_nearest_row", "dow:i mean:f6", """
WITH w AS (SELECT isodow(date) - 1 AS dow, avg(sold) AS mean FROM daily GROUP BY 1)
SELECT * FROM w ORDER BY abs(mean - (SELECT avg(sold) FROM daily)), dow LIMIT 1""")
def nearest_row(t):
    d = daily(t)
    per = d.groupBy(F.weekday("date").alias("dow")).agg(F.avg("sold").alias("mean"))
    return rk.nearest_row(per, "mean", d.agg(F.avg("sold")).scalar(), "dow")


@register("u01_union_models", "model:s n_rows:i qty:f", """
SELECT event_type AS model, count(*) AS n_rows, sum(qty) AS qty FROM check_lines GROUP BY event_type""")
def union_models(t):
    lines = check_lines(t)
    kinds = ("sale", "return", "cancel")
    tables = {k: lines.filter(F.col("event_type") == k).select("date", "store", "qty") for k in kinds}
    return rk.union_models(tables).groupBy("model").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("qty"))


@register("u02_common_dates", "date:d", """
SELECT date FROM daily_fine GROUP BY date HAVING count(DISTINCT category) = (SELECT count(DISTINCT category) FROM daily_fine)""")
def common_dates(t):
    d = daily_fine(t).select("date", F.col("category").alias("model"), F.col("sold").alias("prediction"))
    n = d.agg(F.countDistinct("model")).first()[0]
    return rk.common_dates(d, n)


@register("u03_difference", "city:s date:d", """
SELECT DISTINCT city, date FROM weather EXCEPT SELECT city, date FROM daily""")
def difference(t):
    return weather(t).select("city", "date").exceptAll(daily(t).select("city", "date").distinct())


@register("u04_distinct_report", "n_rows:i n_distinct:i n_removed:i", """
SELECT n AS n_rows, d AS n_distinct, n - d AS n_removed
FROM (SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS d)""")
def distinct_report(t):
    return rk.distinct_report(t("lineitem"))
