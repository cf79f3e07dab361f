"""F: scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.functions import calendar as cal, maths, text, weather as wx
from tillstream.plans.registry import register
from tillstream.sources.testdata import daily, stock_daily, weather

_HOL = "(101,102,103,104,105,106,107,108,223,308,501,509,612,1104)"


def _dates(t):
    return daily(t).select("date").distinct()


_DATES = "(SELECT DISTINCT date FROM daily)"


@register("f01_date_parts", "date:d dow:i day:i is_weekend:i month:i week:i", f"""
SELECT date, isodow(date) - 1 AS dow, day(date) AS day, CAST(isodow(date) > 5 AS INT) AS is_weekend,
       month(date) AS month, week(date) AS week FROM {_DATES}""")
def date_parts(t):
    return _dates(t).transform(cal.add_date_parts)


@register("f02_holiday_flags", "date:d is_holiday:i is_pre_holiday:i is_post_holiday:i", f"""
SELECT date, CAST(month(date) * 100 + day(date) IN {_HOL} AS INT) AS is_holiday,
  CAST(month(date + 1) * 100 + day(date + 1) IN {_HOL} AS INT) AS is_pre_holiday,
  CAST(month(date - 1) * 100 + day(date - 1) IN {_HOL} AS INT) AS is_post_holiday FROM {_DATES}""")
def holiday_flags(t):
    return _dates(t).transform(cal.add_holiday_flags)


@register("f03_month_flags", "date:d is_payday_week:i is_month_start:i is_month_end:i", f"""
SELECT date, CAST(day(date) IN (4,5,6,19,20,21) AS INT) AS is_payday_week, CAST(day(date) <= 5 AS INT) AS is_month_start,
  CAST(day(date) >= 25 AS INT) AS is_month_end FROM {_DATES}""")
def month_flags(t):
    return _dates(t).transform(cal.add_month_flags)


@register("f04_weather_flags", "city:s date:d temp_range:f is_rainy:i is_snowy:i is_cold:i is_warm:i is_windy:i is_bad_weather:i", """
SELECT city, date, temp_max - temp_min AS temp_range, CAST(rain > 1 AS INT) AS is_rainy,
  CAST(snowfall > 0.5e0 AS INT) AS is_snowy, CAST(temp_mean < 0 AS INT) AS is_cold, CAST(temp_mean >= 15 AS INT) AS is_warm,
  CAST(windspeed_max > 30 AS INT) AS is_windy, CAST(rain > 1 OR snowfall > 0.5e0 OR windspeed_max > 30 AS INT) AS is_bad_weather
FROM weather""")
def weather_flags(t):
    return weather(t).transform(wx.add_weather_flags)


@register("f05_weather_category", "weather_category:s weather_cat_code:i n_rows:i", """
SELECT weather_category, CASE weather_category WHEN 'clear' THEN 0 WHEN 'cloudy' THEN 1 WHEN 'fog' THEN 2
  WHEN 'rain' THEN 3 WHEN 'snow' THEN 5 WHEN 'storm' THEN 6 END AS weather_cat_code, count(*) AS n_rows
FROM (SELECT CASE weathercode WHEN 0 THEN 'clear' WHEN 2 THEN 'cloudy' WHEN 45 THEN 'fog' WHEN 61 THEN 'rain'
      WHEN 71 THEN 'snow' WHEN 80 THEN 'rain' WHEN 95 THEN 'storm' END AS weather_category FROM weather) GROUP BY 1""")
def weather_category(t):
    return weather(t).transform(wx.add_weather_category).groupBy("weather_category", "weather_cat_code").agg(
        F.count("*").alias("n_rows"))


@register("f06_text", "p_partkey:i label:s last_word:s has_red:i", """
SELECT p_partkey, replace(replace(p_name || '/' || p_brand, '/', '_'), '*', '_') AS label,
  split_part(p_name, ' ', -1) AS last_word, CAST(contains(p_name, 'red') AS INT) AS has_red FROM part""")
def text_functions(t):
    words = F.split("p_name", " ")
    return t("part").select(
        "p_partkey", text.safe_label(F.concat("p_name", F.lit("/"), "p_brand")).alias("label"),
        F.element_at(words, -1).alias("last_word"), F.col("p_name").contains("red").cast("int").alias("has_red"))


@register("f07_math", "store:i product:s date:d log_sold:f back:f clipped:f rounded:f change:f", """
SELECT store, product, date, ln(1 + sold) AS log_sold, exp(ln(1 + sold)) - 1 AS back,
  least(greatest(sold, 5), 40) AS clipped, floor(sold / 3 + 0.5e0) AS rounded,
  (sold - produced) / (produced + 1e-8) * 100 AS change FROM stock_daily""")
def math_functions(t):
    s = F.col("sold")
    return stock_daily(t).select(
        "store", "product", "date", F.log1p(s).alias("log_sold"), F.expm1(F.log1p(s)).alias("back"),
        maths.clip(s, 5.0, 40.0).alias("clipped"), maths.round_half_up(s / 3).alias("rounded"),
        maths.pct_change(s, F.col("produced")).alias("change"))


_ROW = """SELECT store, product, date, CASE WHEN sold > 20 THEN sold END AS a, CASE WHEN stock > 2 THEN stock END AS b,
  CASE WHEN lost_qty > 0 THEN lost_qty END AS c FROM stock_daily"""


def _row(t):
    return stock_daily(t).select(
        "store", "product", "date", F.when(F.col("sold") > 20, F.col("sold")).alias("a"),
        F.when(F.col("stock") > 2, F.col("stock")).alias("b"),
        F.when(F.col("lost_qty") > 0, F.col("lost_qty")).alias("c"))


@register("f08_row_wise", "store:i product:s date:d row_mean:f first_value:f best:s", f"""
SELECT store, product, date, list_avg(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS row_mean, coalesce(a, b, c) AS first_value,
  CASE WHEN a IS NOT NULL AND a >= coalesce(b, -1) AND a >= coalesce(c, -1) THEN 'a'
       WHEN b IS NOT NULL AND b >= coalesce(c, -1) THEN 'b' WHEN c IS NOT NULL THEN 'c' END AS best FROM ({_ROW})""")
def row_wise(t):
    cols = {k: F.col(k) for k in "abc"}
    return _row(t).select(
        "store", "product", "date", maths.mean_ignoring_nulls(list(cols.values())).alias("row_mean"),
        maths.first_not_null(list(cols.values())).alias("first_value"),
        F.when(maths.first_not_null(list(cols.values())).isNotNull(), maths.arg_max({
            k: F.coalesce(v, F.lit(-1.0)) for k, v in cols.items()})).alias("best"))


@register("f09_pick_by_name", "store:i product:s date:d chosen:f", f"""
SELECT store, product, date, CASE WHEN store < 9 THEN a WHEN store < 17 THEN b WHEN store < 20 THEN c END AS chosen
FROM ({_ROW})""")
def pick_by_name(t):
    name = F.when(F.col("store") < 9, "a").when(F.col("store") < 17, "b").when(F.col("store") < 20, "c").otherwise("none")
    return _row(t).select("store", "product", "date",
                          maths.pick_by_name({k: F.col(k) for k in "abc"}, name).alias("chosen"))


@register("f10_period_dummies", "date:d month_may:i month_december:i month_january:i dow_sunday:i dow_weekday:i", f"""
SELECT date, CAST(month(date) = 5 AS INT) AS month_may, CAST(month(date) = 12 AS INT) AS month_december,
  CAST(month(date) = 1 AS INT) AS month_january, CAST(isodow(date) = 7 AS INT) AS dow_sunday,
  CAST(isodow(date) < 6 AS INT) AS dow_weekday FROM {_DATES}""")
def period_dummies(t):
    return _dates(t).transform(cal.add_period_dummies)


@register("f11_json_fields", "user_id:i n_rows:i k_sum:i k_max:i", """
SELECT user_id, count(*) AS n_rows, sum(CAST(json_extract_string(props, '$.k') AS INT)) AS k_sum,
       max(CAST(json_extract_string(props, '$.k') AS INT)) AS k_max FROM events GROUP BY user_id""")
def json_fields(t):
    k = F.from_json("props", "k int").getField("k")
    return t("events").groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))
