"""Weather flags and the WMO code table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.functions.calendar import flag

# Category -> integer code, one map for history and forecast.
WEATHER_CODES = {"clear": 0, "cloudy": 1, "fog": 2, "rain": 3, "showers": 4, "snow": 5, "storm": 6}
# Highest WMO code of each category, in ascending order.
WMO_UPPER = [(0, "clear"), (3, "cloudy"), (48, "fog"), (67, "rain"), (77, "snow"), (82, "rain")]


def wmo_category(code: Column) -> Column:
    code = F.coalesce(code, F.lit(0.0))
    out = F
    for upper, name in WMO_UPPER:
        cond = code == upper if upper == 0 else code <= upper
        out = out.when(cond, name)
    return out.otherwise("storm")


def category_code(category: Column) -> Column:
    out = F
    for name, code in WEATHER_CODES.items():
        out = out.when(category == name, code)
    return out.otherwise(0)


def add_weather_flags(df: DataFrame) -> DataFrame:
    rainy, snowy, windy = F.col("rain") > 1, F.col("snowfall") > 0.5, F.col("windspeed_max") > 30
    return df.withColumns({
        "temp_range": F.col("temp_max") - F.col("temp_min"),
        "is_rainy": flag(rainy),
        "is_snowy": flag(snowy),
        "is_cold": flag(F.col("temp_mean") < 0),
        "is_warm": flag(F.col("temp_mean") >= 15),
        "is_windy": flag(windy),
        "is_bad_weather": flag(rainy | snowy | windy),
    })


def add_weather_category(df: DataFrame, code: str = "weathercode") -> DataFrame:
    return (df.withColumn("weather_category", wmo_category(F.col(code)))
              .withColumn("weather_cat_code", category_code(F.col("weather_category"))))
