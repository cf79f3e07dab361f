"""Canonical table schemas and header aliases."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(),
          "timestamp_ntz": T.TimestampNTZType()}


def _struct(spec: str) -> T.StructType:
    """`name type, ...` to a schema without needing a session."""
    fields = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


CHECK_LINES_RAW = _struct(
    "sale_date string, check_ts string, event_type string, store string, category string, "
    "product string, freshness string, price string, qty string, amount string, seller string"
)
CHECK_LINES = _struct(
    "date date, check_ts timestamp_ntz, event_type string, store string, category string, "
    "product string, freshness string, price double, qty double, amount double, seller string"
)
DAILY = _struct("date date, store string, product string, category string, city string, sold double")
HOURLY = _struct("date date, store string, product string, hour int, qty double")
PROFILE = _struct("store string, product string, hour int, cum_share double")
WEATHER = _struct(
    "city string, date date, temp_max double, temp_min double, temp_mean double, "
    "precipitation double, rain double, snowfall double, windspeed_max double, weathercode double"
)
PREDICTIONS = _struct(
    "date date, store string, product string, fact double, model string, prediction double"
)
PREDICTION_LOG = _struct(
    "timestamp timestamp_ntz, store string, product string, date date, "
    "prediction double, fact double, response_time_ms double"
)

# Source header -> canonical column name.
HEADER_ALIASES = {
    "Дата продажи": "sale_date",
    "Дата": "date",
    "Дата время чека": "check_ts",
    "Вид события по кассе": "event_type",
    "Касса.Торговая точка": "store",
    "Пекарня": "store",
    "Категория": "category",
    "Номенклатура": "product",
    "Свежесть": "freshness",
    "Цена": "price",
    "Кол-во": "qty",
    "Сумма": "amount",
    "Продавец": "seller",
    "Город": "city",
    "Продано": "sold",
    "Выпуск": "produced",
    "Остаток": "stock",
    "Спрос": "demand",
}

# Event and freshness codes in the source files.
EVENT_CODES = {"Продажа": "sale", "Возврат": "return", "Отмена": "cancel"}
FRESHNESS_CODES = {"Свежий": "fresh", "Вчерашний": "yesterday"}
