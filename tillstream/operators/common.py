"""Defaults shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

PAIR = ("store", "product")
DATE = "date"


def by_date(keys: Sequence[str] = PAIR, date: str = DATE) -> WindowSpec:
    """Rows of one series in date order. One row per key and date is expected, so a
    window holds at most as many rows as there are days."""
    return Window.partitionBy(*keys).orderBy(date)


def before(n: int | None, keys: Sequence[str] = PAIR, date: str = DATE) -> WindowSpec:
    """The n rows before the current one (all of them for None)."""
    start = Window.unboundedPreceding if n is None else -n
    return by_date(keys, date).rowsBetween(start, -1)


def max_date(df: DataFrame, date: str = DATE) -> Column:
    """Latest date as a scalar subquery: one row, computed once, no join."""
    return df.agg(F.max(date)).scalar()


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grouping ignores rows with a null key, as a data-frame library would."""
    return df.dropna(subset=list(keys))
