"""Calendar columns derived from a date column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Public holidays as month * 100 + day.
HOLIDAYS = [101, 102, 103, 104, 105, 106, 107, 108, 223, 308, 501, 509, 612, 1104]
# Days of month around the two usual paydays.
PAYDAY_DAYS = [4, 5, 6, 19, 20, 21]


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def month_day(d: Column) -> Column:
    return F.month(d) * 100 + F.dayofmonth(d)


def is_holiday(d: Column) -> Column:
    return flag(month_day(d).isin(HOLIDAYS))


def day_number(d: Column) -> Column:
    """Days since 1970-01-01: a numeric order key for calendar-range frames."""
    return F.unix_date(d)


def add_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Monday = 0 weekday, day, weekend flag, month, ISO week."""
    d = F.col(date)
    return df.withColumns({
        "dow": F.weekday(d),
        "day": F.dayofmonth(d),
        "is_weekend": flag(F.weekday(d) >= 5),
        "month": F.month(d),
        "week": F.weekofyear(d),
    })


def add_holiday_flags(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "is_holiday": is_holiday(d),
        "is_pre_holiday": is_holiday(F.date_add(d, 1)),
        "is_post_holiday": is_holiday(F.date_sub(d, 1)),
    })


def add_month_flags(df: DataFrame, date: str = "date") -> DataFrame:
    day = F.dayofmonth(F.col(date))
    return df.withColumns({
        "is_payday_week": flag(day.isin(PAYDAY_DAYS)),
        "is_month_start": flag(day <= 5),
        "is_month_end": flag(day >= 25),
    })


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return (df.transform(add_date_parts, date)
              .transform(add_holiday_flags, date)
              .transform(add_month_flags, date))


def add_period_dummies(df: DataFrame, date: str = "date") -> DataFrame:
    """0/1 columns for month and day group, the first level of each dropped.

    Levels are alphabetical, so April and Saturday are the dropped ones.
    """
    d = F.col(date)
    names = ["August", "December", "February", "January", "July", "June",
             "March", "May", "November", "October", "September"]
    numbers = {"January": 1, "February": 2, "March": 3, "May": 5, "June": 6, "July": 7,
               "August": 8, "September": 9, "October": 10, "November": 11, "December": 12}
    cols = {f"month_{n.lower()}": flag(F.month(d) == numbers[n]) for n in names}
    cols["dow_sunday"] = flag(F.weekday(d) == 6)
    cols["dow_weekday"] = flag(F.weekday(d) < 5)
    return df.withColumns(cols)
