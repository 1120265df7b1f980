"""Calendar and seasonal features, with fixed one-hot domains so that schemas never follow the data."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import before, flag, mean


def calendar_fields(rows: DataFrame, ts: str = "ts") -> DataFrame:
    return rows.withColumns({"DayOfWeek": F.weekday(ts), "DayOfMonth": F.dayofmonth(ts), "Month": F.month(ts), "Quarter": F.quarter(ts), "Hour": F.hour(ts)})


def one_hots(rows: DataFrame) -> DataFrame:
    """DOW_0..6, Month_1..12, H_0..23; needs ``calendar_fields``."""
    out = {f"DOW_{i}": flag(F.col("DayOfWeek") == i) for i in range(7)} | {f"Month_{i}": flag(F.col("Month") == i) for i in range(1, 13)}
    return rows.withColumns(out | {f"H_{i}": flag(F.col("Hour") == i) for i in range(24)})


def month_turns(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """TurnOfMonth, EOM and EOQ by calendar days; EOQ compares the day of the month with the quarter end's, so it fires every month."""
    day, last = F.dayofmonth(ts), F.dayofmonth(F.last_day(ts))
    quarter_end = F.dayofmonth(F.last_day(F.add_months(F.trunc(F.to_date(ts), "quarter"), 2)))
    return rows.withColumns({
        "TurnOfMonth": F.when(day <= 3, 1).when(day >= last - 2, -1).otherwise(0), "EOM": flag(day >= last - 1), "EOQ": flag(day >= quarter_end - 4),
    })


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th (from 1), or for -1 the last, such weekday of a month."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _observed(day: date) -> date:
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


def federal_holidays(first: int, last: int) -> list[date]:
    """US federal holidays, as observed, of the years first..last."""
    out = []
    for y in range(first, last + 1):
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)] + ([date(y, 6, 19)] if y >= 2021 else [])
        out += [_observed(d) for d in fixed]
        out += [_nth(y, 1, 0, 3), _nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)]
    return sorted(out)


def holiday_table(spark: SparkSession, first: int = 1990, last: int = 2040) -> DataFrame:
    """A dimension of a few hundred rows: its size depends on the years alone."""
    return spark.createDataFrame([(d,) for d in federal_holidays(first, last)], "holiday date")


def holiday_distance(rows: DataFrame, holidays: DataFrame | None = None, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Whole days to the next and from the last holiday inside the series' range; NULL if there is none.

    Distances are found once a day and key, by window, and joined back by equality.
    """
    holidays = holidays if holidays is not None else holiday_table(rows.sparkSession)
    days = rows.select(key, F.to_date(ts).alias("__day")).distinct()
    span = rows.groupBy(key).agg(F.date_trunc("day", F.min(ts)).alias("__a"), F.min(ts).alias("__min"), F.max(ts).alias("__b"))
    # a holiday counts as midnight of its day; it must not lie before the first time or after the last one
    inside = span.join(F.broadcast(holidays), (F.to_timestamp_ntz(F.col("holiday").cast("string")) >= F.col("__min").cast("timestamp_ntz")) & (F.to_timestamp_ntz(F.col("holiday").cast("string")) <= F.col("__b").cast("timestamp_ntz")))
    marked = days.withColumn("__h", F.lit(None).cast("date")).union(inside.select(key, F.col("holiday").alias("__day"), F.col("holiday").alias("__h")))
    marked = marked.withColumn("__n", F.unix_date("__day"))
    by_number = Window.partitionBy(key).orderBy("__n")
    back, ahead, strictly = by_number.rangeBetween(Window.unboundedPreceding, 0), by_number.rangeBetween(0, Window.unboundedFollowing), by_number.rangeBetween(1, Window.unboundedFollowing)
    found = marked.select(key, "__day", F.max("__h").over(back).alias("__last"), F.min("__h").over(ahead).alias("__today"), F.min("__h").over(strictly).alias("__next")).distinct()
    joined = rows.withColumn("__day", F.to_date(ts)).join(found, [key, "__day"], "left")
    midnight = F.col(ts).cast("timestamp_ntz") == F.to_timestamp_ntz(F.col("__day").cast("string"))
    upcoming = F.when(midnight, F.col("__today")).otherwise(F.col("__next"))
    to = F.datediff(upcoming, F.col("__day")) - F.when(midnight, 0).otherwise(1)
    return joined.withColumns({"DaysToHoliday": to, "DaysFromHoliday": F.datediff("__day", "__last")}).drop("__day", "__last", "__today", "__next")


def seasonal_returns(rows: DataFrame, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Rolling mean return inside each weekday and each month; needs ``calendar_fields``."""
    rows = rows.withColumn("__r", F.try_divide(F.col("close"), before("close")) - 1)
    out: dict[str, Column] = {}
    for w in windows:
        out[f"DOWReturn_{w}"] = mean("__r", w, "DayOfWeek")
        out[f"MonthReturn_{w}"] = mean("__r", w, "Month")
    return rows.withColumns(out).drop("__r")


def add_calendar(bars: DataFrame) -> DataFrame:
    for step in (calendar_fields, one_hots, month_turns, holiday_distance, seasonal_returns):
        bars = bars.transform(step)
    return bars
