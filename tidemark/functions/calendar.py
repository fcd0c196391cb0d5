"""Calendars: grids, holidays, cut-offs. Integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weekday_grid(spark: SparkSession, first: str, last: str, weekday: int) -> DataFrame:
    """Every given weekday (0 Monday) between two days."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where(F.weekday("day") == weekday)


def nth_weekday(year: Column, month: Column, weekday: int, n: int) -> Column:
    """The n-th given weekday (0 Monday) of a month; n = -1 is the last."""
    first = F.make_date(year, month, F.lit(1))
    if n > 0:
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    end = F.last_day(first)
    return F.date_sub(end, F.pmod(F.weekday(end) - F.lit(weekday), F.lit(7)))


def observed(day: Column) -> Column:
    """A fixed holiday on a Saturday is kept on Friday, on a Sunday on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def easter(year: Column) -> Column:
    """Western Easter Sunday by the Gregorian computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    golden, century = F.pmod(year, F.lit(19)), div(year, 100)
    skipped, moon = century - div(century, 4), div(century * 8 + 13, 25)
    epact = F.pmod(19 * golden + skipped - moon + 15, F.lit(30))
    full = epact - div(epact, 28) * (1 - div(F.lit(29), epact + 1) * div(21 - golden, 11))
    day = full - F.pmod(year + div(year, 4) + full + 2 - skipped, F.lit(7))
    month = 3 + div(day + 40, 44)
    return F.make_date(year, month, day + 28 - 31 * div(month, 4))


def zoned_cutoff(day: Column, hour: int, zone: str) -> Column:
    """The instant at which the clocks of ``zone`` show ``hour`` on a day."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.make_interval(hours=F.lit(hour)), zone)
