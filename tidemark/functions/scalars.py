"""Column functions that several operators share. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def instant(c: Column) -> Column:
    """ISO-8601 text with a zone offset -> timestamp; null where it isn't one.

    Text without an offset is taken in the session's zone.
    """
    return c.try_cast("timestamp")


def instant_us(c: Column) -> Column:
    """As :func:`instant`, as microseconds since 1970 UTC."""
    return F.unix_micros(instant(c))


def day_number(c: Column) -> Column:
    """Date text (``YYYY-MM-DD``, with or without a time of day, or ``YYYYMMDD``) -> days since 1970."""
    text = F.trim(c)
    dashed = F.when(F.length(text) == 8, F.concat_ws("-", text.substr(1, 4), text.substr(5, 2), text.substr(7, 2))).otherwise(text.substr(1, 10))
    return F.unix_date(dashed.try_cast("date"))


def us_to_day(us: Column) -> Column:
    """UTC day number of a microsecond count; floors, so it holds before 1970 too."""
    return ((us - F.pmod(us, F.lit(DAY_US))) / F.lit(DAY_US)).cast("int")


def utc_text(us: Column) -> Column:
    """Microseconds -> ``YYYY-MM-DD HH:MM:SS`` in UTC, whatever the session's zone."""
    day, rest = us_to_day(us), F.pmod(us, F.lit(DAY_US))
    sec = F.floor(rest / 1_000_000).cast("int")
    text = F.format_string(
        "%s %02d:%02d:%02d", F.date_from_unix_date(day).cast("string"),
        F.floor(sec / 3600).cast("int"), F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("int"), F.pmod(sec, F.lit(60)),
    )
    return F.when(us.isNotNull(), text)


def folded(c: Column) -> Column:
    """A name without case, outer blanks and doubled blanks."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def decimal_key(c: Column) -> Column:
    """Decimal text -> a canonical spelling: equal numbers have equal keys, of any length.

    Sign, leading and trailing zeros, blanks and exponents don't count; text that is no
    decimal is its own trimmed self, marked so that it equals no number.
    """
    text = F.trim(c)
    pattern = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,9}))?$"
    is_number = text.rlike(pattern) & text.rlike(r"\d") & ~text.rlike(r"^[+-]?\.?[eE]")
    whole = F.regexp_extract(text, pattern, 2)
    part = F.regexp_extract(text, pattern, 3)
    exponent = F.coalesce(F.regexp_extract(text, pattern, 4).try_cast("int"), F.lit(0)) - F.length(part)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    bare = F.regexp_replace(digits, "0+$", "")
    number = F.when(bare == "", F.lit("0")).otherwise(
        F.concat(F.when(F.regexp_extract(text, pattern, 1) == "-", "-").otherwise(""), bare, F.lit("e"), (exponent + F.length(digits) - F.length(bare)).cast("string"))
    )
    return F.when(is_number, number).otherwise(F.concat(F.lit("?"), text))
