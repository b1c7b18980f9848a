"""Acquisition date and time text. Nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK_TEXT = r"^([01]\d|2[0-3])[0-5]\d$"
DATE_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}$"


def pad_time(time: Column) -> Column:
    """Drop colons, pad with zeros to four places; longer text is never cut."""
    digits = F.replace(time.cast("string"), F.lit(":"), F.lit(""))
    return F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))


def default_time(time: Column) -> Column:
    return F.coalesce(pad_time(time), F.lit("0000"))


def default_date(date: Column, run_date: str) -> Column:
    return F.coalesce(date, F.lit(run_date))


def _parsed_date(date: Column) -> Column:
    return F.when(date.rlike(DATE_TEXT), date.try_cast("date"))


def _valid(date: Column, clock: Column) -> Column:
    return _parsed_date(date).isNotNull() & clock.rlike(CLOCK_TEXT)


def hour_of(date: Column, time: Column) -> Column:
    """Hour of day; 0 when date or time does not parse."""
    clock = pad_time(time)
    return F.when(_valid(date, clock), F.substring(clock, 1, 2).try_cast("int")).otherwise(0)


def month_of(date: Column, time: Column) -> Column:
    """Month; 0 when date or time does not parse, as the two are read together."""
    return F.when(_valid(date, pad_time(time)), F.month(_parsed_date(date))).otherwise(0)


def yearday_to_date(yearday: Column) -> Column:
    """`YYYYDDD` to `yyyy-MM-dd`, null when it does not parse."""
    text = F.trim(yearday.cast("string"))
    year = F.substring(text, 1, 4).try_cast("int")
    day = F.substring(text, 5, 3).try_cast("int")
    first = F.when(year >= 1, F.make_date(year, F.lit(1), F.lit(1)))
    date = F.date_add(first, day - 1)
    known = text.rlike(r"^\d{7}$") & (day >= 1) & (F.year(date) == year)
    return F.when(known, date.cast("string"))


# Date-time patterns besides ISO, first match wins.
DATETIME_PATTERNS = (
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "yyyyMMdd HHmmss",
    "yyyyMMdd HHmm",
    "yyyyMMddHHmm",
    "yyyyMMdd",
)


def _wall_clock(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` as written; a zone in the text is kept out of it."""
    text = F.trim(text.cast("string"))
    # Eight or twelve digits are a day, not a year of that many.
    iso = F.when(~text.rlike(r"^\d{5,}"), text.try_cast("timestamp_ntz").cast("string"))
    others = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz").cast("string") for p in DATETIME_PATTERNS]
    return F.coalesce(iso, *others)


def datetime_date(text: Column) -> Column:
    return F.substring(_wall_clock(text), 1, 10)


def datetime_time(text: Column) -> Column:
    wall = _wall_clock(text)
    return F.concat(F.substring(wall, 12, 2), F.substring(wall, 15, 2))
