"""Weather readings to metric units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firelake.functions.numbers import round_to, to_number

# Unit factor.
KMH_PER_MPH = 1.60934


def parse_wind_kmh(text: Column) -> Column:
    """First word is the speed, last word the unit; no unit means mph."""
    words = F.split(F.trim(text), r"\s+")
    in_mph = (F.size(words) == 1) | (F.lower(F.element_at(words, -1)) == "mph")
    factor = F.when(in_mph, F.lit(KMH_PER_MPH)).otherwise(F.lit(1.0))
    return round_to(F.coalesce(to_number(F.get(words, F.lit(0))) * factor, F.lit(0.0)), 2)


def fahrenheit_to_c(fahrenheit: Column) -> Column:
    """A missing reading counts as 0 degrees Fahrenheit."""
    return round_to((F.coalesce(fahrenheit, F.lit(0.0)) - 32) * 5 / 9, 1)


def humidity_pct(value: Column) -> Column:
    return round_to(F.coalesce(value, F.lit(0.0)), 1)
