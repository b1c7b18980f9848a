"""Rounding, coordinate cells and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal or exponent notation; keeps Java-only forms such as "15d" out.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def round_to(value: Column, digits: int) -> Column:
    """The one rounding rule: scale, round half away from zero, scale back."""
    scale = float(10**digits)
    return F.round(value * F.lit(scale)) / F.lit(scale)


def cell_index(degrees: Column) -> Column:
    """Integer 0.01 degree cell; null when the coordinate is no number.

    An integer key hashes the same whatever the sign of zero, and is half as wide.
    """
    return F.round(degrees * F.lit(100.0)).try_cast("int")


def degree_bin(degrees: Column) -> Column:
    return F.floor(degrees).try_cast("int")


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def to_number(text: Column) -> Column:
    text = text.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def array_mean_nonnull(values: Column, digits: int = 4) -> Column:
    """Mean of the elements that are present; 0.0 when there are none."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.struct(
            (acc["total"] + F.coalesce(x.cast("double"), F.lit(0.0))).alias("total"),
            (acc["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n"),
        ),
        lambda acc: F.when(acc["n"] > 0, round_to(acc["total"] / acc["n"], digits)).otherwise(F.lit(0.0)),
    )
