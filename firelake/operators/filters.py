"""Row filters and argument checks. Each filter is plain column predicates next to the
scan, so ranges, equality and partition predicates reach the files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.functions import confidence_norm
from firelake.schemas import CONFIDENCES, REGIONS, US_BOX, Box


def check_region(region: str | None) -> str | None:
    """Region key in lower case; None means no region given."""
    if region is None:
        return None
    key = region.lower()
    if key not in REGIONS:
        raise ValueError(f"Invalid region {region!r}: known regions are {', '.join(REGIONS)}")
    return key


def check_confidence(confidence: str | None) -> str | None:
    if confidence is None:
        return None
    level = confidence.lower()
    if level not in CONFIDENCES:
        raise ValueError(f"{confidence!r} is no confidence level; there are {', '.join(CONFIDENCES)}")
    return level


def in_box(latitude: Column, longitude: Column, box: Box) -> Column:
    return latitude.between(box.min_lat, box.max_lat) & longitude.between(box.min_lon, box.max_lon)


def filter_box(rows: DataFrame, box: Box) -> DataFrame:
    return rows.where(in_box(F.col("latitude"), F.col("longitude"), box))


def filter_us_box(rows: DataFrame, box: Box = US_BOX) -> DataFrame:
    return filter_box(rows, box)


def filter_region(rows: DataFrame, region: str | None) -> DataFrame:
    """Inside the US box and, for a narrower region, inside its box too."""
    key = check_region(region)
    rows = filter_us_box(rows)
    return rows if key in (None, "us") else filter_box(rows, REGIONS[key])


def filter_confidence_exact(rows: DataFrame, confidence: str | None) -> DataFrame:
    """Level as stored, without regard to case; codes such as `h` do not match."""
    level = check_confidence(confidence)
    return rows if level is None else rows.where(F.lower("confidence") == level)


def filter_confidence_normalized(rows: DataFrame, confidence: str = "all") -> DataFrame:
    """Level after normalisation; `all` keeps every row."""
    return rows if confidence == "all" else rows.where(confidence_norm(F.col("confidence")) == confidence)


def _threshold(value: object) -> float:
    """What a form field holds: text that is no finite number counts as 0."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return 0.0
    return number if math.isfinite(number) else 0.0


def filter_min_brightness_frp(
    rows: DataFrame, min_brightness: object = 0, min_frp: object = 0, brightness: str = "bright_ti4"
) -> DataFrame:
    """At least both values, where a missing measurement counts as 0."""

    def at_least(name: str, value: object) -> Column:
        # A positive limit needs no null handling, so it can be pushed to the files.
        limit = _threshold(value)
        measured = F.col(name)
        return measured >= limit if limit > 0 else F.coalesce(measured, F.lit(0.0)) >= limit

    return rows.where(at_least(brightness, min_brightness) & at_least("frp", min_frp))


def filter_positive_risk(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("risk") > 0)


def drop_missing_coords(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def filter_by_date(rows: DataFrame, date: str) -> DataFrame:
    return rows.where(F.col("acq_date") == date)


def find_by_id(rows: DataFrame, event_id: str | None) -> DataFrame:
    """The row with this id, or none."""
    return rows.where(F.lit(False)) if event_id is None else rows.where(F.col("id") == event_id)
