"""Confidence, risk, severity and display values of a detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firelake.functions.numbers import null_if_nan, round_to

BLANKS = " \t\r\n\x0b\x0c"

# Spellings of each confidence level.
HIGH = ("h", "high")
LOW = ("l", "low")
NOMINAL = ("n", "nominal", "medium", "med")

# Brightness and radiative-power limits per severity.
CRITICAL_BRIGHTNESS, CRITICAL_FRP = 350.0, 50.0
WARNING_BRIGHTNESS, WARNING_FRP = 320.0, 20.0

# Marker colours by brightness.
CRITICAL_COLOR, WARNING_COLOR, MONITOR_COLOR = "#d7263d", "#f08c00", "#ffd43b"


def _clean(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(BLANKS)))


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _level(text: Column) -> Column:
    clean = _clean(text)
    return (
        F.when(clean.isin(*HIGH), "high")
        .when(clean.isin(*LOW), "low")
        .when(clean.isin(*NOMINAL), "nominal")
        .otherwise(clean)
    )


def confidence_label(confidence: Column) -> Column:
    return F.when(_clean(confidence).isin(*HIGH), 1).otherwise(0)


def confidence_norm(confidence: Column, on_empty: str = "unknown") -> Column:
    """Level name; null or blank text becomes `on_empty`."""
    return F.coalesce(F.nullif(_level(confidence), F.lit("")), F.lit(on_empty))


def ingest_confidence(confidence: Column, default: str = "medium") -> Column:
    """Level name at ingest; a missing value counts as the default spelling."""
    return _level(F.coalesce(F.nullif(confidence, F.lit("")), F.lit(default)))


def confidence_rank(confidence: Column) -> Column:
    lowered = F.lower(confidence)
    return (
        F.when(lowered == "high", 3).when(lowered.isin("nominal", "medium"), 2).when(lowered == "low", 1).otherwise(0)
    )


def fallback_risk(brightness: Column, frp: Column) -> Column:
    """Score from brightness and radiative power alone; at most 1, no lower bound."""
    raw = (_zero(brightness) * F.lit(0.6) + _zero(frp) * F.lit(0.4)) / F.lit(350.0)
    return round_to(F.least(raw, F.lit(1.0)), 4)


def risk_from_text(risk: Column) -> Column:
    """A risk that came as text; blank text reads as 0, other text as null."""
    text = F.btrim(risk, F.lit(BLANKS))
    return F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def risk_or_fallback(risk: Column, brightness: Column, frp: Column) -> Column:
    """The given risk when it is a number, else the fallback."""
    return F.coalesce(null_if_nan(risk), fallback_risk(brightness, frp))


def severity(brightness: Column, frp: Column) -> Column:
    b, f = _zero(brightness), _zero(frp)
    return (
        F.when((b >= CRITICAL_BRIGHTNESS) | (f >= CRITICAL_FRP), "critical")
        .when((b >= WARNING_BRIGHTNESS) | (f >= WARNING_FRP), "warning")
        .otherwise("monitor")
    )


def marker_color(brightness: Column) -> Column:
    b = _zero(brightness)
    return (
        F.when(b >= CRITICAL_BRIGHTNESS, CRITICAL_COLOR)
        .when(b >= WARNING_BRIGHTNESS, WARNING_COLOR)
        .otherwise(MONITOR_COLOR)
    )


def marker_radius(frp: Column) -> Column:
    return F.least(F.lit(12.0), F.lit(3.0) + _zero(frp) / F.lit(10.0))


def _id_part(value: Column) -> Column:
    """A whole number is written without its fraction, any other without an exponent."""
    whole, text = F.floor(value), value.cast("string")
    plain = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    text = F.when(value == whole, whole.cast("string")).when(text.contains("E"), F.coalesce(plain, text)).otherwise(text)
    return F.coalesce(text, F.lit("na"))


def fire_id(
    latitude: Column,
    longitude: Column,
    acq_date: Column,
    acq_time: Column,
    brightness: Column,
    frp: Column,
    position: Column,
) -> Column:
    """Display id. `position` is whatever tells equal detections apart: the place in a
    bounded list, or a row key of the table. No window is taken here, as equal
    detections may be a large share of all rows."""
    return F.concat_ws(
        "|",
        _id_part(latitude),
        _id_part(longitude),
        F.coalesce(acq_date, F.lit("na")),
        F.coalesce(acq_time, F.lit("na")),
        _id_part(brightness),
        _id_part(frp),
        position.cast("string"),
    )
