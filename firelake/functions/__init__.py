"""Column expressions; none of them is a Python UDF."""

from firelake.functions.detection import (
    confidence_label,
    confidence_norm,
    confidence_rank,
    fallback_risk,
    fire_id,
    ingest_confidence,
    marker_color,
    marker_radius,
    risk_from_text,
    risk_or_fallback,
    severity,
)
from firelake.functions.numbers import array_mean_nonnull, cell_index, degree_bin, null_if_nan, round_to, to_number
from firelake.functions.testlog import shorten_test_id
from firelake.functions.times import (
    datetime_date,
    datetime_time,
    default_date,
    default_time,
    hour_of,
    month_of,
    pad_time,
    yearday_to_date,
)
from firelake.functions.units import fahrenheit_to_c, humidity_pct, parse_wind_kmh

__all__ = [
    "array_mean_nonnull",
    "cell_index",
    "confidence_label",
    "confidence_norm",
    "confidence_rank",
    "datetime_date",
    "datetime_time",
    "default_date",
    "default_time",
    "degree_bin",
    "fahrenheit_to_c",
    "fallback_risk",
    "fire_id",
    "hour_of",
    "humidity_pct",
    "ingest_confidence",
    "marker_color",
    "marker_radius",
    "month_of",
    "null_if_nan",
    "pad_time",
    "parse_wind_kmh",
    "risk_from_text",
    "risk_or_fallback",
    "round_to",
    "severity",
    "shorten_test_id",
    "to_number",
    "yearday_to_date",
]
