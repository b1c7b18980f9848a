"""Table schemas and the fixed values every operator shares."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Box(NamedTuple):
    """Inclusive latitude/longitude box."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float


def _table(doubles_before: list[str], strings: list[str], doubles_after: list[str] = ()) -> T.StructType:
    fields = [T.StructField(n, T.DoubleType()) for n in doubles_before]
    fields += [T.StructField(n, T.StringType()) for n in strings]
    fields += [T.StructField(n, T.DoubleType()) for n in doubles_after]
    return T.StructType(fields)


WEATHER_VALUES = ["wind_speed_kmh", "humidity_pct", "temp_c"]
SOIL_VALUES = ["soil_moisture", "vpd_kpa", "et0_mm"]

# Dates and times stay text (`yyyy-MM-dd`, `HHmm`), so their order is lexical.
FIRES = _table(
    ["latitude", "longitude", "bright_ti4", "bright_ti5", "frp"],
    ["acq_date", "acq_time", "confidence"],
)
WEATHER = _table(["latitude", "longitude"], ["obs_date"], WEATHER_VALUES).add(
    "fetched_at", T.TimestampType()
)
ENVIRONMENT = _table(["latitude", "longitude"], ["obs_date"], SOIL_VALUES).add(
    "fetched_at", T.TimestampType()
)

# A detection is identified by where and when it was seen.
DETECTION_KEY = ["latitude", "longitude", "acq_date", "acq_time"]

# Feature order of the risk model.
FEATURES = [
    "bright_ti4",
    "bright_ti5",
    "frp",
    "hour",
    "month",
    "lat_bin",
    "lon_bin",
    "wind_speed_kmh",
    "humidity_pct",
    "temp_c",
    "soil_moisture",
    "vpd_kpa",
    "et0_mm",
]

# Region boxes (min_lat, max_lat, min_lon, max_lon).
REGIONS = {
    "us": Box(24.0, 49.5, -125.0, -66.5),
    "ca": Box(32.5, 42.1, -124.5, -114.0),
    "fl": Box(24.5, 31.0, -87.6, -80.0),
    "tx": Box(25.8, 36.5, -106.6, -93.5),
    "or": Box(42.0, 46.3, -124.6, -116.5),
    "wa": Box(45.5, 49.0, -124.8, -116.9),
    "az": Box(31.3, 37.0, -114.8, -109.0),
    "co": Box(37.0, 41.0, -109.1, -102.0),
    "ga": Box(30.4, 35.0, -85.6, -80.8),
}
US_BOX = REGIONS["us"]
# The weather service covers less of the north; the map view a little more.
WEATHER_BOX = Box(24.0, 48.5, -125.0, -66.5)
MAP_BOX = Box(24.0, 50.0, -125.0, -66.0)
MAP_CENTER = (39.8283, -98.5795)

# Confidence levels accepted as a query argument, and result cap.
CONFIDENCES = ("high", "nominal", "low")
RESULT_LIMIT = 1000
# Cells enriched per run.
WEATHER_CELLS_PER_RUN = 50
SOIL_CELLS_PER_RUN = 100
