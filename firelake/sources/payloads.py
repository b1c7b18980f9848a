"""Landed JSON payloads of the weather and soil services, one text column each.

A payload is parsed in a generator (`inline`), which runs once per row. As a plain column
it would be parsed again for every condition and value taken from it, since conditions
are moved below the projection that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.functions import (
    array_mean_nonnull,
    fahrenheit_to_c,
    humidity_pct,
    parse_wind_kmh,
    round_to,
    to_number,
)

GRIDPOINT = "properties struct<gridId: string, gridX: string, gridY: string>"
# Numbers as text where the payload may quote them.
FORECAST = """properties struct<periods: array<struct<
    windSpeed: string, temperature: string, relativeHumidity: struct<value: string>>>>"""
SOIL = """hourly struct<soil_moisture_0_to_1cm: array<double>>,
    daily struct<vapor_pressure_deficit_max: array<string>, et0_fao_evapotranspiration: array<string>>"""


def parse_gridpoint_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds grid_id, grid_x, grid_y; a payload without all three is dropped."""
    props = F.from_json(F.col(payload), GRIDPOINT)["properties"]
    kept = [name for name in payloads.columns if name != payload]
    return (
        payloads.select(*kept, F.inline(F.array(props)))
        .where("gridId IS NOT NULL AND gridX IS NOT NULL AND gridY IS NOT NULL")
        .withColumnsRenamed({"gridId": "grid_id", "gridX": "grid_x", "gridY": "grid_y"})
    )


def parse_forecast_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the readings of the first forecast period; a payload without one is dropped."""
    periods = F.from_json(F.col(payload), FORECAST)["properties"]["periods"]
    kept = [name for name in payloads.columns if name != payload]
    return payloads.select(*kept, F.inline(F.slice(periods, 1, 1))).select(
        *kept,
        # An absent speed reads as no wind.
        parse_wind_kmh(F.col("windSpeed")).alias("wind_speed_kmh"),
        humidity_pct(to_number(F.col("relativeHumidity.value"))).alias("humidity_pct"),
        fahrenheit_to_c(to_number(F.col("temperature"))).alias("temp_c"),
    )


def parse_soil_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the hourly mean of soil moisture and the first daily values.

    A missing series, or an empty daily one, drops the payload; a null value reads as 0.
    """
    kept = [name for name in payloads.columns if name != payload]
    hourly = F.col("hourly.soil_moisture_0_to_1cm")
    vpd = F.col("daily.vapor_pressure_deficit_max")
    et0 = F.col("daily.et0_fao_evapotranspiration")

    def first(series: Column) -> Column:
        return round_to(F.coalesce(to_number(F.get(series, F.lit(0))), F.lit(0.0)), 3)

    return (
        payloads.select(*kept, F.inline(F.array(F.from_json(F.col(payload), SOIL))))
        .where(hourly.isNotNull() & (F.size(vpd) > 0) & (F.size(et0) > 0))
        .select(
            *kept,
            array_mean_nonnull(hourly).alias("soil_moisture"),
            first(vpd).alias("vpd_kpa"),
            first(et0).alias("et0_mm"),
        )
    )
