"""The model's feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.functions import confidence_label, degree_bin, hour_of, month_of
from firelake.operators.cells import join_conditions
from firelake.schemas import FEATURES, SOIL_VALUES, WEATHER_VALUES

# Order in which neighbouring rows take the same way down most trees: the rows of a cell share its place and readings.
ALIKE = ["lat_bin", "lon_bin", *WEATHER_VALUES, *SOIL_VALUES, "bright_ti4", "frp", "hour"]


def detection_features(rows: DataFrame, missing_time: str | None = None) -> DataFrame:
    """Adds hour, month and degree bins."""
    time = F.col("acq_time") if missing_time is None else F.coalesce("acq_time", F.lit(missing_time))
    date = F.col("acq_date")
    return rows.withColumns(
        {
            "hour": hour_of(date, time),
            "month": month_of(date, time),
            "lat_bin": degree_bin(F.col("latitude")),
            "lon_bin": degree_bin(F.col("longitude")),
        }
    )


def feature_columns() -> list[Column]:
    """The features in model order; whatever is missing is 0."""
    counted = {"hour", "month", "lat_bin", "lon_bin"}
    return [F.coalesce(F.col(n), F.lit(0 if n in counted else 0.0)).alias(n) for n in FEATURES]


def feature_matrix(
    fires: DataFrame,
    weather: DataFrame | None = None,
    soil: DataFrame | None = None,
    order: Sequence[str] = ("fetched_at",),
    keep: str = "first",
    carry: Sequence[str | Column] = (),
) -> DataFrame:
    """`carry` columns, the thirteen features in model order, and the label.

    One row per detection, also where its cell has no reading. A reading table that is
    not given leaves its features at 0.
    """
    rows = fires
    if weather is not None or soil is not None:
        rows = join_conditions(rows, weather, soil, keep, order)
    absent = WEATHER_VALUES * (weather is None) + SOIL_VALUES * (soil is None)
    rows = detection_features(rows.withColumns({name: F.lit(0.0) for name in absent}))
    return rows.select(*carry, *feature_columns(), confidence_label(F.col("confidence")).alias("label"))
