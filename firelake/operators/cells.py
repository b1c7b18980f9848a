"""0.01 degree cells: distinct cells, one reading per cell, readings joined to detections.

Scale. Detections are the big side, up to a third of them in one cell. A reading table
is first cut down to one row per cell, with a map-side partial result, so it is bounded
by the area covered. The join key is a packed form of the grouping columns: the planner
then shuffles the per-cell rows once more for the join, both inputs of the join are plain
shuffles, and adaptive execution can split the hot cell of the detections over many
tasks (it cannot when an aggregate sits between shuffle and join).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.functions import cell_index, round_to
from firelake.operators.filters import filter_box
from firelake.schemas import (
    SOIL_CELLS_PER_RUN,
    SOIL_VALUES,
    US_BOX,
    WEATHER_BOX,
    WEATHER_CELLS_PER_RUN,
    WEATHER_VALUES,
    Box,
)

LOW_32_BITS = 0xFFFFFFFF


def packed_cell(lat_cell: Column, lon_cell: Column) -> Column:
    """Both cell numbers in one long, exactly: latitude in the high half."""
    high = F.shiftleft(lat_cell.cast("long"), 32)
    return high.bitwiseOR(lon_cell.cast("long").bitwiseAND(F.lit(LOW_32_BITS)))


def cell_of(latitude: Column, longitude: Column) -> Column:
    return packed_cell(cell_index(latitude), cell_index(longitude))


def distinct_cells(fires: DataFrame, box: Box = US_BOX, limit: int | None = None) -> DataFrame:
    """Rounded coordinates of the cells with a detection, northernmost first."""
    cells = (
        filter_box(fires, box)
        .select(cell_index(F.col("latitude")).alias("lat_cell"), cell_index(F.col("longitude")).alias("lon_cell"))
        .distinct()
    )
    if limit is not None:
        cells = cells.orderBy(F.desc("lat_cell"), "lon_cell").limit(limit)
    return cells.select((F.col("lat_cell") / 100.0).alias("latitude"), (F.col("lon_cell") / 100.0).alias("longitude"))


def weather_cells(fires: DataFrame, limit: int = WEATHER_CELLS_PER_RUN) -> DataFrame:
    return distinct_cells(fires, WEATHER_BOX, limit)


def soil_cells(fires: DataFrame, limit: int = SOIL_CELLS_PER_RUN) -> DataFrame:
    return distinct_cells(fires, US_BOX, limit)


def skip_fetched_points(points: DataFrame, observations: DataFrame, obs_date: str) -> DataFrame:
    """Points whose cell has no observation of that date yet; only that day's partition is read."""
    fetched = observations.where(F.col("obs_date") == obs_date)
    fetched = fetched.select(cell_of(F.col("latitude"), F.col("longitude")).alias("_cell"))
    keyed = points.withColumn("_cell", cell_of(F.col("latitude"), F.col("longitude")))
    return keyed.join(fetched, "_cell", "left_anti").select(*points.columns)


def _keyed(readings: DataFrame, values: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Cell, and one struct of what decides first and last followed by the values.

    Equal times are thereby settled by the values, so the choice is repeatable.
    """
    lat_cell, lon_cell = cell_index(F.col("latitude")), cell_index(F.col("longitude"))
    return readings.select(
        lat_cell.alias("lat_cell"),
        lon_cell.alias("lon_cell"),
        F.struct(*order, *values).alias(name),
    ).where("lat_cell IS NOT NULL AND lon_cell IS NOT NULL")


def _pick(keep: str) -> Callable[[str], Column]:
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    return F.min if keep == "first" else F.max


def one_per_cell(
    readings: DataFrame, values: Sequence[str], keep: str = "first", order: Sequence[str] = ("fetched_at",)
) -> DataFrame:
    """Rounded coordinates and the values of the first or last row of each cell.

    A row is taken whole: a null value in it stays null.
    """
    chosen = (
        _keyed(readings, values, order, "reading")
        .groupBy("lat_cell", "lon_cell")
        .agg(_pick(keep)("reading").alias("reading"))
    )
    return chosen.select(
        (F.col("lat_cell") / 100.0).alias("latitude"),
        (F.col("lon_cell") / 100.0).alias("longitude"),
        *[F.col(f"reading.{v}").alias(v) for v in values],
    )


def cell_conditions(
    weather: DataFrame | None,
    soil: DataFrame | None,
    keep: str = "first",
    order: Sequence[str] = ("fetched_at",),
    cells: DataFrame | None = None,
) -> DataFrame:
    """One row per cell with the chosen weather and soil readings.

    Both tables go through one aggregate, so the detections are joined, and shuffled,
    once. `cells` is a list of cells known to be short; only their readings are kept
    then, before anything is shuffled.
    """
    parts = []
    if weather is not None:
        parts.append(_keyed(weather, WEATHER_VALUES, order, "weather"))
    if soil is not None:
        parts.append(_keyed(soil, SOIL_VALUES, order, "soil"))
    if cells is not None:
        wanted = F.broadcast(cells.select("cell"))
        parts = [
            part.withColumn("cell", packed_cell(F.col("lat_cell"), F.col("lon_cell")))
            .join(wanted, "cell", "left_semi")
            .drop("cell")
            for part in parts
        ]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    pick = _pick(keep)
    # Rows of the other table are null here and are passed over.
    chosen = [pick(name).alias(name) for name in ("weather", "soil") if name in rows.columns]
    return (
        rows.groupBy("lat_cell", "lon_cell")
        .agg(*chosen)
        .withColumn("cell", packed_cell(F.col("lat_cell"), F.col("lon_cell")))
        .drop("lat_cell", "lon_cell")
    )


def join_conditions(
    fires: DataFrame,
    weather: DataFrame | None = None,
    soil: DataFrame | None = None,
    keep: str = "first",
    order: Sequence[str] = ("fetched_at",),
) -> DataFrame:
    """Every detection with the readings of its cell; absent and null values are 0.0."""
    columns = fires.columns
    wanted = WEATHER_VALUES * (weather is not None) + SOIL_VALUES * (soil is not None)
    if not wanted:
        return fires
    keyed = fires.withColumn("cell", cell_of(F.col("latitude"), F.col("longitude")))
    joined = keyed.join(cell_conditions(weather, soil, keep, order), "cell", "left")
    return joined.select(*columns, *[condition_value(v).alias(v) for v in wanted])


def condition_value(name: str) -> Column:
    table = "weather" if name in WEATHER_VALUES else "soil"
    return F.coalesce(F.col(f"{table}.{name}"), F.lit(0.0))


def join_weather_first(fires: DataFrame, weather: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return join_conditions(fires, weather=weather, keep="first", order=order)


def join_env_first(fires: DataFrame, soil: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return join_conditions(fires, soil=soil, keep="first", order=order)


def join_weather_last(fires: DataFrame, weather: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return join_conditions(fires, weather=weather, keep="last", order=order)


def join_env_last(fires: DataFrame, soil: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return join_conditions(fires, soil=soil, keep="last", order=order)


def join_conditions_bounded(
    short_list: DataFrame,
    weather: DataFrame | None,
    soil: DataFrame | None,
    keep: str = "last",
    order: Sequence[str] = ("fetched_at",),
) -> DataFrame:
    """As `join_conditions`, for a result list with a fixed cap (the newest 1000).

    The list bounds the broadcasts: its cells reduce the reading tables in place, and at
    most one row per listed cell comes back. Neither reading table is shuffled whole.
    """
    columns = short_list.columns
    wanted = WEATHER_VALUES * (weather is not None) + SOIL_VALUES * (soil is not None)
    absent = WEATHER_VALUES * (weather is None) + SOIL_VALUES * (soil is None)
    joined = short_list
    if wanted:
        joined = short_list.withColumn("cell", cell_of(F.col("latitude"), F.col("longitude")))
        conditions = cell_conditions(weather, soil, keep, order, cells=joined.select("cell").distinct())
        joined = joined.join(F.broadcast(conditions), "cell", "left")
    values = [condition_value(v).alias(v) for v in wanted] + [F.lit(0.0).alias(v) for v in absent]
    return joined.select(*columns, *values)


def rounded_point(rows: DataFrame) -> DataFrame:
    """The rounded coordinates of each row, as the stored readings carry them."""
    return rows.select(round_to(F.col("latitude"), 2).alias("latitude"), round_to(F.col("longitude"), 2).alias("longitude"))
