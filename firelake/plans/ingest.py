"""Batch ingest: detections into the fires table, readings for their cells."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.functions import cell_index
from firelake.operators.cells import skip_fetched_points, soil_cells, weather_cells
from firelake.operators.dedup import dedup_insert, skip_loaded_windows
from firelake.operators.skew import join_reduced
from firelake.schemas import (
    ENVIRONMENT,
    FIRES,
    SOIL_CELLS_PER_RUN,
    SOIL_VALUES,
    WEATHER,
    WEATHER_CELLS_PER_RUN,
    WEATHER_VALUES,
)
from firelake.sources.csv import Window, scan_window_list
from firelake.sources.days import update_day_counts
from firelake.sources.latest import merge_latest
from firelake.sources.payloads import parse_forecast_json, parse_gridpoint_json, parse_soil_json
from firelake.sources.tables import append_rows, scan_or_empty, staged

CELL = ["lat_cell", "lon_cell"]
GRID = ["grid_id", "grid_x", "grid_y"]


class Counts(NamedTuple):
    rows_in: int
    inserted: int
    skipped: int


def batch_days(batch: DataFrame) -> list[str]:
    """The distinct dates of a batch, each of which is a folder of the table."""
    dates = batch.where("acq_date IS NOT NULL").select("acq_date").distinct()
    return sorted(r[0] for r in dates.collect())


def stored_days(table: DataFrame, days: Sequence[str]) -> DataFrame:
    """The partitions of the table that rows of these days can collide with.

    They are listed in the filter; an anti-join alone would read every partition.
    """
    return table.where(F.col("acq_date").isin([*days])) if days else table.where(F.lit(False))


def insert_detections(spark: SparkSession, batch: DataFrame, path: str, source: str) -> Counts:
    """Append the detections the table does not hold, and count; the counts per day are kept up.

    The inserted rows are counted while they are written, so nothing is joined again for
    it. Inserting the same batch twice adds nothing the second time.
    """
    batch = batch.select(*FIRES.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows_in = batch.count()
        if rows_in == 0:
            return Counts(0, 0, 0)
        days = batch_days(batch)
        known = stored_days(scan_or_empty(spark, path, FIRES), days)
        written = Observation()
        append_rows(dedup_insert(batch, known), path, FIRES, "acq_date", source, written)
        inserted = written.get["rows"]
        if inserted:
            update_day_counts(spark, path, source, days)
        return Counts(rows_in, inserted, rows_in - inserted)
    finally:
        batch.unpersist()


def backfill(spark: SparkSession, windows: Iterable[Window], path: str, source: str = "archive") -> Counts:
    """Load the landed windows whose first day neither the table nor an earlier window has.

    Of windows with one start date the first counts. The rest goes in as one job; rows the
    table holds already are skipped.
    """
    first = {}
    for window in windows:
        first.setdefault(window.start_date, window)
    if not first:
        return Counts(0, 0, 0)
    listed = spark.createDataFrame([(start,) for start in first], "start_date string")
    stored = scan_or_empty(spark, path, FIRES).where(F.col("acq_date").isin([*first]))
    missing = {r[0] for r in skip_loaded_windows(listed, stored).collect()}
    left = [w for start, w in first.items() if start in missing]
    # Which start dates the rows of each window hold: at most one pair per two windows.
    landed = scan_window_list(spark, left)
    held = landed.where(F.col("acq_date").isin([w.start_date for w in left])).select("window_start", "acq_date").distinct()
    starts_in: dict[str, set[str]] = {}
    for row in held.collect():
        starts_in.setdefault(row["window_start"], set()).add(row["acq_date"])
    loaded: set[str] = set()
    accepted = []
    for window in left:
        if window.start_date not in loaded:
            accepted.append(window)
            loaded |= starts_in.get(window.start_date, set())
    return insert_detections(spark, scan_window_list(spark, accepted), path, source)


def _wanted_cells(points: DataFrame, path: str, schema: T.StructType, obs_date: str) -> DataFrame:
    """(lat_cell, lon_cell) of the points that have no reading of that date."""
    left = skip_fetched_points(points, scan_or_empty(points.sparkSession, path, schema), obs_date)
    return left.select(*_cell_columns())


def _cell_columns() -> list[Column]:
    return [cell_index(F.col(c)).alias(name) for c, name in (("latitude", "lat_cell"), ("longitude", "lon_cell"))]


def _answers(payloads: DataFrame, cells: DataFrame) -> DataFrame:
    """The landed answers for the wanted cells, as (lat_cell, lon_cell, landed_at, payload)."""
    keyed = payloads.select(*_cell_columns(), "landed_at", "payload")
    return keyed.join(cells, CELL, "left_semi")


def _last(answers: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the answer that landed last, per key; equal times are settled by the values."""
    last = answers.groupBy(*key).agg(F.max(F.struct("landed_at", *values)).alias("last"))
    return last.select(*key, *[F.col(f"last.{v}").alias(v) for v in values])


def _store(readings: DataFrame, path: str, schema: T.StructType, kind: str, obs_date: str, fetched_at: str) -> int:
    """Append to the reading table, and merge into the newest readings beside it."""
    rows = readings.withColumns(
        {
            "latitude": F.col("lat_cell") / 100.0,
            "longitude": F.col("lon_cell") / 100.0,
            "obs_date": F.lit(obs_date),
            "fetched_at": F.lit(fetched_at).cast("timestamp"),
        }
    )
    rows = staged(rows.select(*schema.fieldNames()), "readings")
    written = Observation()
    append_rows(rows, path, schema, "obs_date", written=written)
    merge_latest(rows, path, kind)
    return written.get["rows"]


def grid_of_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(lat_cell, lon_cell, grid_id, grid_x, grid_y): the forecast grid square of each cell that has one.

    `points` are landed answers (latitude, longitude, landed_at, payload); one that names no square, as for
    a place at sea, counts for nothing, and of several the last one landed counts.
    """
    return _last(parse_gridpoint_json(_answers(points, cells)), CELL, GRID)


def readings_of_grids(forecasts: DataFrame, grids: DataFrame) -> DataFrame:
    """(grid_id, grid_x, grid_y) of the wanted squares with the readings of the last usable forecast landed.

    `forecasts` are landed answers (grid_id, grid_x, grid_y, landed_at, payload). Only those of wanted squares are parsed.
    """
    wanted = forecasts.select(*[F.col(c).cast("string").alias(c) for c in GRID], "landed_at", "payload")
    wanted = wanted.join(grids.select(*GRID).distinct(), GRID, "left_semi")
    return _last(parse_forecast_json(wanted), GRID, WEATHER_VALUES)


def ingest_weather(
    fires: DataFrame,
    points: DataFrame,
    forecasts: DataFrame,
    path: str,
    obs_date: str,
    fetched_at: str,
    limit: int | None = WEATHER_CELLS_PER_RUN,
) -> int:
    """Store the forecast of each detection cell not stored today; returns rows added.

    A cell is looked up in two steps: its grid square, then that square's forecast, which goes back to all
    cells of the square. Forecasts are parsed once per square, not per cell; the cells of a
    square that holds a large share of them are split over tasks.
    """
    cells = _wanted_cells(weather_cells(fires, limit), path, WEATHER, obs_date)
    resolved = staged(grid_of_cells(points, cells), "grids")
    readings = readings_of_grids(forecasts, resolved)
    return _store(join_reduced(resolved, readings, GRID, "inner"), path, WEATHER, "weather", obs_date, fetched_at)


def ingest_soil(
    fires: DataFrame, payloads: DataFrame, path: str, obs_date: str, fetched_at: str, limit: int | None = SOIL_CELLS_PER_RUN
) -> int:
    """As `ingest_weather`, for soil moisture, vapour pressure deficit and evapotranspiration.

    `payloads` are landed answers (latitude, longitude, landed_at, payload), one step away from their cells.
    """
    cells = _wanted_cells(soil_cells(fires, limit), path, ENVIRONMENT, obs_date)
    readings = _last(parse_soil_json(_answers(payloads, cells)), CELL, SOIL_VALUES)
    return _store(readings, path, ENVIRONMENT, "soil", obs_date, fetched_at)
