"""The newest reading of each cell, kept up by every append of readings.

`<readings>_latest/band=<degree of latitude>/` holds one row per cell. Adding readings merges them with the
bands they touch: the later `fetched_at` wins, ties are settled by the values. So a lookup joins a table that
is bounded by the area covered, instead of grouping all history. The merge gives the same table in any order of
the appends and when one is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firelake.functions import cell_index
from firelake.operators.cells import cell_of
from firelake.schemas import SOIL_VALUES, WEATHER_VALUES
from firelake.sources.files import matching_paths
from firelake.sources.tables import staged

VALUES = {"weather": WEATHER_VALUES, "soil": SOIL_VALUES}


def latest_path(path: str) -> str:
    return f"{path.rstrip('/')}_latest"


def band_of(latitude: Column) -> Column:
    """Whole degree of the cell, so that a cell lies in one band."""
    return F.floor(cell_index(latitude) / 100).cast("int")


def _schema(kind: str) -> str:
    values = ", ".join(f"{v}: double" for v in VALUES[kind])
    return f"cell long, reading struct<fetched_at: timestamp, {values}>, band int"


def scan_latest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(cell, reading, band) of the table beside `path`; no rows where there is none."""
    folder = latest_path(path)
    if not matching_paths(spark, f"{folder}/band=*"):
        return spark.createDataFrame([], _schema(kind))
    return spark.read.schema(_schema(kind)).parquet(folder)


def merge_latest(readings: DataFrame, path: str, kind: str) -> None:
    """Merge new readings into the table beside `path`; only the bands they touch are read and written."""
    spark = readings.sparkSession
    place = F.col("latitude"), F.col("longitude")
    reading = F.struct("fetched_at", *VALUES[kind]).alias("reading")
    new = readings.select(cell_of(*place).alias("cell"), reading, band_of(place[0]).alias("band"))
    # The newest of the batch first: what is merged is one row per cell.
    new = new.where("cell IS NOT NULL AND band IS NOT NULL").groupBy("band", "cell").agg(F.max("reading").alias("reading"))
    new = staged(new.select("cell", "reading", "band"), "latest")
    bands = [r["band"] for r in new.select("band").distinct().collect()]
    if not bands:
        return
    both = new.unionByName(scan_latest(spark, path, kind).where(F.col("band").isin(bands)))
    merged = staged(both.groupBy("band", "cell").agg(F.max("reading").alias("reading")), "merged")
    writer = merged.select("cell", "reading", "band").repartition("band").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("band").parquet(latest_path(path))


def latest_values(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(latitude, longitude, values) of each cell."""
    rows = scan_latest(spark, path, kind)
    # The halves of the packed cell, each with its sign.
    high, low = F.shiftright("cell", 32), F.shiftright(F.shiftleft("cell", 32), 32)
    return rows.select(
        (high / 100.0).alias("latitude"), (low / 100.0).alias("longitude"), *[F.col(f"reading.{v}").alias(v) for v in VALUES[kind]]
    )


def join_latest(fires: DataFrame, path: str, kind: str, bands: Sequence[int] | None = None) -> DataFrame:
    """Every detection with the newest reading of its cell; absent and null values are 0.0.

    One row per cell on the right and no grouping in between, so a hot cell of the detections can be split.
    `bands`, if the detections are known to lie in few, are the only folders read.
    """
    rows = scan_latest(fires.sparkSession, path, kind)
    if bands is not None:
        rows = rows.where(F.col("band").isin([*bands]))
    keyed = fires.withColumn("_cell", cell_of(F.col("latitude"), F.col("longitude")))
    joined = keyed.join(rows.select(F.col("cell").alias("_cell"), "reading"), "_cell", "left")
    return joined.select(*fires.columns, *[F.coalesce(f"reading.{v}", F.lit(0.0)).alias(v) for v in VALUES[kind]])


def join_latest_bounded(short_list: DataFrame, weather: str, soil: str) -> DataFrame:
    """As `join_latest` with both tables, for a list with a fixed cap: its bands are looked up first."""
    found = short_list.select(band_of(F.col("latitude")).alias("band")).where("band IS NOT NULL").distinct()
    bands = [r["band"] for r in found.collect()]
    return join_latest(join_latest(short_list, weather, "weather", bands), soil, "soil", bands)
