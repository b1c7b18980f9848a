"""Counts, headline values and map summaries.

Every grouping here keeps partial results per input split; no group is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.functions import round_to, severity
from firelake.schemas import MAP_BOX, MAP_CENTER

# Map grid and size classes of a cluster.
CLUSTER_RADIUS_PX = 40
LARGE_CLUSTER, MEDIUM_CLUSTER = 100, 10
TILE_PX = 256
# Zoom of the empty map, and limits for a map on one or more detections.
EMPTY_ZOOM, CLOSEST_ZOOM, FARTHEST_ZOOM = 5, 7, 4
# Fixed value: pixels that stay free on each side of the shown bounds.
PADDING_PX = 50
# Size of the map on the page, and the latitude at which the projected map ends.
VIEW_PX = (1024, 768)
MERCATOR_LIMIT = 85.0511287798
MICRO = 1_000_000.0
STALE_AFTER_SECONDS = 7 * 24 * 3600


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def _severity_counts(brightness: str, frp: str) -> list[Column]:
    level = severity(F.col(brightness), F.col(frp))
    return [F.count_if(level == name).alias(name) for name in ("critical", "warning", "monitor")]


def severity_counts(rows: DataFrame, brightness: str = "brightness", frp: str = "frp") -> DataFrame:
    """Three rows, also when a severity does not occur."""
    counts = rows.agg(*_severity_counts(brightness, frp))
    return counts.select(
        F.stack(
            F.lit(3),
            *[part for name in counts.columns for part in (F.lit(name), F.col(name))],
        ).alias("severity", "n")
    )


def kpi_summary(rows: DataFrame) -> DataFrame:
    """Severity counts, highest risk and newest date over prepared events."""
    return rows.agg(
        *_severity_counts("brightness", "frp"),
        F.max("risk").alias("max_risk"),
        F.coalesce(F.max("acq_date"), F.lit("N/A")).alias("latest_date"),
    )


def staleness(rows: DataFrame, now: datetime) -> DataFrame:
    """Whether the newest date began more than seven days before `now`.

    False without any date, and false when one date does not parse.
    """
    now = now if now.tzinfo else now.replace(tzinfo=UTC)
    given = F.nullif(F.col("acq_date"), F.lit(""))
    day = given.try_cast("date")
    start = F.datediff(F.max(day), F.lit("1970-01-01").cast("date")).cast("double") * 86400
    stale = F.lit(now.timestamp()) - start > STALE_AFTER_SECONDS
    unread = F.count_if(given.isNotNull() & day.isNull())
    return rows.agg(F.when(unread > 0, F.lit(False)).otherwise(F.coalesce(stale, F.lit(False))).alias("is_stale"))


def _mercator(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Place on the square web-mercator map: 0 to 1 eastwards and southwards."""
    sin = F.sin(F.radians(F.least(F.greatest(latitude, F.lit(-MERCATOR_LIMIT)), F.lit(MERCATOR_LIMIT))))
    return (longitude + 180.0) / 360.0, 0.5 - F.log((1.0 + sin) / (1.0 - sin)) / (4.0 * math.pi)


def bounding_box(
    rows: DataFrame, latitude: str = "latitude", longitude: str = "longitude", view: tuple[int, int] = VIEW_PX
) -> DataFrame:
    """Bounds of the finite coordinates, and the view of the map that shows them.

    The zoom is the closest whole one at which the bounds fit into a `view` of so many pixels less the
    padding, between FARTHEST_ZOOM and CLOSEST_ZOOM; the centre is that of the bounds on the projected map
    while it lies on the map, else the national one. A row that is the only one is its own centre.
    """
    lat, lon = F.col(latitude), F.col(longitude)
    bound = F.lit(math.inf)
    # NaN sorts above infinity in Spark, so the comparison drops it too.
    finite = F.coalesce((F.abs(lat) < bound) & (F.abs(lon) < bound), F.lit(False))

    def over(value: Column) -> Column:
        return F.when(finite, value)

    box = rows.agg(
        F.count_if(finite).alias("n"),
        F.min(over(lat)).alias("min_lat"),
        F.max(over(lat)).alias("max_lat"),
        F.min(over(lon)).alias("min_lon"),
        F.max(over(lon)).alias("max_lon"),
        F.count("*").alias("rows"),
    )
    west, north = _mercator(F.col("max_lat"), F.col("min_lon"))
    east, south = _mercator(F.col("min_lat"), F.col("max_lon"))
    # How often the bounds, at zoom 0, go into the view.
    fits = F.least(*[
        F.when(extent > 0, (size - 2 * PADDING_PX) / TILE_PX / extent) for extent, size in ((east - west, view[0]), (south - north, view[1]))
    ])
    # Two decimals first: a whole zoom that rounding has left just short counts.
    closest = F.floor(round_to(F.log2(fits), 2)).cast("int")
    zoom = F.greatest(F.lit(FARTHEST_ZOOM), F.least(F.lit(CLOSEST_ZOOM), F.coalesce(closest, F.lit(CLOSEST_ZOOM))))
    mid_lat = F.degrees(2.0 * F.atan(F.exp((0.5 - (north + south) / 2.0) * (2.0 * math.pi))) - math.pi / 2.0)
    mid_lat, mid_lon = round_to(mid_lat, 6), round_to(F.expr("(min_lon + max_lon) / 2"), 6)
    on_map = mid_lat.between(MAP_BOX.min_lat, MAP_BOX.max_lat) & mid_lon.between(MAP_BOX.min_lon, MAP_BOX.max_lon)
    alone = (F.col("rows") == 1) & (F.col("n") == 1)
    return box.withColumns(
        {
            "center_lat": F.when(alone, F.col("min_lat")).when(on_map, mid_lat).otherwise(F.lit(MAP_CENTER[0])),
            "center_lon": F.when(alone, F.col("min_lon")).when(on_map, mid_lon).otherwise(F.lit(MAP_CENTER[1])),
            "zoom": F.when(F.col("n") > 0, zoom).otherwise(EMPTY_ZOOM),
            "max_zoom": F.when(F.col("n") > 0, CLOSEST_ZOOM).otherwise(EMPTY_ZOOM),
        }
    ).drop("rows")


def heat_points(rows: DataFrame) -> DataFrame:
    """Weight of each event of positive risk against the highest risk, at least 1.

    The highest risk is a scalar subquery: one value, no join.
    """
    highest = rows.agg(F.greatest(F.max("risk"), F.lit(1.0))).scalar()
    return rows.where(F.col("risk") > 0).withColumn("weight", F.col("risk") / highest)


def _cluster_columns() -> tuple[Column, Column, Column]:
    size = F.when(F.col("n") >= LARGE_CLUSTER, "large").when(F.col("n") >= MEDIUM_CLUSTER, "medium").otherwise("small")
    means = [(F.round(F.col(f"{c}_sum") / F.col("n")) / MICRO).alias(name) for c, name in (("lat", "latitude"), ("lon", "longitude"))]
    return *means, size.alias("size")


def _tiles(rows: DataFrame, zoom: int, radius_px: int, latitude: str, longitude: str) -> DataFrame:
    """Count and sums of the coordinates per square of the pixel grid.

    The sums are of whole millionths of a degree: they do not depend on the order of the rows.
    """
    x, y = _mercator(F.col(latitude), F.col(longitude))
    squares = TILE_PX * 2**zoom / radius_px
    return (
        rows.where(F.abs(latitude) < 90.0)
        .groupBy(F.floor(x * squares).alias("grid_x"), F.floor(y * squares).alias("grid_y"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.round(F.col(latitude) * MICRO).cast("long")).alias("lat_sum"),
            F.sum(F.round(F.col(longitude) * MICRO).cast("long")).alias("lon_sum"),
        )
    )


def cluster_counts(
    rows: DataFrame,
    zoom: int,
    radius_px: int = CLUSTER_RADIUS_PX,
    latitude: str = "latitude",
    longitude: str = "longitude",
) -> DataFrame:
    """Events per square of the web-mercator pixel grid, with centre and size class."""
    return _tiles(rows, zoom, radius_px, latitude, longitude).select("grid_x", "grid_y", "n", *_cluster_columns())


def cluster_pyramid(
    rows: DataFrame,
    zooms: Sequence[int] = tuple(range(CLOSEST_ZOOM + 1)),
    radius_px: int = CLUSTER_RADIUS_PX,
    latitude: str = "latitude",
    longitude: str = "longitude",
) -> DataFrame:
    """`cluster_counts` of every zoom, with a column `zoom`, from one pass over the events.

    A square of one zoom is cut into four by the next, so the events are grouped once, at the closest
    zoom; the squares, as many as the map has at most, are then rolled up by halving their numbers.
    """
    last = max(zooms)
    tiles = _tiles(rows, last, radius_px, latitude, longitude)
    levels = [F.struct(F.lit(z).alias("zoom"), F.lit(2 ** (last - z)).alias("side")) for z in sorted(set(zooms))]
    levels = tiles.withColumn("level", F.explode(F.array(*levels))).select("*", "level.*")
    x, y = (F.floor(F.col(c) / F.col("side")).alias(c) for c in ("grid_x", "grid_y"))
    rolled = levels.groupBy("zoom", x, y).agg(
        F.sum("n").alias("n"), F.sum("lat_sum").alias("lat_sum"), F.sum("lon_sum").alias("lon_sum")
    )
    return rolled.select("zoom", "grid_x", "grid_y", "n", *_cluster_columns())


def request_metrics(log: DataFrame, endpoint: str, latency_ms: str, at: str) -> DataFrame:
    """Requests and latest latency per endpoint of a request log."""
    return log.groupBy(F.col(endpoint).alias("endpoint")).agg(
        F.count("*").alias("requests"),
        round_to(F.max_by(F.col(latency_ms), F.struct(at, latency_ms)), 2).alias("last_response_ms"),
    )
