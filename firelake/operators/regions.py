"""Region membership."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.operators.filters import in_box
from firelake.schemas import REGIONS, Box


def join_region_boxes(rows: DataFrame, regions: Mapping[str, Box] = REGIONS) -> DataFrame:
    """One row per detection and region it lies in; boxes overlap, so it may be several.

    The boxes are a fixed handful, so membership is row-local: no join, no shuffle.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = F.array(*[F.when(in_box(lat, lon, box), F.lit(name)) for name, box in regions.items()])
    return rows.withColumn("region", F.explode(F.array_compact(inside)))
