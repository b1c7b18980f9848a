"""Detections per day, kept beside a fires table, so that the newest days are found without reading it.

`<fires>_days/source=<feed>/acq_date=<day>/` holds, per confidence level of a day, how many of its detections
lie in each region. A day is counted anew from the table whenever rows are added to it, after they are: a
count that is missing or too low, as after a failure in between, makes a reader look at more days, never at
fewer than it needs. Rows without a date are not counted; they sort behind all others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.operators.filters import check_confidence, check_region, in_box
from firelake.schemas import FIRES, REGIONS, US_BOX
from firelake.sources.files import matching_paths
from firelake.sources.tables import scan_or_empty

COUNTS = T.StructType(
    [T.StructField("acq_date", T.StringType()), T.StructField("level", T.StringType())]
    + [T.StructField(f"n_{region}", T.LongType()) for region in REGIONS]
)


def days_path(path: str) -> str:
    return f"{path.rstrip('/')}_days"


def count_days(fires: DataFrame) -> DataFrame:
    """(acq_date, level, n_<region>...): detections in the US box and in each region's, by day and level."""
    place = F.col("latitude"), F.col("longitude")
    counts = [F.count_if(in_box(*place, US_BOX) & in_box(*place, box)).alias(f"n_{name}") for name, box in REGIONS.items()]
    dated = fires.where("acq_date IS NOT NULL")
    return dated.groupBy("acq_date", F.lower("confidence").alias("level")).agg(*counts)


def update_day_counts(spark: SparkSession, path: str, source: str, days: Iterable[str] | None = None) -> None:
    """Count these days of a feed, or all of them, anew; other days keep their counts."""
    rows = scan_or_empty(spark, f"{path.rstrip('/')}/source={source}", FIRES)
    if days is not None:
        rows = rows.where(F.col("acq_date").isin([*days]))
    writer = count_days(rows).repartition("acq_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("acq_date").parquet(f"{days_path(path)}/source={source}")


def scan_day_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """The counts beside a fires table; None where nobody has kept any."""
    folder = days_path(path)
    return spark.read.schema(COUNTS).parquet(folder) if matching_paths(spark, f"{folder}/source=*") else None


def oldest_day_needed(counts: DataFrame, limit: int, region: str | None = None, confidence: str | None = None) -> str | None:
    """The day from which on at least `limit` rows pass the filters; None if there are fewer in all.

    One row per day goes through the window.
    """
    level = check_confidence(confidence)
    kept = counts if level is None else counts.where(F.col("level") == level)
    per_day = kept.groupBy("acq_date").agg(F.sum(f"n_{check_region(region) or 'us'}").alias("n"))
    newest = Window.orderBy(F.desc("acq_date"))
    reached = per_day.withColumn("so_far", F.sum("n").over(newest)).where(F.col("so_far") >= limit)
    return reached.agg(F.max("acq_date")).first()[0]
