"""Insert without duplicates, and what is already there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.operators.skew import join_reduced
from firelake.schemas import DETECTION_KEY


def known_keys(table: DataFrame, key: Sequence[str] = tuple(DETECTION_KEY)) -> DataFrame:
    """Distinct complete keys. Copies of one key collapse before the shuffle; a key with
    a null in it can match nothing and is left out."""
    complete = " AND ".join(f"{name} IS NOT NULL" for name in key)
    return table.select(*key).where(complete).distinct()


def dedup_insert(batch: DataFrame, table: DataFrame, key: Sequence[str] = tuple(DETECTION_KEY)) -> DataFrame:
    """Rows of the batch whose key the table does not hold.

    Copies inside the batch are all kept, and so are rows with a null in the key.
    """
    return join_reduced(batch, known_keys(table, key), key, "left_anti").select(*batch.columns)


def flag_new(batch: DataFrame, table: DataFrame, key: Sequence[str] = tuple(DETECTION_KEY)) -> DataFrame:
    """The batch with `is_new`, for counting in one pass."""
    known = known_keys(table, key).withColumn("_known", F.lit(True))
    joined = join_reduced(batch, known, key, "left")
    return joined.select(*batch.columns, F.col("_known").isNull().alias("is_new"))


def ingest_counts(batch: DataFrame, table: DataFrame, key: Sequence[str] = tuple(DETECTION_KEY)) -> DataFrame:
    """rows_in, inserted and skipped of one insert."""
    flags = flag_new(batch.select(*key), table, key)
    counts = flags.agg(F.count("*").alias("rows_in"), F.count_if("is_new").alias("inserted"))
    return counts.withColumn("skipped", F.col("rows_in") - F.col("inserted"))


def within_batch_dates(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The part of the table between the first and last date of the batch.

    The two dates are scalar subqueries on the partition column, so the scan skips the
    other partitions at run time. Rows outside cannot share a key with the batch.
    """
    first = batch.agg(F.min("acq_date")).scalar()
    last = batch.agg(F.max("acq_date")).scalar()
    return table.where((F.col("acq_date") >= first) & (F.col("acq_date") <= last))


def count_by_date(fires: DataFrame) -> DataFrame:
    return fires.groupBy("acq_date").agg(F.count("*").alias("n"))


def distinct_dates(fires: DataFrame) -> DataFrame:
    return fires.select("acq_date").where("acq_date IS NOT NULL").distinct()


def skip_loaded_windows(windows: DataFrame, fires: DataFrame) -> DataFrame:
    """Windows whose start date no detection has."""
    loaded = distinct_dates(fires).withColumnRenamed("acq_date", "start_date")
    return windows.join(loaded, "start_date", "left_anti")


def union_sources(*feeds: DataFrame) -> DataFrame:
    """Rows of all feeds, matched by column name."""
    rows = feeds[0]
    for feed in feeds[1:]:
        rows = rows.unionByName(feed)
    return rows
