"""Tables kept as Parquet folders: read, create, append.

`fires` is laid out as `fires/source=<feed>/acq_date=<day>/`. Each feed appends inside
its own `source=` folder, so two feeds never share a write job's staging folder, and a
reader of the root sees both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.schemas import ENVIRONMENT, FIRES, WEATHER
from firelake.session import work_dir
from firelake.sources.files import matching_paths

# Table names.
# Where rows are dealt over the cores: rows of a task at most, and rows of a table that stays as it is.
MOST_ROWS, LEAST_ROWS = 1_000_000, 20_000
FIRES_TABLE, WEATHER_TABLE, SOIL_TABLE = "fires", "weather_observations", "environmental_conditions"


def scan_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with its fixed schema. Partition columns keep their declared type,
    so `acq_date` stays text and compares like the text of a new batch."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def scan_limit(table: DataFrame, limit: int, *order: Column) -> DataFrame:
    """First rows of a table; give an order to make the choice repeatable."""
    return (table.orderBy(*order) if order else table).limit(limit)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table nobody has written yet reads as no rows."""
    return scan_table(spark, path, schema) if matching_paths(spark, path) else empty(spark, schema)


def load_all_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fires, weather and soil readings under one folder; a missing table reads as no rows."""
    return (
        scan_or_empty(spark, f"{root}/{FIRES_TABLE}", FIRES),
        scan_or_empty(spark, f"{root}/{WEATHER_TABLE}", WEATHER),
        scan_or_empty(spark, f"{root}/{SOIL_TABLE}", ENVIRONMENT),
    )


def staged(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared work folder and read again, for use in several places."""
    path = work_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, n_rows: int | None = None, alike: Sequence[str] = ()) -> DataFrame:
    """The rows dealt evenly over all cores, for work that costs much more per row than reading it.

    Tasks that follow the bytes of a table leave cores idle then: a few large files, or one. With the number of
    rows given, a task gets at most MOST_ROWS, and a table of LEAST_ROWS or fewer stays as it is. A task
    takes its rows in the order of the columns `alike`.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if n_rows is None:
        dealt = rows.repartition(max(4 * cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    elif n_rows <= LEAST_ROWS:
        return rows
    else:
        dealt = rows.repartition(cores * math.ceil(n_rows / (cores * MOST_ROWS)))
    return dealt.sortWithinPartitions(*alike) if alike else dealt


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create the folder with an empty file of the schema unless it is there."""
    if not matching_paths(spark, path):
        empty(spark, schema).coalesce(1).write.mode("ignore").parquet(path)


def append_rows(
    rows: DataFrame,
    path: str,
    schema: T.StructType,
    partition_by: str | None = None,
    source: str | None = None,
    written: Observation | None = None,
) -> None:
    """Append in schema order, matched by name; `written` counts the rows on their way.

    The rebalance hint gathers the rows of a partition value into few files and, under
    adaptive execution, splits a value that holds most of the rows over many tasks.
    """
    rows = rows.select(*schema.fieldNames())
    if partition_by is not None:
        rows = rows.hint("rebalance", F.col(partition_by))
    if written is not None:
        # Above the shuffle, where it also stays when no row comes through.
        rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    if source is not None:
        path = f"{path.rstrip('/')}/source={source}"
    writer = rows.write.mode("append")
    (writer if partition_by is None else writer.partitionBy(partition_by)).parquet(path)
