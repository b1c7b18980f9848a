"""Test-build result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILD = """build_id string, sha string, run_number long,
    summary struct<passed: long, failed: long, total: long>,
    tests array<struct<nodeid: string, outcome: string>>"""


def scan_build_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per build; a build without an id takes it from its file name.

    `run_order` is the run number with missing as 0.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(?:build-)?(.*)\.json$", 1)
    return (
        spark.read.schema(BUILD)
        .option("multiLine", multi_line)
        .json(path)
        .withColumn("build_id", F.coalesce(F.nullif(F.col("build_id"), F.lit("")), name))
        .withColumn("run_order", F.coalesce(F.col("run_number"), F.lit(0)))
    )


def build_results(builds: DataFrame) -> DataFrame:
    """One row per test of a build: build_id, run_order, position, nodeid, outcome."""
    return builds.select(
        "build_id", "run_order", F.posexplode("tests").alias("position", "test")
    ).select(
        "build_id",
        "run_order",
        "position",
        F.col("test.nodeid").alias("nodeid"),
        F.coalesce(F.col("test.outcome"), F.lit("unknown")).alias("outcome"),
    )
