"""Folder listing through the cluster's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern; names only, no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]
