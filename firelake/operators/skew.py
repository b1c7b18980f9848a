"""Joins whose big side may hold one key in a large share of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_reduced(rows: DataFrame, reduced: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Join `rows` with a table that was grouped by `key`, so that a hot key can be split.

    Adaptive execution splits a hot partition of a join only while both inputs are plain
    shuffles. A grouped input would be joined on the shuffle of its grouping, with the
    aggregate in between. One join column more than was grouped by makes the planner
    shuffle the few grouped rows once more instead.
    """
    extra = F.xxhash64(key[-1])
    joined = rows.withColumn("_extra", extra).join(reduced.withColumn("_extra", extra), [*key, "_extra"], how)
    return joined.drop("_extra")
