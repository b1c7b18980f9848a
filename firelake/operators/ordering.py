"""Newest-first lists and sorted views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firelake.functions import confidence_rank
from firelake.schemas import RESULT_LIMIT

SORT_KEYS = ("brightness", "frp", "risk", "confidence")


def newest_first(tie_break: Sequence[str] = ()) -> list[Column]:
    """Lexical date and time, newest first, nulls last; then whatever makes it unique."""
    return [F.desc_nulls_last("acq_date"), F.desc_nulls_last("acq_time"), *[F.col(name) for name in tie_break]]


def _oldest_needed(rows: DataFrame, limit: int) -> Column:
    """Day and minute of the oldest row that can be among the newest `limit`.

    Counts per day and minute come first, so the window runs over at most one row per
    minute of the archive, half a million a year, however many detections there are.
    """
    day, minute = F.coalesce("acq_date", F.lit("")), F.coalesce("acq_time", F.lit(""))
    per_minute = rows.groupBy(day.alias("day"), minute.alias("minute")).agg(F.count("*").alias("n"))
    newest = Window.orderBy(F.desc("day"), F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    newer = per_minute.select("day", "minute", F.coalesce(F.sum("n").over(newest), F.lit(0)).alias("newer"))
    return newer.where(F.col("newer") < limit).agg(F.min(F.struct("day", "minute"))).scalar()


def newest_rows(rows: DataFrame, limit: int = RESULT_LIMIT, tie_break: Sequence[str] = ()) -> DataFrame:
    """The newest `limit` rows.

    A plain top-k would send `limit` rows of every input split to one task. The oldest
    day and minute that can matter are found first, from the filtered columns alone, so
    the top-k gets few rows more than it returns, also where one day holds a third of the
    table. What it reads of a table partitioned by `acq_date` starts at that day.
    """
    day, minute = F.coalesce("acq_date", F.lit("")), F.coalesce("acq_time", F.lit(""))
    oldest = _oldest_needed(rows, limit)
    recent = rows.where((day >= oldest["day"]) & (F.struct(day.alias("day"), minute.alias("minute")) >= oldest))
    return recent.orderBy(*newest_first(tie_break)).limit(limit)


def sort_events(
    rows: DataFrame, key: str = "brightness", direction: str = "desc", tie_break: Sequence[str] = ("id",)
) -> DataFrame:
    """Prepared events by a numeric column or by confidence rank."""
    if key not in SORT_KEYS:
        raise ValueError(f"sort key {key!r} is not one of {', '.join(SORT_KEYS)}")
    if direction not in ("asc", "desc"):
        raise ValueError("Sort direction must be 'asc' or 'desc'")
    value = confidence_rank(F.col(key)) if key == "confidence" else F.coalesce(key, F.lit(0.0))
    first = value.asc() if direction == "asc" else value.desc()
    return rows.orderBy(first, *tie_break)


def top_scored(rows: DataFrame, k: int = 20, score: str = "score", tie_break: Sequence[str] = ()) -> DataFrame:
    """The k highest scores of all rows."""
    return rows.orderBy(F.desc_nulls_last(score), *tie_break).limit(k)
