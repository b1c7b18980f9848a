"""The newest detections of a region with their risk: the main read path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.functions import confidence_norm, fire_id, risk_from_text, risk_or_fallback, severity
from firelake.operators.cells import join_conditions_bounded
from firelake.operators.filters import check_confidence, check_region, filter_confidence_exact, filter_region
from firelake.operators.ordering import newest_first, newest_rows
from firelake.plans.features import detection_features
from firelake.plans.scoring import score
from firelake.schemas import FIRES, RESULT_LIMIT
from firelake.sources.days import oldest_day_needed, scan_day_counts
from firelake.sources.files import matching_paths
from firelake.sources.tables import FIRES_TABLE, load_all_tables, scan_or_empty


def project_api(rows: DataFrame) -> DataFrame:
    """The record handed out: renamed, without the second brightness."""
    return rows.select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("bright_ti4").alias("brightness"),
        "frp",
        "confidence",
        "acq_date",
        "acq_time",
        "risk",
    )


def project_prepared(records: DataFrame, position: str) -> DataFrame:
    """Display values of each record; `position` tells equal records apart."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    brightness, frp = F.col("brightness"), F.col("frp")
    is_text = isinstance(records.schema["risk"].dataType, T.StringType)
    risk = risk_from_text(F.col("risk")) if is_text else F.col("risk").cast("double")
    return records.select(
        lat.alias("lat"),
        lon.alias("lon"),
        F.coalesce(brightness.cast("double"), F.lit(0.0)).alias("brightness"),
        F.coalesce(frp.cast("double"), F.lit(0.0)).alias("frp"),
        confidence_norm(F.col("confidence")).alias("confidence"),
        "acq_date",
        "acq_time",
        risk_or_fallback(risk, brightness, frp).alias("risk"),
        severity(brightness, frp).alias("severity"),
        fire_id(lat, lon, F.col("acq_date"), F.col("acq_time"), brightness, frp, F.col(position)).alias("id"),
    )


def select_newest(
    fires: DataFrame,
    region: str | None = None,
    confidence: str | None = None,
    limit: int = RESULT_LIMIT,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Filters, then the newest rows. Arguments are checked before any plan is built."""
    check_region(region)
    check_confidence(confidence)
    rows = filter_confidence_exact(filter_region(fires, region), confidence)
    return newest_rows(rows, limit, tie_break)


def latest_fires(
    fires: DataFrame,
    weather: DataFrame | None = None,
    soil: DataFrame | None = None,
    region: str | None = None,
    confidence: str | None = None,
    limit: int = RESULT_LIMIT,
    tie_break: Sequence[str] = (),
    order: Sequence[str] = ("fetched_at",),
    model: PipelineModel | None = None,
    allow_fallback: bool = True,
) -> DataFrame:
    """Newest detections as API records, scored from the last reading of their cell.

    The limit comes before the joins, so they see at most `limit` rows. Without a model
    the score needs no reading, so nothing is joined.
    """
    newest = select_newest(fires, region, confidence, limit, tie_break)
    return api_records(newest, weather, soil, order, model, allow_fallback)


def api_records(
    newest: DataFrame,
    weather: DataFrame | None,
    soil: DataFrame | None,
    order: Sequence[str] = ("fetched_at",),
    model: PipelineModel | None = None,
    allow_fallback: bool = True,
) -> DataFrame:
    """Scored records of a bounded list of detections, newest first."""
    if model is None:
        return project_api(score(newest, None, allow_fallback))
    features = latest_features(newest, weather, soil, order)
    return project_api(score(features, model)).orderBy(*newest_first())


def latest_features(
    newest: DataFrame, weather: DataFrame | None, soil: DataFrame | None, order: Sequence[str] = ("fetched_at",)
) -> DataFrame:
    """The model's features for a bounded list of detections; a table not given counts as empty."""
    return detection_features(join_conditions_bounded(newest, weather, soil, "last", order), missing_time="0000")


def newest_partitions(spark: SparkSession, path: str, feed: str | None = None) -> list[str]:
    """Dates present in the `acq_date=` folders of a fires table, newest first.

    Only folder names are listed, at most one per feed and day.
    """
    folders = matching_paths(spark, f"{path.rstrip('/')}/source={feed or '*'}/acq_date=*")
    days = {folder.rsplit("acq_date=", 1)[1] for folder in folders}
    return sorted(days - {"__HIVE_DEFAULT_PARTITION__"}, reverse=True)


def newest_from_table(
    spark: SparkSession,
    path: str,
    region: str | None = None,
    confidence: str | None = None,
    limit: int = RESULT_LIMIT,
) -> DataFrame:
    """Newest rows of a stored fires table, reading no more of its days than needed; ties go by all columns.

    The counts kept beside the table tell from which day on it is read. Without them it looks at
    the newest day, then at four times as many, until the filters leave `limit` rows; a table of
    ten thousand days takes at most seven looks.
    """
    fires = scan_or_empty(spark, path, FIRES)
    filtered = filter_confidence_exact(filter_region(fires, region), confidence)
    ties = [name for name in FIRES.fieldNames() if name not in ("acq_date", "acq_time")]
    counts = scan_day_counts(spark, path)
    if counts is not None:
        oldest = oldest_day_needed(counts, limit, region, confidence)
        return newest_rows(filtered if oldest is None else filtered.where(F.col("acq_date") >= oldest), limit, ties)
    days = newest_partitions(spark, path)
    span = 1
    while span < len(days):
        recent = filtered.where(F.col("acq_date") >= days[span - 1])
        if recent.limit(limit).count() >= limit:
            return newest_rows(recent, limit, ties)
        span *= 4
    return newest_rows(filtered, limit, ties)


def latest_fires_from_table(
    spark: SparkSession,
    root: str,
    region: str | None = None,
    confidence: str | None = None,
    limit: int = RESULT_LIMIT,
    model: PipelineModel | None = None,
    allow_fallback: bool = True,
) -> DataFrame:
    """`latest_fires` over the stored tables of one folder."""
    check_region(region)
    check_confidence(confidence)
    newest = newest_from_table(spark, f"{root}/{FIRES_TABLE}", region, confidence, limit)
    _, weather, soil = load_all_tables(spark, root)
    return api_records(newest, weather, soil, model=model, allow_fallback=allow_fallback)
