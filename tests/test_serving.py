from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from firelake.operators import filters
from firelake.plans import dashboard, scoring, serving, training
from firelake.plans.features import feature_matrix
from firelake.plans.ingest import insert_detections
from firelake.schemas import ENVIRONMENT, FEATURES, FIRES, WEATHER
from firelake.session import work_dir
from firelake.sources import days, latest, sinks, tables


@pytest.fixture
def many(spark):
    """Three hundred detections over thirty days; hot ones are high confidence."""
    return (
        spark.range(300)
        .select(
            (F.lit(30.0) + F.col("id") % 17).alias("latitude"),
            (F.lit(-120.0) + F.col("id") % 50).alias("longitude"),
            (F.lit(290.0) + F.col("id") % 100).alias("bright_ti4"),
            F.lit(None).cast("double").alias("bright_ti5"),
            (F.col("id") % 60).cast("double").alias("frp"),
            F.format_string("2024-08-%02d", F.col("id") % 30 + 1).alias("acq_date"),
            F.format_string("%02d%02d", F.col("id") % 24, F.col("id") % 60).alias("acq_time"),
            F.when(F.col("id") % 100 >= 60, "h").otherwise("n").alias("confidence"),
        )
        .select(*FIRES.fieldNames())
    )


def test_record_fields_order_and_risk(many):
    rows = serving.latest_fires(many, limit=50).collect()
    assert list(rows[0].asDict()) == ["lat", "lon", "brightness", "frp", "confidence", "acq_date", "acq_time", "risk"]
    seen = [(r.acq_date, r.acq_time) for r in rows]
    assert seen == sorted(seen, reverse=True) and len(rows) == 50
    assert all(0 <= r.risk <= 1 for r in rows)


def test_default_cap(many):
    assert serving.latest_fires(many.unionAll(many).unionAll(many).unionAll(many)).count() == 1000


def test_stored_table_reads_only_the_days_it_needs(spark, many):
    root = work_dir(spark, "stored")
    path = f"{root}/fires"
    tables.append_rows(many.where("frp < 30"), path, FIRES, "acq_date", "satellite")
    tables.append_rows(many.where("frp >= 30"), path, FIRES, "acq_date", "smoke")
    assert serving.newest_partitions(spark, path)[:2] == ["2024-08-30", "2024-08-29"]
    assert len(serving.newest_partitions(spark, path, "smoke")) <= 30
    for limit in (5, 10, 35, 290, 1000):
        got = serving.newest_from_table(spark, path, limit=limit)
        want = serving.select_newest(many, limit=limit)
        key = ["acq_date", "acq_time"]
        assert [tuple(r) for r in got.select(*key).collect()] == [tuple(r) for r in want.select(*key).collect()]
    plan = serving.newest_from_table(spark, path, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "acq_date#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "2024-08-30" in plan
    records = serving.latest_fires_from_table(spark, root, region="ca", confidence="high", limit=50)
    assert records.columns == serving.latest_fires(many).columns
    assert records.count() == min(50, serving.latest_fires(many.where("confidence = 'high'"), region="ca").count())
    assert serving.latest_fires_from_table(spark, work_dir(spark, "none")).count() == 0
    with pytest.raises(ValueError, match="Invalid region"):
        serving.latest_fires_from_table(spark, root, region="mars")


def _newest(rows, limit):
    """Newest first, ties by all columns, nulls first."""
    ties = ["latitude", "longitude", "bright_ti4", "bright_ti5", "frp", "confidence"]
    key = lambda r: (r.acq_date or "", r.acq_time or "")
    order = sorted(rows.collect(), key=lambda r: [(r[t] is not None, r[t]) for t in ties])
    return sorted(order, key=key, reverse=True)[:limit]


def test_newest_days_are_found_in_the_counts(spark, many):
    path = f"{work_dir(spark, 'counted')}/fires"
    insert_detections(spark, many.where("frp < 30"), path, "satellite")
    insert_detections(spark, many.where("frp >= 30"), path, "smoke")
    stored = tables.scan_table(spark, path, FIRES)
    us = filters.filter_us_box(stored)
    for limit in (1, 5, 35, 200, 1000):
        got = serving.newest_from_table(spark, path, limit=limit).collect()
        assert got == _newest(us, limit)
    for region, level in (("ca", None), (None, "high"), ("tx", "high")):
        want = filters.filter_confidence_exact(filters.filter_region(stored, region), level)
        assert serving.newest_from_table(spark, path, region, level, 7).collect() == _newest(want, 7)
    # The fires are read from the day on that the counts name, and nothing else of them.
    rows = serving.newest_from_table(spark, path, limit=5)
    oldest = days.oldest_day_needed(days.scan_day_counts(spark, path), 5)
    rows.collect()
    scans = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and all("acq_date" in line.split("PartitionFilters: [")[1].split("]")[0] and oldest in line for line in scans)


def test_counts_that_are_behind_lose_no_row(spark, many):
    path = f"{work_dir(spark, 'behind')}/fires"
    insert_detections(spark, many.where("acq_date < '2024-08-20'"), path, "satellite")
    # Days added, and rows of a counted day, without counting them: as after a failure in between.
    tables.append_rows(many.where("acq_date >= '2024-08-19'"), path, FIRES, "acq_date", "smoke")
    us = filters.filter_us_box(tables.scan_table(spark, path, FIRES))
    for limit in (3, 40, 500):
        assert serving.newest_from_table(spark, path, limit=limit).collect() == _newest(us, limit)
    days.update_day_counts(spark, path, "smoke")
    assert days.oldest_day_needed(days.scan_day_counts(spark, path), 3) >= "2024-08-29"


def test_latest_readings_do_not_depend_on_the_order(spark):
    readings = spark.createDataFrame(
        [
            (34.05, -118.25, "d", 1.0, 2.0, None, datetime(2024, 8, 1)),
            (34.0501, -118.2499, "d", 9.0, None, 3.0, datetime(2024, 8, 2)),
            (34.05, -118.25, "d", 9.0, 1.0, 3.0, datetime(2024, 8, 2)),
            (-0.001, 0.0, "d", 4.0, 4.0, 4.0, datetime(2024, 8, 1)),
            (34.99, -118.25, "d", 5.0, 5.0, 5.0, None),
            (None, 1.0, "d", 6.0, 6.0, 6.0, datetime(2024, 8, 1)),
        ],
        WEATHER,
    )
    parts = readings.randomSplit([0.5, 0.5], 3)
    for order in (parts, parts[::-1], [readings], [readings, parts[0]], [readings.limit(0), readings]):
        path = f"{work_dir(spark, 'latest')}/weather"
        for part in order:
            latest.merge_latest(part, path, "weather")
        got = {tuple(r) for r in latest.latest_values(spark, path, "weather").collect()}
        assert got == {(34.05, -118.25, 9.0, 1.0, 3.0), (0.0, 0.0, 4.0, 4.0, 4.0), (34.99, -118.25, 5.0, 5.0, 5.0)}
    fires = spark.createDataFrame([(34.051, -118.251), (50.0, 1.0), (None, None)], "latitude double, longitude double")
    joined = latest.join_latest_bounded(fires, path, f"{path}-none")
    assert {tuple(r)[2:] for r in joined.collect()} == {(9.0, 1.0, 3.0, 0.0, 0.0, 0.0), (0.0,) * 6}
    # Only the bands of the list are read.
    plan = latest.join_latest(fires, path, "weather", [34])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*band#\d+ = 34", plan)


def test_prepared_list(many, make_fires):
    records = serving.latest_fires(many, limit=20)
    prepared = dashboard.prepare_list(records)
    ids = [r.id for r in prepared.collect()]
    assert len(set(ids)) == 20 and {i.rsplit("|", 1)[1] for i in ids} == {str(n) for n in range(20)}
    assert dashboard.apply_form(prepared, "high").count() == prepared.where("confidence = 'high'").count()
    empty = make_fires((34.05, -118.25, None, None, None, "2024-08-01", "0930", " "))
    row = dashboard.prepare_list(serving.latest_fires(empty)).first()
    assert (row.brightness, row.frp, row.confidence, row.risk, row.severity) == (0.0, 0.0, "unknown", 0.0, "monitor")


def test_feature_matrix_is_complete_and_in_order(spark, many, make_fires):
    weather = spark.createDataFrame(
        [(30.0, -120.0, "2024-08-01", 5.0, None, 20.0, None)], WEATHER
    ).withColumn("fetched_at", F.lit("2024-08-01").cast("timestamp"))
    soil = spark.createDataFrame([], ENVIRONMENT)
    rows = feature_matrix(many, weather, soil)
    assert rows.columns == [*FEATURES, "label"] and rows.count() == 300
    assert rows.where(" OR ".join(f"{c} IS NULL" for c in rows.columns)).count() == 0
    assert rows.where("wind_speed_kmh = 5 AND humidity_pct = 0 AND temp_c = 20").count() > 0
    assert feature_matrix(many).columns == rows.columns
    assert rows.agg(F.sum("label")).first()[0] == 120
    nowhere = make_fires((None, None, None, None, None, None, None, None))
    assert set(feature_matrix(nowhere, weather, soil).first()) == {0}
    odd = make_fires((-0.5, -118.25, 1.0, None, None, "2024-08-01", "12345", None))
    assert feature_matrix(odd).select("hour", "month", "lat_bin", "lon_bin", "label").first()[:] == (0, 0, -1, -119, 0)


def test_model_policy(spark, tmp_path, many):
    assert scoring.model_or_fallback(spark, None) is None
    with pytest.raises(scoring.ModelUnavailableError):
        scoring.model_or_fallback(spark, str(tmp_path))
    assert scoring.model_or_fallback(spark, str(tmp_path), allow_fallback=True) is None
    with pytest.raises(scoring.ModelUnavailableError):
        scoring.model_or_fallback(spark, None, allow_fallback=False)
    with pytest.raises(scoring.ModelUnavailableError):
        scoring.score(many, None, allow_fallback=False)
    with pytest.raises(scoring.ModelUnavailableError):
        serving.latest_fires(many, allow_fallback=False)


def test_training_end_to_end(spark, many):
    weather = spark.createDataFrame([], WEATHER)
    soil = spark.createDataFrame([], ENVIRONMENT)
    artifacts = work_dir(spark, "artifacts")
    training.run_training(many, weather, soil, artifacts, trees=10, max_depth=5)
    metrics = spark.read.json(f"{artifacts}/metrics").select("metrics.*").first()
    assert metrics.n_rows == 300 and metrics.n_features == 13 and metrics.test_size == 0.2
    # The label follows the brightness, so the held-out rows are told apart.
    assert metrics.f1 > 0.9 and metrics.auc_roc > 0.95
    assert max(metrics.feature_importances.asDict().items(), key=lambda kv: kv[1])[0] == "bright_ti4"
    about = sinks.load_metadata(spark, artifacts)
    assert about["features"] == FEATURES and about["saved_at"]
    model = scoring.model_or_fallback(spark, artifacts)
    ranked = scoring.feature_importances(spark, model).collect()
    assert [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)
    scored = serving.latest_fires(many, weather, soil, limit=100, model=model).collect()
    assert len(scored) == 100 and all(0 <= r.risk <= 1 for r in scored)
    top = scoring.predict(many, weather, soil, model, k=5, tie_break=("latitude", "longitude")).collect()
    every = scoring.score(feature_matrix(many, weather, soil), model).agg(F.max("risk")).first()[0]
    assert len(top) == 5 and top[0].pred_score == every and top[0].asDict().keys() >= set(FIRES.fieldNames())
    hot = [r.risk for r in scored if r.brightness >= 360]
    cold = [r.risk for r in scored if r.brightness < 340]
    assert min(hot) > max(cold)
