"""What the plans must look like, on a stored table and over all registered queries."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from firelake.checks.registry import registered
from firelake.operators import buildlog, cells, dedup, filters
from firelake.operators.evaluation import roc_auc
from firelake.operators.ordering import newest_rows
from firelake.plans.features import feature_matrix
from firelake.schemas import FIRES
from firelake.session import work_dir
from firelake.sources.tables import append_rows, scan_table

# Queries whose building runs jobs (files, streams, training).
EAGER = {
    "scan_detections_csv", "scan_window_list", "backfill", "normalize_hms", "normalize_hms_yearday", "append_rows",
    "scan_or_empty", "latest_fires_from_table", "write_api_json", "write_api_json_all", "ingest_weather", "ingest_soil",
    "scan_build_json", "stream_ingest", "stream_dedup", "stream_rejects", "day_counts", "latest_readings", "join_latest", "exact_split", "model_properties", "fit_forest_score", "save_load_model", "predict_top", "rank_importances",
    "write_metrics_json",
}


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def formatted(rows):
    return rows.sparkSession._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")


def final_plan_of(rows):
    rows.collect()
    return plan_of(rows).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark):
    path = work_dir(spark, "plans")
    rows = spark.range(60).select(
        (F.lit(30.0) + F.col("id") % 17).alias("latitude"),
        (F.lit(-120.0) + F.col("id") % 50).alias("longitude"),
        *[F.col("id").cast("double").alias(n) for n in ("bright_ti4", "bright_ti5", "frp")],
        F.format_string("2024-08-%02d", F.col("id") % 30 + 1).alias("acq_date"),
        F.lit("1200").alias("acq_time"),
        F.lit("high").alias("confidence"),
    )
    append_rows(rows, path, FIRES, "acq_date", "satellite")
    return scan_table(spark, path, FIRES)


def test_filters_and_columns_reach_the_scan(stored):
    rows = filters.filter_min_brightness_frp(filters.filter_region(stored, "ca"), 10, 0)
    plan = formatted(filters.filter_by_date(rows, "2024-08-05").select("frp"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(latitude,32.5)" in pushed and "LessThanOrEqual(longitude,-114.0)" in pushed
    assert "GreaterThanOrEqual(bright_ti4,10.0)" in pushed
    assert re.search(r"PartitionFilters: \[.*acq_date#\d+ = 2024-08-05", plan)
    assert "ReadSchema: struct<latitude:double,longitude:double,bright_ti4:double,frp:double>" in plan


def test_newest_rows_prunes_days_and_takes_top_k(stored):
    plan = formatted(newest_rows(filters.filter_us_box(stored), 3))
    assert "TakeOrderedAndProject" in plan
    assert re.search(r"PartitionFilters: \[.*coalesce\(acq_date#\d+, \) >= .*[Ss]ubquery", plan)


def _hot(spark, n=120000):
    """A third of the rows hold one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(
        (F.lit(30.0) + key % 1000 * 0.01).alias("latitude"),
        (F.lit(-120.0) + key % 777 * 0.01).alias("longitude"),
        *[F.lit(1.0).alias(c) for c in ("bright_ti4", "bright_ti5", "frp")],
        F.lit("2024-08-01").alias("acq_date"),
        F.format_string("%04d", key % 1000).alias("acq_time"),
        F.lit("h").alias("confidence"),
        F.col("id"),
    )


@pytest.fixture
def skew_conf(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )


def test_a_hot_cell_is_split(spark, skew_conf):
    fires = _hot(spark)
    readings = fires.select(
        "latitude", "longitude", *[F.lit(1.0).alias(v) for v in ("wind_speed_kmh", "humidity_pct", "temp_c")],
        F.col("id").alias("fetched_at"),
    )
    joined = cells.join_weather_first(fires, readings)
    assert "SortMergeJoin(skew=true)" in final_plan_of(joined)
    assert joined.where("temp_c = 1").count() == 120000


def test_both_reading_tables_take_one_join(spark, skew_conf):
    fires = _hot(spark)
    weather = fires.selectExpr("latitude", "longitude", "1D wind_speed_kmh", "1D humidity_pct", "1D temp_c", "id fetched_at")
    soil = fires.selectExpr("latitude", "longitude", "1D soil_moisture", "1D vpd_kpa", "1D et0_mm", "id fetched_at")
    plan = final_plan_of(feature_matrix(fires, weather, soil, carry=("id",)))
    assert plan.count("SortMergeJoin") == 1 and "skew=true" in plan


def test_a_hot_batch_key_is_split(spark, skew_conf):
    batch = _hot(spark)
    fresh = dedup.dedup_insert(batch, batch.where("id % 7 = 1"))
    assert "SortMergeJoin(skew=true)" in final_plan_of(fresh)
    assert fresh.count() == batch.count() - batch.join(
        batch.where("id % 7 = 1").select("latitude", "longitude", "acq_time").distinct(),
        ["latitude", "longitude", "acq_time"],
    ).count()


def test_a_test_with_most_results_is_split(spark, skew_conf):
    results = spark.range(0, 60000, 1, 8).selectExpr(
        "format_string('b%06d', id) AS build_id", "id AS run_order", "0 AS position",
        "IF(id % 3 = 0, 't::hot', concat('t::', id % 500)) AS nodeid", "IF(id < 3000, 'failed', 'passed') AS outcome",
    )
    assert "SortMergeJoin(skew=true)" in final_plan_of(buildlog.regressions(results))


def test_bounded_list_does_not_shuffle_reading_tables(spark, stored, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    weather = _hot(spark, 1000).selectExpr(
        "latitude", "longitude", "1D wind_speed_kmh", "1D humidity_pct", "1D temp_c", "id fetched_at"
    )
    plan = plan_of(cells.join_conditions_bounded(newest_rows(stored, 10), weather, None))
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin" not in plan


def test_ranking_reads_the_rows_once_and_windows_over_scores(spark, tmp_path):
    path = str(tmp_path / "scored")
    spark.range(1000).selectExpr("(id % 100) / 100D AS score", "CAST(id % 3 = 0 AS INT) AS label").write.parquet(path)
    plan = final_plan_of(roc_auc(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    # Both levels of ranking stand on one grouping with partial counts.
    assert len([line for line in plan.split("\n") if "partial_count" in line]) == 1


@pytest.mark.parametrize("name", sorted(set(registered()) - EAGER))
def test_no_query_leaves_the_jvm_or_joins_without_a_key(spark, sf_dir, name):
    plan = plan_of(registered()[name].run(spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_training_rows_are_dealt_over_the_cores(spark, tmp_path, make_fires, monkeypatch):
    from firelake.plans import training

    seen = []

    def fit(rows, trees, max_depth):
        seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return fitted(rows, trees, max_depth)

    fitted = training.fit_forest
    monkeypatch.setattr(training, "fit_forest", fit)
    rows = [(30 + i / 1e3, -110.0, 300.0 + i % 50, 290.0, float(i % 9), "2024-08-01", "0900", "hl"[i % 2]) for i in range(25_000)]
    training.train(make_fires(*rows).coalesce(1), None, None, str(tmp_path), trees=2, max_depth=2)
    # One file of the matrix; every core gets its share.
    assert len(seen[0]) == spark.sparkContext.defaultParallelism
    assert max(seen[0]) - min(seen[0]) <= len(seen[0])


def test_a_pass_of_a_large_fit_grows_few_trees(spark):
    from firelake.plans import training
    from firelake.schemas import FEATURES

    rows = spark.range(25_000).select(
        *[(F.xxhash64("id", F.lit(i)) % 97).cast("double").alias(name) for i, name in enumerate(FEATURES)], (F.col("id") % 2).cast("int").alias("label")
    )
    large = training.fit_forest(rows, trees=3, max_depth=4).stages[-1]
    assert large.getMaxMemoryInMB() == training.GROUP_MB
    assert (large.getNumTrees, large.getMaxDepth()) == (3, 4)
    # Short tables are fitted as before.
    assert training.fit_forest(rows.limit(5_000), trees=3, max_depth=4).stages[-1].getMaxMemoryInMB() == 256


def test_training_and_scored_rows_come_in_order_of_their_cells(spark, tmp_path, make_fires, monkeypatch):
    from firelake.plans import scoring, training

    def runs(rows):
        """Tasks, and how often the latitude changes from a row to the next of its task."""
        parts = rows.select("lat_bin").rdd.glom().collect()
        return len(parts), sum(a != b for part in parts for a, b in zip(part, part[1:]))

    seen = []

    def fit(rows, trees, max_depth):
        seen.append(runs(rows))
        return fitted(rows, trees, max_depth)

    def score(rows, model, **how):
        seen.append(runs(rows))
        return scored(rows, model, **how)

    fitted, scored = training.fit_forest, training.score
    for module in (training, scoring):
        monkeypatch.setattr(module, "score", score)
    monkeypatch.setattr(training, "fit_forest", fit)
    rows = make_fires(*[(30.5 + i % 10, -110.0, 300.0 + i % 50, 290.0, float(i % 9), "2024-08-01", "0900", "hl"[i % 2]) for i in range(25_000)])
    done = training.train(rows, None, None, str(tmp_path), trees=2, max_depth=2)
    top = scoring.predict(rows, None, None, done.model, k=3, tie_break=("latitude",))
    assert top.count() == 3
    # Fit, test rows, all rows: ten latitudes, so at most nine changes in a task.
    assert len(seen) == 3 and all(0 < changes <= 9 * tasks for tasks, changes in seen)


def test_test_rows_are_scored_once(spark, tmp_path, make_fires):
    from firelake.plans import training

    rows = make_fires(*[(30.5 + i % 10, -110.0, 300.0 + i % 50, 290.0, float(i % 9), "2024-08-01", "0900", "hl"[i % 2]) for i in range(200)])
    done = training.run_training(rows, None, None, str(tmp_path), trees=2, max_depth=2)
    plan = plan_of(done.scored_test)
    assert "FileScan" in plan and "UDF" not in plan and "InMemoryTableScan" not in plan
    assert done.scored_test.count() == 40 and {"label", "risk"} <= set(done.scored_test.columns)


def test_both_models_score_a_row_of_the_matrix_in_one_pass(spark, sf_dir, monkeypatch):
    from firelake.checks import models

    made, scored = [], []

    def matrix(*tables):
        made.append(1)
        return build(*tables)

    def score(rows, model, **how):
        scored.append(model)
        return by(rows, model, **how)

    build, by = models.matrix, models.score
    monkeypatch.setattr(models, "matrix", matrix)
    monkeypatch.setattr(models, "score", score)
    row = models._properties(spark, sf_dir).first()
    assert row.stored_model_scores_alike and row.scores_in_range and row.nothing_unlisted_is_higher and row.metrics_agree
    # The stored model and the fitted one, on all rows, which are joined once for the two.
    assert len(made) == 1 and len(scored) == 2 and scored[0] is not scored[1]
