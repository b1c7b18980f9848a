from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from firelake.operators import filters
from firelake.operators.regions import join_region_boxes
from firelake.plans.serving import latest_fires, select_newest


@pytest.fixture
def four(make_fires):
    """Two in California (one high), one in New York (high), one off the map."""
    return make_fires(
        (34.05, -118.25, 330.0, 290.0, 25.0, "2024-08-01", "1200", "high"),
        (37.77, -122.42, 310.0, None, 10.0, "2024-08-02", "0900", "nominal"),
        (40.71, -74.0, 355.0, 300.0, 60.0, "2024-08-02", "1300", "High"),
        (10.0, -70.0, 355.0, 300.0, 60.0, "2024-08-03", "1300", "high"),
    )


def test_region_and_confidence_counts(four):
    assert filters.filter_us_box(four).count() == 3
    assert filters.filter_region(four, "US").count() == 3
    assert filters.filter_region(four, "ca").count() == 2
    assert filters.filter_confidence_exact(filters.filter_us_box(four), "HIGH").count() == 2
    assert select_newest(four, "ca", "high").count() == 1
    assert select_newest(four, "fl", "low").count() == 0


def test_box_edges_are_inside_and_nulls_outside(make_fires):
    rest = (1.0, 1.0, 1.0, "2024-01-01", "0000", "h")
    rows = make_fires((24.0, -125.0, *rest), (49.5, -66.5, *rest), (None, -100.0, *rest), (49.6, -100.0, *rest))
    assert filters.filter_us_box(rows).count() == 2


@pytest.mark.parametrize("region", ["mars", "", "x" * 500, "ca' OR '1'='1", "us; DROP TABLE fires"])
def test_wrong_region_is_refused_before_a_plan_is_built(region):
    with pytest.raises(ValueError, match="Invalid region"):
        latest_fires(None, region=region)


@pytest.mark.parametrize("confidence", ["veryhigh", "", "h", "high' --"])
def test_wrong_confidence_is_refused(confidence):
    with pytest.raises(ValueError, match="high, nominal, low"):
        latest_fires(None, confidence=confidence)


def test_exact_filter_misses_codes_and_normalized_does_not(make_fires):
    rest = (1.0, 1.0, 1.0, "2024-01-01", "0000")
    rows = make_fires((30.0, -100.0, *rest, "h"), (30.0, -100.0, *rest, "HIGH"), (30.0, -100.0, *rest, None))
    assert filters.filter_confidence_exact(rows, "high").count() == 1
    assert filters.filter_confidence_normalized(rows, "high").count() == 2
    assert filters.filter_confidence_normalized(rows, "unknown").count() == 1
    assert filters.filter_confidence_normalized(rows).count() == 3


def test_form_limits(four, make_fires):
    assert filters.filter_min_brightness_frp(four, "320", "30").count() == 2
    assert filters.filter_min_brightness_frp(four, "abc", float("inf")).count() == 4
    none = make_fires((30.0, -100.0, None, None, None, "2024-01-01", "0000", "h"))
    assert filters.filter_min_brightness_frp(none, 0, 0).count() == 1
    assert filters.filter_min_brightness_frp(none, 1, 0).count() == 0


def test_find_by_id(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert filters.find_by_id(rows, "b").count() == 1
    assert filters.find_by_id(rows, None).count() == 0


def test_regions_overlap(make_fires):
    rest = (1.0, 1.0, 1.0, "2024-01-01", "0000", "h")
    rows = make_fires((46.0, -120.0, *rest), (35.0, -114.5, *rest), (10.0, -70.0, *rest))
    got = {(r.latitude, r.region) for r in join_region_boxes(rows).select("latitude", "region").collect()}
    assert got == {(46.0, "us"), (46.0, "or"), (46.0, "wa"), (35.0, "us"), (35.0, "ca"), (35.0, "az")}


def test_positive_risk_and_missing_coordinates(spark):
    rows = spark.createDataFrame([(0.0, 1.0, None), (0.1, None, 1.0), (None, 1.0, 1.0)], "risk double, latitude double, longitude double")
    assert filters.filter_positive_risk(rows).count() == 1
    assert filters.drop_missing_coords(rows).select(F.col("risk")).count() == 1
