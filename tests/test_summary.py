from __future__ import annotations

import hashlib
from datetime import UTC, datetime

import pytest

from firelake.operators import buildlog, evaluation, summary
from firelake.operators.ordering import newest_rows, sort_events, top_scored


def _dates(spark, *dates):
    return spark.createDataFrame([(d,) for d in dates], "acq_date string")


@pytest.mark.parametrize(
    ("dates", "hours", "stale"),
    [
        (["2024-08-01", "2024-07-01"], 0, False),
        (["2024-08-01", "2024-07-01"], 1, True),
        (["2024-08-01", None, ""], 1, True),
        (["2024-08-01", "soon"], 1, False),
        ([None, ""], 1, False),
        ([], 1, False),
    ],
)
def test_staleness_counts_hours(spark, dates, hours, stale):
    now = datetime(2024, 8, 8, hours, tzinfo=UTC)
    assert summary.staleness(_dates(spark, *dates), now).first()[0] is stale


def test_staleness_does_not_follow_the_session_zone(spark, conf):
    conf(spark__sql__session__timeZone="Asia/Tokyo")
    assert summary.staleness(_dates(spark, "2024-08-01"), datetime(2024, 8, 8, 0, 30, tzinfo=UTC)).first()[0] is True


def _events(spark, *rows):
    return spark.createDataFrame(
        list(rows), "id string, brightness double, frp double, risk double, confidence string, acq_date string"
    )


def test_severity_has_three_rows_for_any_input(spark):
    none = _events(spark)
    assert {tuple(r) for r in summary.severity_counts(none).collect()} == {("critical", 0), ("warning", 0), ("monitor", 0)}
    some = _events(spark, ("a", 355.0, 1.0, 0.7, "high", "2024-08-01"), ("b", None, None, 0.1, "low", None))
    assert dict(map(tuple, summary.severity_counts(some).collect())) == {"critical": 1, "warning": 0, "monitor": 1}
    assert tuple(summary.kpi_summary(some).first()) == (1, 0, 1, 0.7, "2024-08-01")
    assert summary.kpi_summary(none).first().latest_date == "N/A"


def test_bounding_box(spark):
    def box(*points):
        return summary.bounding_box(spark.createDataFrame(list(points), "latitude double, longitude double")).first()

    assert tuple(box((30.0, -120.0), (40.0, -100.0), (float("nan"), -100.0), (float("inf"), 1.0), (None, 1.0))) == (
        2, 30.0, 40.0, -120.0, -100.0, 35.153392, -110.0, 6, 7,
    )
    assert tuple(box()) == (0, None, None, None, None, 39.8283, -98.5795, 5, 5)
    # One detection is its own centre wherever it is; two at one place are not.
    assert box((60.0, -120.0))[5:] == (60.0, -120.0, 7, 7)
    assert box((60.0, -120.0), (60.0, -120.0))[5:] == (39.8283, -98.5795, 7, 7)
    assert box((40.0, -100.0), (40.0, -100.0))[5:] == (40.0, -100.0, 7, 7)
    # A row without coordinates is a row, so the other is not alone.
    assert box((60.0, -120.0), (None, 1.0))[5:7] == (39.8283, -98.5795)


def test_fitted_zoom(spark):
    def zoom(*points, view=(1024, 768)):
        rows = spark.createDataFrame(list(points), "latitude double, longitude double")
        return summary.bounding_box(rows, view=view).first().zoom

    # 256 * 2 ** zoom pixels for 360 degrees, and 924 of 1024 pixels to show them in.
    for wanted in (4, 5, 6, 7):
        exact = 924 / 256 / 2**wanted * 360
        assert zoom((39.0, -100.0 - exact / 2), (39.0, -100.0 + exact / 2)) == wanted
        assert zoom((39.0, -100.0 - exact * 0.51), (39.0, -100.0 + exact * 0.51)) == max(4, wanted - 1)
    assert zoom((39.0, -100.0), (39.0, -100.1)) == 7 and zoom((-80.0, -170.0), (80.0, 170.0)) == 4
    assert zoom((30.0, -110.0), (45.0, -108.0)) == 5 and zoom((30.0, -110.0), (45.0, -108.0), view=(300, 300)) == 4


def test_heat_weight_is_against_the_highest_risk_or_one(spark):
    def weights(*risks):
        rows = spark.createDataFrame([(r,) for r in risks], "risk double")
        return sorted(r.weight for r in summary.heat_points(rows).collect())

    assert weights(0.5, 0.25, 0.0, -1.0, None) == [0.25, 0.5]
    assert weights(4.0, 2.0, 1.0) == [0.25, 0.5, 1.0]


def test_cluster_pyramid_is_every_zoom(spark):
    places = [(-60.0 + (i * 7919 % 12000) / 100, -179.0 + (i * 104729 % 35800) / 100) for i in range(600)]
    rows = spark.createDataFrame([*places, *places[:40], (90.0, 1.0), (None, 2.0)], "latitude double, longitude double")
    got = sorted(tuple(r) for r in summary.cluster_pyramid(rows, (0, 3, 5, 7)).collect())
    wanted = [(z, *r) for z in (0, 3, 5, 7) for r in summary.cluster_counts(rows, z).collect()]
    assert got == sorted(wanted)
    assert summary.cluster_pyramid(rows.limit(0)).collect() == []


def test_cluster_sizes(spark):
    near = [(34.05, -118.25)] * 9 + [(40.0, -100.0)] * 10 + [(45.0, -80.0)] * 100
    rows = spark.createDataFrame(near, "latitude double, longitude double")
    got = {(r.n, r.size, r.latitude) for r in summary.cluster_counts(rows, zoom=5).collect()}
    assert got == {(9, "small", 34.05), (10, "medium", 40.0), (100, "large", 45.0)}
    # The whole world is 256 pixels wide at zoom 0.
    assert summary.cluster_counts(rows, zoom=0, radius_px=256).first().n == 119


def test_newest_rows_by_text_and_nulls_last(spark):
    rows = spark.createDataFrame(
        [("2024-08-02", "0900"), ("2024-08-02", "1000"), ("2024-08-01", "2300"), (None, "0000"), ("2024-08-02", None)],
        "acq_date string, acq_time string",
    )
    order = [("2024-08-02", "1000"), ("2024-08-02", "0900"), ("2024-08-02", None), ("2024-08-01", "2300"), (None, "0000")]
    for limit in (1, 2, 3, 4, 5, 9):
        assert [tuple(r) for r in newest_rows(rows, limit).collect()] == order[:limit]
    assert newest_rows(rows.where("false"), 5).count() == 0


def test_sort_events(spark):
    rows = _events(
        spark,
        ("a", 300.0, 60.0, 0.1, "low", None),
        ("b", 350.0, 35.0, 0.3, "high", None),
        ("c", None, 40.0, 0.2, "medium", None),
    )

    def ids(**how):
        return "".join(r.id for r in sort_events(rows, **how).collect())

    assert ids() == "bac"
    assert ids(key="frp", direction="asc") == "bca"
    assert ids(key="risk") == "bca"
    assert ids(key="confidence") == "bca"
    with pytest.raises(ValueError, match="sort key"):
        sort_events(rows, "latitude")


def test_top_scored_is_over_all_rows(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 997 as double) as score")
    assert [r.id for r in top_scored(rows, 3).collect()] == [996, 995, 994]


def _results(spark):
    rows = [
        ("001", 1, 0, "t::a", "passed"),
        ("001", 1, 1, "t::b", "failed"),
        ("002", 2, 0, "t::a", "failed"),
        ("002", 2, 1, "t::b", "failed"),
        ("003", 3, 0, "t::a", "error"),
        ("003", 3, 1, "t::b", "failed"),
        ("003", 3, 2, "t::b", "passed"),
        ("003", 3, 3, "t::c", "weird"),
    ]
    return spark.createDataFrame(rows, "build_id string, run_order long, position int, nodeid string, outcome string")


def test_outcome_matrix(spark):
    rows = buildlog.outcome_matrix(_results(spark), ["001", "002", "003"]).drop("test")
    assert {tuple(r) for r in rows.collect()} == {
        ("t::a", "passed", "failed", "failed"),
        ("t::b", "failed", "failed", "passed"),
        ("t::c", "none", "none", "none"),
    }


def test_regressions_look_for_failed_only_and_later_passes(spark):
    got = {(r.nodeid, r.first_failed, r.fixed_in) for r in buildlog.regressions(_results(spark)).collect()}
    assert got == {("t::a", "002", None), ("t::b", "001", "003")}


def test_build_summary_and_order(spark):
    rows = spark.createDataFrame(
        [("005-43", None, None, (108, 0, None)), ("001-a1", 1, "a1x", (67, 2, 70)), ("x", 2, None, None)],
        "build_id string, run_number long, sha string, summary struct<passed: long, failed: long, total: long>",
    )
    got = {r.build_id: tuple(r)[1:] for r in buildlog.build_summary(rows).collect()}
    assert got == {
        "005-43": (None, "43", 108, 0, 108, "PASS"),
        "001-a1": (1, "a1x", 67, 2, 70, "FAIL(2)"),
        "x": (2, "?", 0, 0, 0, "PASS"),
    }
    assert [r.build_id for r in buildlog.order_builds(rows).collect()] == ["005-43", "001-a1", "x"]


def _scored(spark, *rows):
    return spark.createDataFrame(list(rows), "score double, label int")


def test_auc_by_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for digits in (2, 4, 6):
        assert evaluation.roc_auc(_scored(spark, *rows), digits=digits).first()[0] == pytest.approx(wins, abs=1e-6)


def test_average_precision_by_steps(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 1)]
    expected = (1 / 3) * 1 + (1 / 3) * (2 / 4) + (1 / 3) * (3 / 5)
    assert evaluation.average_precision(_scored(spark, *rows)).first()[0] == pytest.approx(expected, abs=1e-6)


def test_one_class_has_no_ranking_measure(spark):
    rows = _scored(spark, (0.9, 1), (0.8, 1))
    assert evaluation.roc_auc(rows).first()[0] is None
    assert evaluation.average_precision(rows).first()[0] is None


def test_confusion_and_report(spark):
    rows = _scored(spark, (0.9, 1), (0.5, 1), (0.6, 0), (0.2, 0), (0.1, 0))
    assert tuple(evaluation.confusion_metrics(rows).first()) == (1, 1, 1, 2, 0.6, 0.5, 0.5, 0.5)
    report = {r["class"]: tuple(r)[1:] for r in evaluation.classification_report(rows).collect()}
    assert report == {
        "0": (0.6667, 0.6667, 0.6667, 3),
        "1": (0.5, 0.5, 0.5, 2),
        "accuracy": (0.6, 0.6, 0.6, 5),
        "macro avg": (0.5833, 0.5833, 0.5833, 5),
        "weighted avg": (0.6, 0.6, 0.6, 5),
    }
    assert tuple(evaluation.confusion_metrics(_scored(spark, (0.1, 0))).first())[4:] == (1.0, 0.0, 0.0, 0.0)


def test_split_and_weights(spark):
    rows = spark.range(20000).selectExpr("id", "cast(id % 10 = 0 as int) as label")
    split = evaluation.stratified_split(rows, ("id",))
    shares = {r.label: r.share for r in split.groupBy("label").agg({"is_test": "max"}).join(
        split.where("is_test").groupBy("label").count(), "label").selectExpr("label", "count / if(label = 1, 2000, 18000) as share").collect()}
    assert all(0.17 < share < 0.23 for share in shares.values())
    assert split.exceptAll(evaluation.stratified_split(rows.repartition(3), ("id",))).count() == 0
    weights = {r.label: r.weight for r in evaluation.class_weights(rows).collect()}
    assert weights == {1: 5.0, 0: 0.555556}
    assert evaluation.with_class_weight(rows).where("label = 1").first().weight == 5.0


def test_exact_split_takes_the_lowest_hashes_of_each_class(spark):
    rows = [(i, i % 7 == 0 if i % 11 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "event_id long, label boolean").selectExpr("event_id", "CAST(label AS INT) AS label").repartition(5)
    got = evaluation.exact_split(frame, ("event_id",)).collect()
    assert len(got) == 500
    for label in (0, 1, None):
        drawn = sorted((int(hashlib.md5(str(r.event_id).encode()).hexdigest()[:15], 16), r.is_test) for r in got if r.label == label)
        wanted = (len(drawn) * 20 + 50) // 100
        assert [t for _, t in drawn] == [True] * wanted + [False] * (len(drawn) - wanted)
    assert evaluation.exact_split(frame.limit(0), ("event_id",)).collect() == []


def test_exact_split_of_equal_keys(spark):
    """Most rows of a class share one key, so the cut goes through it."""
    frame = spark.range(300).selectExpr("IF(id < 250, 7, id) AS event_id", "CAST(id % 2 AS INT) AS label", "id AS place").repartition(4)
    for percent in (0, 20, 50, 100):
        got = evaluation.exact_split(frame, ("event_id",), percent).collect()
        assert sorted(r.place for r in got) == list(range(300))
        assert {y: sum(r.is_test for r in got if r.label == y) for y in (0, 1)} == {y: (150 * percent + 50) // 100 for y in (0, 1)}
