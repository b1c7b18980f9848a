from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from firelake import functions as fn


@pytest.fixture
def apply(spark):
    def run(build, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]

    return run


def test_confidence_label(apply):
    values = ["n", "h", "medium", "high", "low", "unknown", None, " H ", "HIGH\n"]
    assert apply(fn.confidence_label, values) == [0, 1, 0, 1, 0, 0, 0, 1, 1]


def test_confidence_norm_for_display_and_ingest(apply):
    values = ["h", "HIGH", "l", " med ", "medium", "n", "weird", "", None]
    shown = ["high", "high", "low", "nominal", "nominal", "nominal", "weird", "unknown", "unknown"]
    assert apply(fn.confidence_norm, values) == shown
    assert apply(fn.ingest_confidence, values) == shown[:7] + ["nominal", "nominal"]


def test_confidence_rank_is_not_trimmed(apply):
    assert apply(fn.confidence_rank, ["High", "nominal", "medium", "low", "h", " low ", None]) == [3, 2, 2, 1, 0, 0, 0]


@pytest.mark.parametrize(
    ("brightness", "frp", "risk"),
    [(None, None, 0.0), (350.0, 50.0, 0.6571), (500.0, 200.0, 1.0), (None, 35.0, 0.04), (-35.0, 0.0, -0.06)],
)
def test_fallback_risk(spark, brightness, frp, risk):
    rows = spark.createDataFrame([(brightness, frp)], "b double, f double")
    assert rows.select(fn.fallback_risk(F.col("b"), F.col("f"))).first()[0] == risk


def test_fallback_risk_grows_with_both_inputs(spark):
    rows = spark.range(50).select((F.lit(200.0) + F.col("id") * 5).alias("b"), (F.col("id") * 2.0).alias("f"))
    for frp in (F.lit(10.0), F.col("f")):
        scores = [r[0] for r in rows.orderBy("b").select(fn.fallback_risk(F.col("b"), frp)).collect()]
        assert scores == sorted(scores)


def test_risk_or_fallback(apply):
    def risk(value):
        return fn.risk_or_fallback(fn.risk_from_text(value), F.lit(350.0), F.lit(50.0))

    assert apply(risk, ["0.25", " 0.5 ", "", "n/a", "NaN", None]) == [0.25, 0.5, 0.0, 0.6571, 0.6571, 0.6571]


@pytest.mark.parametrize(
    ("brightness", "frp", "severity", "color"),
    [
        (350.0, 0.0, "critical", "#d7263d"),
        (300.0, 50.0, "critical", "#ffd43b"),
        (320.0, 0.0, "warning", "#f08c00"),
        (300.0, 20.0, "warning", "#ffd43b"),
        (319.9, 19.9, "monitor", "#ffd43b"),
        (None, None, "monitor", "#ffd43b"),
    ],
)
def test_severity_and_color(spark, brightness, frp, severity, color):
    row = spark.createDataFrame([(brightness, frp)], "b double, f double")
    got = row.select(fn.severity(F.col("b"), F.col("f")), fn.marker_color(F.col("b"))).first()
    assert tuple(got) == (severity, color)


def test_marker_radius(apply):
    assert apply(fn.marker_radius, [None, 0.0, 50.0, 90.0, 500.0], "double") == [3.0, 3.0, 8.0, 12.0, 12.0]


def test_wind(apply):
    values = ["10 mph", "20 km/h", "15", "10 to 15 mph", "calm", "", None, "15d mph", "1e1 MPH"]
    assert apply(fn.parse_wind_kmh, values) == [16.09, 20.0, 24.14, 16.09, 0.0, 0.0, 0.0, 0.0, 16.09]


def test_temperature_and_humidity(apply):
    assert apply(fn.fahrenheit_to_c, [77.0, 32.0, None], "double") == [25.0, 0.0, -17.8]
    assert apply(fn.humidity_pct, [41.26, None], "double") == [41.3, 0.0]


def test_hour_and_month(spark):
    rows = [
        ("2024-05-01", "1210", 12, 5),
        ("2024-05-01", "0600", 6, 5),
        ("2024-11-30", "915", 9, 11),
        ("2024-05-01", "2460", 0, 0),
        ("2024-05-01", "12345", 0, 0),
        ("2024-02-30", "1210", 0, 0),
        (None, "1210", 0, 0),
        ("2024-05-01", None, 0, 0),
    ]
    frame = spark.createDataFrame(rows, "d string, t string, h int, m int")
    date, time = F.col("d"), F.col("t")
    wrong = frame.where((fn.hour_of(date, time) != F.col("h")) | (fn.month_of(date, time) != F.col("m")))
    assert wrong.count() == 0


def test_times_do_not_follow_the_session_zone(spark, conf):
    conf(spark__sql__session__timeZone="America/Los_Angeles")
    # 02:30 does not exist on that day there.
    row = spark.createDataFrame([("2024-03-10", "0230", "2024-03-10T02:30:00Z")], "d string, t string, x string")
    got = row.select(
        fn.hour_of(F.col("d"), F.col("t")), fn.datetime_date(F.col("x")), fn.datetime_time(F.col("x"))
    ).first()
    assert tuple(got) == (2, "2024-03-10", "0230")


def test_pad_time(apply):
    assert apply(fn.pad_time, ["9", "930", "14:30", "12345", "14:30:00", None]) == [
        "0009",
        "0930",
        "1430",
        "12345",
        "143000",
        None,
    ]


def test_yearday(apply):
    values = ["2024153", " 2024366 ", "2023366", "2024000", "x", None]
    assert apply(fn.yearday_to_date, values) == ["2024-06-01", "2024-12-31", None, None, None, None]


def test_datetime_split(apply):
    values = ["2024-05-01T14:30:00Z", "2024-05-01 14:30", "2024-05-01T14:30:00+05:00", "soon", None]
    assert apply(fn.datetime_date, values) == ["2024-05-01"] * 3 + [None, None]
    assert apply(fn.datetime_time, values) == ["1430"] * 3 + [None, None]


def test_to_number(apply):
    assert apply(fn.to_number, ["12", " 1.5 ", "-2e3", ".5", "15d", "0x1", "nan", "", None]) == [
        12.0,
        1.5,
        -2000.0,
        0.5,
        None,
        None,
        None,
        None,
        None,
    ]


def test_rounding_is_half_away_from_zero(apply):
    assert apply(lambda v: fn.round_to(v, 2), [0.125, -0.125, 34.005], "double") == [0.13, -0.13, 34.01]
    # 1.005 is stored just below, but its scaled form rounds as the stores do.
    assert apply(lambda v: fn.round_to(v, 2), [1.005], "double") == [1.0]


def test_cells_and_bins(apply):
    assert apply(fn.cell_index, [34.126, -118.254, float("nan"), 1e300, None], "double") == [3413, -11825, None, None, None]
    assert apply(fn.degree_bin, [-118.25, 34.99, -0.5], "double") == [-119, 34, -1]


def test_array_mean(apply):
    values = [[0.12, None, 0.14], [None, None], [], [0.1, 0.2, 0.3], None]
    assert apply(fn.array_mean_nonnull, values, "array<double>") == [0.13, 0.0, 0.0, 0.2, None]


def test_fire_id(spark):
    row = spark.createDataFrame([(34.0, -118.25, None, "0930", None, 12.5, 3)], "a double, b double, c string, d string, e double, f double, p int")
    assert row.select(fn.fire_id(*[F.col(c) for c in "abcdefp"])).first()[0] == "34|-118.25|na|0930|na|12.5|3"


@pytest.mark.parametrize(
    ("nodeid", "name"),
    [
        ("backend/tests/security/test_s.py::TestA::test_b", "[security] TestA · test_b"),
        ("backend/tests/test_api.py::test_root", "[api] test_root"),
        ("backend/tests/test_api.py", "[api] backend/tests/test_api.py"),
        ("test_api.py::test_root", "[] test_root"),
    ],
)
def test_shorten_test_id(spark, nodeid, name):
    assert spark.createDataFrame([(nodeid,)], "n string").select(fn.shorten_test_id(F.col("n"))).first()[0] == name
