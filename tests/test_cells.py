from __future__ import annotations

from pyspark.sql import functions as F

from firelake.operators import cells
from firelake.schemas import ENVIRONMENT, SOIL_VALUES, WEATHER, WEATHER_VALUES


def _at(second):
    from datetime import datetime

    return datetime(2024, 8, 1, 0, 0, second)


def _weather(spark):
    return spark.createDataFrame(
        [
            (34.05, -118.25, "2024-08-01", 10.0, 50.0, None, _at(1)),
            (34.051, -118.249, "2024-08-02", 20.0, 60.0, 30.0, _at(2)),
            (34.049, -118.251, "2024-08-03", 30.0, None, 31.0, _at(3)),
        ],
        WEATHER,
    )


def _fires(make_fires):
    rest = (330.0, 290.0, 25.0, "2024-08-01", "1200", "high")
    return make_fires((34.0512, -118.2488, *rest), (40.0, -100.0, *rest), (None, -100.0, *rest))


def test_first_and_last_reading_of_a_cell_and_null_inside_it(spark, make_fires):
    first = cells.join_weather_first(_fires(make_fires), _weather(spark))
    last = cells.join_weather_last(_fires(make_fires), _weather(spark))

    def values(rows):
        return {r.latitude: tuple(r[v] for v in WEATHER_VALUES) for r in rows.collect()}

    assert values(first) == {34.0512: (10.0, 50.0, 0.0), 40.0: (0.0, 0.0, 0.0), None: (0.0, 0.0, 0.0)}
    assert values(last)[34.0512] == (30.0, 0.0, 31.0)


def test_equal_times_are_settled_by_the_values(spark, make_fires):
    same = _weather(spark).withColumn("fetched_at", F.lit("2024-08-01").cast("timestamp"))
    for rows in (same, same.orderBy(F.desc("wind_speed_kmh"))):
        assert cells.one_per_cell(rows, WEATHER_VALUES, "first").first().wind_speed_kmh == 10.0
        assert cells.one_per_cell(rows, WEATHER_VALUES, "last").first().wind_speed_kmh == 30.0


def test_no_row_is_added_or_lost(spark, make_fires):
    soil = spark.createDataFrame([(40.0, -100.0, "2024-08-01", 0.2, 1.5, None, _at(1))] * 3, ENVIRONMENT)
    joined = cells.join_conditions(_fires(make_fires), _weather(spark), soil)
    assert joined.count() == 3
    assert joined.where("latitude = 40").select(*SOIL_VALUES).first().asDict() == {
        "soil_moisture": 0.2,
        "vpd_kpa": 1.5,
        "et0_mm": 0.0,
    }


def test_bounded_join_gives_the_same(spark, make_fires):
    soil = spark.createDataFrame([(40.0, -100.0, "2024-08-01", 0.2, 1.5, 3.0, _at(1))], ENVIRONMENT)
    fires, weather = _fires(make_fires), _weather(spark)
    whole = cells.join_conditions(fires, weather, soil, keep="last")
    bounded = cells.join_conditions_bounded(fires, weather, soil)
    assert sorted(map(str, whole.collect())) == sorted(map(str, bounded.select(*whole.columns).collect()))


def test_packed_cell_is_one_to_one(spark):
    values = [-2147483648, -11825, -1, 0, 1, 3413, 2147483647]
    pairs = spark.createDataFrame([(a, b) for a in values for b in values], "a int, b int")
    assert pairs.select(cells.packed_cell(F.col("a"), F.col("b"))).distinct().count() == len(values) ** 2


def test_distinct_cells_are_northernmost_first(make_fires):
    rest = (1.0, 1.0, 1.0, "2024-01-01", "0000", "h")
    rows = make_fires((30.001, -100.0, *rest), (30.004, -100.0, *rest), (49.0, -100.0, *rest), (45.0, -90.0, *rest))
    got = [tuple(r) for r in cells.distinct_cells(rows, limit=2).collect()]
    assert got == [(49.0, -100.0), (45.0, -90.0)]
    # The weather service does not reach that far north.
    assert [tuple(r) for r in cells.weather_cells(rows).collect()] == [(45.0, -90.0), (30.0, -100.0)]
    assert cells.soil_cells(rows).count() == 3


def test_skip_fetched_points(spark):
    points = spark.createDataFrame([(34.05, -118.25), (40.0, -100.0)], "latitude double, longitude double")
    assert [tuple(r) for r in cells.skip_fetched_points(points, _weather(spark), "2024-08-01").collect()] == [(40.0, -100.0)]
    assert cells.skip_fetched_points(points, _weather(spark), "2024-08-09").count() == 2
