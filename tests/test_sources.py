from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
import pytest

from firelake.plans.ingest import backfill, ingest_soil, ingest_weather, insert_detections, readings_of_grids
from firelake.schemas import ENVIRONMENT, FIRES, WEATHER
from firelake.session import work_dir
from firelake.sources import builds, csv, payloads, sinks, tables
from firelake.sources.files import matching_paths

HEADER = "latitude,longitude,bright_ti4,bright_ti5,frp,acq_date,acq_time,confidence"


@pytest.fixture
def land(tmp_path):
    def write(name, *lines):
        folder = tmp_path / name.rsplit("/", 1)[0]
        folder.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(folder)

    return write


def test_detections_extra_columns_box_nan_and_padding(spark, land):
    path = land(
        "a/1.csv",
        "satellite," + HEADER,
        "N,34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h",
        "N,10.0,-70.0,330.5,290.1,25.5,2024-08-01,1200,n",
        "N,35.05,-118.25,NaN,,25.5,2024-08-01,1200, l ",
    )
    got = [tuple(r) for r in csv.scan_detections_csv(spark, path).orderBy("latitude").collect()]
    assert got == [
        (34.05, -118.25, 330.5, 290.1, 25.5, "2024-08-01", "0930", "h"),
        (35.05, -118.25, None, None, 25.5, "2024-08-01", "1200", " l "),
    ]
    assert csv.scan_detections_csv(spark, path).schema.simpleString() == FIRES.simpleString()


def test_detections_without_a_column_or_a_file_are_empty(spark, land, tmp_path):
    path = land("b/1.csv", HEADER.replace(",frp", ""), "34.05,-118.25,330.5,290.1,2024-08-01,930,h")
    for missing in (path, str(tmp_path / "nothing")):
        got = csv.scan_detections_csv(spark, missing)
        assert got.count() == 0 and got.columns == FIRES.fieldNames()


def test_each_file_is_read_by_its_own_header(spark, land):
    path = land("c/1.csv", HEADER, "34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h")
    swapped = HEADER.replace("latitude,longitude", "longitude,latitude")
    land("c/2.csv", swapped, "-118.25,34.05,330.5,290.1,25.5,2024-08-01,930,h")
    land("c/3.csv", HEADER.replace(",frp", "") + ",a long column that comes first", "34.05,-118.25,330.5,290.1,2024-08-01,930,h,x")
    land("c/4.csv", "extra," + HEADER, "x,34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h")
    rows = csv.scan_detections_csv(spark, path)
    assert rows.count() == 3 == len(rows.collect()) and rows.distinct().count() == 1
    assert [(r.file[-5:], r.reason) for r in csv.rejected_files(spark, path).collect()] == [("3.csv", "no column frp")]


def test_blank_first_lines_and_quoted_line_breaks(spark, land):
    row = "34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h"
    path = land("q/1.csv", "", "  ", HEADER, row, "", row.replace("930", "931"))
    land("q/2.csv", HEADER + ",note", row + ',"two', 'lines, and ""quotes"""', row + ",plain")
    land("q/3.csv", '"a quoted', 'name",' + HEADER, "x," + row)
    land("q/a [b]{c}* d.csv", "\ufeff" + HEADER, row.replace("930", "932"))
    land("q/5.csv", "", "")
    rows = csv.scan_detections_csv(spark, path)
    assert sorted(r.acq_time for r in rows.collect()) == ["0930"] * 4 + ["0931", "0932"]
    assert rows.count() == 6 and csv.rejected_files(spark, path).count() == 0


def test_headers_are_looked_up_without_reading_the_files(spark, land):
    path = land("big/1.csv", HEADER, *["34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h"] * 30_000)
    land("big/2.csv", "a,b")
    headers = csv.file_headers(spark, path)
    # A task for each file.
    assert headers.rdd.getNumPartitions() == 2
    assert sorted(r.header for r in headers.collect()) == ["a,b", HEADER]
    seen = []

    def lines():
        for i in range(100):
            seen.append(i)
            yield pa.RecordBatch.from_pydict({"value": ["", HEADER], "file": ["f", "f"]})

    assert len(list(csv._first_records(True)(lines()))) == 1 and seen == [0]


def test_files_of_a_header_are_one_scan(spark, land):
    path = land("one/1.csv", HEADER, "34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h")
    for i in range(2, 9):
        land(f"one/{i}.csv", HEADER, "34.05,-118.25,330.5,290.1,25.5,2024-08-01,930,h")
    rows = csv.scan_detections_csv(spark, path).select("acq_date")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Join" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<latitude:double,longitude:double,acq_date:string>" in plan


@pytest.mark.parametrize("order", [1, -1])
def test_windows_whose_folders_begin_alike(spark, land, order):
    row = "34.05,-118.25,330.5,290.1,25.5,{},0930,h"
    days = {"w1": "2024-08-01", "w10": "2024-08-10", "w1 x": "2024-08-20"}
    windows = [csv.Window(day, 5, "a", land(f"alike/{name}/1.csv", HEADER, row.format(day))) for name, day in days.items()]
    windows[2] = windows[2]._replace(path=windows[2].path + "/1.csv")
    rows = csv.scan_window_list(spark, windows[::order])
    assert {(r.acq_date, r.window_start) for r in rows.collect()} == {(d, d) for d in days.values()}


def test_windows_and_backfill(spark, land):
    row = "34.05,-118.25,330.5,290.1,25.5,{},0930,h"
    windows = [
        csv.Window(day, 5, "archive", land(f"w{day}/1.csv", HEADER, row.format(day)))
        for day in ("2024-08-01", "2024-08-06")
    ]
    assert {r.window_start for r in csv.scan_window_list(spark, windows).collect()} == {"2024-08-01", "2024-08-06"}
    assert csv.scan_window_list(spark, []).count() == 0
    table = work_dir(spark, "backfill")
    assert tuple(backfill(spark, windows[:1], table)) == (1, 1, 0)
    # The first window is skipped whole, and so are both the next time.
    assert tuple(backfill(spark, windows, table)) == (1, 1, 0)
    assert tuple(backfill(spark, windows, table)) == (0, 0, 0)
    assert tuple(backfill(spark, [], table)) == (0, 0, 0)


def test_overlapping_windows_are_loaded_once(spark, land):
    def lines(*days):
        return [f"34.05,-118.25,330.5,290.1,25.5,2024-01-0{d},0930,h" for d in days]

    first = csv.Window("2024-01-01", 5, "a", land("o1/1.csv", HEADER, *lines(1, 2, 3, 4, 5)))
    second = csv.Window("2024-01-03", 5, "a", land("o2/1.csv", HEADER, *lines(3, 4, 5, 6, 7)))
    other = csv.Window("2024-01-01", 5, "b", land("o3/1.csv", HEADER, *lines(1)))
    table = work_dir(spark, "overlap")
    assert backfill(spark, [first, second, other], table).inserted == 5


def test_many_dates_and_a_null_one_are_looked_up(spark, make_fires):
    rest = (34.05, -118.25, 1.0, 1.0, 1.0)
    days = [f"{1990 + i // 300}-{i % 12 + 1:02d}-{i % 25 + 1:02d}x{i}" for i in range(420)]
    batch = make_fires(*[(*rest, day, "0930", "h") for day in days], (*rest, None, "0930", "h"))
    table = work_dir(spark, "dates")
    assert insert_detections(spark, batch, table, "s").inserted == 421
    # A row with a null in its key always counts as new.
    assert insert_detections(spark, batch, table, "s").inserted == 1


def test_smoke_files_with_other_headers_and_dates(spark, land):
    path = land("h/1.csv", "lat,lon,datetime", "34.1,-118.2,06/01/2024 14:30", "34.1,-118.2,20240601 1430", "34.1,-118.2,soon", "34.1,-118.2,")
    land("h/2.csv", "Longitude,Latitude,date,time", "-118.2,34.1,2024-05-01,905")
    land("h/3.csv", "a,b", "1,2")
    rows = sorted((r.acq_date, r.acq_time) for r in csv.scan_hms(spark, path, "2024-09-09").collect())
    assert rows == [("2024-05-01", "0905"), ("2024-06-01", "1430"), ("2024-06-01", "1430"), ("2024-09-09", "0000")]


def _hms(spark, land, name, *lines):
    return csv.normalize_hms(csv.scan_hms_csv(spark, land(f"{name}/1.csv", *lines)), "2024-09-09")


def test_hms_datetime_form(spark, land):
    rows = _hms(
        spark, land, "d", " LATITUDE ,LONGITUDE,BRIGHTNESS,POWER,datetime,CONFIDENCE", "34.1,-118.2,320.5,15.2,2024-05-01T14:30:00Z,med"
    )
    assert tuple(rows.first()) == (34.1, -118.2, 320.5, None, 15.2, "2024-05-01", "1430", "nominal")


def test_hms_yearday_form_without_frp(spark, land):
    rows = _hms(spark, land, "y", "lat,lon,temp,conf,yearday", "34.1,-118.2,320.5,h,2024153", "34.1,-118.2,bad,,oops")
    assert [tuple(r) for r in rows.orderBy("acq_date").collect()] == [
        (34.1, -118.2, 320.5, None, 0.0, "2024-06-01", "0000", "high"),
        (34.1, -118.2, None, None, 0.0, "2024-09-09", "0000", "nominal"),
    ]


def test_hms_date_and_time_form_without_confidence(spark, land):
    rows = _hms(
        spark, land, "t", "latitude,longitude,brightness,frp,date,time,datetime",
        "34.1,-118.2,320.5,1,2024-05-01,9:05,ignored", "34.1,-118.2,320.5,1,2024-05-01,,ignored",
        ",-118.2,320.5,1,2024-05-01,,x", "60.0,-118.2,320.5,1,2024-05-01,,x",
    )
    assert {(r.acq_date, r.acq_time, r.confidence) for r in rows.collect()} == {
        ("2024-05-01", "0905", "nominal"),
        ("2024-05-01", "0000", "nominal"),
    }


def test_hms_needs_coordinates_and_a_date(spark, land):
    with pytest.raises(ValueError, match="latitude"):
        _hms(spark, land, "n", "brightness,date", "1,2024-05-01")
    with pytest.raises(ValueError, match="date"):
        _hms(spark, land, "m", "lat,lon", "34.1,-118.2")
    with pytest.raises(FileNotFoundError):
        csv.scan_hms_csv(spark, land("empty/.keep", ""))


def test_first_alias_wins():
    found = csv.resolve_aliases(["Y", "lat", " LON", "temp", "brightness"])
    assert (found["latitude"], found["longitude"], found["brightness"], found["date"]) == ("lat", " LON", "brightness", None)


def _payloads(spark, *docs):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")


def test_gridpoint_payloads(spark):
    rows = payloads.parse_gridpoint_json(
        _payloads(
            spark,
            {"properties": {"gridId": "MTR", "gridX": 84, "gridY": 105}},
            {"properties": {"gridId": "MTR", "gridX": 84}},
            {"status": 404},
            "<html>",
        )
    )
    assert [tuple(r) for r in rows.collect()] == [(0, "MTR", "84", "105")]


def test_forecast_payloads(spark):
    def period(**values):
        return {"properties": {"periods": [values, {"windSpeed": "99 mph", "temperature": 99}]}}

    rows = payloads.parse_forecast_json(
        _payloads(
            spark,
            period(windSpeed="10 mph", temperature=77, relativeHumidity={"value": 41.26}),
            period(windSpeed="20 km/h", temperature="50", relativeHumidity={"value": "45"}),
            period(temperature=None, relativeHumidity=17),
            {"properties": {"periods": []}},
            {"properties": {}},
            {},
        )
    )
    assert [tuple(r) for r in rows.orderBy("i").collect()] == [
        (0, 16.09, 41.3, 25.0),
        (1, 20.0, 45.0, 10.0),
        (2, 0.0, 0.0, -17.8),
    ]


def test_soil_payloads(spark):
    def doc(hourly, vpd, et0):
        return {
            "hourly": {"soil_moisture_0_to_1cm": hourly},
            "daily": {"vapor_pressure_deficit_max": vpd, "et0_fao_evapotranspiration": et0},
        }

    rows = payloads.parse_soil_json(
        _payloads(
            spark,
            doc([0.12, None, 0.14], [1.23456], [4.5]),
            doc([None, None], [None], ["4.5"]),
            doc([0.1], [], [4.5]),
            doc(None, [1.0], [4.5]),
            {"hourly": {}, "daily": {}},
            "",
        )
    )
    assert [tuple(r) for r in rows.orderBy("i").collect()] == [(0, 0.13, 1.235, 4.5), (1, 0.0, 0.0, 4.5)]


REST = (1.0, 1.0, 1.0, "2024-08-01", "1200", "h")
RUN = ("2024-08-02", "2024-08-02 06:00:00")
POINTS = "latitude double, longitude double, landed_at timestamp, payload string"
FORECASTS = "grid_id string, grid_x string, grid_y string, landed_at timestamp, payload string"


def _at(hour):
    return datetime(2024, 8, 2, hour)


def _square(grid_id, x, y):
    return json.dumps({"properties": {"gridId": grid_id, "gridX": x, "gridY": y}})


def _forecast(mph, fahrenheit):
    return json.dumps({"properties": {"periods": [{"windSpeed": f"{mph} mph", "temperature": fahrenheit}]}})


def _stored_weather(spark, path):
    rows = tables.scan_table(spark, path, WEATHER).collect()
    return {(r.latitude, r.longitude): (r.obs_date, r.wind_speed_kmh, r.temp_c) for r in rows}


def test_weather_goes_by_the_grid(spark, make_fires):
    fires = make_fires((34.051, -118.249, *REST), (34.06, -118.25, *REST), (40.0, -100.0, *REST), (45.0, -90.0, *REST), (46.0, -91.0, *REST))
    points = spark.createDataFrame(
        [
            (34.05, -118.25, _at(1), _square("LOX", 1, 2)),
            # Another answer before it, and the same one again.
            (34.06, -118.25, _at(0), _square("OLD", 9, 9)),
            (34.06, -118.25, _at(1), _square("LOX", "1", "2")),
            (34.06, -118.25, _at(1), _square("LOX", 1, 2)),
            (40.0, -100.0, _at(1), _square("GLD", 5, 6)),
            # At sea, and a later answer that cannot be read.
            (45.0, -90.0, _at(1), json.dumps({"properties": {"gridId": "X"}})),
            (40.0, -100.0, _at(2), "not json"),
            (10.0, 10.0, _at(1), _square("FAR", 1, 1)),
            (None, None, None, None),
        ],
        POINTS,
    )
    forecasts = spark.createDataFrame(
        [
            ("LOX", "1", "2", _at(1), _forecast(99, 99)),
            ("LOX", "1", "2", _at(3), _forecast(10, 77)),
            # The last usable forecast counts.
            ("LOX", "1", "2", _at(4), json.dumps({"properties": {"periods": []}})),
            ("GLD", "5", "6", _at(1), _forecast(0, 32)),
            ("LOX", "2", "1", _at(5), _forecast(50, 50)),
            (None, None, None, None, None),
        ],
        FORECASTS,
    )
    path = work_dir(spark, "weather")
    south = points.where("latitude < 35")
    assert ingest_weather(fires, south, forecasts, path, *RUN) == 2
    assert ingest_weather(fires, points, forecasts, path, *RUN) == 1
    assert ingest_weather(fires, points, forecasts, path, *RUN) == 0
    assert _stored_weather(spark, path) == {
        (34.05, -118.25): ("2024-08-02", 16.09, 25.0),
        (34.06, -118.25): ("2024-08-02", 16.09, 25.0),
        (40.0, -100.0): ("2024-08-02", 0.0, 0.0),
    }
    # The cap counts cells from the north: two without an answer.
    assert ingest_weather(fires, points, forecasts, path, "2024-08-03", RUN[1], limit=2) == 0
    assert ingest_weather(fires, points, forecasts, path, "2024-08-03", RUN[1], limit=3) == 1


def test_forecast_of_a_large_square_is_parsed_once(spark, make_fires):
    cells = spark.range(400).selectExpr("25D + id / 100D AS latitude", "-100D AS longitude")
    plan = cells.selectExpr("latitude", "longitude", "1D AS bright_ti4", "1D AS bright_ti5", "1D AS frp", "'2024-08-01' AS acq_date", "'1200' AS acq_time", "'h' AS confidence")
    points = cells.selectExpr("latitude", "longitude", "TIMESTAMP '2024-08-02 01:00:00' AS landed_at", f"'{_square('HOT', 1, 1)}' AS payload")
    forecasts = spark.createDataFrame([("HOT", "1", "1", _at(1), _forecast(10, 77))], FORECASTS)
    path = work_dir(spark, "weather")
    assert ingest_weather(plan, points, forecasts, path, *RUN, limit=None) == 400
    assert set(_stored_weather(spark, path).values()) == {("2024-08-02", 16.09, 25.0)}
    grids = spark.createDataFrame([(i, 1, "HOT", "1", "1") for i in range(9)], "lat_cell int, lon_cell int, grid_id string, grid_x string, grid_y string")
    assert readings_of_grids(forecasts, grids).count() == 1


def test_soil_skips_stored_points(spark, make_fires):
    fires = make_fires((34.051, -118.249, *REST), (40.0, -100.0, *REST), (45.0, -90.0, *REST))
    soil = json.dumps(
        {
            "hourly": {"soil_moisture_0_to_1cm": [0.1, 0.2]},
            "daily": {"vapor_pressure_deficit_max": [1.5], "et0_fao_evapotranspiration": [4.0]},
        }
    )
    landed = [(34.05, -118.25, _at(1), soil), (34.05, -118.25, _at(2), "{}"), (34.05, -118.25, _at(1), soil), (40.0, -100.0, _at(1), soil)]
    answers, ground = spark.createDataFrame(landed, POINTS), work_dir(spark, "soil")
    assert ingest_soil(fires, answers, ground, *RUN) == 2
    assert ingest_soil(fires, answers, ground, *RUN) == 0
    assert ingest_soil(fires, answers, ground, "2024-08-03", RUN[1]) == 2
    assert {r.soil_moisture for r in tables.scan_table(spark, ground, ENVIRONMENT).collect()} == {0.15}
    # One folder per day: today's points are looked up in today's only.
    assert len(matching_paths(spark, f"{ground}/obs_date=*")) == 2


def test_tables(spark, make_fires):
    path = work_dir(spark, "t")
    assert tables.scan_or_empty(spark, path, FIRES).count() == 0
    tables.ensure_table(spark, path, FIRES)
    tables.ensure_table(spark, path, FIRES)
    assert tables.scan_table(spark, path, FIRES).schema == FIRES
    row = make_fires((34.05, -118.25, 1.0, None, 1.0, "2024-08-01", "0930", "h"))
    tables.append_rows(row.select(*reversed(row.columns)), path, FIRES)
    tables.ensure_table(spark, path, FIRES)
    assert tables.scan_table(spark, path, FIRES).collect() == row.collect()
    assert tables.scan_limit(tables.scan_table(spark, path, FIRES), 5).count() == 1


def test_all_tables_of_a_folder(spark, make_fires):
    root = work_dir(spark, "root")
    row = make_fires((34.05, -118.25, 1.0, None, 1.0, "2024-08-01", "0930", "h"))
    tables.append_rows(row, f"{root}/fires", FIRES)
    fires, weather, soil = tables.load_all_tables(spark, root)
    assert (fires.count(), weather.count(), soil.count()) == (1, 0, 0)
    assert weather.columns == WEATHER.fieldNames() and soil.columns == ENVIRONMENT.fieldNames()


def test_partitioned_table_keeps_date_text_and_both_feeds(spark, make_fires):
    path = work_dir(spark, "p")
    row = make_fires((34.05, -118.25, 1.0, None, 1.0, "2024-08-01", "0930", "h"))
    tables.append_rows(row, path, FIRES, "acq_date", "satellite")
    tables.append_rows(row, path, FIRES, "acq_date", "smoke")
    table = tables.scan_table(spark, path, FIRES)
    assert table.schema["acq_date"].dataType.typeName() == "string"
    assert table.count() == 2 and table.distinct().collect() == row.collect()


def test_build_files(spark, land):
    path = land("builds/build-002-b.json", json.dumps({"run_number": 2, "tests": [{"nodeid": "x::y"}]}))
    land("builds/build-1.json", "{", '"build_id": "001-a", "summary": {"passed": 3, "failed": 1}, "tests": []', "}")
    rows = builds.scan_build_json(spark, f"{path}/build-*.json")
    assert {(r.build_id, r.run_order) for r in rows.collect()} == {("002-b", 2), ("001-a", 0)}
    assert [tuple(r) for r in builds.build_results(rows).collect()] == [("002-b", 2, 0, "x::y", "unknown")]


def test_api_json_keeps_nulls(spark, make_fires):
    rows = make_fires((34.05, -118.25, None, None, 1.5, "2024-08-01", "0930", "h"))
    doc = json.loads(sinks.api_json(rows.select("latitude", "bright_ti4", "confidence")).first()[0])
    assert doc == {"latitude": 34.05, "bright_ti4": None, "confidence": "h"}


def test_a_path_with_no_model_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train first"):
        sinks.load_model(spark, str(tmp_path))


class _Session:
    """Just the two settings the work folder depends on."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_work_dir_is_under_the_shared_folder():
    cluster = _Session("spark://host:7077", "hdfs://shared/")
    assert work_dir(cluster, "x").startswith("hdfs://shared/firelake/x-")
    assert work_dir(cluster, "x") != work_dir(cluster, "x")
    assert work_dir(_Session("local[2]"), "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(_Session("spark://host:7077"), "x")
