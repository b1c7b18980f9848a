"""Scans, parsers, tables and sinks, over files that Spark writes from the check tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firelake.checks.joins import STORED
from firelake.checks.query import Query, over
from firelake.checks.rows import API, LEVEL, NEWEST, US
from firelake.checks.views import view, with_views
from firelake.functions import fallback_risk
from firelake.plans.ingest import backfill, ingest_soil, ingest_weather, insert_detections
from firelake.plans.serving import latest_fires, latest_fires_from_table, project_api
from firelake.schemas import DETECTION_KEY, ENVIRONMENT, FIRES, REGIONS, WEATHER, WEATHER_VALUES
from firelake.session import work_dir
from firelake.sources.builds import build_results, scan_build_json
from firelake.sources.csv import Window, normalize_hms, scan_detections_csv, scan_hms_csv, scan_window_list
from firelake.sources.days import scan_day_counts, update_day_counts
from firelake.sources.latest import join_latest, latest_values, merge_latest
from firelake.sources.payloads import parse_forecast_json, parse_gridpoint_json, parse_soil_json
from firelake.sources.sinks import write_api_json
from firelake.sources.tables import FIRES_TABLE, append_rows, ensure_table, scan_or_empty, scan_table

COLUMNS = ", ".join(FIRES.fieldNames())
RUN_DATE = "2024-02-01"
# The backfill windows of the check, by first and last day.
WINDOWS = [("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-10"), ("2024-01-21", "2024-01-25")]
HMS = {
    "datetime": {
        "LATITUDE": "latitude",
        "LONGITUDE": "longitude",
        "BRIGHTNESS": "bright_ti4",
        "POWER": "frp",
        "datetime": "acq_date || 'T' || substring(acq_time, 1, 2) || ':' || substring(acq_time, 3, 2) || ':00'",
        "CONFIDENCE": "confidence",
    },
    "yearday": {
        "lat": "latitude",
        "lon": "longitude",
        "temp": "bright_ti4",
        "conf": "confidence",
        "yearday": "date_format(ts, 'yyyyDDD')",
    },
}


def land_csv(rows: DataFrame, path: str) -> str:
    """Write as a feed would land it: header, text kept with its blanks."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("append").option("header", True).options(**keep).csv(path)
    return path


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fires")


def _scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three headers in one folder: another order, one column more, and one without `frp`, which is left out."""
    fires, path = detections(spark, sf_dir), work_dir(spark, "csv")
    land_csv(fires.where("event_id % 3 = 0").select(*reversed(FIRES.fieldNames())), path)
    land_csv(fires.where("event_id % 3 = 1").select("event_id", *FIRES.fieldNames()), path)
    land_csv(fires.where("event_id % 3 = 2").drop("frp"), path)
    return scan_detections_csv(spark, path)


def _windows(spark: SparkSession, sf_dir: str) -> list[Window]:
    fires, root = detections(spark, sf_dir).select(*FIRES.fieldNames()), work_dir(spark, "windows")
    return [
        Window(first, 5, "archive", land_csv(fires.where(F.col("acq_date").between(first, last)), f"{root}/{first}"))
        for first, last in WINDOWS
    ]


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second window is in the table already, in part: it is skipped whole."""
    table = work_dir(spark, "backfill")
    fires = detections(spark, sf_dir)
    append_rows(fires.where("acq_date = '2024-01-06'"), table, FIRES, "acq_date", "archive")
    backfill(spark, _windows(spark, sf_dir), table)
    return scan_table(spark, table, FIRES)


def _hms(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        header = [f"{text} AS `{name}`" for name, text in HMS[form].items()]
        path = land_csv(detections(spark, sf_dir).selectExpr(*header), work_dir(spark, f"hms-{form}"))
        return normalize_hms(scan_hms_csv(spark, path), RUN_DATE)

    return run


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires, table = detections(spark, sf_dir), work_dir(spark, "fires")
    ensure_table(spark, table, FIRES)
    append_rows(fires.where(STORED), table, FIRES)
    append_rows(fires.where(f"NOT {STORED}"), table, FIRES)
    return scan_table(spark, table, FIRES)


def _latest_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a partitioned fires table with the detections of two feeds and their counts per day."""
    fires, root = detections(spark, sf_dir), work_dir(spark, "stored")
    table = f"{root}/{FIRES_TABLE}"
    for source, rows in (("satellite", fires.where(STORED)), ("smoke", fires.where(f"NOT {STORED}"))):
        append_rows(rows, table, FIRES, "acq_date", source)
        update_day_counts(spark, table, source)
    return latest_fires_from_table(spark, root, region="us")


def _day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after two inserts into one feed, the second of which meets days of the first."""
    fires, table = detections(spark, sf_dir), work_dir(spark, "counted")
    insert_detections(spark, fires.where(STORED), table, "satellite")
    insert_detections(spark, fires.where(f"NOT {STORED}"), table, "satellite")
    return scan_day_counts(spark, table).drop("source")


def _latest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest reading per cell after three appends, the first of which comes again at the end."""
    readings, path = view(spark, sf_dir, "weather_observations"), work_dir(spark, "weather")
    for part in (0, 1, 2, 0):
        merge_latest(readings.where(f"seq % 3 = {part}"), path, "weather")
    return latest_values(spark, path, "weather")


def _join_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, path = view(spark, sf_dir, "weather_observations"), work_dir(spark, "weather")
    merge_latest(readings, path, "weather")
    fires = detections(spark, sf_dir).select("event_id", "latitude", "longitude")
    return join_latest(fires, path, "weather").drop("latitude", "longitude")


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and a feed whose table nobody has written."""
    known = detections(spark, sf_dir).select(*FIRES.fieldNames())
    return known.unionByName(scan_or_empty(spark, work_dir(spark, "missing"), FIRES))


def _api_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = latest_fires(detections(spark, sf_dir), tie_break=("event_id",))
    path = work_dir(spark, "api")
    write_api_json(records, path)
    return spark.read.schema(records.schema).json(path)


def _all_api_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = detections(spark, sf_dir)
    records = project_api(fires.withColumn("risk", fallback_risk(F.col("bright_ti4"), F.col("frp"))))
    path = work_dir(spark, "api-all")
    write_api_json(records, path)
    return spark.read.schema(records.schema).json(path)


# Cells of the detections, and the grid square of each: a third of the cells shares one, every eleventh is at sea.
CELLS = {
    "cells": "SELECT DISTINCT event_id % 4000 AS fold, round(latitude * 1e2) / 1e2 AS latitude,"
    " round(longitude * 1e2) / 1e2 AS longitude FROM fires",
    "squares": "SELECT *, CASE WHEN fold % 3 = 0 THEN 'HOT' ELSE 'G' || CAST(fold % 7 AS VARCHAR(9)) END AS grid_id,"
    " CASE WHEN fold % 3 = 0 THEN 0 ELSE fold % 40 END AS grid_x, CASE WHEN fold % 3 = 0 THEN 0 ELSE fold % 25 END AS grid_y,"
    " fold % 11 = 0 AS at_sea FROM cells",
}

# Whether a cell has a detection inside the service's box, on its unrounded coordinates.
COVERED = (
    "SELECT squares.*, inside FROM squares JOIN (SELECT round(latitude * 1e2) / 1e2 AS latitude, round(longitude * 1e2) / 1e2"
    " AS longitude, bool_or({box}) AS inside FROM fires GROUP BY 1, 2) AS seen USING (latitude, longitude)"
)


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.sql(CELLS["cells"].replace("FROM fires", "FROM {fires}"), fires=detections(spark, sf_dir))
    return spark.sql(CELLS["squares"].replace("FROM cells", "FROM {cells}"), cells=cells)


def _twice(answers: DataFrame, payload: str, older: str) -> DataFrame:
    """Each answer, and an older one that must not count."""
    columns = [c for c in answers.columns if c in ("latitude", "longitude", "grid_id", "grid_x", "grid_y")]
    new = answers.selectExpr(*columns, f"TIMESTAMP '{RUN_DATE} 05:00:00' AS landed_at", f"{payload} AS payload")
    return new.union(answers.selectExpr(*columns, f"TIMESTAMP '{RUN_DATE} 04:00:00' AS landed_at", f"{older} AS payload"))


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings stored for the cells of every detection; the northern ones are there already."""
    squares, table = _squares(spark, sf_dir), work_dir(spark, "weather")
    there = squares.where("latitude >= 37").selectExpr(
        *("latitude", "longitude", f"'{RUN_DATE}' AS obs_date", "0D AS wind_speed_kmh", "0D AS humidity_pct"),
        *("0D AS temp_c", f"TIMESTAMP '{RUN_DATE} 00:00:00' AS fetched_at"),
    )
    append_rows(there, table, WEATHER, "obs_date")
    named = (
        "'{\"properties\": {\"gridId\": \"' || grid_id || '\", \"gridX\": ' || grid_x ||"
        " CASE WHEN at_sea THEN '' ELSE ', \"gridY\": ' || grid_y END || '}}'"
    )
    other = "'{\"properties\": {\"gridId\": \"OLD\", \"gridX\": 1, \"gridY\": 1}}'"
    points = _twice(squares, named, f"CASE WHEN at_sea THEN 'not json' ELSE {other} END")
    forecast = (
        "CASE WHEN grid_x % 13 = 5 THEN '{\"properties\": {\"periods\": []}}' ELSE '{\"properties\": {\"periods\": [{\"windSpeed\": \"'"
        " || grid_x || ' mph\", \"temperature\": ' || grid_y * 4 || '}]}}' END"
    )
    older = "CASE WHEN grid_x = 31 THEN '{}' ELSE '{\"properties\": {\"periods\": [{\"windSpeed\": \"99 km/h\", \"temperature\": 50}]}}' END"
    forecasts = _twice(squares.select("grid_id", "grid_x", "grid_y").distinct(), forecast, older)
    ingest_weather(detections(spark, sf_dir), points, forecasts, table, RUN_DATE, f"{RUN_DATE} 06:00:00", limit=None)
    return scan_table(spark, table, WEATHER).drop("fetched_at")


def _soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the weather, one step away: the answers are those of the cells."""
    squares, table = _squares(spark, sf_dir), work_dir(spark, "soil")
    there = squares.where("latitude >= 37").selectExpr(
        *("latitude", "longitude", f"'{RUN_DATE}' AS obs_date", "0D AS soil_moisture", "0D AS vpd_kpa", "0D AS et0_mm"),
        f"TIMESTAMP '{RUN_DATE} 00:00:00' AS fetched_at",
    )
    append_rows(there, table, ENVIRONMENT, "obs_date")
    answer = (
        "CASE WHEN fold % 11 = 0 THEN '{\"hourly\": {}}' ELSE '{\"hourly\": {\"soil_moisture_0_to_1cm\": [0.25, null]}, \"daily\":"
        " {\"vapor_pressure_deficit_max\": [' || fold % 9 || '], \"et0_fao_evapotranspiration\": [' || fold % 4 || ']}}' END"
    )
    payloads = _twice(squares.select("*"), answer, "'{}'")
    ingest_soil(detections(spark, sf_dir), payloads, table, RUN_DATE, f"{RUN_DATE} 06:00:00", limit=None)
    return scan_table(spark, table, ENVIRONMENT).drop("fetched_at")


def _build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty results to a build file, so files grow in number and not in size."""
    results = view(spark, sf_dir, "results").withColumn("no", F.expr("position div 50"))
    docs = results.groupBy("no").agg(
        F.concat(F.lit("r"), F.col("no").cast("string")).alias("build_id"),
        F.when(F.col("no") % 4 > 0, F.col("no")).alias("run_number"),
        F.sort_array(F.collect_list(F.struct("position", "nodeid", "outcome"))).alias("tests"),
    )
    path = work_dir(spark, "builds")
    tests = F.transform("tests", lambda t: t.dropFields("position")).alias("tests")
    docs.select("build_id", "run_number", tests).write.json(path)
    rows = build_results(scan_build_json(spark, path, multi_line=False))
    return rows.select("build_id", "run_order", F.col("position").cast("long").alias("position"), "nodeid", "outcome")


def queries() -> dict[str, Query]:
    values = ", ".join(WEATHER_VALUES)
    newest = ", ".join(f"{v} DESC NULLS LAST" for v in ("fetched_at", *WEATHER_VALUES))
    last = (
        "SELECT *, round(latitude * 1e2) AS la, round(longitude * 1e2) AS lo, row_number() OVER (PARTITION BY"
        f" round(latitude * 1e2), round(longitude * 1e2) ORDER BY {newest}) AS place FROM weather_observations"
    )
    same = " AND ".join(f"f.{k} = fires.{k}" for k in DETECTION_KEY)
    per_region = ", ".join(
        f"count(*) FILTER (WHERE {US} AND latitude BETWEEN {b.min_lat}e0 AND {b.max_lat}e0 AND longitude BETWEEN {b.min_lon}e0"
        f" AND {b.max_lon}e0) AS n_{name}"
        for name, b in REGIONS.items()
    )
    hms_time = {"datetime": "acq_time", "yearday": "'0000'"}
    hms_frp = {"datetime": "frp", "yearday": "0e0"}

    def hms_sql(form: str) -> str:
        return with_views(
            f"SELECT latitude, longitude, bright_ti4, CAST(NULL AS DOUBLE) AS bright_ti5, {hms_frp[form]} AS frp, acq_date,"
            f" {hms_time[form]} AS acq_time, {LEVEL} AS confidence FROM fires WHERE {US}",
            "fires",
        )

    in_windows = " OR ".join(f"acq_date BETWEEN '{first}' AND '{last}'" for first, last in WINDOWS)
    first_day = " ".join(f"WHEN acq_date BETWEEN '{a}' AND '{b}' THEN '{a}'" for a, b in WINDOWS)
    kept = [w for w in WINDOWS if w[0] != "2024-01-06"]
    in_kept = " OR ".join(f"acq_date BETWEEN '{first}' AND '{last}'" for first, last in kept)
    wind = "string_split(p.period ->> '$.windSpeed', ' ')"
    return {
        "scan_detections_csv": Query(
            _scan_csv, with_views(f"SELECT {COLUMNS} FROM fires WHERE {US} AND event_id % 3 <> 2", "fires")
        ),
        "scan_window_list": Query(
            lambda spark, sf_dir: scan_window_list(spark, _windows(spark, sf_dir)),
            with_views(
                f"SELECT {COLUMNS}, CASE {first_day} END AS window_start FROM fires WHERE {US} AND ({in_windows})", "fires"
            ),
        ),
        "backfill": Query(
            _backfill,
            with_views(
                f"SELECT {COLUMNS} FROM fires WHERE acq_date = '2024-01-06' OR ({US} AND ({in_kept}))", "fires"
            ),
        ),
        "normalize_hms": Query(_hms("datetime"), hms_sql("datetime")),
        "normalize_hms_yearday": Query(_hms("yearday"), hms_sql("yearday")),
        "parse_gridpoint_json": Query(
            over("gridpoint_payloads", build=parse_gridpoint_json),
            with_views(
                "SELECT event_id, payload ->> '$.properties.gridId' AS grid_id, payload ->> '$.properties.gridX' AS grid_x,"
                " payload ->> '$.properties.gridY' AS grid_y FROM readable WHERE payload ->> '$.properties.gridY' IS NOT NULL",
                "gridpoint_payloads",
                readable="SELECT event_id, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS payload"
                " FROM gridpoint_payloads",
            ),
        ),
        "parse_forecast_json": Query(
            over("forecast_payloads", build=parse_forecast_json),
            with_views(
                f"SELECT event_id, round(coalesce(try_cast(nullif({wind}[1], '') AS DOUBLE) * CASE WHEN len({wind}) = 1"
                f" OR lower({wind}[-1]) = 'mph' THEN 1.60934e0 ELSE 1e0 END, 0e0) * 1e2) / 1e2 AS wind_speed_kmh,"
                " coalesce(CAST(p.period ->> '$.relativeHumidity.value' AS DOUBLE), 0e0) AS humidity_pct,"
                " round((coalesce(CAST(p.period ->> '$.temperature' AS DOUBLE), 0e0) - 32e0) * 5e0 / 9e0 * 1e1) / 1e1"
                " AS temp_c FROM p WHERE p.period IS NOT NULL",
                "forecast_payloads",
                p="SELECT event_id, payload -> '$.properties.periods[0]' AS period FROM forecast_payloads",
            ),
        ),
        "parse_soil_json": Query(
            over("soil_payloads", build=parse_soil_json),
            with_views(
                "SELECT event_id, coalesce(round(list_avg(hourly) * 1e4) / 1e4, 0e0) AS soil_moisture,"
                " round(coalesce(vpd[1], 0e0) * 1e3) / 1e3 AS vpd_kpa, round(coalesce(et0[1], 0e0) * 1e3) / 1e3 AS et0_mm"
                " FROM s WHERE hourly IS NOT NULL AND len(vpd) > 0 AND len(et0) > 0",
                "soil_payloads",
                s="SELECT event_id, CAST(payload -> '$.hourly.soil_moisture_0_to_1cm' AS DOUBLE[]) AS hourly,"
                " CAST(payload -> '$.daily.vapor_pressure_deficit_max' AS DOUBLE[]) AS vpd,"
                " CAST(payload -> '$.daily.et0_fao_evapotranspiration' AS DOUBLE[]) AS et0 FROM soil_payloads",
            ),
        ),
        "append_rows": Query(_append, with_views(f"SELECT {COLUMNS} FROM fires", "fires")),
        "scan_or_empty": Query(_missing, with_views(f"SELECT {COLUMNS} FROM fires", "fires")),
        "latest_fires_from_table": Query(
            _latest_from_table,
            with_views(
                f"SELECT {API} FROM (SELECT * FROM fires WHERE {US} ORDER BY acq_date DESC, acq_time DESC, latitude, longitude,"
                " bright_ti4 NULLS FIRST, bright_ti5 NULLS FIRST, frp NULLS FIRST, confidence LIMIT 1000) AS newest",
                "fires",
            ),
        ),
        "day_counts": Query(
            _day_counts,
            with_views(
                f"SELECT acq_date, lower(confidence) AS level, {per_region} FROM kept GROUP BY 1, 2",
                "fires",
                first=f"SELECT * FROM fires WHERE {STORED}",
                kept="SELECT * FROM first UNION ALL SELECT * FROM fires WHERE NOT"
                f" {STORED} AND NOT EXISTS (SELECT 1 FROM first f WHERE {same})",
            ),
        ),
        "latest_readings": Query(_latest_readings, with_views(f"SELECT latitude, longitude, {values} FROM last WHERE place = 1", "weather_observations", last=last)),
        "join_latest": Query(
            _join_latest,
            with_views(
                "SELECT event_id, " + ", ".join(f"coalesce({v}, 0e0) AS {v}" for v in WEATHER_VALUES) + " FROM fires f LEFT JOIN last"
                " ON place = 1 AND round(f.latitude * 1e2) = la AND round(f.longitude * 1e2) = lo",
                "fires",
                "weather_observations",
                last=last,
            ),
        ),
        "write_api_json": Query(
            _api_json, with_views(f"SELECT {API} FROM (SELECT * FROM fires WHERE {US} {NEWEST}) AS newest", "fires")
        ),
        "write_api_json_all": Query(_all_api_json, with_views(f"SELECT {API} FROM fires", "fires")),
        "ingest_weather": Query(
            _weather,
            with_views(
                f"SELECT latitude, longitude, '{RUN_DATE}' AS obs_date, CASE WHEN latitude >= 37e0 THEN 0e0"
                " WHEN grid_x % 13 = 5 THEN 99e0 ELSE round(grid_x * 1.60934e0 * 1e2) / 1e2 END AS wind_speed_kmh,"
                " 0e0 AS humidity_pct, CASE WHEN latitude >= 37e0 THEN 0e0 WHEN grid_x % 13 = 5 THEN 10e0"
                " ELSE round((grid_y * 4 - 32e0) * 5e0 / 9e0 * 1e1) / 1e1 END AS temp_c FROM covered"
                " WHERE latitude >= 37e0 OR (inside AND NOT at_sea AND grid_x <> 31)",
                "fires",
                **CELLS,
                covered=COVERED.format(box="latitude BETWEEN 24e0 AND 48.5e0 AND longitude BETWEEN -125e0 AND -66.5e0"),
            ),
        ),
        "ingest_soil": Query(
            _soil,
            with_views(
                f"SELECT latitude, longitude, '{RUN_DATE}' AS obs_date, CASE WHEN latitude >= 37e0 THEN 0e0 ELSE 0.25e0 END"
                " AS soil_moisture, CASE WHEN latitude >= 37e0 THEN 0e0 ELSE CAST(fold % 9 AS DOUBLE) END AS vpd_kpa,"
                " CASE WHEN latitude >= 37e0 THEN 0e0 ELSE CAST(fold % 4 AS DOUBLE) END AS et0_mm FROM covered"
                " WHERE latitude >= 37e0 OR (inside AND NOT at_sea)",
                "fires",
                **CELLS,
                covered=COVERED.format(box="latitude BETWEEN 24e0 AND 49.5e0 AND longitude BETWEEN -125e0 AND -66.5e0"),
            ),
        ),
        "scan_build_json": Query(
            _build_files,
            with_views(
                "SELECT 'r' || CAST(position // 50 AS VARCHAR) AS build_id, CASE WHEN (position // 50) % 4 > 0"
                " THEN position // 50 ELSE 0 END AS run_order, row_number() OVER (PARTITION BY position // 50"
                " ORDER BY position) - 1 AS position, nodeid, outcome FROM results",
                "results",
            ),
        ),
    }
