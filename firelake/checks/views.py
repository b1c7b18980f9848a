"""Detections, readings and logs derived from the `events` table.

The check tables hold no fires, so each view is one list of SQL expressions that Spark
and DuckDB both read; only the date formatting differs. Spark uses the list as a
DataFrame select, the check SQL as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firelake.schemas import REGIONS

SPARK = {"date": "date_format(ts, 'yyyy-MM-dd')", "time": "date_format(ts, 'HHmm')"}
DUCKDB = {"date": "strftime(ts, '%Y-%m-%d')", "time": "strftime(ts, '%H%M')"}

# view: (base view, select list, filter)
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "fires": (
        "events",
        [
            "event_id",
            "20e0 + CAST(((event_id % 4000) * 7919) % 35000 AS DOUBLE) / 1e3 + 3e-4 AS latitude",
            "-130e0 + CAST(((event_id % 4000) * 104729) % 70000 AS DOUBLE) / 1e3 + 3e-4 AS longitude",
            "CASE WHEN event_id % 37 = 0 THEN NULL ELSE 280e0 + value / 4e0 END AS bright_ti4",
            "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 250e0 + value / 8e0 END AS bright_ti5",
            "CASE WHEN event_id % 41 = 0 THEN NULL ELSE value / 2e0 END AS frp",
            "{date} AS acq_date",
            "{time} AS acq_time",
            "CASE event_type WHEN 'error' THEN 'h' WHEN 'purchase' THEN 'High' WHEN 'view' THEN 'n'"
            " WHEN 'click' THEN 'medium' ELSE ' low ' END AS confidence",
            "ts",
        ],
        None,
    ),
    "weather_observations": (
        "fires",
        [
            "round(latitude * 1e2) / 1e2 AS latitude",
            "round(longitude * 1e2) / 1e2 AS longitude",
            "acq_date AS obs_date",
            "CASE WHEN event_id % 22 = 0 THEN NULL ELSE CAST(event_id % 60 AS DOUBLE) END AS wind_speed_kmh",
            "CAST((event_id * 7) % 100 AS DOUBLE) AS humidity_pct",
            "CAST((event_id * 13) % 400 AS DOUBLE) / 1e1 - 5e0 AS temp_c",
            "ts AS fetched_at",
            "event_id AS seq",
        ],
        "confidence IN ('h', 'High', 'n')",
    ),
    "environmental_conditions": (
        "fires",
        [
            "round(latitude * 1e2) / 1e2 AS latitude",
            "round(longitude * 1e2) / 1e2 AS longitude",
            "acq_date AS obs_date",
            "CAST((event_id * 17) % 500 AS DOUBLE) / 1e3 AS soil_moisture",
            "CAST((event_id * 11) % 600 AS DOUBLE) / 1e2 AS vpd_kpa",
            "CASE WHEN event_id % 28 = 0 THEN NULL ELSE CAST((event_id * 19) % 900 AS DOUBLE) / 1e2 END AS et0_mm",
            "ts AS fetched_at",
            "event_id AS seq",
        ],
        "confidence IN ('n', 'medium')",
    ),
    "scored": (
        "fires",
        [
            "event_id",
            "acq_date",
            "latitude",
            "longitude",
            "round(least((coalesce(bright_ti4, 0e0) * 0.6e0 + coalesce(frp, 0e0) * 0.4e0) / 350e0, 1e0) * 1e4) / 1e4"
            " AS score",
            "CASE WHEN lower(trim(confidence)) IN ('h', 'high') THEN 1 ELSE 0 END AS label",
        ],
        None,
    ),
    # Text as feeds deliver it, with the spellings and gaps a scalar function must survive.
    "texts": (
        "events",
        [
            "event_id",
            "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unclear ' WHEN 3 THEN ' MED'"
            " WHEN 4 THEN 'H' WHEN 5 THEN 'nominal' WHEN 6 THEN ' low ' WHEN 7 THEN 'High' ELSE 'medium' END"
            " AS confidence_text",
            "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '9' WHEN 2 THEN '930' WHEN 3 THEN '14:30'"
            " WHEN 4 THEN '12345' WHEN 5 THEN '2460' ELSE {time} END AS time_text",
            "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '2024-02-30' ELSE {date} END AS date_text",
            "CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '1e3' WHEN 2 THEN ' 12.5 ' WHEN 3 THEN NULL"
            " ELSE CAST(user_id AS VARCHAR(12)) END AS number_text",
            "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN ' 0.75 '"
            " ELSE CAST(value / 1e3 AS VARCHAR(24)) END AS risk_text",
            "CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN '2024400' WHEN 2 THEN '2023366' WHEN 3 THEN '2024000'"
            " ELSE '2024' || CAST(event_id % 266 + 100 AS VARCHAR(12)) END AS yearday_text",
            "CASE event_id % 6 WHEN 0 THEN 'oops' WHEN 1 THEN NULL WHEN 2 THEN {date} || 'T09:05:07Z'"
            " WHEN 3 THEN {date} || ' 17:45' WHEN 4 THEN {date} || 'T23:59:59+02:00' ELSE {date} END AS datetime_text",
            "CASE event_id % 7 WHEN 0 THEN CAST(user_id % 40 AS VARCHAR(12)) || ' mph'"
            " WHEN 1 THEN CAST(user_id % 40 AS VARCHAR(12)) || ' km/h'"
            " WHEN 2 THEN CAST(user_id % 40 AS VARCHAR(12)) || ' to 60 MPH'"
            " WHEN 3 THEN CAST(user_id % 40 AS VARCHAR(12)) WHEN 4 THEN 'calm' WHEN 5 THEN '' ELSE NULL END AS wind_text",
            "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(user_id % 120 AS DOUBLE) END AS fahrenheit",
            "CASE WHEN event_id % 10 = 1 THEN NULL ELSE value END AS humidity",
        ],
        None,
    ),
    # Test results: one row per test of a build. Equal (build, test) pairs occur.
    "results": (
        "events",
        [
            "event_id AS position",
            "'b' || CAST(event_id % 12 + 100 AS VARCHAR(12)) || '-' || CAST(event_id % 12 AS VARCHAR(12)) AS build_id",
            "CASE WHEN event_id % 12 = 5 THEN 0 ELSE event_id % 12 END AS run_order",
            "'backend/tests/' || CASE user_id % 3 WHEN 0 THEN 'security/' WHEN 1 THEN 'performance/' ELSE '' END"
            " || 'test_' || event_type || '.py::TestCase' || CAST(user_id % 7 AS VARCHAR(12)) || '::test_' ||"
            " CAST(user_id AS VARCHAR(12)) AS nodeid",
            "CASE WHEN value < 2e0 THEN 'failed' WHEN value < 4e0 THEN 'error' WHEN value < 6e0 THEN 'skipped'"
            " WHEN value < 7e0 THEN 'unknown' ELSE 'passed' END AS outcome",
        ],
        None,
    ),
    # Landed JSON answers, one per event; the parts a parser must survive are planted.
    "gridpoint_payloads": (
        "events",
        [
            "event_id",
            "CASE WHEN event_id % 11 = 0 THEN '{{\"properties\": {{\"gridId\": \"MTR\"}}}}'"
            " WHEN event_id % 13 = 0 THEN 'not json'"
            " ELSE '{{\"properties\": {{\"gridId\": \"' || upper(event_type) || '\", \"gridX\": ' ||"
            " CAST(user_id % 200 AS VARCHAR(12)) || ', \"gridY\": ' || CAST(event_id % 150 AS VARCHAR(12)) || '}}}}' END"
            " AS payload",
        ],
        None,
    ),
    "forecast_payloads": (
        "events",
        [
            "event_id",
            "CASE WHEN event_id % 17 = 0 THEN '{{\"properties\": {{\"periods\": []}}}}'"
            " WHEN event_id % 19 = 0 THEN '{{\"type\": \"error\"}}'"
            " ELSE '{{\"properties\": {{\"periods\": [{{\"windSpeed\": \"' || CASE event_id % 6"
            " WHEN 0 THEN CAST(user_id % 40 AS VARCHAR(12)) || ' mph'"
            " WHEN 1 THEN CAST(user_id % 40 AS VARCHAR(12)) || ' km/h'"
            " WHEN 2 THEN CAST(user_id % 40 AS VARCHAR(12)) || ' to ' || CAST(user_id % 40 + 5 AS VARCHAR(12)) || ' MPH'"
            " WHEN 3 THEN CAST(user_id % 40 AS VARCHAR(12))"
            " WHEN 4 THEN 'calm' ELSE '' END"
            " || '\", \"temperature\": ' || CASE WHEN event_id % 23 = 0 THEN 'null'"
            " ELSE CAST(user_id % 120 AS VARCHAR(12)) END"
            " || CASE WHEN event_id % 7 = 0 THEN ''"
            " ELSE ', \"relativeHumidity\": {{\"value\": ' || CAST(event_id % 100 AS VARCHAR(12)) || '}}' END"
            " || '}}, {{\"windSpeed\": \"99 mph\", \"temperature\": 99}}]}}}}' END AS payload",
        ],
        None,
    ),
    "soil_payloads": (
        "events",
        [
            "event_id",
            "CASE WHEN event_id % 17 = 0 THEN '{{\"hourly\": {{}}, \"daily\": {{}}}}'"
            " WHEN event_id % 19 = 0 THEN '{{\"hourly\": {{\"soil_moisture_0_to_1cm\": [0.1]}}, \"daily\":"
            " {{\"vapor_pressure_deficit_max\": [], \"et0_fao_evapotranspiration\": [1]}}}}'"
            " ELSE '{{\"hourly\": {{\"soil_moisture_0_to_1cm\": [' ||"
            " CASE WHEN event_id % 5 = 0 THEN 'null, null' ELSE '0.' || CAST(event_id % 400 + 100 AS VARCHAR(12)) ||"
            " ', null, 0.' || CAST(user_id % 300 + 100 AS VARCHAR(12)) END"
            " || ']}}, \"daily\": {{\"vapor_pressure_deficit_max\": [' ||"
            " CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(user_id % 6 AS VARCHAR(12)) || '.' ||"
            " CAST(event_id % 900 + 100 AS VARCHAR(12)) END"
            " || '], \"et0_fao_evapotranspiration\": [' || CAST(event_id % 9 AS VARCHAR(12)) || ']}}}}' END AS payload",
        ],
        None,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view as a DataFrame over the Parquet tables.

    `made` holds what a query has built already, so its views share one scan definition.
    """
    made = {} if made is None else made
    if name not in made:
        if name in VIEWS:
            base, columns, condition = VIEWS[name]
            rows = view(spark, sf_dir, base, made)
            rows = rows if condition is None else rows.where(condition)
            made[name] = rows.selectExpr(*[c.format(**SPARK) for c in columns])
        else:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return made[name]


def view_sql(name: str) -> dict[str, str]:
    """The view and those it stands on as DuckDB query texts, in order of use."""
    if name not in VIEWS:
        return {}
    base, columns, condition = VIEWS[name]
    text = f"SELECT {', '.join(c.format(**DUCKDB) for c in columns)} FROM {base}"
    return view_sql(base) | {name: text + (f" WHERE {condition}" if condition else "")}


def with_views(select: str, *views: str, **steps: str) -> str:
    """`select` under common table expressions: the views, then the given steps."""
    tables: dict[str, str] = {}
    for name in views:
        tables |= view_sql(name)
    tables |= steps
    if not tables:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in tables.items()) + "\n" + select


def region_box_sql() -> str:
    rows = ", ".join(
        f"('{name}', {b.min_lat}e0, {b.max_lat}e0, {b.min_lon}e0, {b.max_lon}e0)" for name, b in REGIONS.items()
    )
    return f"SELECT * FROM (VALUES {rows}) AS b(region, min_lat, max_lat, min_lon, max_lon)"
