"""Scalar functions, each over every row of a view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake import functions as fn
from firelake.checks.query import Query, over
from firelake.checks.views import with_views
from firelake.operators.cells import rounded_point
from firelake.sources.csv import resolve_aliases

RUN_DATE = "2024-02-01"
TRIMMED = "lower(trim(confidence_text))"
PADDED = (
    "CASE WHEN length(replace(time_text, ':', '')) >= 4 THEN replace(time_text, ':', '')"
    " ELSE lpad(replace(time_text, ':', ''), 4, '0') END"
)
LEVEL = (
    "CASE WHEN {0} IN ('h', 'high') THEN 'high' WHEN {0} IN ('l', 'low') THEN 'low'"
    " WHEN {0} IN ('n', 'nominal', 'medium', 'med') THEN 'nominal' ELSE {0} END"
)
FALLBACK = (
    "round(least((coalesce(bright_ti4, 0e0) * 0.6e0 + coalesce(frp, 0e0) * 0.4e0) / 350e0, 1e0) * 1e4) / 1e4"
)


def _columns(view: str, sql_columns: dict[str, str], **columns: Callable[[], Column]) -> Query:
    """A query of `event_id` and the given columns over one view.

    Columns are made when the query runs, as they need a session.
    """
    return Query(
        over(view, build=lambda rows: rows.select("event_id", *[make().alias(n) for n, make in columns.items()])),
        with_views(
            f"SELECT event_id, {', '.join(f'{text} AS {name}' for name, text in sql_columns.items())} FROM {view}", view
        ),
    )


def queries() -> dict[str, Query]:
    c = F.col
    both = "try_strptime(date_text || ' ' || padded, '%Y-%m-%d %H%M')"
    stamped = with_views(
        f"SELECT event_id, CAST(coalesce(hour({both}), 0) AS INTEGER) AS hour,"
        f" CAST(coalesce(month({both}), 0) AS INTEGER) AS month FROM padded",
        "texts",
        padded=f"SELECT *, {PADDED} AS padded FROM texts",
    )
    words = "string_split(wind_text, ' ')"
    wind = (
        f"round(coalesce(try_cast(nullif({words}[1], '') AS DOUBLE) * CASE WHEN len({words}) = 1"
        f" OR lower({words}[-1]) = 'mph' THEN 1.60934e0 ELSE 1e0 END, 0e0) * 1e2) / 1e2"
    )
    day = "CAST(substr(yearday_text, 5, 3) AS INTEGER)"
    known = f"length(yearday_text) = 7 AND {day} BETWEEN 1 AND 366 AND NOT (yearday_text LIKE '2023%' AND {day} = 366)"
    zoneless = "substr(datetime_text, 1, 10)"
    clock = (
        "CASE WHEN length(datetime_text) > 10 THEN substr(datetime_text, 12, 2) || substr(datetime_text, 15, 2)"
        " ELSE '0000' END"
    )
    readable = "datetime_text IS NOT NULL AND datetime_text <> 'oops'"
    folder = "split_part(split_part(nodeid, '::', 1), '/', -2)"
    stem = "replace(replace(split_part(split_part(nodeid, '::', 1), '/', -1), 'test_', ''), '.py', '')"
    parts = ("latitude", "longitude", "acq_date", "acq_time", "bright_ti4", "frp", "event_id")

    def id_text(name: str) -> str:
        return f"coalesce(regexp_replace(CAST({name} AS VARCHAR), '\\.0$', ''), 'na')"

    return {
        "confidence_label": _columns(
            "texts",
            {"label": f"CASE WHEN {TRIMMED} IN ('h', 'high') THEN 1 ELSE 0 END"},
            label=lambda: fn.confidence_label(c("confidence_text")),
        ),
        "confidence_norm": _columns(
            "texts",
            {
                "shown": f"coalesce(nullif({LEVEL.format(TRIMMED)}, ''), 'unknown')",
                "ingested": LEVEL.format("lower(trim(coalesce(nullif(confidence_text, ''), 'medium')))"),
            },
            shown=lambda: fn.confidence_norm(c("confidence_text")),
            ingested=lambda: fn.ingest_confidence(c("confidence_text")),
        ),
        "confidence_rank": _columns(
            "texts",
            {
                "rank": "CASE lower(confidence_text) WHEN 'high' THEN 3 WHEN 'nominal' THEN 2 WHEN 'medium' THEN 2"
                " WHEN 'low' THEN 1 ELSE 0 END"
            },
            rank=lambda: fn.confidence_rank(c("confidence_text")),
        ),
        "fallback_risk": _columns("fires", {"risk": FALLBACK}, risk=lambda: fn.fallback_risk(c("bright_ti4"), c("frp"))),
        "risk_or_fallback": Query(
            over(
                "fires",
                "texts",
                build=lambda fires, texts: fires.join(texts, "event_id").select(
                    "event_id", fn.risk_or_fallback(fn.risk_from_text(c("risk_text")), c("bright_ti4"), c("frp")).alias("risk")
                ),
            ),
            with_views(
                "SELECT event_id, CASE WHEN trim(risk_text) = '' THEN 0e0"
                f" ELSE coalesce(try_cast(trim(risk_text) AS DOUBLE), {FALLBACK}) END AS risk"
                " FROM fires JOIN texts USING (event_id)",
                "fires",
                "texts",
            ),
        ),
        "severity": _columns(
            "fires",
            {
                "severity": "CASE WHEN coalesce(bright_ti4, 0e0) >= 350e0 OR coalesce(frp, 0e0) >= 50e0 THEN 'critical'"
                " WHEN coalesce(bright_ti4, 0e0) >= 320e0 OR coalesce(frp, 0e0) >= 20e0 THEN 'warning'"
                " ELSE 'monitor' END"
            },
            severity=lambda: fn.severity(c("bright_ti4"), c("frp")),
        ),
        "marker_style": _columns(
            "fires",
            {
                "color": "CASE WHEN bright_ti4 >= 350e0 THEN '#d7263d' WHEN bright_ti4 >= 320e0 THEN '#f08c00'"
                " ELSE '#ffd43b' END",
                "radius": "least(12e0, 3e0 + coalesce(frp, 0e0) / 10e0)",
            },
            color=lambda: fn.marker_color(c("bright_ti4")),
            radius=lambda: fn.marker_radius(c("frp")),
        ),
        "parse_wind_kmh": _columns("texts", {"wind_speed_kmh": wind}, wind_speed_kmh=lambda: fn.parse_wind_kmh(c("wind_text"))),
        "fahrenheit_to_c": _columns(
            "texts",
            {"temp_c": "round((coalesce(fahrenheit, 0e0) - 32e0) * 5e0 / 9e0 * 1e1) / 1e1"},
            temp_c=lambda: fn.fahrenheit_to_c(c("fahrenheit")),
        ),
        "humidity_pct": _columns(
            "texts",
            {"humidity_pct": "round(coalesce(humidity, 0e0) * 1e1) / 1e1"},
            humidity_pct=lambda: fn.humidity_pct(c("humidity")),
        ),
        "hour_month": Query(
            over(
                "texts",
                build=lambda rows: rows.select(
                    "event_id",
                    fn.hour_of(c("date_text"), c("time_text")).alias("hour"),
                    fn.month_of(c("date_text"), c("time_text")).alias("month"),
                ),
            ),
            stamped,
        ),
        "degree_bins": _columns(
            "fires",
            {"lat_bin": "CAST(floor(latitude) AS INTEGER)", "lon_bin": "CAST(floor(longitude) AS INTEGER)"},
            lat_bin=lambda: fn.degree_bin(c("latitude")),
            lon_bin=lambda: fn.degree_bin(c("longitude")),
        ),
        "pad_time": _columns("texts", {"acq_time": PADDED}, acq_time=lambda: fn.pad_time(c("time_text"))),
        "fire_id": _columns(
            "fires",
            {
                "id": " || '|' || ".join(
                    [id_text("latitude"), id_text("longitude"), "coalesce(acq_date, 'na')", "coalesce(acq_time, 'na')"]
                    + [id_text("bright_ti4"), id_text("frp"), "CAST(event_id AS VARCHAR)"]
                )
            },
            id=lambda: fn.fire_id(*[c(name) for name in parts]),
        ),
        "yearday_to_date": _columns(
            "texts",
            {
                "acq_date": f"CASE WHEN {known} THEN strftime(make_date(CAST(substr(yearday_text, 1, 4) AS INTEGER), 1, 1)"
                f" + ({day} - 1), '%Y-%m-%d') END"
            },
            acq_date=lambda: fn.yearday_to_date(c("yearday_text")),
        ),
        "datetime_split": _columns(
            "texts",
            {
                "acq_date": f"CASE WHEN {readable} THEN {zoneless} END",
                "acq_time": f"CASE WHEN {readable} THEN {clock} END",
            },
            acq_date=lambda: fn.datetime_date(c("datetime_text")),
            acq_time=lambda: fn.datetime_time(c("datetime_text")),
        ),
        "to_number": _columns(
            "texts", {"number": "try_cast(trim(number_text) AS DOUBLE)"}, number=lambda: fn.to_number(c("number_text"))
        ),
        "date_time_default": _columns(
            "texts",
            {"acq_date": f"coalesce(date_text, '{RUN_DATE}')", "acq_time": f"coalesce({PADDED}, '0000')"},
            acq_date=lambda: fn.default_date(c("date_text"), RUN_DATE),
            acq_time=lambda: fn.default_time(c("time_text")),
        ),
        "shorten_test_id": Query(
            over("results", build=lambda rows: rows.select("position", fn.shorten_test_id(c("nodeid")).alias("test"))),
            with_views(
                f"SELECT position, '[' || CASE WHEN {folder} = 'tests' THEN {stem} ELSE {folder} END || '] '"
                " || split_part(nodeid, '::', 2) || ' · ' || split_part(nodeid, '::', 3) AS test FROM results",
                "results",
            ),
        ),
        "array_mean_nonnull": Query(
            over(
                "embeddings",
                build=lambda rows: rows.select(
                    "vec_id",
                    fn.array_mean_nonnull(F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")))).alias("mean"),
                ),
            ),
            "SELECT vec_id, coalesce(round((SELECT avg(CAST(x AS DOUBLE)) FROM (SELECT unnest(embedding) AS x) AS u"
            " WHERE x > 0) * 1e4) / 1e4, 0e0) AS mean FROM embeddings",
        ),
        "cell": Query(
            over("fires", build=rounded_point),
            with_views(
                "SELECT round(latitude * 1e2) / 1e2 AS latitude, round(longitude * 1e2) / 1e2 AS longitude FROM fires",
                "fires",
            ),
        ),
        "resolve_aliases": Query(
            over("fires", build=_aliased),
            with_views("SELECT event_id, latitude, longitude, frp, acq_date FROM fires", "fires"),
        ),
    }


def _aliased(fires: DataFrame) -> DataFrame:
    """Detections under another header, read back by field name."""
    header = fires.select(
        "event_id",
        F.col("latitude").alias("LAT"),
        F.col("longitude").alias(" Long "),
        F.col("frp").alias("POWER"),
        F.col("acq_date").alias("UTC_Date"),
    )
    found = resolve_aliases(header.columns)
    return header.select(
        "event_id",
        F.col(found["latitude"]).alias("latitude"),
        F.col(f"`{found['longitude']}`").alias("longitude"),
        F.col(found["frp"]).alias("frp"),
        F.col(found["date"]).alias("acq_date"),
    )
