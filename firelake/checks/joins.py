"""Readings joined to detections, inserts without duplicates, anti-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from firelake.checks.query import Query, over
from firelake.checks.rows import ORDER
from firelake.checks.views import with_views
from firelake.operators import cells, dedup
from firelake.operators.filters import filter_confidence_normalized
from firelake.schemas import DETECTION_KEY, SOIL_VALUES, WEATHER_VALUES

KEY = ", ".join(DETECTION_KEY)
SAME_KEY = " AND ".join(f"t.{k} = b.{k}" for k in DETECTION_KEY)
# The batch is every detection; the table holds those of one feed.
STORED = "confidence IN ('h', 'High', 'n')"
BATCH = f"SELECT event_id, {KEY} FROM fires"
TABLE = f"SELECT event_id, {KEY} FROM fires WHERE {STORED}"


def _chosen(table: str, values: list[str], direction: str) -> str:
    return (
        f"SELECT {', '.join(values)}, round(latitude * 1e2) AS la, round(longitude * 1e2) AS lo, row_number() OVER"
        f" (PARTITION BY round(latitude * 1e2), round(longitude * 1e2) ORDER BY fetched_at {direction}, seq {direction})"
        f" AS rn FROM {table}"
    )


def _reading_join(join, table: str, values: list[str], keep: str) -> Query:
    direction = "ASC" if keep == "first" else "DESC"
    coalesced = ", ".join(f"coalesce(c.{v}, 0e0) AS {v}" for v in values)
    return Query(
        over("fires", table, build=lambda fires, readings: join(fires.select("event_id", *DETECTION_KEY), readings, ORDER)),
        with_views(
            f"SELECT f.event_id, {', '.join('f.' + k for k in DETECTION_KEY)}, {coalesced} FROM fires f LEFT JOIN chosen c"
            " ON c.rn = 1 AND c.la = round(f.latitude * 1e2) AND c.lo = round(f.longitude * 1e2)",
            "fires",
            table,
            chosen=_chosen(table, values, direction),
        ),
    )


def _batch(fires):
    return fires.select("event_id", *DETECTION_KEY)


def _table(fires):
    return fires.where(STORED).select("event_id", *DETECTION_KEY)


def _windows(fires):
    """Backfill windows every three days, up to past the last detection."""
    days = fires.select("acq_date").distinct()
    return days.select(F.date_add(F.col("acq_date").cast("date"), 3).cast("string").alias("start_date"))


def queries() -> dict[str, Query]:
    weather, soil = "weather_observations", "environmental_conditions"
    first_rows = (
        "SELECT la / 1e2 AS latitude, lo / 1e2 AS longitude, wind_speed_kmh, humidity_pct, temp_c FROM chosen WHERE rn = 1"
    )
    existing = f"SELECT DISTINCT {KEY} FROM (" + TABLE + ") AS t"
    return {
        "join_weather_first": _reading_join(cells.join_weather_first, weather, WEATHER_VALUES, "first"),
        "join_env_first": _reading_join(cells.join_env_first, soil, SOIL_VALUES, "first"),
        "join_weather_last": _reading_join(cells.join_weather_last, weather, WEATHER_VALUES, "last"),
        "join_env_last": _reading_join(cells.join_env_last, soil, SOIL_VALUES, "last"),
        "first_per_cell": Query(
            over(weather, build=lambda readings: cells.one_per_cell(readings, WEATHER_VALUES, "first", ORDER)),
            with_views(first_rows, weather, chosen=_chosen(weather, WEATHER_VALUES, "ASC")),
        ),
        "dedup_insert": Query(
            over("fires", build=lambda fires: dedup.dedup_insert(_batch(fires), _table(fires))),
            with_views(
                f"SELECT b.* FROM ({BATCH}) AS b WHERE NOT EXISTS (SELECT 1 FROM ({TABLE}) AS t WHERE {SAME_KEY})", "fires"
            ),
        ),
        "dedup_insert_dates": Query(
            over(
                "fires",
                build=lambda fires: dedup.dedup_insert(
                    _batch(fires).where("acq_date >= '2024-01-20'"),
                    dedup.within_batch_dates(_table(fires), _batch(fires).where("acq_date >= '2024-01-20'")),
                ),
            ),
            with_views(
                f"SELECT b.* FROM ({BATCH}) AS b WHERE b.acq_date >= '2024-01-20'"
                f" AND NOT EXISTS (SELECT 1 FROM ({TABLE}) AS t WHERE {SAME_KEY})",
                "fires",
            ),
        ),
        "ingest_counts": Query(
            over("fires", build=lambda fires: dedup.ingest_counts(_batch(fires), _table(fires))),
            with_views(
                "SELECT count(*) AS rows_in, count(*) FILTER (WHERE t.acq_date IS NULL) AS inserted,"
                " count(t.acq_date) AS skipped"
                f" FROM ({BATCH}) AS b LEFT JOIN ({existing}) AS t ON {SAME_KEY}",
                "fires",
            ),
        ),
        "skip_fetched_points": Query(
            over(
                "fires",
                weather,
                build=lambda fires, readings: cells.skip_fetched_points(
                    cells.distinct_cells(fires), readings, "2024-01-10"
                ),
            ),
            with_views(
                "SELECT p.* FROM points p WHERE NOT EXISTS (SELECT 1 FROM weather_observations w WHERE"
                " w.latitude = p.latitude AND w.longitude = p.longitude AND w.obs_date = '2024-01-10')",
                weather,
                points="SELECT DISTINCT round(latitude * 1e2) / 1e2 AS latitude, round(longitude * 1e2) / 1e2 AS longitude"
                " FROM fires WHERE latitude BETWEEN 24e0 AND 49.5e0 AND longitude BETWEEN -125e0 AND -66.5e0",
            ),
        ),
        "skip_loaded_windows": Query(
            over("fires", build=lambda fires: dedup.skip_loaded_windows(_windows(fires), fires)),
            with_views(
                "SELECT start_date FROM windows WHERE start_date NOT IN (SELECT acq_date FROM fires)",
                "fires",
                windows="SELECT strftime(CAST(acq_date AS DATE) + 3, '%Y-%m-%d') AS start_date FROM"
                " (SELECT DISTINCT acq_date FROM fires) AS d",
            ),
        ),
        "union_sources": Query(
            over(
                "fires",
                build=lambda fires: dedup.union_sources(
                    _table(fires), filter_confidence_normalized(fires, "low").select(*DETECTION_KEY, "event_id")
                ),
            ),
            with_views(
                f"{TABLE} UNION ALL SELECT event_id, {KEY} FROM fires WHERE lower(trim(confidence)) IN ('l', 'low')",
                "fires",
            ),
        ),
    }
