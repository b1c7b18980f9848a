"""Counts, headline values, map summaries, test-build history."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.checks.query import Query, over
from firelake.checks.rows import FALLBACK, PREPARED_STEP, US, prepared
from firelake.checks.views import with_views
from firelake.functions import confidence_label
from firelake.operators import buildlog, cells, dedup, summary
from firelake.operators.filters import filter_us_box

NOW = datetime(2024, 2, 6, 1, 0, tzinfo=UTC)
BUILD_IDS = [f"b{100 + i}-{i}" for i in range(12)]

GRID = {
    "projected": f"SELECT latitude, longitude, (longitude + 180e0) / 360e0 * 8192e0 AS x, (0.5e0 - ln((1e0 +"
    " sin(radians(latitude))) / (1e0 - sin(radians(latitude)))) / (4e0 * pi())) * 8192e0 AS y FROM fires",
}
LAST_OUTCOME = {
    "outcomes": "SELECT nodeid, build_id, run_order, arg_max(outcome, position) AS outcome FROM results"
    " GROUP BY nodeid, build_id, run_order",
}
SHORT = (
    "'[' || CASE WHEN split_part(nodeid, '/', 3) LIKE 'test_%' THEN replace(replace(split_part(split_part(nodeid, '::', 1),"
    " '/', 3), 'test_', ''), '.py', '') ELSE split_part(nodeid, '/', 3) END || '] ' || split_part(nodeid, '::', 2)"
    " || ' · ' || split_part(nodeid, '::', 3)"
)


def builds(results: DataFrame) -> DataFrame:
    """One row per build with its summary, as a build file carries it."""
    return results.groupBy("build_id", "run_order").agg(
        F.struct(
            F.count_if(F.col("outcome") == "passed").alias("passed"),
            F.count_if(F.col("outcome") == "failed").alias("failed"),
            F.when(F.col("run_order") % 3 > 0, F.count("*")).alias("total"),
        ).alias("summary")
    ).select(
        "build_id",
        F.lit(None).cast("string").alias("sha"),
        F.when(F.col("run_order") > 0, F.col("run_order")).alias("run_number"),
        "summary",
    )


def _distinct_cells_sql(max_lat: str, limit: int) -> str:
    return with_views(
        "SELECT DISTINCT round(latitude * 1e2) / 1e2 AS latitude, round(longitude * 1e2) / 1e2 AS longitude FROM fires"
        f" WHERE latitude BETWEEN 24e0 AND {max_lat} AND longitude BETWEEN -125e0 AND -66.5e0"
        f" ORDER BY latitude DESC, longitude LIMIT {limit}",
        "fires",
    )


def queries() -> dict[str, Query]:
    per_severity = (
        "(SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning')"
        " AS warning, count(*) FILTER (WHERE severity = 'monitor') AS monitor, max(risk) AS max_risk,"
        " max(acq_date) AS latest_date FROM prepared)"
    )
    us_prepared = PREPARED_STEP + f" WHERE {US}"
    matrix = ", ".join(
        f"coalesce(max(CASE WHEN build_id = '{b}' THEN CASE outcome WHEN 'error' THEN 'failed' WHEN 'unknown'"
        f" THEN 'none' ELSE outcome END END), 'none') AS \"{b}\""
        for b in BUILD_IDS
    )
    return {
        "count_by_date": Query(
            over("fires", build=dedup.count_by_date),
            with_views("SELECT acq_date, count(*) AS n FROM fires GROUP BY acq_date", "fires"),
        ),
        "distinct_dates": Query(
            over("fires", build=dedup.distinct_dates), with_views("SELECT DISTINCT acq_date FROM fires", "fires")
        ),
        "distinct_cells_weather": Query(over("fires", build=cells.weather_cells), _distinct_cells_sql("48.5e0", 50)),
        "distinct_cells_soil": Query(over("fires", build=cells.soil_cells), _distinct_cells_sql("49.5e0", 100)),
        "label_distribution": Query(
            over(
                "fires",
                build=lambda fires: summary.label_distribution(
                    fires.select(confidence_label(F.col("confidence")).alias("label"))
                ),
            ),
            with_views("SELECT label, count(*) AS n FROM scored GROUP BY label", "scored"),
        ),
        "severity_counts": Query(
            over("fires", build=lambda fires: summary.severity_counts(prepared(filter_us_box(fires)))),
            with_views(
                "SELECT severity, count(*) AS n FROM prepared GROUP BY severity", "fires", prepared=us_prepared
            ),
        ),
        "kpi_summary": Query(
            over("fires", build=lambda fires: summary.kpi_summary(prepared(filter_us_box(fires)))),
            with_views(f"SELECT * FROM {per_severity} AS s", "fires", prepared=us_prepared),
        ),
        "staleness": Query(
            over("fires", build=lambda fires: summary.staleness(fires, NOW)),
            with_views(
                f"SELECT epoch(TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}') - epoch(CAST(max(acq_date) AS TIMESTAMP)) > 604800"
                " AS is_stale FROM fires",
                "fires",
            ),
        ),
        "bounding_box": Query(
            over("fires", build=lambda fires: summary.bounding_box(filter_us_box(fires))),
            with_views(
                "SELECT n, min_lat, max_lat, min_lon, max_lon, round(degrees(2 * atan(exp((0.5e0 - (top + low) / 2) * 2 * pi()))"
                " - pi() / 2) * 1e6) / 1e6 AS center_lat, round((min_lon + max_lon) / 2 * 1e6) / 1e6 AS center_lon,"
                " CAST(greatest(4, least(7, floor(round(log2(least(924e0 / 256 * 360 / (max_lon - min_lon),"
                " 668e0 / 256 / (low - top))) * 1e2) / 1e2))) AS INTEGER) AS zoom, 7 AS max_zoom FROM placed",
                "fires",
                box="SELECT count(*) AS n, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon,"
                f" max(longitude) AS max_lon FROM fires WHERE {US}",
                placed="SELECT *, 0.5e0 - ln((1 + sin(radians(max_lat))) / (1 - sin(radians(max_lat)))) / (4 * pi()) AS top,"
                " 0.5e0 - ln((1 + sin(radians(min_lat))) / (1 - sin(radians(min_lat)))) / (4 * pi()) AS low FROM box",
            ),
        ),
        "heat_points": Query(
            over("fires", build=lambda fires: summary.heat_points(prepared(fires).select("lat", "lon", "risk"))),
            with_views(
                "SELECT lat, lon, risk, risk / greatest((SELECT max(risk) FROM prepared), 1e0) AS weight"
                " FROM prepared WHERE risk > 0",
                "fires",
                prepared=f"SELECT latitude AS lat, longitude AS lon, {FALLBACK} AS risk FROM fires",
            ),
        ),
        "cluster_counts": Query(
            over("fires", build=lambda fires: summary.cluster_counts(fires, zoom=5)),
            with_views(
                "SELECT CAST(floor(x / 40) AS BIGINT) AS grid_x, CAST(floor(y / 40) AS BIGINT) AS grid_y, count(*) AS n,"
                " round(sum(CAST(round(latitude * 1e6) AS BIGINT)) / count(*)) / 1e6 AS latitude,"
                " round(sum(CAST(round(longitude * 1e6) AS BIGINT)) / count(*)) / 1e6 AS longitude,"
                " CASE WHEN count(*) >= 100 THEN 'large' WHEN count(*) >= 10 THEN 'medium' ELSE 'small' END AS size"
                " FROM projected GROUP BY 1, 2",
                "fires",
                **GRID,
            ),
        ),
        "cluster_pyramid": Query(
            over("fires", build=summary.cluster_pyramid),
            with_views(
                "SELECT zoom, CAST(floor(x * 256 * (1 << zoom) / 40) AS BIGINT) AS grid_x,"
                " CAST(floor(y * 256 * (1 << zoom) / 40) AS BIGINT) AS grid_y, count(*) AS n,"
                " round(sum(CAST(round(latitude * 1e6) AS BIGINT)) / count(*)) / 1e6 AS latitude,"
                " round(sum(CAST(round(longitude * 1e6) AS BIGINT)) / count(*)) / 1e6 AS longitude,"
                " CASE WHEN count(*) >= 100 THEN 'large' WHEN count(*) >= 10 THEN 'medium' ELSE 'small' END AS size"
                " FROM at_zoom GROUP BY 1, 2, 3",
                "fires",
                at_zoom="SELECT latitude, longitude, (longitude + 180e0) / 360e0 AS x, 0.5e0 - ln((1e0 + sin(radians(latitude)))"
                " / (1e0 - sin(radians(latitude)))) / (4e0 * pi()) AS y, unnest(range(8)::INTEGER[]) AS zoom FROM fires",
            ),
        ),
        "request_metrics": Query(
            over("events", build=lambda log: summary.request_metrics(log, "event_type", "value", "ts")),
            "SELECT event_type AS endpoint, count(*) AS requests, arg_max(value, ts) AS last_response_ms"
            " FROM events GROUP BY event_type",
        ),
        "order_builds": Query(
            over("results", build=lambda results: buildlog.order_builds(builds(results)).select("build_id", "run_number")),
            with_views(
                "SELECT DISTINCT build_id, CASE WHEN run_order > 0 THEN run_order END AS run_number FROM results", "results"
            ),
        ),
        "build_summary": Query(
            over("results", build=lambda results: buildlog.build_summary(builds(results))),
            with_views(
                "SELECT build_id, run_number, sha, passed, failed, CASE WHEN coalesce(run_number, 0) % 3 > 0 THEN n"
                " ELSE passed + failed END AS total, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL(' || failed || ')' END"
                " AS status FROM b",
                "results",
                b="SELECT build_id, CASE WHEN run_order > 0 THEN run_order END AS run_number, split_part(build_id, '-', 2)"
                " AS sha, count(*) FILTER (WHERE outcome = 'passed') AS passed,"
                " count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) AS n FROM results"
                " GROUP BY build_id, run_order",
            ),
        ),
        "outcome_matrix": Query(
            over("results", build=lambda results: buildlog.outcome_matrix(results, BUILD_IDS)),
            with_views(
                f"SELECT nodeid, {SHORT} AS test, {matrix} FROM outcomes GROUP BY nodeid", "results", **LAST_OUTCOME
            ),
        ),
        "regressions": Query(
            over("results", build=buildlog.regressions),
            with_views(
                f"SELECT f.nodeid, {SHORT.replace('nodeid', 'f.nodeid')} AS test, f.build_id AS first_failed,"
                " (SELECT p.build_id FROM outcomes p WHERE p.nodeid = f.nodeid AND p.outcome = 'passed' AND"
                " (p.run_order > f.run_order OR (p.run_order = f.run_order AND p.build_id > f.build_id))"
                " ORDER BY p.run_order, p.build_id LIMIT 1) AS fixed_in FROM failed f WHERE f.rn = 1",
                "results",
                **LAST_OUTCOME,
                failed="SELECT *, row_number() OVER (PARTITION BY nodeid ORDER BY run_order, build_id) AS rn FROM outcomes"
                " WHERE outcome = 'failed'",
            ),
        ),
    }
