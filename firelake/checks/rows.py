"""Filters, projections, regions and ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.checks.functions import FALLBACK
from firelake.checks.query import Query, over
from firelake.checks.views import region_box_sql, with_views
from firelake.functions import fallback_risk
from firelake.operators import filters
from firelake.operators.ordering import sort_events, top_scored
from firelake.operators.regions import join_region_boxes
from firelake.plans.dashboard import apply_form, prepare_list
from firelake.plans.serving import latest_features, latest_fires, project_api, project_prepared, select_newest
from firelake.schemas import FEATURES, REGIONS
from firelake.sources.tables import scan_limit

ORDER = ("fetched_at", "seq")
SIDE = ("weather_observations", "environmental_conditions")
DETECTION = (
    "event_id, latitude, longitude, bright_ti4, bright_ti5, frp, acq_date, acq_time, confidence"
)
US = "latitude BETWEEN 24e0 AND 49.5e0 AND longitude BETWEEN -125e0 AND -66.5e0"
NEWEST = "ORDER BY acq_date DESC, acq_time DESC, event_id LIMIT 1000"
API = (
    "latitude AS lat, longitude AS lon, bright_ti4 AS brightness, frp, confidence, acq_date, acq_time,"
    f" {FALLBACK} AS risk"
)
SEVERITY = (
    "CASE WHEN coalesce(bright_ti4, 0e0) >= 350e0 OR coalesce(frp, 0e0) >= 50e0 THEN 'critical'"
    " WHEN coalesce(bright_ti4, 0e0) >= 320e0 OR coalesce(frp, 0e0) >= 20e0 THEN 'warning' ELSE 'monitor' END"
)
LEVEL = (
    "CASE WHEN lower(trim(confidence)) IN ('h', 'high') THEN 'high' WHEN lower(trim(confidence)) IN ('l', 'low')"
    " THEN 'low' WHEN lower(trim(confidence)) IN ('n', 'nominal', 'medium', 'med') THEN 'nominal'"
    " ELSE coalesce(nullif(lower(trim(confidence)), ''), 'unknown') END"
)


def _id(position: str) -> str:
    def text(name: str) -> str:
        return f"coalesce(regexp_replace(CAST({name} AS VARCHAR), '\\.0$', ''), 'na')"

    fields = [text("latitude"), text("longitude"), "coalesce(acq_date, 'na')", "coalesce(acq_time, 'na')"]
    return " || '|' || ".join([*fields, text("bright_ti4"), text("frp"), f"CAST({position} AS VARCHAR)"])


PREPARED = (
    "latitude AS lat, longitude AS lon, coalesce(bright_ti4, 0e0) AS brightness, coalesce(frp, 0e0) AS frp,"
    f" {LEVEL} AS confidence, acq_date, acq_time, {FALLBACK} AS risk, {SEVERITY} AS severity, "
)
PREPARED_STEP = f"SELECT {PREPARED} {_id('event_id')} AS id FROM fires"


def box_sql(region: str) -> str:
    b = REGIONS[region]
    return f"latitude BETWEEN {b.min_lat}e0 AND {b.max_lat}e0 AND longitude BETWEEN {b.min_lon}e0 AND {b.max_lon}e0"


def prepared(fires: DataFrame) -> DataFrame:
    """Every detection as a prepared event; the row key takes the place in the list."""
    scored = fires.withColumn("risk", fallback_risk(F.col("bright_ti4"), F.col("frp")))
    records = scored.select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("bright_ti4").alias("brightness"),
        *["frp", "confidence", "acq_date", "acq_time", "risk", "event_id"],
    )
    return project_prepared(records, "event_id")


def _kept(build) -> object:
    return over("fires", build=lambda fires: build(fires).select(*DETECTION.split(", ")))


def _where(condition: str) -> str:
    return with_views(f"SELECT {DETECTION} FROM fires WHERE {condition}", "fires")


def _latest(region: str | None = None, confidence: str | None = None) -> Query:
    condition = US
    if region not in (None, "us"):
        condition += f" AND {box_sql(region.lower())}"
    if confidence is not None:
        condition += f" AND lower(confidence) = '{confidence.lower()}'"

    return Query(
        over(
            "fires",
            build=lambda fires: latest_fires(
                fires, region=region, confidence=confidence, tie_break=("event_id",), order=ORDER
            ),
        ),
        with_views(f"SELECT {API} FROM (SELECT * FROM fires WHERE {condition} {NEWEST}) AS newest", "fires"),
    )


LAST_CONDITIONS = {
    "w": "SELECT round(latitude * 1e2) AS la, round(longitude * 1e2) AS lo, wind_speed_kmh, humidity_pct, temp_c,"
    " row_number() OVER (PARTITION BY round(latitude * 1e2), round(longitude * 1e2) ORDER BY fetched_at DESC, seq DESC)"
    " AS rn FROM weather_observations",
    "e": "SELECT round(latitude * 1e2) AS la, round(longitude * 1e2) AS lo, soil_moisture, vpd_kpa, et0_mm,"
    " row_number() OVER (PARTITION BY round(latitude * 1e2), round(longitude * 1e2) ORDER BY fetched_at DESC, seq DESC)"
    " AS rn FROM environmental_conditions",
}
JOIN_CONDITIONS = (
    "LEFT JOIN w ON w.rn = 1 AND w.la = round(f.latitude * 1e2) AND w.lo = round(f.longitude * 1e2)"
    " LEFT JOIN e ON e.rn = 1 AND e.la = round(f.latitude * 1e2) AND e.lo = round(f.longitude * 1e2)"
)
FEATURE_SQL = {
    "bright_ti4": "coalesce(f.bright_ti4, 0e0)",
    "bright_ti5": "coalesce(f.bright_ti5, 0e0)",
    "frp": "coalesce(f.frp, 0e0)",
    "hour": "CAST(substr(f.acq_time, 1, 2) AS INTEGER)",
    "month": "CAST(substr(f.acq_date, 6, 2) AS INTEGER)",
    "lat_bin": "CAST(floor(f.latitude) AS INTEGER)",
    "lon_bin": "CAST(floor(f.longitude) AS INTEGER)",
} | {n: f"coalesce({n}, 0e0)" for n in FEATURES[7:]}
FEATURE_LIST = ", ".join(f"{text} AS {name}" for name, text in FEATURE_SQL.items())


def _sorted(key: str, direction: str) -> Query:
    """All prepared events in the asked order; the SQL check compares the rows, a unit
    test the order."""
    return Query(
        over("fires", build=lambda fires: sort_events(prepared(fires), key, direction)),
        with_views("SELECT * FROM prepared", "fires", prepared=PREPARED_STEP),
    )


def queries() -> dict[str, Query]:
    form = "confidence = 'high' AND brightness >= 300 AND frp >= 5"
    return {
        "latest_fires": _latest(),
        "latest_fires_region": _latest(region="TX"),
        "latest_fires_confidence": _latest(confidence="HIGH"),
        "latest_fires_region_confidence": _latest(region="ca", confidence="high"),
        "latest_features": Query(
            over(
                "fires",
                *SIDE,
                build=lambda fires, weather, soil: latest_features(
                    select_newest(fires, tie_break=("event_id",)), weather, soil, ORDER
                ).select("event_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in FEATURES]),
            ),
            with_views(
                f"SELECT event_id, {FEATURE_LIST} FROM (SELECT * FROM fires WHERE {US} {NEWEST}) AS f {JOIN_CONDITIONS}",
                "fires",
                *SIDE,
                **LAST_CONDITIONS,
            ),
        ),
        "project_api": Query(
            over(
                "fires",
                build=lambda fires: project_api(
                    fires.withColumn("risk", fallback_risk(F.col("bright_ti4"), F.col("frp")))
                ),
            ),
            with_views(f"SELECT {API} FROM fires", "fires"),
        ),
        "project_prepared": Query(
            over("fires", build=prepared), with_views("SELECT * FROM prepared", "fires", prepared=PREPARED_STEP)
        ),
        "prepare_list": Query(
            over("fires", build=lambda fires: prepare_list(latest_fires(fires, tie_break=("event_id",)))),
            with_views(
                f"SELECT {PREPARED} {_id('place')} AS id FROM placed",
                "fires",
                newest=f"SELECT * FROM fires WHERE {US} {NEWEST}",
                placed="SELECT *, row_number() OVER (ORDER BY acq_date DESC, acq_time DESC, latitude, longitude,"
                " bright_ti4 NULLS FIRST, frp NULLS FIRST) - 1 AS place FROM newest",
            ),
        ),
        "filter_us_box": Query(_kept(filters.filter_us_box), _where(US)),
        "filter_region": Query(
            _kept(lambda fires: filters.filter_region(fires, "CA")), _where(f"{US} AND {box_sql('ca')}")
        ),
        "filter_region_us": Query(_kept(lambda fires: filters.filter_region(fires, "us")), _where(US)),
        "filter_confidence_exact": Query(
            _kept(lambda fires: filters.filter_confidence_exact(fires, "High")), _where("lower(confidence) = 'high'")
        ),
        "filter_confidence_normalized": Query(
            _kept(lambda fires: filters.filter_confidence_normalized(fires, "nominal")), _where(f"{LEVEL} = 'nominal'")
        ),
        "filter_min_brightness_frp": Query(
            _kept(lambda fires: filters.filter_min_brightness_frp(fires, "300", 5)),
            _where("coalesce(bright_ti4, 0e0) >= 300 AND coalesce(frp, 0e0) >= 5"),
        ),
        "apply_form": Query(
            over("fires", build=lambda fires: apply_form(prepared(fires), "high", "300", "5")),
            with_views(f"SELECT * FROM prepared WHERE {form}", "fires", prepared=PREPARED_STEP),
        ),
        "filter_positive_risk": Query(
            over("fires", build=lambda fires: filters.filter_positive_risk(prepared(fires))),
            with_views("SELECT * FROM prepared WHERE risk > 0", "fires", prepared=PREPARED_STEP),
        ),
        "drop_missing_coords": Query(
            over(
                "fires",
                build=lambda fires: filters.drop_missing_coords(
                    fires.select(
                        "event_id",
                        F.when(F.col("event_id") % 29 > 0, F.col("latitude")).alias("latitude"),
                        F.when(F.col("event_id") % 31 > 0, F.col("longitude")).alias("longitude"),
                    )
                ),
            ),
            with_views(
                "SELECT event_id, latitude, longitude FROM fires WHERE event_id % 29 > 0 AND event_id % 31 > 0", "fires"
            ),
        ),
        "filter_by_date": Query(
            _kept(lambda fires: filters.filter_by_date(fires, "2024-01-15")), _where("acq_date = '2024-01-15'")
        ),
        "find_by_id": Query(
            over(
                "fires",
                build=lambda fires: filters.find_by_id(
                    prepared(fires).withColumn("id", F.element_at(F.split("id", r"\|"), -1)), "77"
                ),
            ),
            with_views(
                f"SELECT {PREPARED} CAST(event_id AS VARCHAR) AS id FROM fires WHERE event_id = 77", "fires"
            ),
        ),
        "join_region_boxes": Query(
            over("fires", build=lambda fires: join_region_boxes(fires.select("event_id", "latitude", "longitude"))),
            with_views(
                "SELECT event_id, latitude, longitude, region FROM fires JOIN boxes ON latitude BETWEEN min_lat AND max_lat"
                " AND longitude BETWEEN min_lon AND max_lon",
                "fires",
                boxes=region_box_sql(),
            ),
        ),
        "sort_events": _sorted("brightness", "desc"),
        "sort_events_confidence": _sorted("confidence", "asc"),
        "top_scored": Query(
            over("scored", build=lambda scored: top_scored(scored, 20, tie_break=("event_id",))),
            with_views("SELECT * FROM scored ORDER BY score DESC, event_id LIMIT 20", "scored"),
        ),
        "scan_table": Query(_kept(lambda fires: fires), with_views(f"SELECT {DETECTION} FROM fires", "fires")),
        "scan_limit": Query(
            _kept(lambda fires: scan_limit(fires, 500, F.col("event_id"))),
            with_views(f"SELECT {DETECTION} FROM fires ORDER BY event_id LIMIT 500", "fires"),
        ),
    }


