"""Streaming ingest and streaming deduplication, run over what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firelake.checks.joins import STORED
from firelake.checks.query import Query
from firelake.checks.rows import LEVEL, US
from firelake.checks.sources import COLUMNS, HMS, detections, land_csv
from firelake.checks.views import SPARK, VIEWS, with_views
from firelake.schemas import DETECTION_KEY, FIRES
from firelake.session import work_dir
from firelake.sources.tables import scan_table
from firelake.streaming import detection_feed, hms_feed, poll_once, stream_dedup

KEY = ", ".join(DETECTION_KEY)
# Seen by the second feed too.
SMOKE = "confidence IN ('n', 'medium')"


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls of two feeds that overlap, and a third that finds nothing new."""
    root = work_dir(spark, "stream")
    table = f"{root}/fires"
    fires = detections(spark, sf_dir)
    smoke_header = [f"{text} AS `{name}`" for name, text in HMS["datetime"].items()]
    feeds = [
        lambda s: detection_feed(s, f"{root}/satellite"),
        lambda s: hms_feed(s, f"{root}/smoke"),
    ]
    satellite = fires.select(*FIRES.fieldNames())
    land_csv(satellite.where(STORED), f"{root}/satellite")
    land_csv(fires.where(SMOKE).selectExpr(*smoke_header), f"{root}/smoke")
    # One feed at a time: both hold some detections, and the first one's rows are to stay.
    for feed in feeds:
        poll_once(spark, [feed], table, f"{root}/checkpoint")
    land_csv(satellite, f"{root}/satellite")
    poll_once(spark, feeds, table, f"{root}/checkpoint")
    poll_once(spark, feeds, table, f"{root}/checkpoint")
    return scan_table(spark, table, FIRES)


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the files that two feeds could not read, by reason, after the batch was run twice."""
    root = work_dir(spark, "rejects")
    fires = detections(spark, sf_dir).select("event_id", *FIRES.fieldNames())
    land_csv(fires.where("event_id % 4 = 0").drop("frp", "acq_time"), f"{root}/satellite")
    land_csv(fires.where("event_id % 4 = 1"), f"{root}/satellite")
    land_csv(fires.where("event_id % 4 = 2").select("latitude", "longitude"), f"{root}/smoke")
    land_csv(fires.where("event_id % 4 = 3").select("frp", "acq_date"), f"{root}/smoke")
    feeds = [lambda s: detection_feed(s, f"{root}/satellite"), lambda s: hms_feed(s, f"{root}/smoke")]
    for attempt in range(2):
        # A checkpoint lost after the batch: the same files come as the same batch again.
        poll_once(spark, feeds, f"{root}/fires", f"{root}/checkpoint-{attempt}", f"{root}/rejects")
    rejects = spark.read.parquet(f"{root}/rejects")
    lines = spark.read.text([f"{root}/satellite", f"{root}/smoke"])
    lines = lines.select("value", F.col("_metadata.file_path").alias("line_of"))
    # Both write one path in their own way.
    same = F.regexp_replace(F.url_decode("line_of"), "^file:/+", "") == F.regexp_replace(F.url_decode("file"), "^file:/+", "")
    records = rejects.join(lines, same & (F.col("value") != F.col("header")))
    return records.groupBy("source", "header", "reason").agg(F.count("*").alias("n_records"))


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection arrives twice; the stream passes it once."""
    root = work_dir(spark, "stream-dedup")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    fires = events.selectExpr(*[c.format(**SPARK) for c in VIEWS["fires"][1]])
    twice = fires.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    # Some have no time: each of their copies stays.
    twice = twice.withColumn("acq_time", F.when(F.col("event_id") % 50 > 0, F.col("acq_time")))
    passed = stream_dedup(twice).select(*DETECTION_KEY)
    writer = passed.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def queries() -> dict[str, Query]:
    def new(batch: str, *tables: str) -> str:
        conditions = [
            f"NOT EXISTS (SELECT 1 FROM {t} t WHERE {' AND '.join(f't.{k} = b.{k}' for k in DETECTION_KEY)})" for t in tables
        ]
        return f"SELECT b.* FROM {batch} b WHERE {' AND '.join(conditions)}"

    satellite = f"SELECT {COLUMNS} FROM fires WHERE {US}"
    short = ",".join(name for name in FIRES.fieldNames() if name not in ("frp", "acq_time"))
    return {
        "stream_ingest": Query(
            _ingest,
            with_views(
                "SELECT * FROM first UNION ALL SELECT * FROM smoke UNION ALL SELECT * FROM second",
                "fires",
                first=f"{satellite} AND {STORED}",
                landed_smoke="SELECT latitude, longitude, bright_ti4, CAST(NULL AS DOUBLE) AS bright_ti5, frp, acq_date,"
                f" acq_time, {LEVEL} AS confidence FROM fires WHERE {US} AND {SMOKE}",
                smoke=new("landed_smoke", "first"),
                landed_second=satellite,
                second=new("landed_second", "first", "smoke"),
            ),
        ),
        "stream_rejects": Query(
            _rejects,
            with_views(
                f"SELECT 'satellite' AS source, 'event_id,{short}' AS header, 'no column frp, acq_time' AS reason, count(*) AS n_records"
                " FROM fires WHERE event_id % 4 = 0 HAVING count(*) > 0 UNION ALL"
                " SELECT 'smoke', 'latitude,longitude', 'the header must name a date, datetime or yearday column', count(*)"
                " FROM fires WHERE event_id % 4 = 2 HAVING count(*) > 0 UNION ALL"
                " SELECT 'smoke', 'frp,acq_date', 'the header must name latitude and longitude columns', count(*)"
                " FROM fires WHERE event_id % 4 = 3 HAVING count(*) > 0",
                "fires",
            ),
        ),
        "stream_dedup": Query(
            _dedup,
            with_views(
                f"SELECT DISTINCT {KEY} FROM fires WHERE event_id % 50 > 0 UNION ALL"
                " SELECT latitude, longitude, acq_date, NULL FROM fires, range(2) WHERE event_id % 50 = 0",
                "fires",
            ),
        ),
    }
