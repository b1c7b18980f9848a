"""Feeds as file streams: each landed file is normalised and inserted once.

One query and one checkpoint per feed, all started together, so neither a failing nor a slow feed holds up
another. One `source=` folder per feed, so their appends do not meet; inside one driver a feed looks
detections up and adds them while no other does. A micro-batch that is run again after a failure finds
its rows in the table and adds nothing, and writes its rejects over those of the first attempt.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from threading import Lock
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firelake.plans.ingest import insert_detections
from firelake.schemas import DETECTION_KEY
from firelake.sources.csv import REJECTS, Landed, Reject, land_detections, land_hms, literal_path

# Poll interval.
POLL_INTERVAL = "30 minutes"

# The columns of a stream of files.
LANDED_FILES = "path string, modificationTime timestamp, length long, content binary"

log = logging.getLogger(__name__)
_inserting: defaultdict[str, Lock] = defaultdict(Lock)


class Feed(NamedTuple):
    """Where a source lands its files and how these become detections."""

    source: str
    landing: str
    read: Callable[[SparkSession, list[str]], Landed]


def detection_feed(spark: SparkSession, landing: str, source: str = "satellite") -> Feed:
    return Feed(source, landing, land_detections)


def hms_feed(
    spark: SparkSession, landing: str, source: str = "smoke", today: Callable[[], str] | None = None
) -> Feed:
    """A row without a date gets the day its file was written, so that a replay gives it the same key."""
    written = F.col("_written").cast("date").cast("string")
    return Feed(source, landing, lambda s, files: land_hms(s, files, written if today is None else today()))


def write_rejects(spark: SparkSession, rejects: list[Reject], path: str, source: str, batch_id: int) -> None:
    """(file, header, reason) under `source=<feed>/batch=<id>`; a batch that is run again replaces its own."""
    rows = spark.createDataFrame(rejects, REJECTS).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/source={source}/batch={batch_id}")


def start_feed(
    spark: SparkSession,
    feed: Feed,
    table: str,
    checkpoint: str,
    once: bool = False,
    interval: str = POLL_INTERVAL,
    files_per_batch: int | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Start the query of one feed: every `interval`, or over what has landed by now.

    The stream carries the names of landed files; a batch reads its files natively, each by its own header, so
    a file with other columns holds up neither its batch nor a later one. What cannot be read goes to the table
    `rejects`, if one is given. `files_per_batch` bounds a batch.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Names with glob characters make the source list a file of their batch more than once.
        files = sorted({literal_path(r["path"]) for r in batch.collect()})
        landed = feed.read(session, files)
        if rejects is not None and landed.rejects:
            write_rejects(session, landed.rejects, rejects, feed.source, batch_id)
        with _inserting[table]:
            counts = insert_detections(session, landed.rows, table, feed.source)
        log.info("%s batch %d: inserted %d, skipped %d", feed.source, batch_id, counts.inserted, counts.skipped)

    reader = spark.readStream.format("binaryFile").schema(LANDED_FILES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The content is not among the columns, so it is not read here.
    landed = reader.load(feed.landing).select("path")
    writer = landed.writeStream.foreachBatch(insert).option("checkpointLocation", f"{checkpoint}/{feed.source}")
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def poll_once(
    spark: SparkSession,
    feeds: Iterable[Callable[[SparkSession], Feed]],
    table: str,
    checkpoint: str,
    rejects: str | None = None,
) -> list[str]:
    """Run all feeds together over what has landed; a failure is logged and the others go on.

    Returns the sources that succeeded.
    """
    running, done = [], []
    for make in feeds:
        try:
            feed = make(spark)
            running.append((feed.source, start_feed(spark, feed, table, checkpoint, once=True, rejects=rejects)))
        except Exception:
            log.exception("feed did not start")
    for source, query in running:
        try:
            query.awaitTermination()
            done.append(source)
        except Exception:
            log.exception("feed %s failed", source)
    return done


def acquired_at(date: Column, time: Column) -> Column:
    """Event time of a detection, for the watermark."""
    clock = F.concat_ws(":", F.substring(time, 1, 2), F.substring(time, 3, 2))
    return F.concat_ws(" ", date, clock).try_cast("timestamp")


def stream_dedup(
    detections: DataFrame, delay: str = "2 days", key: Sequence[str] = tuple(DETECTION_KEY)
) -> DataFrame:
    """First row of each key while its time is within the watermark; state stays bounded.

    Unlike the insert into a table, copies inside a batch are dropped, and so are rows
    that arrive later than the watermark. As there, a row with a null in its key is a copy of none: it
    passes without state, and so does a row whose time cannot be read.
    """
    timed = detections.withColumn("_at", acquired_at(F.col("acq_date"), F.col("acq_time"))).withWatermark("_at", delay)
    whole = F.col("_at").isNotNull()
    for name in key:
        whole &= F.col(name).isNotNull()
    once = timed.where(whole).dropDuplicatesWithinWatermark(list(key))
    return once.unionByName(timed.where(~whole)).drop("_at")
