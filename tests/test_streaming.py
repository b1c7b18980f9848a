from __future__ import annotations

from pyspark.sql import functions as F

from firelake.schemas import DETECTION_KEY, FIRES
from firelake.session import work_dir
from firelake.sources.tables import scan_or_empty
from firelake.streaming import detection_feed, hms_feed, poll_once, start_feed, stream_dedup

HEADER = "latitude,longitude,bright_ti4,bright_ti5,frp,acq_date,acq_time,confidence"
ROW = "34.05,-118.25,330.5,290.1,25.5,2024-08-01,{},h"


def _land(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_feeds_insert_each_detection_once(spark, tmp_path):
    table, checkpoint = work_dir(spark, "fires"), work_dir(spark, "checkpoint")
    feeds = [
        lambda s: detection_feed(s, str(tmp_path / "satellite")),
        lambda s: hms_feed(s, str(tmp_path / "smoke"), today=lambda: "2024-09-09"),
    ]

    def stored():
        return scan_or_empty(spark, table, FIRES).count()

    _land(tmp_path / "satellite", "1.csv", HEADER, ROW.format("0930"), ROW.format("0931"), ROW.format("0931"))
    # The second feed has landed nothing: it fails, the first goes on.
    assert poll_once(spark, feeds, table, checkpoint) == ["satellite"]
    assert stored() == 3  # copies inside a batch are kept
    _land(tmp_path / "satellite", "2.csv", HEADER, ROW.format("930"), ROW.format("1000"))
    _land(tmp_path / "smoke", "1.csv", "lat,lon,date,time", "34.05,-118.25,2024-08-01,10:00", "34.05,-118.25,,")
    assert poll_once(spark, feeds, table, checkpoint) == ["satellite", "smoke"]
    assert stored() == 5
    assert poll_once(spark, feeds, table, checkpoint) == ["satellite", "smoke"]
    assert stored() == 5
    assert scan_or_empty(spark, table, FIRES).where("acq_date = '2024-09-09' AND acq_time = '0000'").count() == 1


def test_a_file_with_another_header_holds_up_nothing(spark, tmp_path):
    table, checkpoint = work_dir(spark, "fires"), work_dir(spark, "checkpoint")
    feeds = [lambda s: detection_feed(s, str(tmp_path / "in"))]
    _land(tmp_path / "in", "1.csv", "a,b", "1,2")
    assert poll_once(spark, feeds, table, checkpoint) == ["satellite"]
    _land(tmp_path / "in", "2.csv", HEADER, ROW.format("0930"))
    _land(tmp_path / "in", "3.csv", "extra," + HEADER, "x," + ROW.format("0931"))
    assert poll_once(spark, feeds, table, checkpoint) == ["satellite"]
    assert scan_or_empty(spark, table, FIRES).count() == 2


def test_rejects_of_a_replayed_batch_are_written_once(spark, tmp_path):
    table, rejects = work_dir(spark, "fires"), work_dir(spark, "rejects")
    _land(tmp_path / "in", "1.csv", "a,b", "1,2")
    _land(tmp_path / "in", "2 [x].csv", HEADER, ROW.format("0930"))

    def poll(checkpoint):
        feeds = [lambda s: detection_feed(s, str(tmp_path / "in"))]
        assert poll_once(spark, feeds, table, str(tmp_path / checkpoint), rejects) == ["satellite"]
        rows = spark.read.parquet(rejects).collect()
        assert scan_or_empty(spark, table, FIRES).count() == 1
        return sorted((r.file.rsplit("/", 1)[1], r.header, r.source, r.batch) for r in rows)

    first = [("1.csv", "a,b", "satellite", 0)]
    assert poll("one") == first == poll("two")
    _land(tmp_path / "in", "3.csv", "c", "1")
    assert poll("two") == first + [("3.csv", "c", "satellite", 1)]
    # The reason names what is missing.
    assert "latitude" in spark.read.parquet(rejects).first().reason


def test_the_file_stream_reads_names_only(spark, tmp_path):
    _land(tmp_path / "in", "1.csv", HEADER, ROW.format("0930"))
    query = start_feed(spark, detection_feed(spark, str(tmp_path / "in")), work_dir(spark, "fires"), str(tmp_path / "c"), once=True)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "ReadSchema: struct<path:string>" in plan


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    """A checkpoint lost after the append, as by a driver failure in between."""
    table = work_dir(spark, "fires")
    _land(tmp_path / "in", "1.csv", HEADER, ROW.format("0930"), ROW.format("0931"))
    for attempt in range(2):
        feed = detection_feed(spark, str(tmp_path / "in"))
        start_feed(spark, feed, table, str(tmp_path / f"checkpoint-{attempt}"), once=True).awaitTermination()
    assert scan_or_empty(spark, table, FIRES).count() == 2


def test_stream_dedup_keeps_one_row_per_key(spark, tmp_path, make_fires):
    row = (34.05, -118.25, 1.0, 1.0, 1.0, "2024-08-01", "0930", "h")
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    odd = [(*row[:6], None, "h"), (None, *row[1:]), (*row[:5], "soon", "0930", "h")]
    make_fires(row, row, (*row[:6], "0931", "h"), *odd, *odd).coalesce(1).write.parquet(source)
    stream = stream_dedup(spark.readStream.schema(FIRES).parquet(source))
    options = {"checkpointLocation": str(tmp_path / "checkpoint")}
    stream.writeStream.format("parquet").options(**options).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.schema(FIRES).parquet(out)
    whole = got.where("latitude IS NOT NULL AND acq_time IS NOT NULL AND acq_date <> 'soon'")
    assert whole.count() == 2 == whole.select(*DETECTION_KEY).distinct().count()
    assert whole.where(F.col("acq_time") == "0930").count() == 1
    # A null in the key, or a time that cannot be read, is a copy of nothing.
    assert got.count() == 2 + 2 * len(odd)
