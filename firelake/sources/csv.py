"""Detection files: the satellite product and the smoke/fire product.

Files with different headers land side by side. Their headers are looked up first, one short read per
file; then the files of each header are one native scan, with the header's schema, so column
pruning holds and nothing is joined per line.
"""

from __future__ import annotations

import io
import logging
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from csv import reader as csv_reader
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.functions import (
    datetime_date,
    datetime_time,
    default_date,
    default_time,
    ingest_confidence,
    null_if_nan,
    pad_time,
    to_number,
    yearday_to_date,
)
from firelake.operators.filters import drop_missing_coords, filter_box
from firelake.schemas import FIRES, US_BOX, Box
from firelake.sources.files import matching_paths
from firelake.sources.tables import empty

log = logging.getLogger(__name__)

# Header spellings per field, first match wins.
HMS_ALIASES = {
    "latitude": ["latitude", "lat", "y"],
    "longitude": ["longitude", "lon", "long", "x"],
    "brightness": ["bright_ti4", "brightness", "temp", "temperature"],
    "frp": ["frp", "power", "fire_radiative_power"],
    "confidence": ["confidence", "conf", "confidence_text"],
    "date": ["acq_date", "date", "utc_date"],
    "time": ["acq_time", "time", "utc_time"],
    "datetime": ["acq_datetime", "datetime", "timestamp", "date_time"],
    "yearday": ["yearday", "year_day", "julian_day"],
}

# Characters after which a header with an open quote is taken as it is.
LONGEST_HEADER = 1 << 20
# Bytes of a split, and the cost of opening a file, that leave every file whole and alone in its task.
WHOLE_FILES = str(1 << 40)


class Window(NamedTuple):
    """One landed backfill window."""

    start_date: str
    days: int
    source: str
    path: str


class HeaderGroup(NamedTuple):
    """Landed files with one header."""

    header: str
    columns: list[str]
    files: list[str]


class Reject(NamedTuple):
    """A landed file that cannot be read, and why."""

    file: str
    header: str
    reason: str


class Landed(NamedTuple):
    """Detections of landed files, and the files that gave none."""

    rows: DataFrame
    rejects: list[Reject]


REJECTS = T.StructType([T.StructField(name, T.StringType()) for name in Reject._fields])


def _first_records(single: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, header): the first record of each file that is not blank, quoted line breaks included.

    With one file to a task the rest of the file is not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, header = set(), None, ""
        for batch in batches:
            for value, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of in done:
                    continue
                if of != file:
                    file, header = of, ""
                if not header and not value.removeprefix("\ufeff").strip():
                    continue
                header = f"{header}\n{value}" if header else value
                if header.count('"') % 2 and len(header) < LONGEST_HEADER:
                    continue
                done.add(of)
                yield pa.RecordBatch.from_pydict({"file": [of], "header": [header]})
                if single:
                    return

    return run


def file_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, header) of every landed file that has a line.

    A session of its own gives each file a task of its own, which stops after the first record.
    """
    heads = spark.newSession()
    for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        heads.conf.set(name, WHOLE_FILES)
    heads.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    single = heads.conf.get("spark.sql.files.openCostInBytes") == WHOLE_FILES
    lines = heads.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(_first_records(single), "file string, header string")


def header_columns(header: str) -> list[str]:
    """Column names of a header record; a name that comes again gets its place added."""
    names = next(csv_reader(io.StringIO(header.removeprefix("\ufeff"))), [])
    return [name if name not in names[:i] else f"{name}{i}" for i, name in enumerate(names)]


def header_groups(spark: SparkSession, paths: str | list[str]) -> list[HeaderGroup]:
    """The landed files by header: few groups, however many files.

    The list of files is the driver's, as that of any scan is.
    """
    groups: dict[str, list[str]] = {}
    for row in file_headers(spark, paths).toLocalIterator():
        groups.setdefault(row["header"], []).append(row["file"])
    return [HeaderGroup(h, header_columns(h), sorted(files)) for h, files in sorted(groups.items())]


def literal_path(path: str) -> str:
    """A path as reported for a file, so that a scan takes it for this one file."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(path))


def scan_group(spark: SparkSession, group: HeaderGroup, schema: T.StructType, line_breaks: bool = True) -> DataFrame:
    """One native scan of the group's files.

    With `line_breaks` a quoted value may go over several lines, and a file is one task; without, large
    files are split.
    """
    reader = spark.read.schema(schema).options(header=True, multiLine=line_breaks, escape='"')
    return reader.csv([literal_path(f) for f in group.files])


def _found(spark: SparkSession, path: str | list[str]) -> bool:
    return bool(path) if isinstance(path, list) else bool(matching_paths(spark, path))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, reason) of the landed files without all eight detection columns."""
    groups = header_groups(spark, path) if _found(spark, path) else []
    rejects = [Reject(f, g.header, reason) for g in groups if (reason := _lacking(g)) for f in g.files]
    return spark.createDataFrame(rejects, REJECTS)


def _lacking(group: HeaderGroup) -> str:
    lacking = [name for name in FIRES.fieldNames() if name not in group.columns]
    return f"no column {', '.join(lacking)}" if lacking else ""


def detection_schema(header: Iterable[str]) -> T.StructType:
    """Declared types for the known columns, text for the rest, in file order."""
    known = {f.name: f.dataType for f in FIRES.fields}
    return T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in header])


def normalize_detections(raw: DataFrame, box: Box = US_BOX, keep: Iterable[str] = ()) -> DataFrame:
    """The eight table columns inside the box, NaN as null, time padded to `HHmm`."""
    columns = [
        null_if_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in FIRES.fields
    ]
    rows = raw.select(*keep, *columns).withColumn("acq_time", pad_time(F.col("acq_time")))
    return filter_box(rows, box)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark, FIRES)


def _left_out(group: HeaderGroup, reason: str) -> list[Reject]:
    log.warning("%d files are left out (%s); their header is %s", len(group.files), reason, group.header)
    return [Reject(f, group.header, reason) for f in group.files]


def land_detections(spark: SparkSession, paths: str | list[str], box: Box = US_BOX, line_breaks: bool = True) -> Landed:
    """Detections of landed files, each file read by its own header.

    Files without all eight columns give no rows and hold up no other.
    """
    parts, rejects = [], []
    for group in header_groups(spark, paths) if _found(spark, paths) else []:
        if reason := _lacking(group):
            rejects += _left_out(group, reason)
        else:
            parts.append(normalize_detections(scan_group(spark, group, detection_schema(group.columns), line_breaks), box))
    return Landed(_union(spark, parts), rejects)


def scan_detections_csv(spark: SparkSession, path: str, box: Box = US_BOX, line_breaks: bool = True) -> DataFrame:
    """Satellite detections of all landed files; column order and further columns do not matter."""
    return land_detections(spark, path, box, line_breaks).rows


def _plain(path: str) -> str:
    """Without escapes, and with one slash after the scheme, however many the reporter writes."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", unquote(path)).rstrip("/")


def scan_window_list(spark: SparkSession, windows: Iterable[Window], box: Box = US_BOX) -> DataFrame:
    """All landed windows, each row with the start date of the window whose folder (or file) it is in.

    Of windows with one folder the first counts; in nested folders the innermost does.
    """
    start_of: dict[str, str] = {}
    folders = []
    for window in windows:
        for folder in matching_paths(spark, window.path):
            if _plain(folder) not in start_of:
                folders.append(folder)
            start_of.setdefault(_plain(folder), window.start_date)

    def start(file: str) -> str | None:
        path = _plain(file)
        while path not in start_of and "/" in path:
            path = path.rpartition("/")[0]
        return start_of.get(path)

    parts = []
    for group in header_groups(spark, [literal_path(f) for f in folders]) if folders else []:
        if reason := _lacking(group):
            _left_out(group, reason)
            continue
        of_file = spark.createDataFrame([(f, start(f)) for f in group.files], "file string, window_start string")
        raw = scan_group(spark, group, detection_schema(group.columns)).withColumn("file", F.col("_metadata.file_path"))
        parts.append(normalize_detections(raw.join(of_file, "file"), box, ["window_start"]))
    if not parts:
        return empty(spark, FIRES).withColumn("window_start", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, parts).select(*FIRES.fieldNames(), "window_start")


def scan_hms_csv(spark: SparkSession, path: str) -> DataFrame:
    """Smoke/fire product whose files share one header; every column as text."""
    groups = header_groups(spark, path) if _found(spark, path) else []
    if not groups:
        raise FileNotFoundError(f"no smoke/fire product files under {path}")
    if len(groups) > 1:
        raise ValueError("the files have several headers: read them with scan_hms")
    return scan_group(spark, groups[0], _text_schema(groups[0].columns))


def _text_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def land_hms(
    spark: SparkSession, paths: str | list[str], run_date: str | Column, box: Box = US_BOX, line_breaks: bool = True
) -> Landed:
    """Detections of smoke/fire files, each file by its own header; files without a place or a date are left out.

    `run_date` may use the column `_written`, the time a file was written.
    """
    parts, rejects = [], []
    for group in header_groups(spark, paths) if _found(spark, paths) else []:
        raw = scan_group(spark, group, _text_schema(group.columns), line_breaks)
        raw = raw.select("*", F.col("_metadata.file_modification_time").alias("_written"))
        try:
            parts.append(normalize_hms(raw, run_date, box))
        except ValueError as reason:
            rejects += _left_out(group, str(reason))
    return Landed(_union(spark, parts), rejects)


def scan_hms(spark: SparkSession, path: str, run_date: str, box: Box = US_BOX) -> DataFrame:
    """All landed files of the smoke/fire product, whatever headers they have."""
    return land_hms(spark, path, run_date, box).rows


def resolve_aliases(
    columns: Iterable[str], aliases: Mapping[str, list[str]] = HMS_ALIASES
) -> dict[str, str | None]:
    """Field -> column of this header, without regard to case or outer blanks."""
    present = {name.strip().lower(): name for name in columns}
    found = {
        field: next((present[name] for name in names if name in present), None) for field, names in aliases.items()
    }
    if not found["latitude"] or not found["longitude"]:
        raise ValueError("the header must name latitude and longitude columns")
    return found


def normalize_hms(raw: DataFrame, run_date: str | Column, box: Box = US_BOX, default_confidence: str = "medium") -> DataFrame:
    """Any header to the eight table columns.

    The date comes from a date column, else a datetime, else a year-day number. A
    missing date becomes `run_date`, a missing time `0000`; rows with a datetime that cannot
    be read are dropped.
    """
    found = resolve_aliases(raw.columns)

    def col(field: str) -> Column | None:
        # Backticks, as a header may hold dots or blanks.
        return F.col(f"`{found[field]}`") if found[field] else None

    def number(field: str) -> Column:
        return F.lit(0.0) if col(field) is None else to_number(col(field))

    date, time = col("date"), col("time")
    if date is None and found["datetime"]:
        text = col("datetime")
        date, time = datetime_date(text), datetime_time(text)
        # A text that no pattern reads says nothing of the day, least of all that it is today.
        raw = raw.where(F.coalesce(F.trim(text), F.lit("")).isin("") | date.isNotNull())
    elif date is None and found["yearday"]:
        date = yearday_to_date(col("yearday"))
    if date is None:
        raise ValueError("the header must name a date, datetime or yearday column")

    given = col("confidence")
    confidence = F.lit(None).cast("string") if given is None else given.cast("string")
    rows = raw.select(
        to_number(col("latitude")).alias("latitude"),
        to_number(col("longitude")).alias("longitude"),
        number("brightness").alias("bright_ti4"),
        F.lit(None).cast("double").alias("bright_ti5"),
        number("frp").alias("frp"),
        default_date(date.cast("string"), run_date).alias("acq_date"),
        default_time(F.lit(None) if time is None else time).alias("acq_time"),
        ingest_confidence(confidence, default_confidence).alias("confidence"),
    )
    return filter_box(drop_missing_coords(rows), box)
