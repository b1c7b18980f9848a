from __future__ import annotations

import random

from pyspark.sql import functions as F

from firelake.operators import dedup
from firelake.plans.ingest import insert_detections
from firelake.schemas import FIRES
from firelake.session import work_dir
from firelake.sources.tables import append_rows, scan_or_empty

ROW = (34.05, -118.25, 330.0, 290.0, 25.0, "2024-08-01", "1200", "high")


def test_copies_in_the_batch_and_null_keys_are_kept(make_fires):
    other = (*ROW[:6], "1300", "high")
    nameless = (*ROW[:5], None, "1200", "high")
    batch = make_fires(ROW, other, other, nameless, nameless)
    table = make_fires(ROW, ROW, nameless)
    assert dedup.dedup_insert(batch, table).count() == 4
    assert dedup.ingest_counts(batch, table).first().asDict() == {"rows_in": 5, "inserted": 4, "skipped": 1}


def test_other_columns_are_not_part_of_the_key(make_fires):
    changed = (*ROW[:2], 1.0, 2.0, 3.0, *ROW[5:7], "low")
    assert dedup.dedup_insert(make_fires(changed), make_fires(ROW)).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(7)

    def rows(n):
        return [
            (rng.choice([0.0, -0.0, 1.5, None]), float(rng.randrange(3)), rng.choice(["a", "b", None]), str(rng.randrange(3)))
            for _ in range(n)
        ]

    batch, table = rows(400), rows(25)
    held = {r for r in table if None not in r}
    expected = sorted(str(r) for r in batch if None in r or r not in held)
    schema = "latitude double, longitude double, acq_date string, acq_time string"
    got = dedup.dedup_insert(spark.createDataFrame(batch, schema), spark.createDataFrame(table, schema))
    assert sorted(str(tuple(r)) for r in got.collect()) == expected


def test_inserting_twice_adds_nothing(spark, make_fires):
    table = work_dir(spark, "insert")
    batch = make_fires(ROW, (*ROW[:6], "1300", "high"), (*ROW[:5], "2024-08-02", "1300", "h"))
    assert tuple(insert_detections(spark, batch, table, "satellite")) == (3, 3, 0)
    assert tuple(insert_detections(spark, batch, table, "satellite")) == (3, 0, 3)
    assert tuple(insert_detections(spark, batch.limit(1), table, "smoke")) == (1, 0, 1)
    assert tuple(insert_detections(spark, batch.where("false"), table, "smoke")) == (0, 0, 0)
    assert scan_or_empty(spark, table, FIRES).count() == 3


def test_only_days_of_the_batch_are_read(spark, make_fires):
    table = work_dir(spark, "pruned")
    days = [(*ROW[:5], f"2024-08-{d:02d}", "1200", "high") for d in range(1, 11)]
    append_rows(make_fires(*days), table, FIRES, "acq_date", "satellite")
    batch = make_fires(days[3], days[4])
    pruned = dedup.within_batch_dates(scan_or_empty(spark, table, FIRES), batch)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(acq_date" in scan and "Subquery" in scan
    assert dedup.dedup_insert(batch, pruned).count() == 0
    assert pruned.count() == 2


def test_skip_loaded_windows(spark, make_fires):
    windows = spark.createDataFrame([("2024-08-01",), ("2024-08-06",)], "start_date string")
    assert [r[0] for r in dedup.skip_loaded_windows(windows, make_fires(ROW)).collect()] == ["2024-08-06"]


def test_union_matches_by_name(spark, make_fires):
    fires = make_fires(ROW)
    shuffled = fires.select(*reversed(fires.columns))
    assert dedup.union_sources(fires, shuffled).distinct().count() == 1


def test_counts(make_fires):
    fires = make_fires(ROW, ROW, (*ROW[:5], None, "1200", "high"))
    assert {tuple(r) for r in dedup.count_by_date(fires).collect()} == {("2024-08-01", 2), (None, 1)}
    assert [r[0] for r in dedup.distinct_dates(fires).collect()] == ["2024-08-01"]
    assert fires.where(F.col("acq_date") == "2024-08-01").count() == 2
