"""Test-build history: summaries, outcome matrix, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.functions import shorten_test_id
from firelake.operators.skew import join_reduced


def order_builds(builds: DataFrame) -> DataFrame:
    """By run number; a missing one counts as 0, so such builds come first."""
    return builds.orderBy(F.coalesce("run_number", F.lit(0)), "build_id")


def build_summary(builds: DataFrame) -> DataFrame:
    """Passed, failed and total per build, and the verdict."""
    passed = F.coalesce("summary.passed", F.lit(0))
    failed = F.coalesce("summary.failed", F.lit(0))
    short_id = F.regexp_extract("build_id", "^[^-]*-(.*)$", 1)
    sha = F.when(F.col("build_id").contains("-"), short_id).otherwise("?")
    return builds.select(
        "build_id",
        "run_number",
        F.coalesce("sha", sha).alias("sha"),
        passed.alias("passed"),
        failed.alias("failed"),
        F.coalesce("summary.total", passed + failed).alias("total"),
        F.when(failed == 0, "PASS").otherwise(F.concat(F.lit("FAIL("), failed.cast("string"), F.lit(")"))).alias("status"),
    )


def last_outcomes(results: DataFrame) -> DataFrame:
    """One outcome per test and build: the last one listed."""
    return results.groupBy("nodeid", "build_id", "run_order").agg(F.max_by("outcome", "position").alias("outcome"))


def shown_outcome(outcome: str) -> Column:
    """An error is shown as a failure, anything unknown as nothing."""
    known = F.col(outcome)
    return F.when(known == "error", "failed").when(known.isin("passed", "failed", "skipped"), known).otherwise("none")


def outcome_rows(results: DataFrame) -> DataFrame:
    """One row per test and build with the outcome shown, for any number of builds."""
    shown = results.select("nodeid", "build_id", "position", shown_outcome("outcome").alias("shown"))
    return shown.groupBy("nodeid", "build_id").agg(F.max_by("shown", "position").alias("shown"))


def outcome_matrix(results: DataFrame, build_ids: Sequence[str]) -> DataFrame:
    """One row per test, one column per listed build; how wide it gets is the caller's choice."""
    shown = results.where(F.col("build_id").isin(*build_ids)).select(
        "nodeid", "build_id", "position", shown_outcome("outcome").alias("shown")
    )
    matrix = shown.groupBy("nodeid").pivot("build_id", list(build_ids)).agg(F.max_by("shown", "position"))
    filled = matrix.fillna("none", subset=list(build_ids))
    return filled.select("nodeid", shorten_test_id(F.col("nodeid")).alias("test"), *build_ids)


def regressions(results: DataFrame) -> DataFrame:
    """Tests that failed: the first failing build and the first later one that passed.

    Two grouped passes instead of a window, so a test with a long history is reduced
    per input split before it is shuffled.
    """
    outcomes = last_outcomes(results)
    run = F.struct("run_order", "build_id")
    failed = outcomes.where("outcome = 'failed'").groupBy("nodeid").agg(F.min(run).alias("first"))
    passed = outcomes.where("outcome = 'passed'").select("nodeid", run.alias("run"))
    fixed = (
        join_reduced(passed, failed, ["nodeid"], "inner")
        .where(F.col("run") > F.col("first"))
        .groupBy("nodeid")
        .agg(F.min("run").alias("fixed"))
    )
    return failed.join(fixed, "nodeid", "left").select(
        "nodeid",
        shorten_test_id(F.col("nodeid")).alias("test"),
        F.col("first.build_id").alias("first_failed"),
        F.col("fixed.build_id").alias("fixed_in"),
    )
