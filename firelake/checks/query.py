"""One registered query: the Spark plan and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from firelake.checks.views import view


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def over(*names: str, build: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Run `build` on the named views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made: dict[str, DataFrame] = {}
        return build(*[view(spark, sf_dir, name, made) for name in names])

    return run
