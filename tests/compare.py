"""Run registered queries in Spark and DuckDB and compare their rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_rows, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(spark_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(names)}"
    got = rows_of(spark_rows.columns, [tuple(r) for r in spark_rows.collect()])
    if got == expected:
        return ""
    only_spark, only_sql = got - expected, expected - got
    return (
        f"{got.total()} rows and {expected.total()} rows; only in Spark {only_spark.total()}: {list(only_spark)[:2]};"
        f" only in SQL {only_sql.total()}: {list(only_sql)[:2]}"
    )
