"""Every registered query against DuckDB."""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

import __spark_entry__
from firelake.checks.registry import registered

CHECK_DIR = os.environ.get("FIRELAKE_CHECK_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"fit_forest_score", "save_load_model", "predict_top", "rank_importances", "write_metrics_json"}


@pytest.fixture(scope="module")
def con():
    connection = connect(CHECK_DIR)
    yield connection
    connection.close()


def test_all_but_the_model_queries_have_sql():
    assert {name for name, query in registered().items() if query.sql is None} == ROWS_ONLY
    assert set(registered()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    query = registered()[name]
    rows = query.run(spark, CHECK_DIR)
    if query.sql is None:
        assert rows.count() > 0
    else:
        assert compare(rows, con, query.sql) == ""


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).collect()) > 0
