"""Readable names for test ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten_test_id(nodeid: Column) -> Column:
    """`dir/sub/test_x.py::Class::test` to `[sub] Class · test`; files directly under
    `tests` take their own name as the category."""
    parts = F.split(nodeid, "::")
    path = F.get(parts, F.lit(0))
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    category = F.when(folder == "tests", F.regexp_replace(stem, "^test_", "")).otherwise(folder)
    inner = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " · ")
    name = F.when(F.size(parts) > 1, inner).otherwise(path)
    return F.concat(F.lit("["), category, F.lit("] "), name)
