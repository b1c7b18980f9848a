"""What the operators of this subpackage share: stored steps and joins by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.session import work_dir

# Ids that may be sent to every executor (8 bytes each); a longer list is joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write the rows to the shared folder and read them again.

    The lineage ends there: a lost executor costs no more than the step it was working on.
    """
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def only_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join by `key`; the ids are broadcast only when few enough."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; a row without id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
