"""Hard negatives by slot-decomposed selection.

Each positive of an anchor opens a window of scores, from `low` to `high` hundredths of its own; the
anchor's negatives for this positive are the best `negatives` rows of other labels inside. Windows of
one anchor overlap. Their upper limits split the scores below the highest limit into disjoint slots,
so

1. a task scores its rows against a block of anchors by one matrix product and keeps the best
   `negatives` rows of each (anchor, slot); what was kept so far sets the least score worth looking at;
2. the tasks' rows are merged to the best of each (anchor, slot);
3. the slots of an anchor from a window's upper limit downwards, laid end to end, start with the best
   rows below that limit; those above the lower limit are the window's.

The positives are found the same way with one slot. Anchors are a stated query set; they are sent to
the tasks in chunks of at most MAX_VALUES components, so neither the driver nor a task holds more.
Scores are integers, exact as long as they and a hundred times their size fit in 64 bits, and held at
that limit beyond. Ties go to the smaller vec_id.

Rows without vec_id, label or vector, or with a null component, take no part. Vectors of different
lengths are compared as if the shorter one went on with zeros. Rows that share their vec_id with an
anchor are never its positives or negatives; other repeated rows count each, and anchors equal in all
columns count once. Anchors without positives or without rows in a window give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firelake.llm.shared import stored

POSITIVES = 5
NEGATIVES = 10
LOW = 30
HIGH = 90
# Components of the anchors that are sent to every task together (8 bytes each).
MAX_VALUES = 4_000_000
# Anchors and rows that are multiplied together.
_ANCHORS, _ROWS = 1024, 4096
_LIMIT = np.int64(2**63 // 100 - 1)
FOUND = "anchor long, slot int, score long, vec_id long"

Batches = Iterator[pa.RecordBatch]


class Anchors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    # Upper limits of the slots of each anchor, falling; -limit - 1 opens none. And the least score that counts.
    uppers: np.ndarray
    lowest: np.ndarray


class Best(NamedTuple):
    """Rows kept so far, by anchor, slot, falling score and vec_id."""

    anchor: np.ndarray
    slot: np.ndarray
    score: np.ndarray
    vec_id: np.ndarray


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of a matrix; shorter ones go on with zeros, longer ones are cut at `width`."""
    at = column.offsets.to_numpy()
    sizes = np.minimum(np.diff(at), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = column.values.to_numpy(zero_copy_only=False)[(at[:-1, None] + np.arange(width))[inside]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of `a` and `b`, held at the limit."""
    most = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < float(_LIMIT):
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -int(_LIMIT), int(_LIMIT)).astype(np.int64)


def merge(best: Best, more: Best, keep: int) -> Best:
    """The first `keep` of each (anchor, slot)."""
    both = [np.concatenate(pair) for pair in zip(best, more)]
    order = np.lexsort((both[3], -both[2], both[1], both[0]))
    anchor, slot, score, vec_id = (x[order] for x in both)
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    first = np.flatnonzero(opens)
    kept = np.arange(len(order)) - first[np.cumsum(opens) - 1] < keep
    return Best(anchor[kept], slot[kept], score[kept], vec_id[kept])


def _select(sent: Broadcast, keep: int, same: bool) -> Callable[[Batches], Batches]:
    """Task that keeps the best rows of each slot, of the anchor's label or of all others."""

    def run(batches: Batches) -> Batches:
        a = sent.value
        firsts = range(0, len(a.ids), _ANCHORS)
        none = [np.zeros(0, dtype=np.int64)] * 4
        best = {f: Best(*none) for f in firsts}
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for row in range(0, batch.num_rows, _ROWS):
                part = matrix(batch.column(2).slice(row, _ROWS), a.vectors.shape[1])
                i, y = ids[row : row + _ROWS], labels[row : row + _ROWS]
                for f in firsts:
                    cut = slice(f, f + _ANCHORS)
                    block = Anchors(*(x[cut] for x in a))
                    best[f] = _look(best[f], block, products(block.vectors, part), i, y)
        for f, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.anchor + f), pa.array(found.slot.astype(np.int32)), pa.array(found.score), pa.array(found.vec_id)],
                names=["anchor", "slot", "score", "vec_id"],
            )

    def _look(best: Best, a: Anchors, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Best:
        slot = np.full(scores.shape, -1, dtype=np.int16)
        for upper in a.uppers.T:
            slot += scores <= upper[:, None]
        # The last score kept in a full slot; nothing below it can enter.
        floor = np.repeat(a.lowest[:, None], a.uppers.shape[1], axis=1)
        if len(best.anchor):
            ends = np.flatnonzero(np.append((np.diff(best.anchor) != 0) | (np.diff(best.slot) != 0), True))
            sizes = np.diff(ends, prepend=-1)
            full = ends[sizes == keep]
            floor[best.anchor[full], best.slot[full]] = np.maximum(best.score[full], a.lowest[best.anchor[full]])
        fits = (slot >= 0) & (scores >= np.take_along_axis(floor, np.maximum(slot, 0).astype(np.int64), axis=1))
        fits &= (labels == a.labels[:, None]) == same
        fits &= ids != a.ids[:, None]
        x, y = np.nonzero(fits)
        return merge(best, Best(x, slot[x, y].astype(np.int64), scores[x, y], ids[y]), keep)

    return run


def _chunk(rows: DataFrame) -> Anchors:
    table = rows.sort("vec_id", "label", "vector").toArrow()
    columns = [c.combine_chunks() for c in table.columns]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    width = max(np.diff(columns[2].offsets.to_numpy()), default=0)
    ids, labels = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:2])
    every, none = np.full((len(ids), 1), _LIMIT), np.full(len(ids), -_LIMIT)
    return Anchors(ids, labels, matrix(columns[2], int(width)), every, none)


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _of_chunk(vectors: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = vectors.sparkSession
    n = len(anchors.ids)
    # At most `positives` rows of each anchor of the chunk come back, so the windows are as few.
    near = vectors.mapInArrow(_select(spark.sparkContext.broadcast(anchors), positives, True), FOUND)
    near = _first(near, positives).toPandas()
    near = near.sort_values(["anchor", "rank"])
    tops, floors = near.score.to_numpy(np.int64) * high // 100, -(-near.score.to_numpy(np.int64) * low // 100)
    uppers, lowest = np.full((n, positives), -_LIMIT - 1), np.full(n, _LIMIT)
    at = near.anchor.to_numpy(np.int64)
    uppers[at, near["rank"].to_numpy(np.int64) - 1] = tops
    # Scores of the positives fall, so their limits do; an equal limit opens no slot of its own.
    uppers[:, 1:][uppers[:, 1:] == uppers[:, :-1]] = -_LIMIT - 1
    uppers = -np.sort(-uppers, axis=1)
    np.minimum.at(lowest, at, floors)
    sent = spark.sparkContext.broadcast(anchors._replace(uppers=uppers, lowest=lowest))
    kept = _first(vectors.mapInArrow(_select(sent, negatives, False), FOUND), negatives)
    slots = kept.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id"))).alias("slots")
    )
    columns = {"anchor": at, "anchor_id": anchors.ids[at], "positive_id": near.vec_id.to_numpy(np.int64)}
    columns |= {"positive_score": near.score.to_numpy(np.int64), "top": tops, "floor": floors}
    windows = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))
    from_top = F.slice(F.filter("slots", lambda s: -s["below"] <= F.col("top")), 1, negatives)
    inside = F.filter(from_top, lambda s: -s["below"] >= F.col("floor"))
    each = windows.join(slots, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "x"))
    return each.select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("x.vec_id").alias("negative_id"),
        "positive_score",
        (-F.col("x.below")).alias("negative_score"),
    )


def scaled(rows: DataFrame, column: str, scale: int) -> DataFrame:
    """`rows(vec_id, label, column)` with each component x as floor(scale * x); rows that take no part go."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(column, finite))
    vector = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables have vec_id, label and vector, an array of long; the anchors are rows of the vectors.
    """
    columns = ["vec_id", "label", "vector"]
    usable = "vec_id IS NOT NULL AND label IS NOT NULL AND forall(vector, x -> x IS NOT NULL)"
    vectors = vectors.select(*columns).where(usable)
    queries = stored(anchors.select(*columns).where(usable).distinct(), "anchors")
    values = queries.agg(F.sum(F.size("vector") + 3)).first()[0] or 0
    chunks = math.ceil(values / MAX_VALUES)
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64(*columns), F.lit(max(1, chunks))))
    found = []
    for c in range(max(1, chunks)):
        chunk = _chunk(queries.where(F.col("chunk") == c).select(*columns))
        found.append(stored(_of_chunk(vectors, chunk, positives, negatives, low, high), "negatives"))
    return reduce(DataFrame.union, found)
