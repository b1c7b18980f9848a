"""Spelling variants: words one edit apart, by asymmetric chunks.

Words are runs of letters that occur often enough in the whole corpus. Two words are near when one
inserted, deleted or replaced code point turns one into the other. The shorter word gives two disjoint
chunks, its halves; a single edit leaves one of them as it is. The other word gives its grams of the
same sizes at the places where such a chunk can be: at the chunk's own place, or moved by the difference
of the lengths, which is one at most. Words that share a chunk and a gram are compared exactly.

A chunk that many words share (a common first half) would pair them all. Where more than SHARED words
stand on both sides, the edit is known to lie in the other half, so that half is cut into two chunks
again, one of which is whole as well; and so on, until all but one letter agree and every pair is near.
So a word meets no more than SHARED others for each of its chunks, and no pair is lost.

The form of a word is its near word of largest count (ties: the smallest in code-point order), if that
count is at least RATIO times its own. The root is where following the forms ends: counts grow by RATIO
at each step, so the walk is short.

Texts are read whole; null texts have no words, and a null doc_id stands as empty text in the hash that
strews errors. Repeated rows count each time. Runs of any length are words. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.llm.shared import stored
from firelake.llm.words import pieces, utf8
from firelake.operators.skew import join_reduced

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
# One run in so many loses a code point: errors with a known source.
STREWN = 31
SHARED = 32
_PIECE_BYTES = 6_000_000
# Longer runs are hashed one by one.
_LONG = 48

Batches = Iterator[pa.RecordBatch]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code points) of all runs: ASCII letters, and the pairs of bytes of U+00C0 to U+00FF."""
    lead = raw == 0xC3
    lead[:-1] &= (raw[1:] & 0xC0) == 0x80
    lead[-1:] = False
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(raw))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return start, end, end - start - (leads[end] - leads[start])


def _crc(raw: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes that goes on from the value `before`."""
    out = np.empty(len(start), dtype=np.uint32)
    sizes = end - start
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = zlib.crc32(raw[start[i] : end[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(sizes <= _LONG)
    short = short[np.argsort(-sizes[short], kind="stable")]
    state, first, lengths = ~before[short], start[short], sizes[short]
    for j in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -j, side="left"))
        state[:n] = _CRC[(state[:n] ^ raw[first[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    out[short] = ~state
    return out


def _count(ids: pa.Array, texts: pa.Array, least: int, strewn: int | None) -> pa.StructArray:
    """Words of the texts with their counts."""
    raw, at = utf8(texts)
    raw = _FOLD[raw]
    start, end, letters = _runs(raw, at)
    kept = letters >= least
    start, end, letters = start[kept], end[kept], letters[kept]
    errors = []
    if strewn:
        heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()]
        before = np.array(heads, dtype=np.uint32)[np.searchsorted(at[1:], start, side="right")]
        hashes = _crc(raw, start, end, before)
        hit = hashes % np.uint32(strewn) == 0
        for s, e, h in zip(start[hit & (letters > least)], end[hit & (letters > least)], hashes[hit & (letters > least)]):
            run = raw[s:e].tobytes().decode()
            errors.append(run[: h % len(run)] + run[h % len(run) + 1 :])
        start, end = start[~hit], end[~hit]
    marks = np.zeros(len(raw) + 1, dtype=np.int8)
    marks[start] += 1
    marks[end] -= 1
    data = raw[np.cumsum(marks[:-1]).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return pc.value_counts(pa.concat_arrays([words, pa.array(errors, pa.string())]))


def _count_task(least: int, strewn: int | None):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE_BYTES):
                found = _count(piece.column(0), piece.column(1), least, strewn)
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1).cast(pa.int64())], names=["word", "n"])

    return run


def word_counts(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, strewn: int | None = None
) -> DataFrame:
    """(word, n) of `docs(doc_id, text)`; with `strewn`, one run in so many loses a code point first."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    each = texts.mapInArrow(_count_task(least_letters, strewn), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _sides(words: DataFrame) -> DataFrame:
    """One row per word and part it can play: with a word as long as itself, as the shorter, as the longer."""
    parts = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(r).alias("role")) for s, r in ((0, "both"), (1, "chunk"), (1, "gram"))])
    rows = words.withColumn("part", F.explode(parts)).select("word", "n", "part.*")
    size = F.char_length("word") - F.when(F.col("role") == "gram", 1).otherwise(0)
    return rows.withColumn("size", size).withColumn("front", F.lit(0)).withColumn("back", F.lit(0))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row once per half of what is still open: the kept half joins the known front or back.

    `size`, `front` and `back` are the chunk word's; a gram word gives the letters that these would be in it.
    """
    wide = "size - front - back"
    halves = f"array(struct(front + greatest(1, ({wide}) div 2) AS f, back AS b), struct(front AS f, size - front - ({wide}) div 2 AS b))"
    cut = rows.withColumn("half", F.expr(f"explode({halves})"))
    cut = cut.select("word", "n", "shift", "role", "size", F.col("half.f").cast("int").alias("front"), F.col("half.b").cast("int").alias("back"))
    key = "xxhash64(shift, size, front, back, substring(word, 1, front), right(word, back))"
    return cut.withColumn("key", F.expr(key)).withColumn("open", F.expr(wide) > 1 - F.col("shift"))


def near_pairs(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of `words(word, n)` once."""
    rows, found = _sides(words), []
    while True:
        rows = _cut(rows)
        chunks, grams = (F.count_if(F.col("role") != other) for other in ("gram", "chunk"))
        keys = rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("rows"), chunks.alias("chunks"), grams.alias("grams"), F.count_if("open").alias("open")
        )
        keys = keys.where("rows > 1 AND chunks > 0 AND grams > 0")
        hot = (F.least("chunks", "grams") > shared) & (F.col("open") > 0)
        rows = stored(join_reduced(rows.drop("open"), keys.select("key", hot.alias("hot")), ["key"], "inner"), "chunks")
        ready = rows.where("NOT hot")
        x, y = ready.where("role <> 'gram'").alias("x"), ready.where("role <> 'chunk'").alias("y")
        met = F.expr("x.key = y.key AND x.shift = y.shift AND (x.shift = 1 OR x.word < y.word) AND levenshtein(x.word, y.word, 1) = 1")
        pairs = x.join(y, met).select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b"))
        found.append(stored(pairs.distinct(), "pairs"))
        rows = rows.where("hot").drop("hot", "key")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms(word, form)`; every turn doubles the steps that are behind each word."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        steps = moved.select("word", "root")
        if moved.where("next IS NOT NULL").isEmpty():
            return steps


def spelling_variants(words: DataFrame, ratio: int = RATIO, shared: int = SHARED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of `words(word, n)`, whose words are distinct."""
    words = stored(words.select("word", "n"), "words")
    pairs = near_pairs(words, shared)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("below"), "near"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    taken = -F.col("best.below") >= ratio * F.col("n")
    joined = joined.select(
        "word",
        F.when(taken, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, -F.col("best.below")).alias("form_n"),
    )
    joined = stored(joined, "forms")
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
