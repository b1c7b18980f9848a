"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of letters, marks and digits of any script in lower case, so punctuation of any
kind and layout do not matter. A seed is a run of five words, or of all words of a shorter item.

1. The seeds of all benchmark items are put into a bit table of fixed size. Every document
   keeps the stretches whose seeds are in it; all other text is left where it is. What the
   table lets through by chance is dropped by the join.
2. The kept seeds are joined with the items' seeds. Tiles of five words or more that cover a
   share of an item hold at least a fifth as many of its seeds, so pairs with fewer are dropped.
3. Each remaining pair is tiled: window hashes (Karp-Rabin) of decreasing length find the
   longest common stretches of unmarked words, which are marked longest first until none of five
   words is left. Tiles do not overlap and may come in any order, so moved passages count.
4. A document is contaminated by an item when tiles cover at least half of the item's words.

An item with fewer than LEAST_WORDS words would be found in nearly every text: it matches only
documents that consist of it. Null and empty texts match nothing; very long ones are read whole.
Documents with equal kept stretches are tiled once. Repeated rows give one result row per doc_id and
item; rows without doc_id are reported under a null doc_id. Texts that share an item_id are items of their
own, and the best of them is reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firelake.llm.shared import only_ids, stored
from firelake.llm.words import NOT_ALNUM, mix, pieces, shingle_places, shingles, words_of

SEED_WORDS = 5
# Items of fewer words are looked for as whole documents only.
LEAST_WORDS = 3
COVERAGE = 0.5
# Bits of the seed table (2 ** 27: 16 MB in every task), whatever the size of the benchmark.
TABLE_BITS = 27
# Benchmark seeds and items that may be broadcast to the joins; more are joined by shuffles.
MAX_BROADCAST_ROWS = 500_000
_U = np.uint64

Batches = Iterator[pa.RecordBatch]


def _item_task(k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = words_of(piece.column(1), NOT_ALNUM)
                first, (_, seeds) = shingle_places(words, piece.num_rows, k), shingles(words, piece.num_rows, k)
                ends = np.cumsum(np.bincount(words.row, minlength=piece.num_rows))
                seed_ends = np.cumsum(np.bincount(words.row[first], minlength=piece.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), _lists(words.hash, ends), _lists(seeds, seed_ends)],
                    names=["item_id", "item_words", "item_seeds"],
                )

    return run


def _plain(text: Column) -> Column:
    """In lower case, with a blank between words; a text in ASCII is left to the byte table."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.when(text.rlike(r"[^\x00-\x7F]"), spaced).otherwise(text)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> _U(64 - TABLE_BITS)).astype(np.int64)


def seed_table(items: DataFrame) -> np.ndarray:
    """One bit per slot that a benchmark seed falls into; at most 2 ** (TABLE_BITS - 6) rows are collected."""
    slot = F.shiftrightunsigned(F.col("seed"), 64 - TABLE_BITS)
    bits = items.select(F.explode("item_seeds").alias("seed")).select(slot.alias("slot"))
    words = bits.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    )
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    rows = words.toArrow()
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return table.view(_U)


def _stretch_task(k: int, short: list[int], table) -> Callable[[Batches], Batches]:
    """`short`: the lengths of items that have fewer than k words."""

    def run(batches: Batches) -> Batches:
        bits = table.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = words_of(piece.column(1), NOT_ALNUM)
                sizes = [*short, k]
                first = np.concatenate([shingle_places(words, piece.num_rows, n) for n in sizes])
                seeds = np.concatenate([shingles(words, piece.num_rows, n)[1] for n in sizes])
                if short:
                    order = np.argsort(first, kind="stable")
                    first, seeds = first[order], seeds[order]
                slot = _slot(seeds)
                hit = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(_U)) & _U(1))
                if len(hit):
                    yield _stretches(piece, words, first[hit], seeds[hit], k)

    return run


def _stretches(piece: pa.RecordBatch, words, first: np.ndarray, seeds: np.ndarray, k: int) -> pa.RecordBatch:
    """Per document with seeds in the table: those seeds, and its words under them with 0 between stretches."""
    row = words.row[first]
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = np.append(begins[1:], len(row))
    word_row_end = np.searchsorted(words.row, row[begins], side="right")
    lists: list[np.ndarray] = []
    for b, e, stop in zip(begins, ends, word_row_end):
        at = first[b:e]
        parts, cut = [], np.flatnonzero(at[1:] > at[:-1] + k)
        for low, high in zip(np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1])):
            parts += [words.hash[low : min(high + k, stop)], np.zeros(1, _U)]
        lists.append(np.concatenate(parts[:-1]))
    tokens = np.concatenate(lists)
    names = ["doc_id", "stretch", "seeds", "k1", "k2"]
    keys = [[int(mix(x * _U(salt) + np.arange(len(x), dtype=_U)).sum(dtype=_U).view(np.int64)) for x in lists] for salt in (3, 5)]
    columns = [
        piece.column(0).cast(pa.int64()).take(pa.array(row[begins])),
        _lists(tokens, np.cumsum([len(x) for x in lists])),
        _lists(seeds, ends),
        *[pa.array(x, pa.int64()) for x in keys],
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first. 0 in doc matches nothing."""
    free_doc, free_item = doc != 0, np.ones(len(item), dtype=bool)
    found: list[tuple[int, int, int]] = []
    length = len(item)
    while length >= least:
        best, at = _common(doc, item, free_doc, free_item, length)
        if not at:
            length = length - 1 if length <= 2 * least else max(least, length // 2)
            continue
        if best > length:
            # Longer stretches exist than those looked for: begin with them.
            length = best
            continue
        for d, i in at:
            if free_doc[d : d + length].all() and free_item[i : i + length].all():
                free_doc[d : d + length] = free_item[i : i + length] = False
                found.append((d, i, length))
    return found


def _windows(values: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of all windows of free words."""
    if len(values) < length:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    base = 0xD6E8FEB86659FD93
    powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(len(values), base, dtype=_U)]), dtype=_U)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values * powers[:-1], dtype=_U)])
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[length:] == taken[:-length])
    # Aligned to the power of the last window instead of divided by its own.
    return starts, (total[starts + length] - total[starts]) * powers[len(values) - starts]


def _common(doc, item, free_doc, free_item, length) -> tuple[int, list[tuple[int, int]]]:
    """Longest common stretch (at most a bound for the next search) and the matches of exactly `length`."""
    d_at, d_hash = _windows(doc, free_doc, length)
    i_at, i_hash = _windows(item, free_item, length)
    # The two sides are aligned to their own lengths: bring both to the same power.
    gap = len(doc) - len(item)
    scale = _U(pow(0xD6E8FEB86659FD93, abs(gap), 1 << 64))
    if gap > 0:
        i_hash = i_hash * scale
    elif gap < 0:
        d_hash = d_hash * scale
    places = defaultdict(list)
    for i, h in zip(i_at.tolist(), i_hash.tolist()):
        places[h].append(i)
    wanted = np.isin(d_hash, np.unique(i_hash))
    best, at = length, []
    for d, h in zip(d_at[wanted].tolist(), d_hash[wanted].tolist()):
        for i in places[h]:
            if (doc[d : d + length] == item[i : i + length]).all():
                n = length
                while d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                best = max(best, n)
                at.append((d, i))
    return best, at


def _tile_task(k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            docs, items = columns[3], columns[4]
            for r in range(batch.num_rows):
                item = items[r].values.to_numpy(zero_copy_only=False).view(_U)
                doc = docs[r].values.to_numpy(zero_copy_only=False).view(_U)
                lengths = [n for *_, n in tiles(doc, item, min(k, len(item)))]
                out.append((len(lengths), sum(lengths), max(lengths, default=0), len(item)))
            parts = [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns[:3], *parts], names=["k1", "k2", "item_id", "n_tiles", "n_matched", "longest", "n_words"])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, k: int = SEED_WORDS, coverage: float = COVERAGE
) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_matched, longest, coverage) of each document and item it gives away.

    `docs` needs doc_id and text, `benchmark` item_id and text.
    """
    spark = docs.sparkSession
    text = _plain(F.col("text").cast("string")).alias("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text).mapInArrow(
        _item_task(k), "item_id long, item_words array<long>, item_seeds array<long>"
    )
    items = items.where(F.size("item_words") > 0).distinct()
    items = stored(items.withColumn("item", F.xxhash64("item_id", "item_words")), "benchmark")
    lengths = items.select(F.size("item_words").alias("n")).where(F.col("n").between(LEAST_WORDS, k - 1)).distinct()
    short = sorted(r["n"] for r in lengths.collect())
    table = spark.sparkContext.broadcast(seed_table(items))
    schema = "doc_id long, stretch array<long>, seeds array<long>, k1 long, k2 long"
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_stretch_task(k, short, table), schema)
    kept = stored(kept, "stretches")

    by_seed = items.select("item", F.size("item_words").alias("n"), F.explode("item_seeds").alias("seed"))
    few = by_seed.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    sized = F.broadcast if few else (lambda frame: frame)
    contents = kept.groupBy("k1", "k2").agg(F.any_value("seeds").alias("seeds"), F.any_value("stretch").alias("stretch"))
    seeds = contents.select("k1", "k2", F.explode(F.array_distinct("seeds")).alias("seed"))
    shared = seeds.join(sized(by_seed), "seed").groupBy("k1", "k2", "item", "n").agg(F.count(F.lit(1)).alias("seeds"))
    pairs = shared.where(F.col("seeds") * k >= F.lit(coverage) * F.col("n")).select("k1", "k2", "item")
    pairs = pairs.join(contents.select("k1", "k2", "stretch"), ["k1", "k2"])
    pairs = pairs.join(sized(items.select("item", "item_id", "item_words")), "item")
    measured = pairs.select("k1", "k2", "item_id", "stretch", "item_words").mapInArrow(
        _tile_task(k), "k1 long, k2 long, item_id long, n_tiles long, n_matched long, longest long, n_words long"
    )
    over = measured.withColumn("coverage", F.col("n_matched") / F.col("n_words")).where(F.col("coverage") >= coverage)
    return (
        kept.select("doc_id", "k1", "k2")
        .join(over, ["k1", "k2"])
        .groupBy("doc_id", "item_id")
        .agg(*[F.max_by(c, F.struct("coverage", "n_tiles", "longest")).alias(c) for c in ("n_tiles", "n_matched", "longest", "coverage")])
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that give away no item; rows without doc_id stay."""
    found = stored(contaminated(docs, benchmark).select("doc_id").where("doc_id IS NOT NULL").distinct(), "contaminated")
    return only_ids(docs, found, "doc_id", "left_anti").select(*docs.columns)
