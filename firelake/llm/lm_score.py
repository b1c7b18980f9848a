"""Language-model scoring by cross-entropy difference.

Two bigram models are counted over all documents: the target model over those marked as good, the
background model over all others. Both have the same smoothing.
A document's score is the mean over its words of the loss under the background model less the loss
under the target model: higher means closer to the target.

Every word and every word pair has its own count, by a 64-bit hash: the tables are Spark data and grow
with the corpus. Texts are cut into blocks of about BLOCK_BYTES. A block sends each of its distinct
n-grams once, with its own counts, as packed chunks by the leading bits of the hash; a bucket of these is
summed by n-gram, and the block gets back the sums in the order it sent. So a frequent n-gram is sent once
per block, not once per occurrence, and what is shuffled is about six bytes for an n-gram and two for its sums.
Probabilities are interpolated: pair given word, word, and a floor of one in 2 ** WORD_BITS. When a
document is scored, each occurrence is first taken out of the counts of the model that holds the
document, so that no text is judged by itself.

Words are runs of letters and digits (A-Z folded). A document without words has a score of 0 and
null losses. Without any good document the two models hold nothing to tell apart: the target model
is uniform. A doc_id with several marks is good if any is. Repeated rows give repeated result rows
and count each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.llm.shared import MAX_BROADCAST_IDS, stored
from firelake.llm.words import NOT_ALNUM, mix, pieces, utf8, words_of

# The floor under a word's probability is one in 2 ** WORD_BITS, however many words there are.
WORD_BITS = 18
# Weights of pair, word and floor.
WEIGHTS = (0.55, 0.44, 0.01)
# Text that is counted and scored together; a longer single text is a block of its own.
BLOCK_BYTES = 24_000_000
# Leading bits of an n-gram that say in which bucket it is summed, and the blocks from which on it takes more of them.
BUCKET_BITS, MANY_BLOCKS = 10, 2048
_ROWS = 256
_CHUNK = ["block", "bucket", "n", "grams", "seen"]
_U = np.uint64
# Stands for all words: its counts are the sizes of the models.
ALL_WORDS = _U(0)

Batches = Iterator[pa.RecordBatch]


class Grams(NamedTuple):
    """Words of some texts in reading order; a pair is at the place of its second word."""

    row: np.ndarray
    word: np.ndarray
    second: np.ndarray
    pair: np.ndarray


def grams(texts: pa.Array) -> Grams:
    words = words_of(texts, NOT_ALNUM)
    second = np.flatnonzero(words.row[1:] == words.row[:-1]) + 1 if len(words.row) else np.zeros(0, np.int64)
    return Grams(words.row, words.hash, second, mix(words.hash[second - 1] * _U(3) + words.hash[second]))


class Counts(NamedTuple):
    """Distinct n-grams, ascending, and their occurrences in background (0) and target (1)."""

    grams: np.ndarray
    seen: np.ndarray


def counted(parts: list[tuple[Grams, np.ndarray]]) -> Counts:
    """Counts of texts, given as n-grams and whether each text is good."""
    keys = [np.zeros(0, _U)]
    sides = [np.zeros(0, bool)]
    sizes = np.zeros(2, np.int64)
    for found, good in parts:
        side = good[found.row]
        keys += [found.word, found.pair]
        sides += [side, side[found.second]]
        sizes += np.bincount(side, minlength=2)
    values, place = np.unique(np.concatenate(keys), return_inverse=True)
    side = np.concatenate(sides)
    seen = np.stack([np.bincount(place[side == model], minlength=len(values)) for model in (False, True)])
    return Counts(np.append(ALL_WORDS, values), np.concatenate([sizes[:, None], seen], axis=1))


def _block_task(batches: Batches) -> Batches:
    """The rows with the number of their block."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            more = len(utf8(piece.column(0))[0]) + 16 * piece.num_rows
            if size and size + more > BLOCK_BYTES:
                block, size = block + 1, 0
            size += more
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(piece.num_rows, block, np.int64)), *piece.columns], names=["block", *piece.schema.names]
            )


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _packed(values: np.ndarray) -> bytes:
    """64-bit integers by byte planes, compressed: the high bytes of small values cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).reshape(n)


def _slices(counts: Counts, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets, by the leading bits, that hold n-grams, and where these are; ALL_WORDS has one of its own."""
    yield -1, slice(0, 1)
    bucket = (counts.grams[1:] >> _U(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    for low, high in zip(begins, [*begins[1:], len(bucket)]):
        yield int(bucket[low]), slice(int(low) + 1, int(high) + 1)


def _rows(block: int, counts: Counts, bits: int) -> Batches:
    rows = []
    for bucket, part in _slices(counts, bits):
        steps = np.diff(counts.grams[part], prepend=_U(0))
        rows.append((block, bucket, len(steps), _packed(steps), _packed(counts.seen[:, part].reshape(-1))))
        if len(rows) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_CHUNK)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_CHUNK)


def _count_task(bits: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        current, parts = None, []
        for batch in batches:
            column = batch.column(0).to_numpy()
            cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
            for low, high in zip([0, *cuts], [*cuts, len(column)]):
                if low == high:
                    continue
                if parts and column[low] != current:
                    yield from _rows(current, counted(parts), bits)
                    parts = []
                current = int(column[low])
                for piece in pieces(batch.slice(low, high - low), "text"):
                    parts.append((grams(piece.column(1)), _flags(piece.column(2))))
        if parts:
            yield from _rows(current, counted(parts), bits)

    return run


def _sum_bucket(chunks: pa.Table) -> pa.Table:
    """For the chunks of one bucket, the sums over all blocks in the order of their own n-grams."""
    sizes = chunks.column("n").to_pylist()
    ends = np.cumsum([0, *sizes])
    gram = np.empty(ends[-1], _U)
    seen = np.empty((2, ends[-1]), np.int64)
    for n, low, steps, own in zip(sizes, ends, chunks.column("grams").to_pylist(), chunks.column("seen").to_pylist()):
        gram[low : low + n] = np.cumsum(_unpacked(steps, n, _U), dtype=_U)
        seen[:, low : low + n] = _unpacked(own, 2 * n, np.int64).reshape(2, n)
    values, place = np.unique(gram, return_inverse=True)
    for own in seen:
        # A float holds every count below 2 ** 53.
        own[:] = np.bincount(place, own, minlength=len(values)).astype(np.int64)[place]
    sums = [_packed(seen[:, low : low + n].reshape(-1)) for n, low in zip(sizes, ends)]
    return chunks.select(["block", "bucket", "n"]).append_column("seen", pa.array(sums, pa.binary()))


def _bits(blocks: int) -> int:
    """A bucket holds a thousandth of all n-grams; with very many blocks, about as much as two of them."""
    return BUCKET_BITS + max(0, -(-blocks // MANY_BLOCKS) - 1).bit_length()


def summed_counts(marked: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, n, seen) over all rows of `marked(block, text, good)`.

    A block sends its distinct n-grams, ascending, as one row per bucket, and gets back their sums in the
    same order, so the n-grams themselves travel once.
    """
    rows = marked.select("block", "text", "good").mapInArrow(
        _count_task(bits), "block long, bucket long, n long, grams binary, seen binary"
    )
    return rows.groupBy("bucket").applyInArrow(_sum_bucket, "block long, bucket long, n long, seen binary")


def losses(counts: Counts, found: Grams, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the summed loss of each text under both models (bits)."""
    n = np.bincount(found.row, minlength=len(good))
    out = np.zeros((2, len(good)))
    # ALL_WORDS is the first n-gram.
    word = np.searchsorted(counts.grams[1:], found.word) + 1
    pair = np.searchsorted(counts.grams[1:], found.pair) + 1
    for model in range(2):
        own = (good[found.row] == bool(model)).astype(np.int64)
        total = int(counts.seen[model, 0])
        seen = np.maximum(0, counts.seen[model, word] - own)
        chance = WEIGHTS[1] * seen / np.maximum(1, total - own) + WEIGHTS[2] / (1 << WORD_BITS)
        before = seen[found.second - 1]
        both = np.maximum(0, counts.seen[model, pair] - own[found.second])
        chance[found.second] += WEIGHTS[0] * np.minimum(1.0, both / np.maximum(1, before))
        out[model] = np.bincount(found.row, -np.log2(chance), minlength=len(good))
    return n, out


_SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _score_block(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, sums: pa.Table) -> pa.Table:
        """Scores of one block, with the sums of its n-grams over all blocks."""
        parts = [
            (piece.column(2), grams(piece.column(1)), _flags(piece.column(3)))
            for batch in texts.select(["block", "text", "doc_id", "good"]).to_batches()
            for piece in pieces(batch, "text")
        ]
        counts = counted([part[1:] for part in parts])
        places = dict(_slices(counts, bits))
        for bucket, n, seen in zip(*(sums.column(name).to_pylist() for name in ("bucket", "n", "seen"))):
            counts.seen[:, places[bucket]] = _unpacked(seen, 2 * n, np.int64).reshape(2, n)
        return _scores(parts, counts)

    return run


def _scores(parts: list[tuple[pa.Array, Grams, np.ndarray]], counts: Counts) -> pa.Table:
    out = []
    for doc_id, found, good in parts:
        n, loss = losses(counts, found, good)
        mean = loss / np.maximum(1, n)
        nothing = n == 0
        columns = [
            doc_id, pa.array(n.astype(np.int64)), pa.array(mean[1], mask=nothing), pa.array(mean[0], mask=nothing),
            pa.array(np.where(nothing, 0.0, mean[0] - mean[1])),
        ]
        out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"]))
    return pa.Table.from_batches(out)


def cross_entropy_difference(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of each row of `docs(doc_id, text)`.

    `good(doc_id)` names the documents of the target model.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    named = good.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    few = named.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    named = named.withColumn("good", F.lit(True))
    marked = rows.join(F.broadcast(named) if few else named, "doc_id", "left")
    marked = marked.select("text", "doc_id", F.coalesce("good", F.lit(False)).alias("good"))
    marked = stored(marked.mapInArrow(_block_task, "block long, text string, doc_id long, good boolean"), "marked")
    bits = _bits(marked.select("block").distinct().count())
    sums = summed_counts(marked, bits)
    return marked.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_score_block(bits), _SCORES)
