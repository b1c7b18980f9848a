"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is then parsed into
phrases, each the longest stretch that occurs in that language's text. Few phrases mean that the
language's text predicts it well: phrases * log2(length of the labelled text) / length of the text
estimates the cross entropy in bits per byte (Ziv and Merhav). The language with the least wins;
ties go to the first language in alphabetical order.

Training takes a bounded sample (a parameter): from each language, stretches of rows chosen by a
hash of their doc_id, until TRAIN_BYTES bytes. All rows are predicted, on their whole text.

Texts are lower-cased; every run of characters that are not letters or marks is one blank. Pieces of PIECE
bytes are read in step, each as if a phrase began there, and then once more from the state that the piece
before it ends in, until both readings agree: phrases go on from piece to piece, and the count is that of
one reading of the whole text. A phrase of a byte that the language's text never has is one byte long.
`und` is given to a null text and to one without a letter, and to all if there is no labelled row; its score
is 0. Other scores are the share of 1 / entropy among all languages, between 1 / languages and 1. Repeated
rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.llm.words import pieces, utf8

UNKNOWN = "und"
TRAIN_BYTES = 24_000
# Bytes that one row may give to the sample.
TRAIN_STRETCH = 600
PIECE = 2048
BATCH_BYTES = 1_000_000

Batches = Iterator[pa.RecordBatch]


def normalised(text: Column) -> Column:
    """Lower case, with one blank for every run of other characters than letters and marks; empty without a letter."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), clean).otherwise("")


class Automaton:
    """Suffix automaton of a byte string: the shortest automaton that reads all its stretches."""

    def __init__(self, data: bytes) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for byte in data:
            last = self._extend(last, byte)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, byte: int) -> int:
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and byte not in self.next[at]:
            self.next[at][byte] = state
            at = self.link[at]
        if at >= 0:
            after = self.next[at][byte]
            if self.length[after] > self.length[at] + 1:
                copy = self._new(self.length[at] + 1, self.link[after], dict(self.next[after]))
                while at >= 0 and self.next[at].get(byte) == after:
                    self.next[at][byte] = copy
                    at = self.link[at]
                self.link[after] = copy
                after = copy
            self.link[state] = after
        return state

    def edges(self) -> list[tuple[int, int, int]]:
        return [(state, byte, to) for state, out in enumerate(self.next) for byte, to in out.items()]


class Languages:
    """The automata of all languages as one table: next state by state and byte class, 0 for none.

    State 0 is dead and state 1 follows a byte that the language's text never has: no edge leaves
    it. Byte class 0 is every byte that no labelled text has.
    """

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.names = sorted(texts)
        self.classes = np.zeros(256, dtype=np.uint8)
        seen = sorted(set(b"".join(texts.values())))
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width, base, roots = len(seen) + 1, 2, []
        parts = [np.zeros((2, width), dtype=np.int32)]
        for name in self.names:
            automaton = Automaton(texts[name])
            table = np.zeros((len(automaton.next), width), dtype=np.int32)
            state, byte, to = np.array(automaton.edges(), dtype=np.int64).reshape(-1, 3).T
            table[state, self.classes[byte]] = to + base
            table[0][table[0] == 0] = 1
            roots.append(base)
            parts.append(table)
            base += len(table)
        self.table = np.concatenate(parts)
        self.roots = np.array(roots, dtype=np.int32)
        self.bits = np.array([np.log2(max(2, len(texts[n]))) for n in self.names])

    def phrases(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
        """Phrases of each stretch of `raw` in each language; one that `follows` goes on from the one before it."""
        count, end = self._read_in_step(raw, start, size)
        if follows is None or not follows.any():
            return count
        fresh, fresh_end, classes = count.copy(), end.copy(), self.classes[raw]
        # The stretches of each language whose reading must begin with the state of the one before.
        lang, at = (x.ravel() for x in np.meshgrid(np.arange(len(self.names)), np.flatnonzero(follows), indexing="ij"))
        while len(at):
            given = end[lang, at - 1]
            added, last, settled = self._reread(classes, start[at], size[at], lang, given)
            count[lang, at] = fresh[lang, at] + added
            last = np.where(settled, fresh_end[lang, at], last)
            changed = end[lang, at] != last
            end[lang[changed], at[changed]] = last[changed]
            # A reading that never agreed ends in another state, which the next stretch goes on from.
            lang, at = lang[changed], at[changed] + 1
            inside = at < len(start)
            lang, at = lang[inside], at[inside]
            lang, at = lang[follows[at]], at[follows[at]]
        return count

    def _read_in_step(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each stretch in each language, and the state at its end."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        width = self.table.shape[1]
        flat, classes = self.table.ravel(), self.classes[raw]
        fresh = self.roots[:, None] * width
        state = np.repeat(fresh, len(start), axis=1)
        count = np.ones(state.shape, dtype=np.int64)
        # How many stretches are still read at each step.
        reading = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for step, n in enumerate(reading):
            byte = classes[start[:n] + step]
            to = flat[state[:, :n] + byte]
            # A phrase ends where the automaton has no edge; the byte begins the next one.
            ended = to == 0
            count[:, :n] += ended
            np.copyto(to, flat[fresh + byte], where=ended)
            np.multiply(to, width, out=state[:, :n])
        out, last = np.empty_like(count), np.empty_like(state)
        out[:, order], last[:, order] = count, state
        return out, last

    def _reread(
        self, classes: np.ndarray, start: np.ndarray, size: np.ndarray, lang: np.ndarray, given: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the count of a fresh reading lacks when it begins in the state `given`; the last state, and whether both agreed."""
        width, flat = self.table.shape[1], self.table.ravel()
        root = self.roots[lang].astype(np.int64) * width
        # A fresh reading has counted the phrase that it begins with.
        added, last, settled = np.full(len(start), -1), given.copy(), np.zeros(len(start), dtype=bool)
        left, a, b = np.arange(len(start)), root.copy(), given.astype(np.int64)
        step = 0
        while True:
            left_on = size[left] > step
            left, a, b = left[left_on], a[left_on], b[left_on]
            if not len(left):
                return added, last, settled
            byte = classes[start[left] + step]
            new_a, new_b = flat[a + byte], flat[b + byte]
            begun = flat[root[left] + byte]
            added[left] += (new_b == 0).astype(np.int64) - (new_a == 0)
            a, b = np.where(new_a == 0, begun, new_a).astype(np.int64) * width, np.where(new_b == 0, begun, new_b).astype(np.int64) * width
            last[left] = b
            agreed = a == b
            settled[left[agreed]] = True
            left, a, b = left[~agreed], a[~agreed], b[~agreed]
            step += 1


def training_texts(labelled: DataFrame, size: int = TRAIN_BYTES, stretch: int = TRAIN_STRETCH) -> dict[str, bytes]:
    """About `size` bytes of each language, from rows in the order of a hash of doc_id.

    `labelled` has doc_id, text and lang. No language sends more than a few times `size` to the driver.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    wanted = 2 * -(-size // stretch)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, (wanted + 6 * wanted**0.5) / n)).otherwise(share)
    chosen = rows.withColumn("draw", draw).where(F.col("draw") <= share)
    text = normalised(F.col("text"))
    # A stretch from a place that the draw decides, so that beginnings do not weigh more.
    spread = F.greatest(F.length("clean") - stretch, F.lit(0))
    begin = F.floor(spread * F.pmod(F.xxhash64("clean"), F.lit(1 << 20)) / (1 << 20)).cast("int") + 1
    chosen = chosen.withColumn("clean", text).where("clean <> ''").select(
        "lang", "draw", F.col("clean").substr(begin, F.lit(stretch)).alias("clean")
    )
    texts: dict[str, bytes] = {}
    for row in chosen.distinct().orderBy("lang", "draw", "clean").collect():
        before = texts.get(row["lang"], b"")
        if len(before) < size:
            texts[row["lang"]] = (before + b" " + row["clean"].encode())[:size]
    return texts


def _predict_task(model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        languages: Languages = model.value
        names = pa.array([*languages.names, UNKNOWN])
        for batch in batches:
            for piece in pieces(batch, "_clean", BATCH_BYTES):
                raw, at = utf8(piece.column(piece.num_columns - 1))
                sizes = np.diff(at)
                parts = -(-sizes // PIECE)
                row = np.repeat(np.arange(len(sizes)), parts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = at[row] + place * PIECE
                counts = languages.phrases(raw, start, np.minimum(PIECE, at[row + 1] - start), place > 0)
                total = np.stack([np.bincount(row, c, minlength=len(sizes)) for c in counts])
                entropy = total * languages.bits[:, None] / np.maximum(1, sizes)
                known = sizes > 0
                best = np.where(known, entropy.argmin(axis=0), len(languages.names))
                inverse = 1 / np.where(known, entropy, 1.0)
                score = np.where(known, inverse.max(axis=0) / inverse.sum(axis=0), 0.0)
                columns = [*piece.columns[:-1], names.take(pa.array(best)), pa.array(np.clip(score, 0.0, 1.0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(rows: DataFrame, labelled: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of `rows` with lang_pred and score."""
    texts = training_texts(labelled)
    kept = rows.select(*keep, text)
    if not texts:
        return kept.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = rows.sparkSession.sparkContext.broadcast(Languages(texts))
    clean = rows.select(*keep, F.coalesce(normalised(F.col(text).cast("string")), F.lit("")).alias("_clean"))
    fields = [clean.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return clean.mapInArrow(_predict_task(model), schema)
