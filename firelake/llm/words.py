"""Words and word shingles of Arrow text columns as 64-bit hashes, computed on the raw bytes.

A word is a maximal run of bytes that are not separators; every text starts and ends one.
Letters A-Z are folded to a-z. Hashes depend on the bytes of the word only, so they agree
between tasks and runs. Work goes on in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on together; a longer single text is a piece of its own.
PIECE_BYTES = 2_000_000
_CHUNK = 1_000_000
_U = np.uint64

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Everything in ASCII that is neither letter nor digit; bytes of other characters count as letters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_low:_high] = False


class Words(NamedTuple):
    row: np.ndarray  # text that holds the word
    hash: np.ndarray
    start: np.ndarray  # bytes from the start of the first text
    end: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=_U)


_POWERS, _BACK_POWERS = _powers(_BASE, _CHUNK + 1), _powers(_BACK, _CHUNK + 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `limit` bytes of text each."""
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _word_bounds(raw: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~separators[raw]
    opens, closes = inside.copy(), inside.copy()
    if len(raw) > 1:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = at[(at > 0) & (at < len(raw))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of byte values times powers of the base, from each word's own start."""
    out = np.empty(len(start), dtype=_U)
    first = 0
    while first < len(start):
        low = start[first]
        last = max(first + 1, int(np.searchsorted(end, low + _CHUNK, side="right")))
        high = end[last - 1]
        n = int(high - low)
        up = _POWERS[:n] if n <= _CHUNK else _powers(_BASE, n)
        down = _BACK_POWERS if n <= _CHUNK else _powers(_BACK, n)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(_VALUES[raw[low:high]] * up, out=total[1:])
        s = start[first:last] - low
        out[first:last] = (total[end[first:last] - low] - total[s]) * down[s]
        first = last
    return mix(out)


def words_of(column: pa.Array, separators: np.ndarray = SPACES) -> Words:
    raw, at = utf8(column)
    start, end = _word_bounds(raw, at, separators)
    row = np.searchsorted(at[1:], start, side="right")
    return Words(row, _hashes(raw, start, end), start, end)


_SHINGLE_BASE = 0xA0761D6478BD642F


def shingles(words: Words, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words in reading order.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    n = len(words.hash)
    counts = np.bincount(words.row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(n) - first[words.row]
    size = np.minimum(counts[words.row], k)
    total = np.zeros(n, dtype=_U)
    for j in range(min(k, n)):
        part = words.hash[j:] * _U(pow(_SHINGLE_BASE, j + 1, 1 << 64))
        np.add(total[: n - j], np.where(size[: n - j] > j, part, _U(0)), out=total[: n - j])
    kept = place <= counts[words.row] - size
    return words.row[kept], mix(total[kept] + size[kept].astype(_U))


def distinct_by_row(row: np.ndarray, values: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """For each row its distinct values, ascending."""
    ends = np.cumsum(np.bincount(row, minlength=rows))
    begin = 0
    for end in ends:
        yield np.unique(values[begin:end])
        begin = end


def shingle_places(words: Words, rows: int, k: int) -> np.ndarray:
    """Index of the first word of each run, in the order of `shingles`."""
    counts = np.bincount(words.row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(words.row)) - first[words.row]
    return np.flatnonzero(place <= counts[words.row] - np.minimum(counts[words.row], k))
