"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field then
labels the open tokens of a text, runs of other characters than blanks that hold a digit or `@`; all
other tokens are outside. Neighbouring open tokens share a chain potential, tokens that repeat the
same digits or letters, or the last SHORT digits of longer numbers, anywhere in the text share a skip potential. Tokens under base spans keep
their label and are the evidence; loopy message passing carries it through the text. So the second
mention of a phone number without its country code is found, where the first had one.

A token joins a span when its label has at least CERTAIN of the belief; runs of one label that hold
seven digits or an `@` and touch no base span are added. Base spans always stay.

Weights are learned by pseudo-likelihood from what the base patterns find in a bounded sample
(SAMPLE_DOCS documents with open tokens by a hash of doc_id, of each a stretch of TOKENS_PER_DOC tokens).
All rows are searched on their whole text, however long. Positions are code points, ends exclusive. Null and
empty texts have no spans. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.llm.words import pieces, utf8

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
CERTAIN = 0.9
SAMPLE_DOCS = 3_000
# Open tokens of one text that may go into the sample: a stretch from a place that a hash of the text decides.
TOKENS_PER_DOC = 40
# Rounds over all edges at once; messages that still change go on in sweeps along the text.
TURNS = 8
# Messages (log scale) that change by less have settled. Sweeps go on until then; on loops that swing each sweep
# after the plain ones takes a smaller share of the change, so that they settle too.
SETTLED = 1e-3
PLAIN_SWEEPS, CALMER = 10, 0.9
SHORT = 7
# A longer shape is named by its checksum.
LONGEST_SHAPE = 60

Batches = Iterator[pa.RecordBatch]


class Span(NamedTuple):
    start: int
    kind: int
    end: int


class Token(NamedTuple):
    start: int
    end: int
    text: str


DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Digits before a match or given back by it never help, so neither is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
OPEN_TOKEN = re.compile(r"[^ \t-\r]+")
DIGIT_OR_AT = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    ended, at = 0, text.find("@")
    while at >= 0:
        local = text[ended:at]
        start = ended + len(local.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        # A local part begins after the last match or the last `@`.
        ended = domain.end() if domain else at + 1
        if domain:
            yield start, ended
        at = text.find("@", ended)


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, by start and then kind; each kind leftmost without overlaps."""
    spans = [Span(start, 0, end) for start, end in _emails(text)]
    spans += [Span(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0])]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            spans.append(Span(m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(Span(m.start(), 3, m.end()))
    return sorted(spans)


def open_tokens(text: str) -> list[Token]:
    return [Token(m.start(), m.end(), m[0]) for m in OPEN_TOKEN.finditer(text) if DIGIT_OR_AT.search(m[0])]


def token_labels(tokens: Sequence[Token], spans: Sequence[Span]) -> np.ndarray:
    """Kind of the first span that a token touches, else OUTSIDE."""
    labels = np.full(len(tokens), OUTSIDE)
    starts = np.array([t.start for t in tokens])
    ends = np.array([t.end for t in tokens])
    for span in reversed(spans):
        labels[np.searchsorted(ends, span.start, side="right") : np.searchsorted(starts, span.end, side="left")] = span.kind
    return labels


def _shape(token: str) -> str:
    text = re.sub(r"[0-9]+", "9", token)
    shape = re.sub(r"[^\W\d_]+", "a", text).strip("\"'*#$%&|<>!,;:")
    return shape if len(shape) <= LONGEST_SHAPE else f"long {zlib.crc32(shape.encode())}"


def _bucket(n: int) -> int:
    return next(i for i, most in enumerate((0, 2, 4, 6, 9, 13, 19, 1 << 60)) if n <= most)


def features(tokens: Sequence[Token]) -> list[list[str]]:
    sizes = [_bucket(sum(c.isdigit() for c in t.text)) for t in tokens]
    out = []
    for i, token in enumerate(tokens):
        near = [
            sizes[j] if 0 <= j < len(tokens) and _adjacent(tokens[min(i, j)], tokens[max(i, j)]) else "-" for j in (i - 1, i + 1)
        ]
        text = token.text
        out.append([
            "any", f"shape {_shape(text)}", f"digits {sizes[i]}", f"before {near[0]}", f"after {near[1]}",
            f"marks {'@' in text}{text[0] == '+'}{text.count('.') == 3}{'-' in text}{'(' in text}",
            f"letters {any(c.isalpha() for c in text)} {sizes[i]}",
        ])
    return out


def _adjacent(a: Token, b: Token) -> bool:
    return b.start - a.end == 1


def _mention(token: str) -> str:
    """What two mentions of one thing have in common: five digits or more, else the letters and digits."""
    digits = NOT_DIGIT.sub("", token)
    return digits if len(digits) >= 5 and "@" not in token else re.sub(r"[^\w@]+", "", token.lower())


def _number_end(token: str) -> str:
    """The last SHORT digits, which a number has in common with its form without country or area code."""
    digits = NOT_DIGIT.sub("", token)
    return digits[-SHORT:] if len(digits) >= SHORT and "@" not in token else ""


def edges(tokens: Sequence[Token]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of tokens, 0 for a chain and 1 for a skip edge); each mention is tied to the one before, else to the last number of the same end."""
    pairs, kinds, seen, ended = [], [], {}, {}
    for i, token in enumerate(tokens):
        chained = i > 0 and _adjacent(tokens[i - 1], token)
        if chained:
            pairs.append((i - 1, i))
            kinds.append(0)
        key = _mention(token.text)
        end = _number_end(token.text)
        last = seen.get(key, ended.get(end) if end else None)
        if last is not None and not (chained and last == i - 1):
            pairs.append((last, i))
            kinds.append(1)
        seen[key] = i
        if end:
            ended[end] = i
    return np.array(pairs, dtype=int).reshape(-1, 2), np.array(kinds, dtype=int)


class Field:
    """Weights of the skip-chain field: by feature and label, and by label pair for each kind of edge."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray) -> None:
        self.names, self.unary, self.pair = names, unary, pair

    def scores(self, tokens: Sequence[Token]) -> np.ndarray:
        rows = [[self.names[f] for f in each if f in self.names] for each in features(tokens)]
        return np.array([self.unary[r].sum(axis=0) for r in rows]).reshape(len(tokens), OUTSIDE + 1)

    def beliefs(self, tokens: Sequence[Token], labels: np.ndarray) -> np.ndarray:
        """Probability of each label of each token by loopy message passing; known labels are fixed."""
        score = self.scores(tokens)
        known = labels != OUTSIDE
        score[known] = np.where(np.arange(OUTSIDE + 1) == labels[known, None], 0.0, -50.0)
        pairs, kinds = edges(tokens)
        if not len(pairs):
            return _softmax(score)
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        potential = np.concatenate([self.pair[kinds], self.pair[kinds].transpose(0, 2, 1)])
        back = np.roll(np.arange(len(source)), len(pairs))
        message = np.zeros((len(source), OUTSIDE + 1))
        for _ in range(TURNS):
            total = score.copy()
            np.add.at(total, target, message)
            # What a token tells a neighbour leaves out what the neighbour told it.
            new = _told(total[source] - message[back], potential)
            change, message = abs(new - message).max(), new
            if change < SETTLED:
                break
        else:
            message = _swept(score, message, pairs, potential)
        np.add.at(score, target, message)
        return _softmax(score)


def _told(given: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages over edges from what their sources hold."""
    each = given[..., None] + potential
    most = each.max(axis=-2, keepdims=True)
    new = np.log(np.exp(each - most).sum(axis=-2)) + most[..., 0, :]
    return new - new.max(axis=-1, keepdims=True)


def _swept(score: np.ndarray, message: np.ndarray, pairs: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages passed edge by edge, forward and backward along the text, until they settle: evidence crosses it in one sweep."""
    n = len(pairs)
    message, total = message.copy(), score.copy()
    np.add.at(total, np.concatenate([pairs[:, 1], pairs[:, 0]]), message)
    forward = np.argsort(pairs[:, 1], kind="stable").tolist()
    backward = (n + np.argsort(-pairs[:, 0], kind="stable")).tolist()
    ends = pairs.tolist()
    for sweep in count():
        change, share = 0.0, CALMER ** max(0, sweep - PLAIN_SWEEPS)
        for e in forward + backward:
            (low, high), back = ends[e % n], (e + n) % (2 * n)
            source, target = (low, high) if e < n else (high, low)
            step = share * (_told(total[source] - message[back], potential[e]) - message[e])
            message[e] += step
            total[target] += step
            change = max(change, float(abs(step).max()))
        if change < SETTLED:
            break
    return message


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(sample: Sequence[Sequence[tuple[int, int, str, int]]], steps: int = 120, ridge: float = 1e-3) -> Field:
    """Maximise the pseudo-likelihood of the labels: each token given its features and its neighbours' labels."""
    names: dict[str, int] = {}
    rows, labels, links, kinds = [], [], [], []
    for doc in sample:
        tokens = [Token(*t[:3]) for t in doc]
        pairs, kind = edges(tokens)
        links.append(pairs + len(labels))
        kinds.append(kind)
        labels += [t[3] for t in doc]
        rows += [[names.setdefault(f, len(names)) for f in each] for each in features(tokens)]
    width = OUTSIDE + 1
    unary, pair = np.zeros((len(names), width)), np.zeros((2, width, width))
    if not rows:
        return Field(names, unary, pair)
    x, y = np.array(rows), np.array(labels)
    link, kind = np.concatenate(links), np.concatenate(kinds)
    wanted = np.eye(width)[y]
    parts = [unary, pair]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        score = unary[x].sum(axis=1)
        if len(link):
            np.add.at(score, link[:, 1], pair[kind, y[link[:, 0]]])
            np.add.at(score, link[:, 0], pair[kind, :, y[link[:, 1]]])
        error = (wanted - _softmax(score)) / len(y)
        slope_unary = np.stack([np.bincount(x.ravel(), np.repeat(error[:, c], x.shape[1]), len(names)) for c in range(width)], axis=1)
        slope_pair = np.zeros_like(pair)
        if len(link):
            np.add.at(slope_pair, (kind, y[link[:, 0]]), error[link[:, 1]])
            np.add.at(slope_pair.transpose(0, 2, 1), (kind, y[link[:, 1]]), error[link[:, 0]])
        for i, (p, slope) in enumerate(zip(parts, (slope_unary, slope_pair))):
            slope = slope - ridge * p / 10
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            p += 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Field(names, unary, pair)


def added_spans(text: str, base: Sequence[Span], field: Field) -> list[Span]:
    """Spans that the field finds beside the base spans."""
    tokens = open_tokens(text)
    labels = token_labels(tokens, base)
    free = labels == OUTSIDE
    if not any(free[i] and _long_enough(t.text) for i, t in enumerate(tokens)) and not (free[1:] & free[:-1]).any():
        return []
    belief = field.beliefs(tokens, labels)
    best = belief[:, :OUTSIDE].argmax(axis=1)
    sure = free & (belief[np.arange(len(tokens)), best] >= CERTAIN)
    found, i = [], 0
    while i < len(tokens):
        last = i
        while sure[i] and last + 1 < len(tokens) and sure[last + 1] and best[last + 1] == best[i] and _adjacent(tokens[last], tokens[last + 1]):
            last += 1
        if sure[i]:
            start, end = tokens[i].start, tokens[last].end
            whole = text[start:end]
            start += len(whole) - len(whole.lstrip("\"'*#$%&|<>!,;:[]{}"))
            end -= len(whole) - len(whole.rstrip("\"'*#$%&|<>!,;:[]{}."))
            if end > start and _long_enough(text[start:end]):
                found.append(Span(start, int(best[i]), end))
        i = last + 1
    return found


def _long_enough(text: str) -> bool:
    return "@" in text or sum("0" <= c <= "9" for c in text) >= SHORT


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[64, *range(48, 58)]] = True


def _rows_to_read(texts: pa.Array) -> list[int]:
    """Texts with a digit or `@`; no other holds an open token."""
    raw, at = utf8(texts)
    return np.unique(np.searchsorted(at[1:], np.flatnonzero(_MARKS[raw]), side="right")).tolist()


def _sample_task(batches: Batches) -> Batches:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.int32())]))
    for batch in batches:
        for piece in pieces(batch, "text"):
            texts, out = piece.column(0), []
            for row in _rows_to_read(texts):
                text = texts[row].as_py()
                tokens = open_tokens(text)
                labels = token_labels(tokens, base_spans(text))
                first = zlib.crc32(text.encode()) % max(1, len(tokens) - TOKENS_PER_DOC + 1)
                taken = slice(first, first + TOKENS_PER_DOC)
                out.append([(*t, int(y)) for t, y in zip(tokens[taken], labels[taken])])
            yield pa.RecordBatch.from_arrays([pa.array([[dict(zip(("start", "end", "text", "label"), t)) for t in d] for d in out], kind)], names=["tokens"])


def train(docs: DataFrame, size: int = SAMPLE_DOCS) -> Field:
    """The field, learned from about `size` texts with open tokens; equal stretches count once.

    The sample is put in order before it is learned from, so a rerun learns the same.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, size / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), F.lit("pii")), F.lit(1 << 40)) / float(1 << 40)
    schema = "tokens array<struct<start: int, end: int, text: string, label: int>>"
    found = rows.where(draw <= share).select("text").mapInArrow(_sample_task, schema).distinct()
    ordered = found.orderBy(F.xxhash64("tokens"), "tokens").limit(2 * size)
    return fit([[tuple(t) for t in row["tokens"]] for row in ordered.collect()])


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, field))


def _joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def _find_task(field) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column(1).fill_null("")
                counts, base_text, all_text = np.zeros((len(KINDS), len(texts)), int), [""] * len(texts), [""] * len(texts)
                for row in _rows_to_read(texts):
                    base, spans = all_spans(texts[row].as_py(), field.value)
                    counts[:, row] = np.bincount([s.kind for s in base], minlength=len(KINDS))
                    base_text[row], all_text[row] = _joined(base), _joined(spans)
                columns = [piece.column(0), *map(pa.array, counts), pa.array(base_text, pa.string()), pa.array(all_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans); the counts are of base spans."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_find_task(field), f"doc_id long, {counts}, base string, spans string")


def redacted(text: str, spans: Sequence[Span]) -> str:
    """The text with its kind in place of each span; overlapping spans become one."""
    parts, ended = [], 0
    for span in spans:
        if span.start >= ended:
            parts += [text[ended : span.start], f"<{KINDS[span.kind].upper()}>"]
        ended = max(ended, span.end)
    return "".join([*parts, text[ended:]])


def without_pii(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with spans in `text` replaced by their kind, and n_chars, if there, counted anew."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs))

    def clean(batches: Batches) -> Batches:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for piece in pieces(batch, "text"):
                column = piece.column(place)
                texts = column.to_pylist()
                for row in _rows_to_read(column):
                    texts[row] = redacted(texts[row], all_spans(texts[row], field.value)[1])
                yield piece.set_column(place, piece.schema.field(place), pa.array(texts, column.type))

    cleaned = docs.mapInArrow(clean, docs.schema)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))).select(*docs.columns)
