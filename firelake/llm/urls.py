"""URL filters by a bit-parallel wildcard automaton.

All rules are globs over a canonical form of the URL, `.host#path`: `*` stands for any run of
characters, everything else for itself. Host and path never hold `#`, so a glob says which side it
means. The globs are packed into one Shift-And automaton of several 64-bit words: each bit is a
place in a glob, one shift moves every glob of every URL of a batch on by a character, a table by
character says which places may follow, and places before a `*` also stay where they are.

Two tables of rules are packed together:

* site rules: a host with all its subdomains and the start of a path; the longest that fits decides;
* patterns: globs of unwanted hosts, asked only where no site rule fits.

What fits nothing is allowed. The host is what follows the first `://` up to `/`, `?`, `#` or the
end, with A-Z lower-cased, the path goes on to `?`, `#` or the end. A null URL and one without `://`
have an empty host and path. Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
# URLs that move through the automaton together.
STEP_ROWS = 4096

Batches = Iterator[pa.RecordBatch]


class SiteRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def glob(self) -> str:
        return f"*.{self.host}#{self.path}*"


# The site rules.
SITE_RULES = (
    SiteRule("block", "net", "/"),
    SiteRule("allow", "example.net", "/en/"),
    SiteRule("block", "example.com", "/de/"),
    SiteRule("allow", "org", "/fr/"),
)
# Unwanted hosts, by a part of a host label.
UNWANTED = (
    "*casino*#*",
    "*.free-bets.*#*",
    "*betting*#*",
    "*cheap-pills*#*",
    "*viagra*#*",
    "*spam-*#*",
    "*-spam.*#*",
    "*.ads-*#*",
    "*.adserv*#*",
    "*.track-*#*",
    "*.adult-*#*",
    "*porn*#*",
    "*.xxx.*#*",
)


class Automaton:
    """Globs as masks over a row of 64-bit words; glob g ends at bit `ends[g]`."""

    def __init__(self, globs: Sequence[str]) -> None:
        bits = sum(len(g.replace("*", "")) + 1 for g in globs)
        self.words = -(-max(1, bits) // 64)
        self.first, self.stay = self._mask(), self._mask()
        letters = sorted(set("".join(globs)) - {"*"})
        # Class 0 is every character that no glob has.
        self.classes = {ord(c): i + 1 for i, c in enumerate(letters)}
        self.follow = np.zeros((len(letters) + 1, self.words), dtype=_U)
        self.ends: list[int] = []
        bit = 0
        for glob in globs:
            self._set(self.first, bit)
            for char in glob:
                if char == "*":
                    self._set(self.stay, bit)
                else:
                    bit += 1
                    self._set(self.follow[self.classes[ord(char)]], bit)
            self.ends.append(bit)
            bit += 1

    def _mask(self) -> np.ndarray:
        return np.zeros(self.words, dtype=_U)

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= _U(1 << bit % 64)

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character classes of all texts, and where each text begins."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = np.array(sorted(self.classes), dtype=np.uint32)
        number = np.array([self.classes[int(c)] for c in known] + [0], dtype=np.int64)
        place = np.searchsorted(known, points)
        found = np.append(known, 0)[place] == points
        return np.where(found, number[place], 0), np.concatenate([[0], np.cumsum(sizes)])

    def matches(self, texts: list[str]) -> np.ndarray:
        """Whether text t fits glob g: a table of booleans by t and g."""
        classes, at = self._read(texts)
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        sizes, start = sizes[order], at[:-1][order]
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        longest = int(sizes[0]) if len(sizes) else 0
        reading = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for step, n in enumerate(reading):
            now = state[:n]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            state[:n] = (moved & self.follow[classes[start[:n] + step]]) | (now & self.stay)
        out = np.zeros((len(texts), len(self.ends)), dtype=bool)
        for g, end in enumerate(self.ends):
            out[order, g] = (state[:, end // 64] >> _U(end % 64)) & _U(1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _judge_task(rules: tuple[SiteRule, ...], unwanted: tuple[str, ...]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        automaton = Automaton([*(r.glob for r in rules), *unwanted])
        # Longest first; the first that fits decides.
        ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
        names = pa.array([rules[i].name for i in ranked] + [None], pa.string())
        verdicts = np.array([rules[i].verdict for i in ranked], dtype=object)
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(begin, STEP_ROWS)
                hosts, paths = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                fits = automaton.matches([f".{h}#{p}" for h, p in zip(hosts, paths)])
                site = np.hstack([fits[:, ranked], np.ones((len(hosts), 1), dtype=bool)]).argmax(axis=1)
                method = np.where(fits[:, len(rules) :].any(axis=1), "block", "allow").astype(object)
                verdict = np.where(site < len(rules), np.append(verdicts, "")[site], method)
                columns = [*part.columns, names.take(pa.array(site)), pa.array(verdict, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "rule", "verdict"])

    return run


def judge_urls(
    pages: DataFrame, rules: Sequence[SiteRule] = SITE_RULES, unwanted: Sequence[str] = UNWANTED
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of `pages(page_id, url)`."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    text = [T.StructField(name, T.StringType()) for name in ("host", "path", "rule", "verdict")]
    schema = T.StructType([parts.schema["page_id"], *text])
    return parts.mapInArrow(_judge_task(tuple(rules), tuple(unwanted)), schema)
