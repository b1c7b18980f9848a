"""Toxicity by a weighted finite-state pattern grammar.

Every word of a clause is an insult, a threat, a target, a negation, a word of reported speech or
none of these. Five small weighted transducers read these symbols:

* insult: an insult emits its weight;
* target: an insult near a target counts more, and so does a target after an insult;
* threat: a threat and a target soon after it emit a weight together; a threat alone does not;
* negation: what follows a negation closely counts less;
* reported speech: what follows in the same clause counts less.

They are composed into one transducer, and each clause is scored by one run of it. The sum over the
clauses of a text goes into a logistic curve.

Insults and their weights are learned besides a fixed list: words much more frequent in texts with
label 1, in varying company (a word that always follows the same word belongs to a copied passage).
Words and curve are learned from a bounded sample (SAMPLE_ROWS labelled rows, by a hash of doc_id);
labels of the held-out rows are never read. All rows are scored, on their whole text.

Null and empty texts, and texts without insult or threat, get the score of a text without any.
Without labels of both kinds the curve is a fixed one. A doc_id with several labels has the largest.
Repeated rows give repeated result rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.llm.shared import held_out, only_ids, stored
from firelake.llm.words import NOT_ALNUM, pieces, utf8, words_of

THRESHOLD = 0.3
SAMPLE_ROWS = 20_000
# Two standard errors below its log odds, a learned word still has these.
LEAST_LOG_ODDS = 1.5
# Words the learned list may have; the strongest stay.
MOST_WORDS = 2_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Words of each class.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash clown clowns worthless pathetic disgusting dumb fool fools"
    " imbecile vermin filthy garbage pig pigs bastard jerk creep parasite parasites"
    " dumm dummkopf trottel abschaum versager ekelhaft widerlich wertlos"
    " crétin imbécile débile ordure minable nul dégoûtant"
    " estúpido imbécil basura escoria inútil asqueroso"
).split()
THREATS = (
    "kill killing hurt destroy beat shoot stab burn crush punish töten schlagen vernichten tuer frapper détruire matar"
    " golpear destruir"
).split()
TARGETS = (
    "you your yours he she him her they them this these those people everyone"
    " du dich dir dein ihr euch sie er ihn tu te toi vous il elle ils elles tú usted ustedes ellos ellas él ella"
).split()
NEGATIONS = "not no never neither nor isn aren wasn don doesn didn won nicht kein keine nie pas jamais aucun no nunca ningún".split()
REPORTS = (
    "said says say wrote writes called calls claimed claims quoted reported according alleged sagte sagt schrieb nannte"
    " dit disait écrit selon dijo dice escribió según"
).split()
FIXED_WEIGHT = 3.0
FIXED_CURVE = (-3.0, 1.5, 2.0)

Batches = Iterator[pa.RecordBatch]


class Machine(NamedTuple):
    """A transducer from symbols to weights: step(state, symbol) gives state, factor and addend."""

    states: int
    step: Callable[[int, int], tuple[int, float, float]]


def insult_machine() -> Machine:
    return Machine(1, lambda state, symbol: (0, 1.0, 0.0))


def target_machine(reach: int = 3) -> Machine:
    """States up to `reach` count down from a target, the ones above from an insult."""

    def step(state: int, symbol: int) -> tuple[int, float, float]:
        if symbol == TARGET:
            return reach, 1.0, 0.5 if state > reach else 0.0
        if symbol == INSULT:
            return 2 * reach, 1.5 if 0 < state <= reach else 1.0, 0.0
        return (0 if state in (0, reach + 1) else state - 1), 1.0, 0.0

    return Machine(2 * reach + 1, step)


def threat_machine(reach: int = 4, weight: float = 3.0) -> Machine:
    def step(state: int, symbol: int) -> tuple[int, float, float]:
        if symbol == THREAT:
            return reach, 1.0, 0.0
        if symbol == TARGET and state:
            return 0, 1.0, weight
        return max(0, state - 1), 1.0, 0.0

    return Machine(reach + 1, step)


def negation_machine(reach: int = 4, factor: float = 0.3) -> Machine:
    def step(state: int, symbol: int) -> tuple[int, float, float]:
        after = reach if symbol == NEGATION else max(0, state - 1)
        return after, factor if state and symbol in (INSULT, TARGET) else 1.0, 0.0

    return Machine(reach + 1, step)


def report_machine(factor: float = 0.5) -> Machine:
    return Machine(2, lambda state, symbol: (int(state or symbol == REPORT), factor if state else 1.0, 0.0))


class Grammar:
    """The composition of all machines as tables by state and symbol."""

    def __init__(self) -> None:
        machines = (insult_machine(), target_machine(), threat_machine(), negation_machine(), report_machine())
        states = list(product(*(range(m.states) for m in machines)))
        number = {state: i for i, state in enumerate(states)}
        shape = (len(states), REPORT + 1)
        self.start = number[(0,) * len(machines)]
        self.next, self.factor, self.addend = np.zeros(shape, int), np.ones(shape), np.zeros(shape)
        for state, i in number.items():
            for symbol in range(REPORT + 1):
                steps = [m.step(s, symbol) for m, s in zip(machines, state)]
                self.next[i, symbol] = number[tuple(s[0] for s in steps)]
                self.factor[i, symbol] = np.prod([s[1] for s in steps])
                self.addend[i, symbol] = sum(s[2] for s in steps)
        self.tables = (self.next.tolist(), self.factor.tolist(), self.addend.tolist())

    def clause(self, symbols: list[int], weights: list[float]) -> float:
        """Weight of the path of one clause."""
        after, factor, addend = self.tables
        state, total = self.start, 0.0
        for symbol, weight in zip(symbols, weights):
            total += factor[state][symbol] * (weight + addend[state][symbol])
            state = after[state][symbol]
        return total


CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+")


class Scorer:
    """Words with their class and weight, the grammar, and the curve over a text's weight."""

    def __init__(self, insults: Mapping[str, float], curve: tuple[float, float, float] = FIXED_CURVE) -> None:
        self.words: dict[str, tuple[int, float]] = {}
        for symbol, words in ((REPORT, REPORTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (THREAT, THREATS)):
            self.words |= {w: (symbol, 0.0) for w in words}
        self.words |= {w: (INSULT, weight) for w, weight in insults.items()}
        heavy = pa.array([w for w, (symbol, _) in self.words.items() if symbol in (INSULT, THREAT)])
        self.heavy = np.sort(words_of(heavy, NOT_ALNUM).hash)
        self.grammar, self.curve = Grammar(), curve

    def weight(self, text: str) -> float:
        """Sum over the clauses of a text."""
        total = 0.0
        for clause in CLAUSE_END.split(text):
            found = [self.words.get(w, (OTHER, 0.0)) for w in WORD.findall(clause.lower())]
            if any(symbol in (INSULT, THREAT) for symbol, _ in found):
                total += self.grammar.clause(*map(list, zip(*found)))
        return total

    def weights(self, texts: pa.Array) -> np.ndarray:
        """As `weight`, for many texts; only those with an insult or threat are read word by word.

        Bytes tell the words of ASCII texts only, so texts with other characters are all read.
        """
        words = words_of(texts, NOT_ALNUM)
        place = np.searchsorted(self.heavy, words.hash)
        hit = np.append(self.heavy, 0)[place] == words.hash
        raw, at = utf8(texts)
        wide = np.searchsorted(at[1:], np.flatnonzero(raw >= 128), side="right")
        out = np.zeros(len(texts))
        for row in np.union1d(words.row[hit], wide):
            out[row] = self.weight(texts[int(row)].as_py())
        return out

    def score(self, weights: np.ndarray) -> np.ndarray:
        bias, slope, any_weight = self.curve
        return 1 / (1 + np.exp(-(bias + slope * np.log1p(weights) + any_weight * (weights > 0))))


def fit_curve(weights: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method on the weight of a text and on whether it has any."""
    if len(set(labels.tolist())) < 2:
        return FIXED_CURVE
    x = np.stack([np.ones(len(weights)), np.log1p(weights), weights > 0], axis=1).astype(float)
    penalty = np.diag([1e-6, ridge, ridge])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (labels - p) - penalty @ beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, slope)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about `rows` labelled rows that are not held out, chosen by a hash; equal texts count once."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40)
    chosen = stored(usable.where(draw <= share), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = only_ids(texts.where("text IS NOT NULL"), chosen.select("doc_id"), "doc_id")
    rows = stored(texts.join(chosen, "doc_id"), "sample")
    same = rows.groupBy(F.xxhash64("text"), F.crc32(F.col("text").cast("binary")), F.length("text"))
    kept = same.agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic")
    return rows.drop("toxic").join(kept, "doc_id").select("text", "toxic")


def learned_insults(rows: DataFrame) -> dict[str, float]:
    """Words whose log odds for label 1 are high, with those odds as weights."""
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"), "")
    listed = rows.select("toxic", words.alias("words"))
    each = listed.select("toxic", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("docs"))
    bad, good = F.col("bad") + 0.5, F.col("docs") - F.col("bad") + 0.5
    odds = F.ln(bad / (n[1] + 1) / (good / (n[0] + 1)))
    certain = odds - 2 * F.sqrt(1 / bad + 1 / good) >= LEAST_LOG_ODDS
    strong = counts.where(certain).select("word", "docs", odds.alias("odds")).orderBy(F.desc("odds"), "word")
    strong = stored(strong.limit(MOST_WORDS), "words")
    # The word before each of their mentions.
    pairs = F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit("")), "words").alias("before"))
    met = listed.select(F.explode(pairs).alias("pair")).select("pair.word", "pair.before").where("word IS NOT NULL")
    company = met.join(F.broadcast(strong.select("word")), "word").groupBy("word").agg(F.countDistinct("before").alias("company"))
    found = strong.join(company, "word").where("2 * company >= docs").select("word", "odds")
    return {r["word"]: float(r["odds"]) for r in found.collect()}


def _weight_task(scorer) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text"):
                weights = scorer.value.weights(piece.column(1).fill_null(""))
                columns = [piece.column(0), pa.array(weights), pa.array(scorer.value.score(weights))]
                yield pa.RecordBatch.from_arrays(columns, names=[piece.schema.names[0], "weight", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    rows = sample(docs, labels)
    insults = {w: FIXED_WEIGHT for w in INSULTS} | learned_insults(rows)
    first = docs.sparkSession.sparkContext.broadcast(Scorer(insults))
    measured = rows.select("toxic", "text").mapInArrow(_weight_task(first), "toxic int, weight double, score double").toArrow()
    # In one order, so that sums and with them scores are the same in every run.
    weight, toxic = measured.column("weight").to_numpy(), measured.column("toxic").to_numpy()
    order = np.lexsort((toxic, weight))
    curve = fit_curve(weight[order], toxic[order])
    return Scorer(insults, curve)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, weight) of each row of `docs(doc_id, text)`; `labels` has doc_id and toxic."""
    scorer = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_weight_task(scorer), "doc_id long, weight double, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "weight")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    scorer = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column(piece.schema.get_field_index("text")).fill_null("")
                yield piece.filter(pa.array(scorer.value.score(scorer.value.weights(texts)) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
