"""Quality rules as one projection: a table of thresholds over lengths, symbols, stop words and lines.

Words are maximal runs of characters other than blanks and the controls 9 to 13. All measures
are built-in functions of the text, evaluated row by row without shuffles; each rule is a line of
`RULES`, and a text is kept if it breaks none and passes the base rules (at least ten words; at most
20 of 100 words inside a window of five words that the text has twice).

Null and empty texts have no words and are not kept. Repeated rows give repeated result rows, and
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 10
WINDOW_WORDS = 5
REPEATED_PERCENT = 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they"
    " this to was we were which will with you"
    " als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im"
    " ist kann mit nach nicht noch nur oder sich sie sind so über um und von vor war was wenn werden wie wird wir zu zum zur"
    " au aux avec ce cette ces dans de du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus"
    " pour que qui sa se ses son sont sur un une vous y"
    " al como con del donde el ella ellos entre era ese esta este fue ha hay las lo los más me mi muy no nos o para pero"
    " por porque se ser si sin sobre su sus también tiene todo una uno yo"
).split()


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """A text breaks the rule when `top` per 100 of `bottom` is outside the limits."""

    name: str
    top: str
    bottom: str
    least: float | None
    most: float | None


# Thresholds on the measures below.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1200),
    Rule("symbols per word", "n_symbols", "n_words", None, 10),
    Rule("exclamation marks per word", "n_exclamations", "n_words", None, 50),
    Rule("ellipses per word", "n_ellipses", "n_words", None, 10),
    Rule("words with a letter", "n_letter_words", "n_words", 50, None),
    Rule("stop words", "n_stop_words", "n_words", 2, None),
    Rule("capital letters", "n_capitals", "word_chars", None, 40),
    Rule("digits", "n_digits", "word_chars", None, 30),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bulleted lines", "n_bullets", "n_lines", None, 90),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _left(text: Column, drop: str) -> Column:
    """Characters that remain without those that match."""
    return F.length(F.regexp_replace(text, drop, ""))


def repeated_words(words: Column, size: int = WINDOW_WORDS) -> Column:
    """Words inside windows of `size` words that occur twice or more, the first one included.

    Windows are compared by a 64-bit hash. Their sorted hashes show whether any occurs twice;
    only then are hash and place sorted together and the covered places counted.
    """
    last = F.size(words) - size + 1
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))

    def window(i: Column) -> Column:
        return F.xxhash64(F.slice(words, i, size))

    def occurs_again(pairs: Column) -> Callable[[Column, Column], Column]:
        def same(pair: Column, at: Column) -> Column:
            return F.coalesce(F.get(pairs, at)["h"] == pair["h"], F.lit(False))

        return lambda pair, i: same(pair, i - 1) | same(pair, i + 1)

    def covered(pairs: Column) -> Column:
        again = F.array_sort(F.transform(F.filter(pairs, occurs_again(pairs)), lambda pair: pair["i"]))
        nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

        def add(state: Column, i: Column) -> Column:
            more = i + size - F.greatest(state["end"], i)
            return F.struct((i + size).alias("end"), (state["n"] + more).alias("n"))

        return F.aggregate(again, nothing, add, lambda state: state["n"])

    pairs = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))
    distinct = F.size(F.array_distinct(F.transform(places, window))) == last
    # A transform of one element names the sorted pairs, so that they are built once.
    counted = F.get(F.transform(F.array(pairs), covered), F.lit(0))
    return F.when((last < 2) | distinct, F.lit(0)).otherwise(counted)


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """All measures by name, from the text, its words, and its lines that hold a word."""
    bare = F.split(F.lower(text), r"[^\p{L}\p{M}]+")
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": _left(text, r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_exclamations": _left(text, "[^!]+"),
        "n_ellipses": F.size(F.split(text, r"\.\.\.|…")) - 1,
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "n_stop_words": F.size(F.filter(bare, lambda w: w.isin(*sorted(set(STOP_WORDS))))),
        "n_capitals": _left(text, r"\P{Lu}+"),
        "n_digits": _left(text, "[^0-9]+"),
        "n_bullets": F.size(F.filter(lines, lambda line: line.rlike(r"^[ \t]*[-*•][ \t]"))),
    }


def broken(rule: Rule) -> Column:
    """Whether a row of measures breaks the rule."""
    top, bottom = 100 * F.col(rule.top), F.col(rule.bottom)
    low = F.lit(False) if rule.least is None else top < rule.least * bottom
    high = F.lit(False) if rule.most is None else top > rule.most * bottom
    return low | high


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the names of the broken rules, comma-joined."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    split = rows.select(
        "*",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    found = measures(F.col("_text"), F.col("_words"), F.col("_lines"))
    measured = split.select("doc_id", *[value.cast("long").alias(name) for name, value in found.items()])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    names = F.concat_ws(",", *[F.when(broken(rule), F.lit(rule.name)) for rule in rules])
    judged = measured.select(*BASE, base.alias("base_failed"), names.alias("broken"))
    return judged.select(*BASE, "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken")
