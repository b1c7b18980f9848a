"""Split, class weights and quality of a scored table with a 0/1 label."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firelake.functions import round_to
from firelake.operators.summary import label_distribution
from firelake.sources.tables import staged

# Digits of a score that are told apart when it is ranked.
SCORE_DIGITS = 4
# Bits of the number that a row draws for the split, and of those that one pass looks at.
DRAW_BITS, STEP_BITS = 60, 12


def split_bucket(key: Sequence[str]) -> Column:
    """0..99 from the md5 of the row key: the same row always falls on the same side."""
    digest = F.md5(F.concat_ws("|", *[F.col(name).cast("string") for name in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def stratified_split(rows: DataFrame, key: Sequence[str], test_percent: int = 20) -> DataFrame:
    """Adds `is_test`. The key hash knows nothing of the label, so each class is split in
    about the same proportion, without a shuffle or a second pass."""
    return rows.withColumn("is_test", split_bucket(key) < test_percent)


def split_draw(key: Sequence[str]) -> Column:
    """60 bits of the md5 of the row key."""
    digest = F.md5(F.concat_ws("|", *[F.col(name).cast("string") for name in key]))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


class Cut(NamedTuple):
    """Where a class is split: draws below go to the test rows, and so do `taken` of the rows at the draw."""

    draw: int
    taken: int


def split_cuts(drawn: DataFrame, test_percent: int, label: str = "label", draw: str = "_draw") -> dict[object, Cut]:
    """The cut that leaves round(n * test_percent / 100) rows of each class below it.

    An order statistic without sorting: counts of the leading STEP_BITS of the draws say in which bucket
    the cut lies; the next pass counts that bucket alone, by the next bits. A pass brings back at most
    2 ** STEP_BITS rows per class; three passes are enough for a billion rows.
    """
    wanted: dict[object, int] = {}
    cuts: dict[object, Cut] = {}
    prefix: dict[object, int] = {}
    shift = DRAW_BITS
    while shift and (shift == DRAW_BITS or prefix):
        shift -= STEP_BITS
        inside = F.lit(True)
        if prefix:
            open_buckets = [F.col(label).eqNullSafe(F.lit(c)) & (F.shiftright(draw, shift + STEP_BITS) == p) for c, p in prefix.items()]
            inside = reduce(Column.__or__, open_buckets)
        counted = drawn.where(inside).groupBy(label, F.shiftright(draw, shift).alias("bucket")).count().collect()
        classes: dict[object, list[tuple[int, int]]] = {}
        for row in counted:
            classes.setdefault(row[label], []).append((row["bucket"], row["count"]))
        for name, buckets in classes.items():
            if name not in wanted:
                wanted[name] = (sum(n for _, n in buckets) * test_percent + 50) // 100
            left = wanted[name]
            for bucket, n in sorted(buckets):
                if left <= n:
                    break
                left -= n
            wanted[name] = left
            if left == n or not shift:
                # The bucket goes in whole, or is a single draw.
                cuts[name] = Cut((bucket + 1) << shift, 0) if left == n else Cut(bucket, left)
                prefix.pop(name, None)
            else:
                prefix[name] = bucket
    return cuts


def exact_split(rows: DataFrame, key: Sequence[str], test_percent: int = 20, label: str = "label") -> DataFrame:
    """Adds `is_test`: exactly round(n * test_percent / 100) rows of each class, those whose key hashes lowest.

    Rows of equal keys at the cut are told apart by a number counted within each input task first; which of
    them is taken is not defined. A null label is a class of its own. The rows are read a few times: give a
    stored table.
    """
    columns = rows.columns
    drawn = rows.withColumn("_draw", split_draw(key))
    cuts = split_cuts(drawn, test_percent, label)
    is_test, at_cut = F.lit(False), F.lit(False)
    for name, cut in cuts.items():
        mine = F.col(label).eqNullSafe(F.lit(name))
        is_test = F.when(mine, F.col("_draw") < cut.draw).otherwise(is_test)
        if cut.taken:
            at_cut = at_cut | (mine & (F.col("_draw") == cut.draw))
    flagged = drawn.withColumn("is_test", is_test)
    if not any(cut.taken for cut in cuts.values()):
        return flagged.select(*columns, "is_test")
    tied = staged(flagged.where(at_cut).withColumn("_part", F.spark_partition_id()), "tied")
    parts = tied.groupBy(label, "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(label).alias("_class"), F.col("_part").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_draw")).alias("_number")
    numbered = tied.select("*", number).join(parts, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_part") == F.col("_of")))
    taken = F.lit(0)
    for name, cut in cuts.items():
        taken = F.when(F.col(label).eqNullSafe(F.lit(name)), cut.taken).otherwise(taken)
    chosen = numbered.withColumn("is_test", F.col("_number") + F.col("_before") <= taken)
    return flagged.where(~at_cut).select(*columns, "is_test").union(chosen.select(*columns, "is_test"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = label_distribution(rows, label)
    everything = Window.partitionBy()  # one row per class
    share = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.withColumn("weight", round_to(share, 6))


def with_class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds `weight`. The label is 0 or 1, so two rows are broadcast."""
    weights = class_weights(rows, label).where(F.col(label).isin(0, 1)).select(label, "weight")
    return rows.join(F.broadcast(weights), label, "left").select(*rows.columns, "weight")


def _ranked(rows: DataFrame, score: str, label: str, digits: int) -> DataFrame:
    """Per distinct score: positives and negatives at it and above it, and the totals.

    Scores are grouped first (partial counts per split), so what is ranked is at most
    10^digits values of a score in [0, 1]. The running sum is taken in two levels, over
    coarse score bands and inside each band, so no task sees all of them.
    """
    step = 10 ** (digits // 2)
    tick = F.round(F.col(score) * float(10**digits)).cast("long")
    per_tick = (
        rows.where(F.col(score).isNotNull())
        .groupBy(tick.alias("tick"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
        .withColumn("band", F.floor(F.col("tick") / step))
    )
    before = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bands = (
        per_tick.groupBy("band")
        .agg(F.sum("pos").alias("band_pos"), F.sum("neg").alias("band_neg"))
        .select(
            "band",
            F.coalesce(F.sum("band_pos").over(before), F.lit(0)).alias("above_pos"),
            F.coalesce(F.sum("band_neg").over(before), F.lit(0)).alias("above_neg"),
            F.sum("band_pos").over(whole).alias("all_pos"),
            F.sum("band_neg").over(whole).alias("all_neg"),
        )
    )
    inside = Window.partitionBy("band").orderBy(F.desc("tick"))
    # Doubles from here on: products of two counts may pass the range of a long.
    as_double = [F.col(n).cast("double").alias(n) for n in ("pos", "neg", "all_pos", "all_neg")]
    return (
        per_tick.withColumns({"in_pos": F.sum("pos").over(inside), "in_neg": F.sum("neg").over(inside)})
        .join(bands, "band", "left")
        .select(
            *as_double,
            (F.col("above_pos") + F.col("in_pos")).cast("double").alias("cum_pos"),
            (F.col("above_neg") + F.col("in_neg")).cast("double").alias("cum_neg"),
        )
    )


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label", digits: int = SCORE_DIGITS) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    ranked = _ranked(rows, score, label, digits)
    beaten = F.sum(F.expr("neg * (cum_pos - pos / 2)"))
    pairs = F.max("all_pos") * F.max("all_neg")
    return ranked.agg(F.when(pairs > 0, round_to(beaten / pairs, 6)).alias("roc_auc"))


def average_precision(
    rows: DataFrame, score: str = "score", label: str = "label", digits: int = SCORE_DIGITS
) -> DataFrame:
    """Precision averaged over the recall steps; null with one class only."""
    ranked = _ranked(rows, score, label, digits)
    summed = F.sum(F.expr("pos * cum_pos / (cum_pos + cum_neg)"))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return ranked.agg(F.when(both, round_to(summed / F.max("all_pos"), 6)).alias("average_precision"))


def _confusion(rows: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn. As from a two-class vote, a score must pass the threshold."""
    said, true = F.col(score) > threshold, F.col(label) == 1
    return rows.agg(
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"),
        F.count_if(~said & ~true).alias("tn"),
    )


def _ratio(top: str, bottom: str) -> Column:
    """0 where nothing is divided by."""
    return F.expr(f"CASE WHEN {bottom} = 0 THEN 0e0 ELSE ({top}) / CAST({bottom} AS DOUBLE) END")


def confusion_metrics(
    rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """Counts with accuracy, precision, recall and f1 of class 1."""
    return _confusion(rows, score, label, threshold).select(
        "tp",
        "fp",
        "fn",
        "tn",
        round_to(_ratio("tp + tn", "(tp + fp + fn + tn)"), 4).alias("accuracy"),
        round_to(_ratio("tp", "(tp + fp)"), 4).alias("precision"),
        round_to(_ratio("tp", "(tp + fn)"), 4).alias("recall"),
        round_to(_ratio("2 * tp", "(2 * tp + fp + fn)"), 4).alias("f1"),
    )


def classification_report(
    rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """Rows for both classes, accuracy, macro and weighted average."""
    per_class = _confusion(rows, score, label, threshold).select(
        _ratio("tn", "(tn + fn)").alias("p0"),
        _ratio("tn", "(tn + fp)").alias("r0"),
        _ratio("2 * tn", "(2 * tn + fn + fp)").alias("f0"),
        F.expr("tn + fp").alias("s0"),
        _ratio("tp", "(tp + fp)").alias("p1"),
        _ratio("tp", "(tp + fn)").alias("r1"),
        _ratio("2 * tp", "(2 * tp + fp + fn)").alias("f1"),
        F.expr("tp + fn").alias("s1"),
        _ratio("tp + tn", "(tp + fp + fn + tn)").alias("acc"),
        F.expr("tp + fp + fn + tn").alias("n"),
    )

    def line(name: str, precision: Column, recall: Column, f1: Column, support: str) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            round_to(precision, 4).alias("precision"),
            round_to(recall, 4).alias("recall"),
            round_to(f1, 4).alias("f1"),
            F.col(support).alias("support"),
        )

    def macro(measure: str) -> Column:
        return (F.col(f"{measure}0") + F.col(f"{measure}1")) / 2

    def weighted(measure: str) -> Column:
        return _ratio(f"{measure}0 * s0 + {measure}1 * s1", "n")

    lines = F.array(
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), "s0"),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), "s1"),
        line("accuracy", F.col("acc"), F.col("acc"), F.col("acc"), "n"),
        line("macro avg", macro("p"), macro("r"), macro("f"), "n"),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), "n"),
    )
    return per_class.select(F.inline(lines))
