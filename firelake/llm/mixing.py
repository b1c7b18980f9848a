"""Mixing sources to target weights by Poisson replication.

A source with n documents and target share w gets the mean rate w * total / n. Each document draws
a number between 0 and 1 from a hash of its doc_id and a seed, and the inverse of the Poisson
distribution with its source's mean turns it into a number of copies. The draws depend on nothing
else, so a rerun, other partitions or more documents of other sources give the same draws. Copies
are then put into one global order by another hash.

Targets are weights by source, or n ** temperature for each source when none are given (1 keeps the
mixture, 0 makes all sources equal). Sources without a given weight get no copies; weights of
sources that do not occur count for nothing. A null source is a source of its own; it takes its
weight from the key None. Rows without doc_id share one draw; repeated rows get equal counts. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firelake.operators.skew import join_reduced

SEED = 20
TEMPERATURE = 0.5
# Entries of all distribution tables (8 bytes each) that may be sent to every executor.
MAX_BROADCAST_ENTRIES = 500_000
KEY = "_source_key"


def _key(source: Column) -> Column:
    """Text key that tells a null source from every other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the first 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, temperature: float, total: int | None) -> DataFrame:
    """(key, rate): mean number of copies of a document of each source; sources with rate 0 are left out."""
    counts = docs.groupBy(_key(F.col("source")).alias(KEY)).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = [("" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        weighed = counts.join(docs.sparkSession.createDataFrame(given, f"{KEY} string, weight double"), KEY)
    weight_sum = weighed.agg(F.sum("weight")).first()[0] or 0.0
    size = counts.agg(F.sum("n")).first()[0] if total is None else total
    if weight_sum <= 0:
        return weighed.select(KEY, F.lit(0.0).alias("rate")).where(F.lit(False))
    rate = F.col("weight") / F.lit(float(weight_sum)) * F.lit(float(size)) / F.col("n")
    return weighed.select(KEY, rate.alias("rate")).where("rate > 0")


def distributions(mean_rates: DataFrame) -> DataFrame:
    """(key, steps): the cumulative Poisson probabilities of 0, 1, 2, ... until nothing is left in doubles."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    each = mean_rates.select(KEY, "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    so_far = Window.partitionBy(KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factorial = F.sum(F.when(F.col("k") > 0, F.ln(F.col("k"))).otherwise(0.0)).over(so_far)
    chance = F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("factorial"))
    summed = each.withColumn("factorial", factorial).withColumn("chance", chance)
    summed = summed.withColumn("step", F.sum("chance").over(so_far))
    return summed.groupBy(KEY).agg(F.sort_array(F.collect_list("step")).alias("steps"))


def replicate(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    total: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """All columns of `docs` (doc_id and source among them) with n_copies and copy, in one random order.

    `total` is the wanted number of rows; by default that of `docs`. Columns named n_copies or copy are replaced; any
    other name is free, as a record travels as one struct.
    """
    kept = [c for c in docs.columns if c not in ("n_copies", "copy")]
    tables = distributions(rates(docs, weights, temperature, total))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("record"), _key(F.col("source")).alias(KEY))
    entries = tables.select(F.sum(F.size("steps"))).first()[0] or 0
    if entries <= MAX_BROADCAST_ENTRIES:
        drawn = keyed.join(F.broadcast(tables), KEY)
    else:
        drawn = join_reduced(keyed, tables, [KEY], "inner")
    # The distribution is inverted: as many copies as there are steps at or below the draw.
    drawn = drawn.withColumn("draw", draw(F.col("record.doc_id"), seed))
    counted = drawn.withColumn("n_copies", F.size(F.filter("steps", lambda s: s <= F.col("draw"))))
    copies = counted.where("n_copies > 0").select("record", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    copies = copies.orderBy(F.xxhash64(F.lit(seed), F.col("record.doc_id"), F.col("copy")), "record.doc_id", "copy")
    return copies.select("record.*", "n_copies", "copy")
