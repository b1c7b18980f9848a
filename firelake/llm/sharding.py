"""Two-pass external shuffle into shards, with DataFrame functions only.

1. Every record draws a number: a hash of a seed, its doc_id, its text and its copy number. The draw
   scatters the records uniformly over buckets that hold about BUCKET_ROWS records and no more than
   about BUCKET_BYTES; this is the only shuffle of whole records.
2. Each bucket is put in the order of its draws and then shuffled by Fisher-Yates: places n - 1 down
   to 1 are swapped with a place at or below that a second hash draws. Only places are swapped, as an
   array of a few hundred numbers per bucket.

Buckets in turn make one global order. The record at place p goes to shard p % shards, slot p div
shards: the shards' row counts differ by one at most, and the slots of a shard have no gap. The
order depends on the seed and the records alone, not on partitions or reruns.

Rows equal in doc_id and text are told apart by a copy number, counted per input task first, so
that even a third of all rows in one key is scattered like any other; which of them gets which
number is not defined. A null doc_id counts as an empty one; a null text has no bytes and is told
apart from an empty one. Long texts travel whole. Any columns are carried, under any names: a record
is one struct. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firelake.llm.shared import only_ids, stored
from firelake.operators.skew import join_reduced
from firelake.session import work_dir

SEED = 12
SHARDS = 8
BUCKET_ROWS = 512
BUCKET_BYTES = 64 << 20
# Buckets whose places are summed together; the sums of blocks are summed once more.
_BLOCK = 4096
# Buckets whose permutations one task draws: their rows are few but each is a second's fraction of work.
_BUCKETS_PER_TASK = 64


def size_of(text: Column) -> Column:
    """UTF-8 bytes and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def _identity() -> Column:
    text = F.coalesce(F.md5(F.col("record.text").cast("binary")), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col("record.doc_id").cast("string"), F.lit("")), text)


def _with_copy(records: DataFrame) -> DataFrame:
    """The records with `identity` and `copy`: 0, or the number among those of equal doc_id and text."""
    rows = records.withColumn("print", F.xxhash64("record.doc_id", "record.text"))
    repeated = stored(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "repeated")
    if repeated.isEmpty():
        return records.select("record", _identity().alias("identity"), F.lit(0).cast("long").alias("copy"))
    once = only_ids(rows, repeated, "print", "left_anti")
    once = once.select("record", _identity().alias("identity"), F.lit(0).cast("long").alias("copy"))
    again = only_ids(rows, repeated, "print").select("record", _identity().alias("identity"))
    # Numbered within the task that read them, then after the tasks before it.
    again = stored(again.withColumn("part", F.spark_partition_id()), "again")
    parts = again.groupBy("identity", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("identity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("identity", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("identity", "part").orderBy(F.xxhash64("record"))
    numbered = again.withColumn("copy", F.row_number().over(within))
    numbered = join_reduced(numbered, parts, ["identity", "part"], "inner")
    return once.union(numbered.select("record", "identity", (F.col("copy") - 1 + F.col("offset")).alias("copy")))


def _fisher_yates(bucket: Column, n: Column, seed: int) -> Column:
    """A permutation of 0 to n - 1 as an array."""

    def drawn(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(f"swap {seed}"), bucket.cast("string"), i.cast("string")))
        return F.struct(i.alias("i"), F.pmod(_number(digest, 13), i + 1).cast("int").alias("j"))

    def swapped(places: Column, step: Column) -> Column:
        at = lambda k: F.element_at(places, k + 1)
        return F.transform(
            places,
            lambda x, p: F.when(p == step["i"], at(step["j"])).when(p == step["j"], at(step["i"])).otherwise(x),
        )

    last = (n - 1).cast("int")
    steps = F.when(last > 0, F.transform(F.sequence(last, F.lit(1), F.lit(-1)), drawn)).otherwise(F.array())
    return F.aggregate(steps, F.sequence(F.lit(0), last), swapped)


def _buckets(placed: DataFrame, seed: int) -> DataFrame:
    """(bucket, start, places): first global place of each bucket and its permutation."""
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("block", F.expr(f"bucket div {_BLOCK}")), "buckets")

    def before(key: list[str], order: str) -> Column:
        window = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before([], "block").alias("first"))
    inner = counts.withColumn("inside", before(["block"], "bucket"))
    start = (F.col("first") + F.col("inside")).alias("start")
    tasks = math.ceil(counts.count() / _BUCKETS_PER_TASK)
    started = inner.join(blocks, "block").select("bucket", "n", start).repartition(max(1, tasks), "bucket")
    return stored(started.select("bucket", "start", _fisher_yates(F.col("bucket"), F.col("n"), seed).alias("places")), "places")


def shuffled(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(record, shard, slot): each row of `docs(doc_id, text, ...)` as a struct, at its place in its shard."""
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    rows, size = records.agg(F.count(F.lit(1)), F.sum(size_of(F.col("record.text")))).first()
    buckets = max(1, math.ceil(rows / bucket_rows), math.ceil((size or 0) / bucket_bytes))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "identity", F.col("copy").cast("string")))
    placed = _with_copy(records).select("record", draw.alias("draw"))
    placed = placed.withColumn("bucket", F.pmod(_number(F.col("draw"), 15), F.lit(buckets)).cast("long"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("draw")))
    put = ranked.join(_buckets(placed, seed), "bucket")
    place = F.col("start") + F.element_at("places", F.col("rank"))
    return put.select("record", place.alias("place")).select(
        "record",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **settings: int) -> DataFrame:
    """Write the shuffled rows under `path`, one folder per shard, and return what was written.

    Files hold their rows in the order of the slots.
    """
    rows = shuffled(docs, **settings)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.select("record", "slot", "shard").schema).parquet(path)


def shard_digest(docs: DataFrame) -> DataFrame:
    """Of the written shards: sizes, checksums of the texts, and places, under the law of equal row counts."""
    written = write_shards(docs, work_dir(docs.sparkSession, "shards"))
    return written.select(
        "record.doc_id",
        size_of(F.col("record.text")).alias("size"),
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
