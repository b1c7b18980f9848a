"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

Words are maximal runs of characters other than blanks and the controls 9 to 13, with A-Z
folded. A document's set holds its distinct runs of five words; with fewer words, the whole
sequence; without words it is empty and linked with nothing. Two documents link when
100 * |A and B| >= 75 * |A or B|.

1. All shingles are counted into a table of fixed size (sums of hash buckets). Ordering each
   set by that count puts common passages last. The order decides speed only: any order that
   all documents share gives the same links.
2. Each document keeps the first n - ceil(0.75 n) + 1 shingles. Two sets that link share one.
   Documents with the same prefix and size are one group and enter the index once.
3. Pairs of groups that share a token are filtered by size, by the places of the token, and by a
   sketch where a group has one set. What is left is expanded to the groups' members, filtered by their
   sketches, and verified. Tokens of few groups have all their pairs formed this way at once.
4. Star turns over the other tokens: every member is compared with a few hubs that share a
   frequent token, and what links is one component. A family of thousands of near copies needs a few
   comparisons per member instead of all pairs. Turns end when one joins few of the components left.
5. Then all remaining pairs of groups with members of different components go through step 3.

The sketch holds SKETCH_LONGS * 64 bits; each shingle of the set flips one. The bits in which two
sketches differ are never more than the shingles in which the sets do, so the test is exact: it drops no
link. It is part of the join condition, so near misses do not leave the join, and what is verified grows
with the links between components, not with the square of a family.

Every comparison is exact, on the two texts. Rows without doc_id are linked with nothing and get
a null component. Repeated rows give repeated result rows. Rows that share a doc_id but differ in their
sets are told apart: each has the component of its own text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.llm.components import components
from firelake.llm.shared import only_ids, stored
from firelake.llm.words import distinct_by_row, mix, pieces, shingles, words_of
from firelake.operators.skew import join_reduced

SHINGLE_WORDS = 5
THRESHOLD = 75
# Buckets of the shingle counts: 4 bytes each in every task, independent of the input.
COUNT_BITS = 20
_BLOCK = 1 << 14
_FAN_IN = 64
# Tokens of so many groups or fewer have all their pairs formed at once.
FEW_ROWS = 8
# Star turns go on while each leaves no more than this share of the components that were open before it.
SHRINKS = 0.9
# Members of a token that all its members are compared with in one star turn.
HUBS = 8
# Bits of a sketch, in words of 64.
SKETCH_LONGS = 8
_SKETCH = ", ".join(f"s{i} long" for i in range(SKETCH_LONGS))
SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
SET_SCHEMA = f"doc_id long, n long, f1 long, f2 long, p1 long, p2 long, prefix array<long>, {_SKETCH}"
_U = np.uint64

Batches = Iterator[pa.RecordBatch]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    words = words_of(batch.column(batch.schema.get_field_index(column)))
    row, values = shingles(words, batch.num_rows, k)
    return distinct_by_row(row, values, batch.num_rows)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> _U(64 - COUNT_BITS)).astype(np.int64)


def _count_task(k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                for values in _sets(piece, "text", k):
                    np.add.at(total, _bucket(values), 1)
        part = TaskContext.get().partitionId()
        blocks = total.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(used.astype(np.int32)),
                "part": pa.array(np.full(len(used), part, dtype=np.int64)),
                "counts": pa.array([blocks[i].tobytes() for i in used], pa.binary()),
            }
        )

    return run


def _add_blocks(table: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(c, dtype=np.int64) for c in table.column("counts").to_pylist())
    return table.slice(0, 1).set_column(2, "counts", pa.array([counts.tobytes()], pa.binary()))


def shingle_counts(docs: DataFrame, k: int = SHINGLE_WORDS) -> np.ndarray:
    """How many document sets hold a shingle of each bucket; all documents count.

    Every task sends one array of fixed size; arrays are added 64 at a time, so no group
    grows with the input.
    """
    tasks = docs.rdd.getNumPartitions()
    blocks = docs.select("text").mapInArrow(_count_task(k), "block int, part long, counts binary")
    while tasks > 1:
        blocks = (
            blocks.withColumn("part", F.expr(f"part div {_FAN_IN}"))
            .groupBy("block", "part")
            .applyInArrow(_add_blocks, "block int, part long, counts binary")
        )
        tasks = math.ceil(tasks / _FAN_IN)
    total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for block, _, counts in blocks.collect():
        total[block * _BLOCK : (block + 1) * _BLOCK] += np.frombuffer(counts, dtype=np.int64)
    return np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)


def _fingerprints(values: np.ndarray) -> tuple[int, int]:
    salts = (_U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3))
    return tuple(int(_signed(mix(values ^ s).sum(dtype=_U).reshape(1))[0]) for s in salts)


def _sketch(values: np.ndarray) -> np.ndarray:
    """Bit v is set when an odd number of values end in v."""
    odd = np.bincount((values & _U(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1 if n else 0


def _prefix_task(k: int, threshold: int, counts) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        order = counts.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                n, prints, prefixes, sketches = [], [], [], [np.zeros((0, SKETCH_LONGS), np.int64)]
                for values in _sets(piece, "text", k):
                    n.append(len(values))
                    p = prefix_length(len(values), threshold)
                    # Values ascend, so a stable sort by count settles ties by value.
                    kept = values[np.argsort(order[_bucket(values)], kind="stable")[:p]]
                    prints.append(_fingerprints(values) + _fingerprints(kept))
                    prefixes.append(_signed(kept))
                    sketches.append(_sketch(values)[None])
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                columns = [piece.column(piece.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n, pa.int64())]
                columns += [pa.array([p[i] for p in prints], pa.int64()) for i in range(4)]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                columns += [pa.array(np.ascontiguousarray(column)) for column in np.concatenate(sketches).T]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "p1", "p2", "prefix", *SKETCH])

    return run


def document_sets(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: size and fingerprints of the set, fingerprints of its prefix, and the prefix."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k))
    return docs.select("doc_id", "text").mapInArrow(_prefix_task(k, threshold, counts), SET_SCHEMA)


def _verify_task(k: int, threshold: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text_a"):
                linked = []
                for a, b in zip(_sets(piece, "text_a", k), _sets(piece, "text_b", k)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= threshold * (len(a) + len(b) - both))
                yield piece.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes whose texts link. Each row holds its two texts, so no pair waits for another."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify_task(k, threshold), "a long, b long").distinct()


def _can_link(a: str, b: str, threshold: int) -> Column:
    """Whether two sets, with their first common shingle at these places, can still link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (100 * rest >= threshold * (n + m - rest))


def _near(a: str, b: str, threshold: int) -> Column:
    """Whether the sketches allow a link; true where one is null."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH))
    return F.coalesce((100 + threshold) * (both - apart) >= 2 * threshold * both, F.lit(True))


class Index(NamedTuple):
    members: DataFrame  # one row per different set: group, node, doc_id, n, f1, f2, nodes of the group, sketch
    entries: DataFrame  # one row per group and prefix token: token, group, n, pos, rows of the token
    inside: DataFrame  # token, node, rows: members of one group meet under the fingerprint of their prefix


def _group() -> Column:
    return F.xxhash64("n", "p1", "p2")


def _index(sets: DataFrame, repeated: DataFrame | None) -> Index:
    """`repeated`: ids that name several rows; None if there are none.

    A node is named by the smallest doc_id that has its set, or by a hash where that id has several sets.
    """
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    sketch = [F.any_value(s).alias(s) for s in SKETCH]
    classes = usable.groupBy("n", "f1", "f2", "p1", "p2").agg(F.min("doc_id").alias("doc_id"), *sketch)
    classes = classes.withColumn("node", F.col("doc_id"))
    if repeated is not None:
        several = repeated.withColumn("several", F.lit(True))
        own = F.xxhash64("doc_id", "f1", "f2")
        classes = classes.join(several, "doc_id", "left").withColumn("node", F.when(F.col("several"), own).otherwise(F.col("doc_id")))
    classes = stored(classes.select("doc_id", "node", "n", "f1", "f2", "p1", "p2", *SKETCH), "classes")
    heads = classes.groupBy("n", "p1", "p2").agg(F.count(F.lit(1)).alias("nodes"))
    members = join_reduced(classes, heads, ["n", "p1", "p2"], "inner").withColumn("group", _group())
    members = stored(members.select("group", "node", "doc_id", "n", "f1", "f2", "nodes", "p1", *SKETCH), "members")

    # One entry per group and prefix shingle; tokens of a single group lead nowhere.
    groups = usable.groupBy("n", "p1", "p2").agg(F.any_value("prefix").alias("prefix"))
    entries = groups.select(_group().alias("group"), "n", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("rows > 1")
    inside = members.where("nodes > 1").select(F.col("p1").alias("token"), "node", F.col("nodes").alias("rows"))
    return Index(members, stored(entries.select("token", "group", "n", "pos", "rows"), "index"), inside)


def _expanded(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of different members of paired groups (ga, gb) that the sketches allow.

    With a column `comp` on the members, only members of different components are paired.
    """
    x, y = members.alias("x"), members.alias("y")
    apart = F.expr("x.comp <> y.comp") if "comp" in members.columns else F.lit(True)
    apart &= F.expr("x.node < y.node OR ga <> gb")
    half = pairs.join(x, F.expr("ga = x.group"))
    return _pairs(half.join(y, F.expr("gb = y.group") & apart & _near("x", "y", threshold)))


def _few_pairs(entries: DataFrame, threshold: int) -> DataFrame:
    """All pairs of groups that can link under tokens of few groups; no list is longer than FEW_ROWS."""
    entry = F.sort_array(F.collect_list(F.struct("group", "n", "pos")))
    listed = entries.where(F.col("rows") <= FEW_ROWS).groupBy("token").agg(entry.alias("entries"))
    firsts = listed.select("entries", F.posexplode("entries").alias("at", "x"))
    others = firsts.select("x", F.explode(F.slice("entries", F.col("at") + 2, F.lit(FEW_ROWS))).alias("y"))
    met = others.where(_can_link("x", "y", threshold))
    return met.select(F.col("x.group").alias("ga"), F.col("y.group").alias("gb")).distinct()


def _star_pairs(rows: DataFrame, members: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Every node, at one token of its own, against a few hubs of other components.

    In the first turn a node stands at its most frequent token, later at one that a hash draws; nodes
    of a family mostly stand together. A token's hubs are drawn one from each of so many shares of its
    nodes: HUBS in the first turn, four times as many in each later one, for the fewer nodes that are left.
    """
    rank = F.struct(F.col("rows") if turn == 0 else F.lit(0), F.xxhash64("token", F.lit(turn)))
    place = rows.groupBy("node").agg(F.max_by("token", rank).alias("token"))
    one = place.join(members.select("node", "n", "comp", *SKETCH), "node")
    one = stored(one.withColumn("draw", F.xxhash64("node", F.lit(turn))), "places")
    hubs = one.groupBy("token", F.pmod("draw", F.lit(HUBS * 4**turn)).alias("share"))
    hubs = hubs.agg(F.min(F.struct("draw", "node", "n", "comp", *SKETCH)).alias("x")).select("token", "x")
    met = join_reduced(one, hubs, ["token"], "inner").withColumn("y", F.struct("node", "n", "comp", *SKETCH))
    sizes = 100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    return _pairs(met.where((F.col("x.comp") != F.col("y.comp")) & sizes & _near("x", "y", threshold)))


def _across(entries: DataFrame, members: DataFrame, mains: DataFrame, threshold: int) -> DataFrame:
    """All pairs of members of different components that can still link.

    Groups are paired first: one of them with members outside its token's largest component. A group
    whose members are in several components has no `comp`; one with several members has no sketch. Two
    groups that met at the token before, in both their orders, are not paired again.
    """
    single = F.col("nodes") == 1
    of_group = members.groupBy("group").agg(
        F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("comp"),
        *[F.when(F.max("nodes") == 1, F.any_value(s)).alias(s) for s in SKETCH],
    )
    rows = join_reduced(entries, mains, ["token"], "inner").join(of_group, "group")
    rows = rows.withColumn("before", F.lag("token").over(Window.partitionBy("group").orderBy("pos", "token")))
    a, b = rows.where("NOT coalesce(comp = main, false)").alias("x"), rows.alias("y")
    apart = F.expr(
        "x.token = y.token AND x.group <> y.group AND NOT coalesce(x.comp = y.comp, false)"
        " AND (coalesce(y.comp = y.main, false) OR x.group < y.group) AND NOT coalesce(x.before = y.before, false)"
    )
    met = a.join(b, apart & _can_link("x", "y", threshold) & _near("x", "y", threshold))
    pairs = met.select(F.col("x.group").alias("ga"), F.col("y.group").alias("gb")).distinct()
    own = members.where(~single).select(F.col("group").alias("ga"), F.col("group").alias("gb")).distinct()
    return _expanded(pairs.union(own), members, threshold)


def _pairs(met: DataFrame) -> DataFrame:
    smaller, larger = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
    return met.select(smaller.alias("a"), larger.alias("b")).distinct()


def _open_tokens(rows: DataFrame) -> DataFrame:
    """(token, main): tokens that more than one component holds, with the largest."""
    sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    tokens = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("rows", "comp")).alias("main"))
    return stored(tokens.where("comps > 1").select("token", "main"), "tokens")


def _joined(named: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """(node, component) after the links (a, b) of `found`."""
    if found.isEmpty():
        return named
    if named is not None:
        found = found.union(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(found)


def _placed(nodes: DataFrame, named: DataFrame | None) -> DataFrame:
    if named is None:
        return nodes.withColumn("comp", F.col("node"))
    placed = nodes.join(named, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    return placed.drop("component")


def _linked_nodes(index: Index, texts: DataFrame, k: int, threshold: int) -> DataFrame | None:
    """(node, component) of the nodes that link with another one; None if none does."""

    def links(pairs: DataFrame) -> DataFrame:
        return stored(verified(pairs, texts, k, threshold), "verified")

    of_group = index.members.select("group", "node", "n", "nodes", *SKETCH)
    named = _joined(None, links(_expanded(_few_pairs(index.entries, threshold), of_group, threshold)))
    entries, inside = index.entries.where(F.col("rows") > FEW_ROWS), index.inside
    before, turn = 0, 0
    while True:
        members = _placed(of_group, named)
        rows = entries.select("token", "group", "rows").join(members.select("group", "node", "comp"), "group")
        rows = rows.select("token", "node", "comp", "rows")
        rows = stored(rows.union(_placed(inside, named).select(*rows.columns)), "placed")
        mains = _open_tokens(rows)
        if mains.isEmpty():
            return named
        # Components only grow, so a token with a single one is done with.
        entries = stored(entries.join(mains.select("token"), "token", "left_semi"), "open")
        inside = inside.join(mains.select("token"), "token", "left_semi")
        open_rows = stored(rows.join(mains.select("token"), "token", "left_semi"), "rows")
        left = open_rows.select("comp").distinct().count()
        if turn and left > SHRINKS * before:
            return _joined(named, links(_across(entries, members, mains, threshold)))
        named = _joined(named, links(_star_pairs(open_rows, members, turn, threshold)))
        before, turn = left, turn + 1


def _linked(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(doc_id, n, f1, f2, component, head) of each row.

    The component is the smallest doc_id reached, null without doc_id; `head` is true for rows of that id
    and of the first of its sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(document_sets(docs, k, threshold), "sets")
    counts = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = stored(counts.where("rows > 1").select("doc_id"), "repeated")
    repeated = None if repeated.isEmpty() else repeated
    index = _index(sets, repeated)
    wanted = index.entries.select("group").union(index.members.where("nodes > 1").select("group")).distinct()
    nodes = stored(index.members.join(wanted, "group", "left_semi").select("doc_id", "node", "f1", "f2"), "nodes")
    named = _linked_nodes(index, _texts(docs, nodes, repeated, k), k, threshold)
    own = F.struct("doc_id", "f1", "f2")
    placed = _placed(index.members.select("node", "doc_id", "n", "f1", "f2"), named)
    heads = placed.groupBy("comp").agg(F.min(own).alias("first"))
    places = join_reduced(placed, heads, ["comp"], "inner").select("n", "f1", "f2", "first")
    # One row per set on the right; a set that a third of the rows share is split on the left.
    rows = join_reduced(sets.select("doc_id", "n", "f1", "f2"), places, ["n", "f1", "f2"], "left")
    first = F.coalesce("first", own)
    rows = rows.select("doc_id", "n", "f1", "f2", first["doc_id"].alias("component"), (first == own).alias("head"))
    return rows.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))


def _print_task(k: int) -> Callable[[Batches], Batches]:
    """Adds n, f1 and f2 of the column `text` to the record of each row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [(len(values), *_fingerprints(values)) for values in _sets(piece, "text", k)]
                added = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
                columns = [piece.column(i) for i in range(piece.num_columns)]
                yield pa.RecordBatch.from_arrays(columns + added, names=[*piece.schema.names, "n", "f1", "f2"])

    return run


def _texts(docs: DataFrame, nodes: DataFrame, repeated: DataFrame | None, k: int) -> DataFrame:
    """(node, text) of the nodes; a doc_id that names several rows has its texts told apart by their fingerprints."""
    found = only_ids(docs, nodes.select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    if repeated is None:
        return stored(found.withColumnRenamed("doc_id", "node"), "texts")
    found = stored(found, "texts")
    once = found.join(repeated, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "text")
    again = found.join(repeated, "doc_id", "left_semi")
    again = again.mapInArrow(_print_task(k), "doc_id long, text string, n long, f1 long, f2 long")
    again = again.join(nodes, ["doc_id", "f1", "f2"]).dropDuplicates(["node"]).select("node", "text")
    return stored(once.union(again), "texts")


def link_components(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs(doc_id, text)`."""
    rows = _linked(docs, k, threshold)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without those that link, over any number of links, to one named before them.

    Rows without doc_id stay. Of rows equal in doc_id and set one stays; rows that share a doc_id with
    different sets are judged each by its own.
    """
    found = stored(_linked(docs, k, threshold).where("doc_id IS NOT NULL"), "components")
    repeated = stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    dropped = found.where("NOT head").select("doc_id").distinct()
    if repeated.isEmpty():
        return only_ids(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
    rest = only_ids(docs, repeated, "doc_id", "left_anti")
    kept = only_ids(rest, dropped, "doc_id", "left_anti").select(*docs.columns)
    # The whole rows are one struct, whatever their columns are called.
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = only_ids(docs, repeated, "doc_id").select(record.alias("record"))
    again = again.select(F.col("record.doc_id").cast("long").alias("id"), F.col("record.text").cast("string").alias("text"), "record")
    schema = T.StructType([*again.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")]])
    printed = again.mapInArrow(_print_task(k), schema)
    judged = found.where("head").select(F.col("doc_id").alias("id"), "n", "f1", "f2").distinct()
    once = join_reduced(printed, judged, ["id", "n", "f1", "f2"], "left_semi").dropDuplicates(["id", "n", "f1", "f2"])
    return kept.union(once.select("record.*"))
