"""Shards, hard negatives and spelling variants against brute force and odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from firelake.llm import decontaminate, jaccard, language, mixing, negatives, pii, sharding, spelling, urls

DOCS = "doc_id long, text string, shard string, slot long, record string"


# Shards ------------------------------------------------------------------------------------------------


def _shards(docs, **settings):
    rows = sharding.shuffled(docs, **settings).collect()
    places = sorted(r.slot * settings.get("shards", 8) + r.shard for r in rows)
    assert places == list(range(len(rows)))
    return rows


def test_shards_of_odd_rows(spark):
    odd = [(1, None, "x", 1, None), (2, "", None, None, "r"), (None, "a", "s", 2, ""), (None, None, None, 0, None)]
    odd += [(4, "é" * 200_000, "long", 9, "t"), (5, "same", "a", 1, "b"), (5, "same", "a", 1, "b"), (5, "same", "c", 2, "d")]
    docs = spark.createDataFrame(odd, DOCS).repartition(3)
    rows = _shards(docs, shards=3)
    # Whole records with all their columns, whatever their names.
    assert Counter(tuple(r.record) for r in rows) == Counter(odd)
    digest = {r.doc_id: r for r in sharding.shard_digest(docs).collect()}
    assert (digest[1].size, digest[1].text_crc32, digest[2].size, digest[2].text_crc32) == (1, 0, 1, 0)
    assert digest[4].size == 400_001 and digest[4].text_crc32 == zlib.crc32(("é" * 200_000).encode())
    assert sharding.shuffled(spark.createDataFrame([], DOCS)).collect() == []
    assert sharding.shard_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.range(700).selectExpr("id AS doc_id", "repeat('t', CAST(id % 90 AS INT)) AS text")
    one = {(r.record.doc_id, r.shard, r.slot) for r in _shards(docs.repartition(1), bucket_rows=50)}
    two = {(r.record.doc_id, r.shard, r.slot) for r in _shards(docs.repartition(7), bucket_rows=50)}
    assert one == two
    assert one != {(r.record.doc_id, r.shard, r.slot) for r in _shards(docs, bucket_rows=50, seed=1)}


def test_a_third_of_all_rows_alike_is_scattered(spark):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id) AS doc_id", "IF(id % 3 = 0, 'same', 'x') AS text").repartition(5)
    records = docs.selectExpr("struct(*) AS record")
    copies = sharding._with_copy(records).where("record.doc_id = 0").collect()
    assert sorted(r.copy for r in copies) == list(range(1000))
    rows = _shards(docs, bucket_rows=100)
    place = np.array(sorted(r.slot * 8 + r.shard for r in rows if r.record.doc_id == 0))
    # Uniform: no tenth of the order holds far more than its share.
    assert np.histogram(place, bins=10, range=(0, 3000))[0].max() < 150


def test_fisher_yates_is_uniform(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(sharding._fisher_yates(F.col("id"), F.lit(3), 5).alias("p")).collect()
    seen = Counter(tuple(r.p) for r in rows)
    assert len(seen) == 6 and max(abs(n - 1000) for n in seen.values()) < 150
    one = spark.range(1).select(sharding._fisher_yates(F.col("id"), F.lit(1), 5).alias("p")).first()
    assert one.p == [0]


def test_shard_files_hold_their_slots_in_order(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "'t' AS text")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=2, bucket_rows=64)
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)


# Hard negatives ----------------------------------------------------------------------------------------

VECTORS = "vec_id long, label long, vector array<long>"


def _mined(rows, anchors, positives=5, keep=10, low=30, high=90):
    rows = [r for r in rows if None not in r and None not in r[2]]
    out = []
    for a in {(i, y, tuple(v)) for i, y, v in anchors if i is not None and y is not None and v is not None and None not in v}:
        scored = sorted((-sum(p * q for p, q in zip(a[2], v)), i, y) for i, y, v in rows if i != a[0])
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            inside = [x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:keep]
            out += [(a[0], i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(inside, 1)]
    return Counter(out)


def _got(spark, rows, anchors, **settings):
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = negatives.hard_negatives(vectors, spark.createDataFrame(anchors, VECTORS), **settings)
    return Counter(tuple(r) for r in found.collect())


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "_ROWS", 16)
    monkeypatch.setattr(negatives, "_ANCHORS", 3)
    rng = np.random.default_rng(1)
    # Few distinct scores, so ties are common; several windows overlap.
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in rng.integers(-1, 4, 6)]) for i in range(300)]
    assert _got(spark, rows, rows[::20]) == _mined(rows, rows[::20])
    wide = [(i, y, [9 * x for x in v]) for i, y, v in rows]
    assert _got(spark, wide, wide[::30], positives=2, negatives=3, low=10, high=100) == _mined(wide, wide[::30], 2, 3, 10, 100)
    # Anchors in several chunks.
    monkeypatch.setattr(negatives, "MAX_VALUES", 40)
    assert _got(spark, rows, rows[::20]) == _mined(rows, rows[::20])


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4, 5]), (2, 1, []), (3, 2, [2, 1]), (3, 2, [2, 1]), (4, None, [9, 9]), (None, 2, [2, 2])]
    rows += [(5, 2, None), (6, 2, [1, None]), (7, 3, [1, 1, 9])]
    assert _got(spark, rows, rows) == _mined(rows, rows)
    assert _got(spark, rows, []) == Counter() == _got(spark, [], [])
    # A vector alone, and all rows of one label.
    assert _got(spark, [(0, 1, [1])], [(0, 1, [1])]) == Counter()
    assert _got(spark, [(i, 1, [i]) for i in range(9)], [(0, 1, [5])]) == Counter()


def test_large_scores_are_exact():
    a, b = np.array([[2**30, 1]]), np.array([[2**26, 1], [2**20, 3]])
    assert negatives.products(a, b).tolist() == [[2**56 + 1, 2**50 + 3]]
    huge = np.array([[2**60, 2**60]])
    assert negatives.products(huge, huge).tolist() == [[negatives._LIMIT]] and negatives.products(huge, -huge)[0, 0] == -negatives._LIMIT


def test_scaled_vectors(spark):
    rows = [(1, 1, [0.1, -0.1]), (2, 1, [float("nan")]), (3, 1, [float("inf")]), (4, None, [1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.vector for r in negatives.scaled(frame, "embedding", 256).collect()}
    assert got == {1: [25, -26], 7: []}


# Spelling variants -------------------------------------------------------------------------------------


def _words(docs, strewn=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % strewn == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def _is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [v for v in counts if _is_near(v, w)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def _found(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def test_word_counts_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["Abcdefgh", "Étérévolution", "naïveté", "straßenbahn", "x" * 90, "short", "1", "-", "Ābcdefghi", "×÷abcdefg", "\U0001f600", "ABCDEFGI"]
    docs = [(i, " ".join(rng.choice(parts) + rng.choice(["", "s", "ÿ"]) for _ in range(30))) for i in range(80)]
    docs += [(None, "abcdefghij abcdefghij"), (7, None), (8, ""), (9, "z" * 70_000), (9, "z" * 70_000), (3, "abcdefgh" * 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.word: r.n for r in spelling.word_counts(frame, strewn=31).collect()}
    assert got == _words(docs)


@pytest.mark.parametrize("shared", [1, 3, 32])
def test_variants_against_brute_force(spark, shared):
    """Words full of repeats and common halves, so that chunks are hot at every depth."""
    rng = random.Random(shared)
    counts = {}
    for _ in range(700):
        word = "".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 8, 9, 10])))
        counts[word] = rng.choice([2, 3, 5, 30, 400, 9000])
    for _ in range(200):
        counts["common" + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 6)))] = rng.randrange(2, 3000)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert _found(spelling.spelling_variants(words, shared=shared)) == _variants(counts)


def test_chunk_groups_stay_small(spark):
    """Words with one common half meet few others, yet every near pair is found."""
    words = {f"unbeliev{x}{y}{z}" for x in "abcdefghij" for y in "abcdefghij" for z in "abcdefghij"}
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = spelling.near_pairs(rows).collect()
    assert len(pairs) == 1000 * 27 // 2 and all(_is_near(p.a, p.b) for p in pairs)


def test_variants_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string, n long")
    assert spelling.spelling_variants(spelling.word_counts(empty, strewn=31)).collect() == []
    # Forms lead to forms: the root is the last.
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 1, "q" * 70_000: 3, "q" * 70_001: 40}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = _found(spelling.spelling_variants(words))
    assert found["aaaaaaa"] == ("aaaaaab", "aaaabbb", 2, 1, 20) and found["zzzzzzz"] == (None, "zzzzzzz", 1, 0, None)
    assert found["q" * 70_000][0] == "q" * 70_001


# Near copies -------------------------------------------------------------------------------------------


def _variants_of_one_text(n):
    """Copies of one text of forty words with one word replaced each: they link to the text, mostly not to each other."""
    base = [f"w{i}" for i in range(40)]
    return [" ".join(base)] + [" ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]]) for i in range(n)]


def _links(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(texts))]


def test_verified_pairs_grow_with_the_family(spark, monkeypatch):
    verify, counts = jaccard.verified, []

    def counted(pairs, *rest):
        pairs = jaccard.stored(pairs, "counted")
        counts[-1] += pairs.count()
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    for n in (200, 800):
        counts.append(0)
        texts = _variants_of_one_text(n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in jaccard.link_components(docs).collect()}
        assert [got[i] for i in range(len(texts))] == _links(texts)
        # About 600 and 8,400 pairs link, of 20,100 and 320,400.
        assert counts[-1] <= 8 * n, counts


def test_rows_of_one_doc_id_are_told_apart(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    near = one.replace("a29", "zz")
    rows = [(1, one, 1), (1, two, 2), (2, near, 3), (3, two, 4), (3, two, 4), (4, "alone here", 5), (4, "", 6), (None, one, 7), (None, one, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect())
    assert got == Counter(
        {(1, 26, 1): 2, (2, 26, 1): 1, (3, 26, 1): 2, (4, 1, 4): 1, (4, 0, 4): 1, (None, 26, None): 2}
    )
    kept = Counter(tuple(r) for r in jaccard.keep_one_of_each(docs).collect())
    assert kept == Counter([r for r in rows if r[2] in (1, 2, 5, 6, 7, 8)])


def test_sketches_drop_no_link(spark):
    rng = np.random.default_rng(0)
    for n in (10, 100, 2000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 8], rng.integers(0, 2**63, n // 8, dtype=np.uint64)]))
        apart = sum(int(x).bit_count() for x in (jaccard._sketch(a) ^ jaccard._sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


# Whole texts, whatever their length and script -----------------------------------------------------------


def test_phrases_go_on_from_piece_to_piece():
    rng = random.Random(4)
    texts = {name: bytes(rng.choice(letters) for _ in range(500)) for name, letters in (("x", b"ab "), ("y", b"abc "), ("z", b"abab"))}
    model = language.Languages(texts)

    def count(known, text):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in known:
                size += 1
            n, at = n + 1, at + size
        return n

    for piece in (1, 3, 16, 64):
        # Stretches of the labelled text itself make phrases that are longer than a piece.
        whole = [texts["y"][40:260], bytes(rng.choice(b"abcd ") for _ in range(300)), texts["x"][:90] + texts["z"][3:200], b"a"]
        raw = np.frombuffer(b"".join(whole), dtype=np.uint8)
        sizes = np.array([len(t) for t in whole])
        begin = np.cumsum(sizes) - sizes
        start = np.concatenate([np.arange(b, b + n, piece) for b, n in zip(begin, sizes)])
        row = np.repeat(np.arange(len(whole)), -(-sizes // piece))
        size = np.minimum(piece, (begin + sizes)[row] - start)
        got = model.phrases(raw, start, size, np.append(False, row[1:] == row[:-1]))
        total = [np.bincount(row, c).astype(int).tolist() for c in got]
        assert total == [[count(texts[name], t) for t in whole] for name in "xyz"], piece


def test_a_text_of_marks_has_no_language(spark):
    docs = spark.createDataFrame([(1, "́̂ ̈"), (2, "12 !"), (3, "été")], "doc_id long, text string")
    train = spark.createDataFrame([(9, "eau ete etre", "fr"), (8, "und der die", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, train).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] != "und"


def test_short_items_and_typographic_marks(spark):
    docs = [
        (1, "please name the largest ocean now thanks"), (2, "“what is the capital of france”—he asked"),
        (3, "WAS IST DIE GRÖSSTE STADT ÖSTERREICHS…"), (4, "the largest"), (5, "an ocean"), (6, "yes"), (7, "yes or no"), (8, None), (9, ""),
    ]
    items = [
        (1, "Name the largest ocean"), (2, "What is the capital of France?"), (3, "Was ist die grösste Stadt Österreichs?"),
        (4, "Yes."), (5, None), (6, "name the smallest ocean"), (6, "capital of france"), (6, "capital of france"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 2), (2, 6), (3, 3), (6, 4)} and len(found) == 5


def test_contamination_against_greedy_tiling(spark):
    """Every document and item, tiled without seeds, joins or hashes."""
    rng = random.Random(11)
    items = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(4)) for _ in range(rng.randrange(3, 25))] for _ in range(25)]
    docs = []
    for _ in range(60):
        item, words = rng.choice(items), [f"x{rng.randrange(99)}" for _ in range(rng.randrange(0, 30))]
        cut = rng.randrange(len(item) + 1)
        parts = [item[cut:], words, item[:cut]]
        rng.shuffle(parts)
        docs.append([w for part in parts for w in part])

    def covered(doc, item, least):
        doc, free, n = list(doc), [True] * len(item), 0
        while True:
            best = (least - 1, None, None)
            for d in range(len(doc)):
                for i in range(len(item)):
                    m = 0
                    while d + m < len(doc) and i + m < len(item) and free[i + m] and doc[d + m] == item[i + m]:
                        m += 1
                    if m > best[0]:
                        best = (m, d, i)
            m, d, i = best
            if d is None:
                return n
            doc[d : d + m], free[i : i + m], n = [None] * m, [False] * m, n + m

    wanted = {
        (d, i) for d, doc in enumerate(docs) for i, item in enumerate(items)
        if 2 * covered(doc, item, min(5, len(item))) >= len(item)
    }
    got = decontaminate.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, ", ".join(d)) for i, d in enumerate(items)], "item_id long, text string"),
    )
    assert {(r.doc_id, r.item_id) for r in got.collect()} == wanted


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "s", i, f"k{i}", 0.5, "r") for i in range(50)], "doc_id long, source string, steps long, _source_key string, draw double, record string")
    rows = mixing.replicate(docs.withColumn("_u", F.lit(7)), {"s": 1.0}, total=200).collect()
    assert {(r.doc_id, r.steps, r._source_key, r.draw, r.record, r._u) for r in rows} <= {(i, i, f"k{i}", 0.5, "r", 7) for i in range(50)}
    assert len(rows) > 100


def test_messages_settle_on_loops_that_swing():
    names = {"any": 0}
    pair = np.zeros((2, pii.OUTSIDE + 1, pii.OUTSIDE + 1))
    # Neighbours must differ strongly: on odd loops no assignment does.
    pair[0] = pair[1] = -9.0 * np.eye(pii.OUTSIDE + 1)
    field = pii.Field(names, np.zeros((1, pii.OUTSIDE + 1)), pair)
    text = " ".join(["5550107777", "x1", "5550107777"] * 4 + ["+1 555-010-7777"])
    tokens = pii.open_tokens(text)
    belief = field.beliefs(tokens, pii.token_labels(tokens, pii.base_spans(text)))
    assert np.isfinite(belief).all() and np.allclose(belief.sum(axis=1), 1)


def test_training_sees_the_ends_of_long_texts(spark):
    text = " ".join(f"word {i}" for i in range(400)) + " call +1 (555) 010-1234 now"
    docs = spark.createDataFrame([(i, f"{i} {text} {i}") for i in range(60)], "doc_id long, text string")
    rows = docs.select("text").mapInArrow(pii._sample_task, "tokens array<struct<start: int, end: int, text: string, label: int>>").collect()
    assert {len(r.tokens) for r in rows} == {pii.TOKENS_PER_DOC}
    assert len({r.tokens[0].start > 4000 for r in rows}) == 2 or max(r.tokens[-1].end for r in rows) > 3000


# URLs --------------------------------------------------------------------------------------------------


def test_urls_of_any_shape(spark):
    rows = [
        (1, None), (2, ""), (3, "example.net/en/x"), (4, "HTTP://WWW.Example.NET/en/x?q#f"), (5, "http://example.net/EN/"),
        (6, "https://a.b.org/fr/" + "y" * 70_000), (7, "ftp://org#x"), (8, "http://"), (9, "http://example.com/de/"),
        (9, "http://example.com/de/"), (None, "http://sub.example.com/de"), (10, "http://a://b.net/c"), (11, "http://élan.net/é\U0001f600\n/x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("taken")).repartition(3)
    got = Counter((r.page_id, r.host, r.path[:12], r.rule, r.verdict) for r in urls.judge_urls(pages).collect())
    assert got == Counter([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "www.example.net", "/en/x", "example.net/en/", "allow"), (5, "example.net", "/EN/", "net/", "block"),
        (6, "a.b.org", "/fr/" + "y" * 8, "org/fr/", "allow"), (7, "org", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "example.com", "/de/", "example.com/de/", "block"), (9, "example.com", "/de/", "example.com/de/", "block"),
        (None, "sub.example.com", "/de", None, "allow"), (10, "a:", "//b.net/c", None, "allow"),
        (11, "élan.net", "/é\U0001f600\n/x", "net/", "block"),
    ])
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_hundreds_of_rules_against_plain_matching(spark):
    rng = random.Random(8)
    hosts = [f"{a}{b}.{t}" for a in "abc" for b in range(20) for t in ("net", "org", "com")]
    rules = [urls.SiteRule(rng.choice(["block", "allow"]), h, rng.choice(["/", "/x/", "/x/y/"])) for h in rng.sample(hosts, 120)]
    globs = [f"*{rng.choice('abc')}{rng.randrange(20)}*#*{w}*" for w in ("ad", "track", "q9")] * 30 + [f"*{i}z#*" for i in range(200)]
    pages = [(i, f"http://{rng.choice(['', 'www.', 'x.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/x/', '/x/y/z', '/ad', '/track/q9'])}") for i in range(400)]

    def judged(url):
        host, _, path = url[7:].partition("/")
        path = "/" + path if "/" in url[7:] else ""
        fits = [r for r in rules if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: len(r.name))
            return best.name, best.verdict
        bad = any(re.fullmatch(re.escape(g).replace(r"\*", ".*"), f".{host}#{path}", re.S) for g in globs)
        return None, "block" if bad else "allow"

    frame = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(frame, rules, globs).collect()}
    assert got == {i: judged(u) for i, u in pages}
