"""The text operators against brute force, SQL, and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect

from firelake.llm import decontaminate, jaccard, language, licenses, lm_score, mixing, pii, quality, toxicity, urls
from firelake.llm.components import components
from firelake.llm.queries import queries
from firelake.llm.words import shingles, words_of

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, a long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", None, 0, None, None),
    (3, " \t\n ", "en", "s", 3, None, 2),
    (4, "one", None, "s", 3, "y", 3),
    (5, LONG, "en", "s", len(LONG), None, None),
    (5, LONG, "en", "s", len(LONG), None, None),
    (None, "a text without id, said you idiot a@b.co 1.2.3.4", "de", "s", None, None, None),
    (7, "Ünï çödé \U0001f600 !! <<>>", "fr", "t", 20, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, None), (5, 1, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, LONG[:400])], "item_id long, text string")


def runs(labels, benchmark):
    """name -> (job, rows per input row or None)."""
    return {
        "decontaminate": (lambda d: decontaminate.contaminated(d, benchmark), None),
        "decontaminated": (lambda d: decontaminate.without_contaminated(d, benchmark), None),
        "language": (lambda d: language.identify(d, d), 1),
        "licenses": (licenses.scan_licenses, None),
        "quality": (quality.quality, 1),
        "mixing": (mixing.replicate, None),
        "lm": (lambda d: lm_score.cross_entropy_difference(d, labels.where("quality = 1")), 1),
        "pii": (pii.find_pii, 1),
        "without_pii": (pii.without_pii, 1),
        "jaccard": (jaccard.link_components, 1),
        "one_of_each": (jaccard.keep_one_of_each, None),
        "toxicity": (lambda d: toxicity.toxicity(d, labels), 1),
        "without_toxic": (lambda d: toxicity.without_toxic(d, labels), None),
    }


@pytest.mark.parametrize("name", list(runs(None, None)))
def test_odd_and_empty_tables(odd, empty, labels, benchmark, name):
    job, each = runs(labels, benchmark)[name]
    rows = job(odd).collect()
    if each:
        assert len(rows) == len(ODD)
    assert job(empty).collect() == []


def test_results_of_odd_rows(odd, labels, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, benchmark).collect()}
    assert found == {(4, 3), (5, 4)}
    assert {r.lang_pred for r in language.identify(odd, odd).where("doc_id <= 3").collect()} == {"und"}
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(odd).collect()}
    assert linked[1] == (0, 1) and linked[4] == (1, 4) and linked[None][1] is None
    assert [r.doc_id for r in jaccard.keep_one_of_each(odd).collect()].count(5) == 1
    spans = {r.doc_id: r for r in pii.find_pii(odd).collect()}
    assert (spans[None].n_email, spans[None].n_ip, spans[1].spans) == (1, 1, "")
    assert not any(r.kept for r in quality.quality(odd).where("doc_id <= 4").collect())
    clean = {r.doc_id: r.text for r in pii.without_pii(odd).collect()}
    assert clean[None].endswith("<EMAIL> <IP>") and clean[1] is None


@pytest.mark.parametrize("name", sorted(n for n, q in queries().items() if q.sql))
def test_query_with_sql(spark, name):
    query = queries()[name]
    assert compare(query.run(spark, SF_DIR), connect(SF_DIR), query.sql) == ""


def test_words_and_shingles():
    texts = ["The cat  sat\ton the mat", None, "", "THE Cat sat on the mat", "cat", "é É"]
    words = words_of(pa.array(texts))
    own = [words.hash[words.row == i].tolist() for i in range(len(texts))]
    assert [len(x) for x in own] == [6, 0, 0, 6, 1, 2] and own[0] == own[3] and own[5][0] != own[5][1]
    assert own[0][1] == own[4][0]
    row, values = shingles(words, len(texts), 5)
    assert Counter(row.tolist()) == {0: 2, 3: 2, 4: 1, 5: 1} and values[0] == values[2]


def _sets(text):
    w = re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components_against_all_pairs(spark):
    """Families of near copies around the threshold, sharing passages, besides loose texts."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(60)] + passage
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + texts[:5]
    sets, top = [_sets(t) for t in texts], list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def _greedy(doc, item, least):
    """Greedy string tiling without hashes: total tile length."""
    free_d, free_i, total = [x != 0 for x in doc], [True] * len(item), 0
    while True:
        best = []
        size = least - 1
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n > size:
                    size, best = n, [(d, i)]
                elif n == size and n >= least:
                    best.append((d, i))
        if size < least:
            return total
        for d, i in best:
            if all(free_d[d : d + size]) and all(free_i[i : i + size]):
                free_d[d : d + size] = free_i[i : i + size] = [False] * size
                total += size


def test_components_plan_each_star_by_itself(spark, monkeypatch):
    import firelake.llm.components as module

    plans, store = [], module.stored

    def stored(frame, purpose):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return store(frame, purpose)

    monkeypatch.setattr(module, "stored", stored)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == dict.fromkeys(range(21), 0) | {50: 50, 51: 50}
    # One grouping, the two sides of one join and the distinct rows; a star inside another's plan makes more.
    assert max(plan.count("Exchange hashpartitioning") for plan in plans) <= 4


def test_tiles_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(1, 9, rng.integers(5, 40)).astype(np.uint64)
        doc = np.concatenate([item[10:], rng.integers(0, 9, 20), item[:12]]).astype(np.uint64)
        found = decontaminate.tiles(doc, item, 5)
        assert all((doc[d : d + n] == item[i : i + n]).all() for d, i, n in found)
        places = [p for _, i, n in found for p in range(i, i + n)]
        assert len(places) == len(set(places))
        assert abs(sum(n for *_, n in found) - _greedy(doc.tolist(), item.tolist(), 5)) <= 5


def test_reordered_passages_are_found(spark):
    words = [f"b{i}" for i in range(60)]
    moved = " ".join(words[40:60] + ["x", "y"] + words[0:20] + ["z"] + words[20:40])
    docs = spark.createDataFrame([(1, "A b. " + moved.upper()), (2, " ".join(words[:20])), (3, "c " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(9, ", ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.n_tiles, r.n_matched) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 3, 60)]


def test_phrases_against_brute_force():
    rng = random.Random(1)
    texts = {name: bytes(rng.choice(letters) for _ in range(300)) for name, letters in (("x", b"abc "), ("y", b"bcd "))}
    model = language.Languages(texts)
    stretches = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (1, 2, 17, 200)]

    def count(known, text):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in known:
                size += 1
            n, at = n + 1, at + size
        return n

    raw = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    sizes = np.array([len(s) for s in stretches])
    got = model.phrases(raw, np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [[count(texts[name], s) for s in stretches] for name in ("x", "y")]


def test_held_out_language_accuracy(spark):
    rows = queries()["op2_language_id"].run(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = rows.join(docs, "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()


def test_band_settings_keep_their_promise():
    for similarity in (0.1, 0.3, 0.6, 0.9):
        bands, rows = licenses.band_settings(similarity)
        assert 1 - (1 - similarity**rows) ** bands >= licenses.COLLISION


def test_mixing_follows_the_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'a' WHEN id % 10 = 1 THEN NULL ELSE 'b' END AS source")
    rows = mixing.replicate(docs, {"a": 0.6, None: 0.3, "gone": 5.0}, total=9000)
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    assert set(counts) == {"a", None} and abs(counts["a"] - 6000 / 5.9 * 9000 / 6000 * 0.6) < 1e9
    shares = mixing.replicate(docs, {"a": 0.6, None: 0.3}, total=9000).groupBy("source").count().collect()
    got = {r.source: r["count"] for r in shares}
    # Poisson counts: within five standard deviations of 6000 and 3000.
    assert abs(got["a"] - 6000) < 5 * math.sqrt(6000) and abs(got[None] - 3000) < 5 * math.sqrt(3000)


def test_globs_against_patterns():
    globs = ["*.net#/*", "a*b*c", "*x*", "", "abc", "*", "*" + "q" * 70 + "*"]
    automaton = urls.Automaton(globs)
    texts = ["", "abc", ".b.net#/en", "axbxc", "ab", "c" * 90, "q" * 75 + "é", "aébcc"]
    wanted = [[bool(re.fullmatch(re.escape(g).replace(r"\*", ".*"), t, re.S)) for g in globs] for t in texts]
    assert automaton.matches(texts).tolist() == wanted


def _base(text):
    def luhn(digits):
        return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1]))) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    parts = ["a", "B.", "@", "b.co", "1", "23.", "4.5.6.7", "255.1.2.3", "4111 1111 1111 1111", "-", " ", "+1 (555) 010-2030", "\n", "é", "%", "999.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [tuple(s) for s in pii.base_spans(text)] == _base(text), text


def test_field_adds_a_second_mention(spark):
    filler = "lorem ipsum dolor sit amet 7 times or 2024 "
    train = [(i, f"{filler}call +1 (555) 010-{1000 + i} now, mail u{i}@site.org at 10.0.0.{i % 200} {filler}") for i in range(300)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    field = pii.train(docs)
    text = f"{filler}reach +1 (555) 010-7777 today. {filler}or again (555) 010-7777 tonight {filler}"
    base, spans = pii.all_spans(text, field)
    assert set(base) <= set(spans)
    assert pii.all_spans(filler * 3, field)[1] == []
    rows = {r.doc_id: r for r in queries()["op8_pii_spans"].run(spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in _base(r.text or ""))
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_grammar():
    scorer = toxicity.Scorer({"idiot": 3.0})
    plain = scorer.weight("what an idiot")
    assert plain == 3.0 and scorer.weight("the weather is fine") == 0.0
    assert scorer.weight("you idiot") > plain > scorer.weight("he is not an idiot")
    assert scorer.weight("she said idiot") < plain
    assert scorer.weight("I will kill you") > 0 == scorer.weight("they kill time")
    assert scorer.weight("no. idiot") == plain


def test_lm_scores_against_plain_counts(spark):
    texts = [(1, "a b c a b"), (2, "a b d"), (3, "x y x y z"), (4, "x y a b"), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    good = spark.createDataFrame([(1,), (2,)], "doc_id long")
    words = {i: t.split() for i, t in texts}

    def loss(i, model):
        own = Counter(), Counter()
        for j, w in words.items():
            if (j in (1, 2)) == model:
                own[0].update(w)
                own[1].update(zip(w, w[1:]))
        held, total, bits = int((i in (1, 2)) == model), sum(own[0].values()), 0.0
        for at, w in enumerate(words[i]):
            p = 0.44 * max(0, own[0][w] - held) / max(1, total - held) + 0.01 / 2**lm_score.WORD_BITS
            if at:
                before = max(0, own[0][words[i][at - 1]] - held)
                p += 0.55 * min(1.0, max(0, own[1][words[i][at - 1], w] - held) / max(1, before))
            bits -= math.log2(p)
        return bits / len(words[i])

    for r in lm_score.cross_entropy_difference(docs, good).collect():
        if r.n_words:
            assert r.target_loss == pytest.approx(loss(r.doc_id, True)) and r.background_loss == pytest.approx(loss(r.doc_id, False))
        else:
            assert r.score == 0.0 and r.target_loss is None


def test_lm_counts_each_pair_by_itself(spark, monkeypatch):
    # More distinct words and pairs than a table of 2 ** 18 words and 2 ** 21 pairs keeps apart, in many blocks.
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2_000_000)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 400_000, 20_000)) for _ in range(60)]
    texts += ["alpha beta gamma", "alpha beta delta", "unseen words only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in [*range(0, 60, 2), 60, 61]], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, good).collect()}
    assert len(got) == len(texts)
    total = 30 * 20_000
    floor = 0.01 / 2**lm_score.WORD_BITS
    # Each word of the last text occurs nowhere else: nothing but the floor in both models.
    assert got[62].background_loss == pytest.approx(-math.log2(floor)) and got[62].target_loss == pytest.approx(-math.log2(floor))
    one = 0.44 / (total + 5) + floor
    wanted = -(math.log2(one) + math.log2(one + 0.55) + math.log2(floor)) / 3
    assert got[60].target_loss == pytest.approx(wanted) and got[60].score == pytest.approx(-math.log2(floor) - wanted)


def _field():
    filler = "lorem ipsum dolor sit amet 7 times or 2024 "
    calls = [f"call +1 555-010-{1000 + i} now, mail u{i}@site.org at 10.0.0.{i % 200}" for i in range(300)]
    texts = [f"{filler}{call} {filler}or {call if i % 2 else ''} {filler}" for i, call in enumerate(calls)]
    sample = []
    for text in texts:
        tokens = pii.open_tokens(text)
        sample.append([(*t, int(y)) for t, y in zip(tokens, pii.token_labels(tokens, pii.base_spans(text)))])
    return pii.fit(sample)


@pytest.mark.parametrize("between", ["words and more words", "lorem 7 times or 2024"])
def test_field_ties_mentions_apart(between):
    text = f"call +1 555-010-7777 now {between} again 555-010-7777 tonight"
    tokens = pii.open_tokens(text)
    mentions = [i for i, t in enumerate(tokens) if t.text == "555-010-7777"]
    pairs, kinds = pii.edges(tokens)
    assert (tuple(mentions), 1) in [(tuple(p), k) for p, k in zip(pairs.tolist(), kinds)]
    base, spans = pii.all_spans(text, _field())
    at = text.rindex("555-010-7777")
    assert (at, pii.KINDS.index("phone"), at + 12) in {tuple(s) for s in spans} - {tuple(s) for s in base}
    tokens = pii.open_tokens("call 555-010-7777 555-010-7777")
    assert pii.edges(tokens)[1].tolist() == [0]


def test_field_reaches_far_mentions():
    """Against exact beliefs: one known label at the end of a long row of mentions."""
    names = {"any": 0}
    weak = np.zeros((1, pii.OUTSIDE + 1))
    pair = np.zeros((2, pii.OUTSIDE + 1, pii.OUTSIDE + 1))
    pair[1] = 8.0 * np.eye(pii.OUTSIDE + 1)
    field, n = pii.Field(names, weak, pair), 60
    text = " and ".join(["+1 555-010-7777"] + ["5550107777"] * n)
    tokens = pii.open_tokens(text)
    labels = pii.token_labels(tokens, pii.base_spans(text))
    belief = field.beliefs(tokens, labels)[:, pii.KINDS.index("phone")]
    step = np.exp(pair[1])
    step /= step.sum(axis=1, keepdims=True)
    for k in (1, 9, 30, n):
        assert belief[1 + k] == pytest.approx(np.linalg.matrix_power(step, k)[3, 3], abs=1e-3)
    assert belief[-1] >= pii.CERTAIN and pii.all_spans(text, field)[1][-1].end == len(text)


def test_similar_numbers_are_tied():
    tokens = pii.open_tokens("+15550107777 then 5550107777 then 010-7777 then 5550107777 or 5550108888")
    pairs, kinds = pii.edges(tokens)
    assert pairs.tolist() == [[0, 1], [1, 2], [1, 3]] and kinds.tolist() == [1, 1, 1]


def test_weights_of_many_texts_as_of_one():
    scorer = toxicity.Scorer({w: 3.0 for w in toxicity.INSULTS})
    texts = [
        "plain words", "what an idiot", "", "\u201cidiot\u201d he shouted", "you\u2014idiot\u2026", "idiot\u00a0!", "QUEL IMB\u00c9CILE",
        "CR\u00c9TIN", "ich will dich T\u00d6TEN \u2013 dich", "caf\u00e9", "You \u00abMORON\u00bb", "id_iot", "an_idiot_",
    ]
    wanted = [scorer.weight(t) for t in texts]
    assert scorer.weights(pa.array(texts)).tolist() == wanted
    assert sum(w > 0 for w in wanted) == 9
    assert scorer.weights(pa.array(texts).slice(3, 2)).tolist() == wanted[3:5]


def test_lm_counts_travel_packed(spark):
    words = [f"w{i * 7919 % 40009}" for i in range(60_000)]
    texts = [(part << 32, " ".join(words[at : at + 500]), False) for part in (0, 1) for at in range(0, len(words), 500)]
    marked = spark.createDataFrame(texts, "block long, text string, good boolean").repartition(2, "block")
    bits = lm_score._bits(2)
    sent = marked.mapInArrow(lm_score._count_task(bits), "block long, bucket long, n long, grams binary, seen binary")
    n, there = sent.selectExpr("sum(n)", "sum(length(grams) + length(seen))").first()
    back = lm_score.summed_counts(marked, bits).selectExpr("sum(length(seen))").first()[0]
    assert n > 150_000
    # Small chunks; larger ones take less. A row of four longs takes 32 bytes, and went both ways.
    assert there < 10 * n and back < 4 * n
