"""The corpus pipeline from end to end, on planted cases and on odd tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from firelake.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, steps long, comp string"
LABELS = "doc_id long, quality int, toxic int"


def _words(rng, n):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, labels, benchmark):
        spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(benchmark, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def test_stages_do_what_they_say(spark, folder):
    rng = random.Random(3)
    item = _words(rng, 20)
    insult = sorted(toxicity.INSULTS)[0]
    docs, labels = [], []
    for i in range(120):
        text = _words(rng, 40)
        toxic = i % 10 == 0
        docs.append((i, f"{text} you {insult} , what a {insult} you are" if toxic else text, "en", "ab"[i % 2], None, i, "x"))
        labels.append((i, 1, int(toxic)))
    near = docs[1][1].rsplit(" ", 1)[0] + " changed"
    docs += [
        (200, docs[1][1], "en", "a", 5, 0, None),
        (201, near, "en", "b", 5, 0, None),
        (202, f"{_words(rng, 15)} {item} {_words(rng, 15)}", "en", "a", 5, 0, None),
        (203, f"{_words(rng, 30)} call +1 (555) 010-7777 or mail ann@site.org now", "en", "b", 5, 0, None),
        (204, None, None, "a", None, None, None),
        (None, f"{_words(rng, 30)} no id", "en", "b", 5, 0, None),
    ]
    sf_dir = folder(docs, labels, [(1, item), (2, None)])
    stages, kept = dict(corpus_pipeline.STAGES), {}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages.items():
        rows = corpus_pipeline.stored(stage(spark, rows, sf_dir), name)
        kept[name] = {r.doc_id: r.text for r in rows.collect()}
        if name != "source_mixing":
            assert rows.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    clean = {d[0] for d in docs} - {i for i in range(0, 120, 10)}
    assert set(kept["toxicity"]) == clean
    assert set(kept["ngram_jaccard_join"]) == clean - {200, 201}
    assert set(kept["benchmark_decontamination"]) == clean - {200, 201, 202}
    assert set(kept["pii"]) == clean - {200, 201, 202}
    assert kept["pii"][203].endswith("call <PHONE> or mail <EMAIL> now") and kept["pii"][204] is None
    assert {i: t for i, t in kept["pii"].items() if i != 203} == {i: t for i, t in kept["benchmark_decontamination"].items() if i != 203}
    # Copies of whole records, about as many as there were.
    assert set(kept["source_mixing"]) <= set(kept["pii"]) and 60 < rows.count() < 180
    assert {"n_copies", "copy"} < set(rows.columns)


def test_empty_tables_and_missing_labels(spark, folder):
    sf_dir = folder([], [], [])
    assert corpus_pipeline.run(spark, sf_dir).collect() == []


def test_documents_without_labels_or_benchmark(spark, folder):
    rng = random.Random(5)
    docs = [(i, _words(rng, 30), "en", "a", None, 1, "c") for i in range(20)] + [(3, _words(rng, 8), None, None, None, None, None)]
    sf_dir = folder(docs, [], [])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} <= set(range(20)) and len(rows) > 0
