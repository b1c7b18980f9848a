"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firelake.checks.query import Query
from firelake.llm import decontaminate, jaccard, language, licenses, lm_score, mixing, negatives, oracles, pii, quality
from firelake.llm import sharding, spelling, toxicity, urls
from firelake.llm.shared import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    return language.identify(docs, docs.where(~F.col("held_out")), keep=("doc_id", "held_out"))


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def _lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.cross_entropy_difference(documents(spark, sf_dir), good)


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(documents(spark, sf_dir))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def _spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(documents(spark, sf_dir), strewn=spelling.STREWN))


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(documents(spark, sf_dir))


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.scaled(table(spark, sf_dir, "embeddings"), "embedding", 256)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def queries() -> dict[str, Query]:
    return {
        "op1_benchmark_decontamination": Query(_decontamination),
        "op2_language_id": Query(_language),
        "op3_license_scans": Query(_licenses, oracles.licenses_sql()),
        "op4_quality_rules": Query(_quality, oracles.quality_sql()),
        "op5_source_mixing": Query(_mixture, oracles.mixing_sql()),
        "op6_url_filters": Query(_urls, oracles.urls_sql()),
        "op7_lm_scoring": Query(_lm_scores),
        "op8_pii_spans": Query(_pii),
        "op9_ngram_jaccard_join": Query(_near_duplicates, oracles.near_duplicates_sql()),
        "op10_toxicity_grammar": Query(_toxicity),
        "op11_spelling_variants": Query(_spelling, oracles.spelling_sql()),
        "op12_shard_shuffle": Query(_shards, oracles.shards_sql()),
        "op13_hard_negatives": Query(_negatives, oracles.negatives_sql()),
    }
