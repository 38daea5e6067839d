"""Registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, contracts_sql, decontaminate, forest, langid, licenses, mix, phrases, pii, ranked, shard, substring, toxicity, urls
from .tables import ready, table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 runs of the Hilbert order."""
    return shard.shards(table(ready(spark), sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above."""
    return licenses.scan(licenses.document_paths(table(ready(spark), sf_dir, "documents")))


def op3_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held-out rows are never trained on."""
    out = langid.predictions(table(ready(spark), sf_dir, "documents"))
    return out.withColumn("languages", F.to_json("languages"))


def op4_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bagminhash.near_duplicate_classes(table(ready(spark), sf_dir, "documents"))


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words, items and verdict of every document."""
    ready(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; held-out rows are never learned from."""
    ready(spark)
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document repeats from earlier documents, and what is left."""
    out = substring.duplicate_spans(table(ready(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_budgeted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix.mixture(table(ready(spark), sf_dir, "documents"))


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return forest.nearest(table(ready(spark), sf_dir, "embeddings"))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(table(ready(spark), sf_dir, "documents"))


def op11_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.collocations(table(ready(spark), sf_dir, "documents")).drop("path_words")


def op12_segmented_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return urls.judged(table(ready(spark), sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op13_shared_subexpression_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    ready(spark)
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_hilbert_shards, op2_license_scan, op3_mixture_language_id, op4_bagminhash_near_duplicates, op5_wu_manber_decontamination,
        op6_weak_supervision_toxicity, op7_relative_lempel_ziv, op8_budgeted_mixture, op9_hash_prefix_forest, op10_bootstrapped_pii,
        op11_de_bruijn_phrases, op12_segmented_url_filter, op13_shared_subexpression_search)
}
ORACLES: dict[str, str] = {
    "op1_hilbert_shards": contracts_sql.hilbert_shards(),
    "op8_budgeted_mixture": contracts_sql.MIXTURE,
    "op5_wu_manber_decontamination": contracts_sql.DECONTAMINATION,
    "op7_relative_lempel_ziv": contracts_sql.SUBSTRINGS,
    "op11_de_bruijn_phrases": contracts_sql.PHRASES,
    "op12_segmented_url_filter": contracts_sql.url_filter(),
    "op13_shared_subexpression_search": contracts_sql.RANKED,
}
