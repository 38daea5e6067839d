"""A training corpus in five stages: language, near-duplicates, benchmarks, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of ``docs``.
Between the stages the rows are written to the shared folder and read again, so
a lost executor costs no more than the stage it worked on.

* language_id: documents whose language is not recognised go (no letter, null
  text, or a fit under that of nearly all training rows: no language explains the text).
* near_duplicates: of each class of near-duplicates the smallest doc_id stays.
* decontamination: documents that hold a benchmark window go.
* mixture: documents stay whole and appear as often as the mix takes them
  (0 to 3 times), sources near their targets.
* sharding: doc_id, size, text_crc32, law, shard, slot, grown_shard, source,
  lang and place on the curve, for every row of the mix.

Empty tables, null columns and further columns pass through every stage (see
the operators); an empty input gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartpulse.llm import bagminhash, decontaminate, langid, mix, shard
from cartpulse.llm.tables import ready, table
from cartpulse.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return bagminhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, table(ready(spark), sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return shard.shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: SQL cannot express the EM of the first stage; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(ready(spark), sf_dir, "documents")
    name = f"pipeline-{uuid.uuid4().hex}"
    for step, stage in STAGES:
        path = scratch_path(spark, f"{name}/{step}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
