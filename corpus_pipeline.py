"""The corpus pipeline: five stages over documents, each on all that the one before kept.

1. language: documents without a letter, or like no language at all, go.
2. near_duplicates: of documents joined by links of four fifths of their five-word shingles, the first stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: sources are taken at temperature weights under a budget of all tokens, as block permutations.
5. sharding: eight shards of near equal bytes, equal texts together.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
gives what it reads back to the next stage, so a lost executor never repeats an earlier stage. All but the last keep
the columns of ``docs``. Null and repeated rows fare as each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import contamination, jaccard, language, mixing, sharding
from palimpsest.session import shared_folder

SHARDS = 8
ORACLE_SQL = None  # language profiles and differencing have no SQL


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from the stage's own labelled documents."""
    return language.select_known(docs, language.learn_means(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [("language", identify_language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix_sources), ("sharding", assign_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
