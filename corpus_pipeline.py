"""A corpus pipeline over ``documents``: quality rules, near-duplicates, personal data, source mix, token ids.

Each stage takes all rows that the one before kept, written as Parquet and read again. All but the
last return the columns of ``documents``. Null and empty texts have no words, so the quality stage
drops them; stages also accept them on their own. Extra columns go through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from amberline.llm import bpe_automaton, common, mixing, pii, quality, simhash
from amberline.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(ship(spark), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(ship(spark), docs, width=5, similarity=0.8)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(ship(spark), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(ship(spark), docs, power=0.5, seed=7)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of ids, and digests of the ids and of the text that they decode to."""
    return bpe_automaton.coded(ship(spark), docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "source"])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]
#: Posteriors, similarity groups and the automaton have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
