"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; every
result is written as Parquet and read again before the next stage, so a lost
executor repeats work of one stage only. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm import bpe_stream, exact_dedup, mixing, near_dup, toxicity
from tunetable.llm.common import stored
from tunetable.llm.queries import tokenizer_path

#: Documents with at least this score go.
TOXIC = 0.5


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__score").filter(F.col("__score") < TOXIC).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: its number of tokens and digests of ids and decoded text."""
    return bpe_stream.token_digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", ordinary),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_contents),
    ("source mixing", mixed_sources),
    ("BPE", tokens),
]

#: The stages' results can't be had in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
