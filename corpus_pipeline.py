"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing and packing, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platehouse.llm import jaccard, mixing, packing, repetition, toxicity
from platehouse.llm.shared import documents, small_batches, staged
from platehouse.llm.tokens import vocabulary

END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    small_batches(spark)
    return repetition.keep(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned on this stage's labelled rows does not call toxic."""
    small_batches(spark)
    return toxicity.keep(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), END_ID)


STAGES = [("quality rules", quality), ("toxicity", non_toxic), ("near duplicates", one_of_each), ("mixing", mixture), ("packing", packed)]

#: Learned scores and tokenizers can't be put in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{number}")
    return docs
