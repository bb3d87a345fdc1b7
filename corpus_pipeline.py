"""A training corpus from raw documents: toxic and poor documents go, one of each class of near copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores it as Parquet and gives it to the next one.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, packing, quality, toxicity
from millrace.llm.common import fold, written
from millrace.runtime import load


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold; learned from the labelled documents of the training fold."""
    weights = toxicity.fit(docs, load(spark, sf_dir, "labels"), lambda c: fold(c, 3) != 1)
    return toxicity.keep_rows(docs, weights)


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold; learned from the labelled documents of the training fold."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"), lambda c: fold(c, 4) != 2)
    return quality.keep_rows(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near copies."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents cut into pieces and packed into sequences of at most 2048 tokens."""
    return packing.op6(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_out), ("quality", quality_in), ("jaccard", one_of_each), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
