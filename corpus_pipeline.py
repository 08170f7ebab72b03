"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it
keeps; the last one returns where their tokens are packed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph import ship
from loomgraph.llm import packing, pivotal_mix, pu_toxicity, secret_ledger, simhash
from loomgraph.llm.common import shared_dir, stash, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    ship(spark)
    return pu_toxicity.clean(docs, pu_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship(spark)
    return simhash.keep_first(docs, distance=4, shingle=4, seed=42)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked."""
    ship(spark)
    return secret_ledger.mask(docs, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, stay or repeat, by their source's target."""
    return pivotal_mix.mixed_rows(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of each piece of each document."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packed)]

#: Classifiers, XXH64 and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
