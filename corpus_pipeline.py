"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

Toxic documents go, of equal texts one row stays, of near duplicates (shingles of five words,
similarity 0.8 or more) the smallest id stays, secrets give way to a mark, and what is left is
packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.common import staged
from nestrank.llm.op1_query import HELD_OUT
from nestrank.llm.op1_toxicity import keep_clean, train
from nestrank.llm.op3_packing import pack
from nestrank.llm.op7_cuckoo import drop_duplicates
from nestrank.llm.op9_random import redact_secrets
from nestrank.llm.op10_setsketch import drop_near_duplicates
from nestrank.llm.tokens import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, train(docs, labels, f"not ({HELD_OUT})"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

# Learning, near-duplicate search, the test battery and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
