"""Query of the token-id files over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op2_mixing import document_digests, write_blocks
from nestrank.llm.tokens import tokenizer_path

NAME = "op2_token_files"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_digests(write_blocks(docs, tokenizer_path("word_bpe_49k.json")))
