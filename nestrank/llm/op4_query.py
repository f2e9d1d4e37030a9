"""Query of the token counts over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op4_viterbi import token_counts
from nestrank.llm.tokens import tokenizer_path

NAME = "op4_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
