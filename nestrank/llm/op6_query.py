"""Query of the encoding and decoding operator over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op6_chunks import encode_decode
from nestrank.llm.tokens import tokenizer_path

NAME = "op6_bpe"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
