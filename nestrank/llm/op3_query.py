"""Query of the packing operator over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op3_packing import pack
from nestrank.llm.tokens import tokenizer_path

NAME = "op3_best_fit_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
