"""Query of the nearest-neighbour operator over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op5_onebit import search

NAME = "op5_nearest"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
