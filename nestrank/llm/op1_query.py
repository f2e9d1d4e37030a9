"""Query of the toxicity operator over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestrank.llm.op1_toxicity import THRESHOLD, scored, train

NAME = "op1_toxicity"
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, f"not ({HELD_OUT})")
    return scored(docs, model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
