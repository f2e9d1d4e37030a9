"""Query of the secret scan over ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestrank.llm.op9_random import KINDS, secret_spans

NAME = "op9_secret_scan"


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _count(spans: str, kind: int) -> Column:
    # One parameter only: a second one of the lambda would be the element's index.
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count("base", kind).alias(f"n_{KINDS[kind]}") for kind in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )
