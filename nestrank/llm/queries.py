"""Registered queries of the subpackage; thin: each takes its rows from the operator."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "op7_query", "op10_query", "op9_query", "op3_query", "op1_query", "op5_query", "op8_query", "op4_query", "op6_query", "op2_query",
    "op11_query", "op12_query", "op13_query",
)


def all_queries() -> dict[str, Query]:
    return {m.NAME: m.query for m in map(_module, MODULES)}


def all_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in map(_module, MODULES) if getattr(m, "SQL", None)}


def _module(name: str):
    return import_module(f"nestrank.llm.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
