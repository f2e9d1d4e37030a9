"""Table storage: Parquet with declared schemas, JSON export and import."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestrank.schema import LISTINGS, struct_of


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTINGS).parquet(path)


def conform(df: DataFrame, table: str = "property_listings") -> DataFrame:
    """Columns of the schema in its order; missing ones are typed NULLs."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_of(table)
        ]
    )


def write_listings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per source.  Adaptive execution sizes the files of a large source, so one
    source with a third of all rows is not one writer."""
    conform(df).hint("rebalance", "source").write.mode(mode).partitionBy("source").parquet(path)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are removed when it ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def append_log(df: DataFrame, path: str, by: str | None = None, pieces: int = 1) -> None:
    """Append to a log table, one folder per day of ``created_at``.

    ``pieces`` are written one after the other, cut by the hash of ``by``; where ``by`` is the key that the
    log is made by, each makes its own rows only.  So the disk holds the shuffled rows of one piece beside
    the log.  An append that fails may leave the pieces before.  Rows lie by day and ``by``.
    """
    dated = df.withColumn("day", F.to_date("created_at"))
    order = ["day"] if by is None else ["day", by]
    for i in range(pieces):
        rows = dated if pieces == 1 else dated.where(F.pmod(F.xxhash64(by), F.lit(pieces)) == i)
        rows = rows.hint("rebalance", "day").sortWithinPartitions(*order)
        with _tidy(df.sparkSession):
            rows.write.mode("append").option("compression", "zstd").partitionBy("day").parquet(path)


def export_json(tables: Mapping[str, DataFrame], path: str, stamp: Column | None = None) -> None:
    """Each table to its own JSON folder, timestamps in ISO form, stamped ``exported_at``."""
    stamp = F.current_timestamp() if stamp is None else stamp
    for name, df in tables.items():
        iso = {
            f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            for f in df.schema if isinstance(f.dataType, T.TimestampType)
        }
        out = df.withColumns(iso) if iso else df
        out = out.withColumn("exported_at", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        out.write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)


def parse_timestamp(col: Column) -> Column:
    """ISO timestamps with ``Z`` or an offset and any number of fraction digits."""
    cut = F.regexp_replace(col, r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(F.regexp_replace(cut, "Z$", "+00:00"))


def merge_by_key(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; an incoming row replaces the one with the same key."""
    kept = target.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def import_json(spark: SparkSession, path: str, table: str, target: DataFrame | None = None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Read an exported table and merge it into ``target`` by primary key."""
    schema = struct_of(table)
    stamps = [f.name for f in schema if isinstance(f.dataType, T.TimestampType)]
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in stamps else f.dataType) for f in schema]
    )
    rows = spark.read.schema(raw).json(f"{path}/{table}")
    rows = rows.withColumns({name: parse_timestamp(F.col(name)) for name in stamps}) if stamps else rows
    return rows if target is None else merge_by_key(conform(target, table), rows, keys)
