"""Helpers that several operators share: staging, hashing of words, token ids, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder, in folders ``by`` columns, and read it back.

    Cuts the lineage: what follows survives a lost executor without running this part again.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/nestrank-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts in ``column`` hold about ``limit`` bytes (one row at least)."""
    values = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(values.type) else np.int32)
    ends = sizes[values.offset : values.offset + batch.num_rows + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_labels(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Alternating large-star and small-star steps: a neighbour list is never gathered, only its
    minimum (a partial aggregate) is joined back. Minima are staged, so both sides of that join are
    plain shuffles and adaptive execution may split the edges of a hub. The driver sees one
    (count, checksum) row per round.
    """
    def minima(pairs: DataFrame) -> DataFrame:
        return staged(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)

    def pairs_of(a: str, b: str, table: DataFrame) -> DataFrame:
        return table.select(F.col(a).alias("u"), F.col(b).alias("v"))

    now = staged(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = None
    while True:
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == seen:
            break
        seen = check
        # Large star: every larger neighbour of a node is hooked under the node's minimum.
        both = pairs_of("a", "b", now).union(pairs_of("b", "a", now))
        wide = both.where("v > u").join(minima(both), "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        wide = staged(wide.distinct(), name)
        # Small star: every smaller neighbour, and the node, is hooked under the node's minimum.
        down = pairs_of("a", "b", wide)
        low = minima(down)
        hooked = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        now = staged(hooked.union(own).where("a != b").distinct(), name)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def word_hashes(words: Iterable[bytes], known: dict[bytes, int], limit: int = 150_000) -> np.ndarray:
    """64-bit hashes of words; ``known`` is a bounded cache that the caller keeps per task."""
    import xxhash

    words = list(words)
    new = set(words).difference(known)
    if new:
        if len(known) > limit:
            known.clear()
            new = set(words)
        digest = xxhash.xxh3_64_intdigest
        known.update((w, digest(w)) for w in new)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
