"""Exact dedup: a cuckoo-filter index over live digests, sharded by digest.

Texts are equal when they are identical after lower-casing A-Z. Every text becomes the SHA-256
of its normalised bytes (null counts as empty). Digests are combined per task first, so a text
that a third of all rows share costs one row per task. Each shard then holds

* a cuckoo filter: four 16-bit tags a bucket, two buckets a digest; it answers "not live"
  without touching a key,
* the live keys, bucketed by the filter's first bucket: a hit of the filter is verified there
  against the whole stored digest, length included, so a tag collision changes nothing.

Insertion that finds no place within the kick limit doubles the table and refills it from the
stored keys. Deletion removes the tag and the key of a live digest, and only if it is live.

Defined results: null text equals empty text; a row with null id takes part in the size of its
group, is never the keeper unless the group has no other, and keeps ``keep_id`` of the group;
repeated ids are separate rows (all of them carry ``kept`` if theirs is the largest id); an
empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import MASK, slices, staged, texts

SLOTS = 4
KICKS = 500


class CuckooIndex:
    """Live digests of one shard. Keys are bytes of 16 or more uniform bytes; values are any object."""

    def __init__(self, buckets: int = 64) -> None:
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.tags = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
        self.keys: dict[int, dict[bytes, object]] = {}
        self.live = 0
        self.resized = 0

    def _place(self, key: bytes) -> tuple[int, int, int]:
        first = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        tag = int.from_bytes(key[8:10], "little") or 1
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E9955BD1E995 & MASK) >> 17 & (self.buckets - 1))

    def _maybe(self, tag: int, first: int, second: int) -> bool:
        return tag in self.tags[first] or tag in self.tags[second]

    def get(self, key: bytes) -> object | None:
        """Value of a live digest, else None; a filter hit is verified against the stored key."""
        tag, first, second = self._place(key)
        return self.keys.get(first, {}).get(key) if self._maybe(tag, first, second) else None

    def put(self, key: bytes, value: object) -> bool:
        """Insert or replace; True if the digest was not live before."""
        tag, first, second = self._place(key)
        if self._maybe(tag, first, second) and key in self.keys.get(first, {}):
            self.keys[first][key] = value
            return False
        self.keys.setdefault(first, {})[key] = value
        self.live += 1
        if not self._seat(tag, first, second):
            self._grow()
        return True

    def delete(self, key: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        tag, first, second = self._place(key)
        if not self._maybe(tag, first, second) or self.keys.get(first, {}).pop(key, None) is None:
            return False
        for bucket in (first, second):
            at = np.flatnonzero(self.tags[bucket] == tag)
            if len(at):
                self.tags[bucket, at[0]] = 0
                break
        self.live -= 1
        return True

    def _seat(self, tag: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            free = np.flatnonzero(self.tags[bucket] == 0)
            if len(free):
                self.tags[bucket, free[0]] = tag
                return True
        bucket = second
        for kick in range(KICKS):
            slot = (tag + kick) % SLOTS
            tag, self.tags[bucket, slot] = int(self.tags[bucket, slot]), tag
            bucket = self._other(bucket, tag)
            free = np.flatnonzero(self.tags[bucket] == 0)
            if len(free):
                self.tags[bucket, free[0]] = tag
                return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, refilled from the stored keys (a tag alone cannot be moved)."""
        stored = [item for bucket in self.keys.values() for item in bucket.items()]
        while True:
            self.buckets *= 2
            self.resized += 1
            self.tags = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
            self.keys = {}
            for key, value in stored:
                self.keys.setdefault(self._place(key)[1], {})[key] = value
            if all(self._seat(*self._place(key)) for key, _ in stored):
                return

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.keys.values():
            yield from bucket.items()


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key): SHA-256 of each normalised text followed by its length, 40 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for part in slices(batch, text_col):
                for text in texts(part, text_col):
                    raw = text.encode("utf-8").lower()  # bytes.lower() changes A-Z only
                    keys.append(hashlib.sha256(raw).digest() + len(raw).to_bytes(8, "little"))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(keys, pa.binary())], ["id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"id {kind}, key binary"
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (batch, digest), so a digest that fills a third of the table stays few rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("key").aggregate([("id", "max"), ("delta", "sum")])
        table = table.select(["key", "id_max", "delta_sum"]).rename_columns(["key", "id", "delta"])
        yield from table.combine_chunks().to_batches()


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The live digests of one shard, after all inserts and deletes that reached it."""
    index, id_type = CuckooIndex(), None
    for batch in batches:
        id_type = batch.column("id").type
        for key, last, delta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = index.get(key)
            if old is not None:
                last = max((x for x in (old[0], last) if x is not None), default=None)
                delta += old[1]
            if delta != 0:
                index.put(key, (last, delta))
            elif old is not None:
                index.delete(key)
    rows = [item for item in index.items() if item[1][1] > 0]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.binary()),
                pa.array([v[0] for _, v in rows], id_type),
                pa.array([v[1] for _, v in rows], pa.int64()),
            ],
            ["key", "keep_id", "group_size"],
        )


def live_groups(digests: DataFrame) -> DataFrame:
    """(key, keep_id, group_size) of every live digest, through the sharded index.

    ``digests`` (id, key) may carry ``delta`` (+1 insert, -1 delete): a digest whose changes cancel
    is deleted from the index, and an id whose changes cancel (or of which more was deleted than
    inserted) is no keeper; ``keep_id`` is the largest id left. Shards follow the shuffle partitions,
    so a shard's index grows with the table over their number.
    """
    kind = digests.schema["id"].dataType.simpleString()
    rows = digests.select("key", "id", F.lit(1).cast("long").alias("delta"))
    if "delta" in digests.columns:
        delta = F.col("delta").cast("long")
        rows = (
            digests.groupBy("key", "id")
            .agg(F.sum(F.greatest(delta, F.lit(0))).alias("put"), F.sum(F.least(delta, F.lit(0))).alias("gone"))
            .select(
                "key", F.when(F.col("put") + F.col("gone") > 0, F.col("id")).alias("id"),
                F.explode(F.array("put", "gone")).alias("delta"),
            )
            .where("delta != 0")
        )
    return (
        rows.mapInArrow(_combined, f"key binary, id {kind}, delta long")
        .repartition("key")
        .mapInArrow(_shard, f"key binary, keep_id {kind}, group_size long")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    digests = staged(digest_rows(docs, id_col, text_col), "digests")
    groups = live_groups(digests)
    return digests.join(groups, "key").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns; one row of each group of equal texts.

    Rows are found again by id and digest, so an id that repeats with another text does no harm,
    and a row that repeats as a whole stays once. The columns of ``docs`` pass in one struct, so none
    of them can clash with a name used here.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, lower), 256)
    marks = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha")
    )
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), digest.alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha"))
    stay = rows.join(marks.distinct(), same, "left_semi").dropDuplicates(["own_id", "own_sha"])
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
