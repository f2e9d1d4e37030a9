"""MinHash near-dedup on SetSketch registers.

A text's set holds its distinct shingles of five words (words split at ASCII white space, A-Z
lowered). ``REGISTERS`` registers per set: register i is ``floor(1 - log_b x)`` of the smallest
exponential variate x over the set, cut to 0 .. ``Q + 1``; registers of a union are the maxima
of its parts' registers (``merge_registers``). Equal runs of ``ROWS`` registers make a bucket.

1. Sets are grouped by a 128-bit digest; one numbered node stands for all equal sets, so an id that
   repeats with another text is another node. Numbers become smallest ids at the end.
2. Every bucket proposes the pairs (smallest member, other member). A pair's similarity is
   estimated jointly by maximum likelihood from the counts of larger, smaller and equal
   registers; pairs more than six deviations under the threshold end here. The rest is
   verified on the full sets: 100 * common >= ``percent`` * union.
3. A bucket whose members do not yet lie in one component may hold further links between
   members. It is cut into cells by size class, one class with the next larger one, since sets at
   the threshold are at most one class apart; cells whose members lie in one component end here.
   A link that is still of use has an end outside the cell's largest component. So a cell of up to
   ``BLOCK`` members (or ``WEIGHT`` shingles) is one small task that gets each set once, and of a
   larger one only blocks of such outsiders meet blocks of the rest. A task counts the common
   shingles exactly (a sparse product) and returns a spanning forest of the verified links, never
   the pairs. No bucket is capped.
4. Components: alternating minimum-label stars, no driver collection.

A pair at the threshold shares no bucket with probability (1 - 0.85^7)^50 < 1e-8.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer
than five words are one shingle; a row with a null id is returned with a null component, kept,
and links nothing; rows that repeat an id are one node when equal and separate otherwise; an
empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import min_labels, mix64, slices, staged, texts, word_hashes

SHINGLE = 5
ROWS, BANDS = 7, 50
REGISTERS = ROWS * BANDS
BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
BLOCK, WEIGHT = 1024, 1 << 20
_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of one text."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z lowered, ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words, known)
    width = min(SHINGLE, len(hashes))
    mixed = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        mixed = mix64(mixed + hashes[k : k + len(mixed)] + np.uint64(width))
    return np.unique(mixed)


def set_digest(hashes: np.ndarray) -> bytes | None:
    """128-bit digest of a set; None for the empty set."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set; all zero for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(low, (hashes[at : at + 256, None] * _SEEDS).min(axis=0), out=low)
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge_registers(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, two)


def estimate(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of row pairs of registers with known set sizes."""
    larger = (one > two).sum(1)
    smaller = (one < two).sum(1)
    equal = REGISTERS - larger - smaller
    u = n_one / (n_one + n_two)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return -(larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = loss(low + third) < loss(high - third)
        low, high = np.where(left, low, low + third), np.where(left, high - third, high)
    return (low + high) / 2


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sketch) of every row; digest and sketch are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, text_col):
                sizes, digests, sketches = [], [], []
                for text in texts(part, text_col):
                    hashes = shingle_set(text, known)
                    sizes.append(len(hashes))
                    digests.append(set_digest(hashes))
                    sketches.append(registers(hashes).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                    ["id", "n", "digest", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"id {kind}, n long, digest binary, sketch binary"
    )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node): one row per band of each node."""
    band = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        mixed = np.broadcast_to(band, sketch.shape[:2]).copy()
        for k in range(ROWS):
            mixed = mix64(mixed + sketch[:, :, k].astype(np.uint64))
        at = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mixed.reshape(-1).view(np.int64)), batch.column("node").take(pa.array(at))], ["bucket", "node"]
        )


def _full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, digest, hashes) of the given rows: the sorted shingle hashes as packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, text_col):
                digests, packed = [], []
                for text in texts(part, text_col):
                    hashes = shingle_set(text, known)
                    digests.append(set_digest(hashes))
                    packed.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                    ["rep", "digest", "hashes"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"rep {kind}, digest binary, hashes binary")


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def _verifier(percent: int):
    floor = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("ha", "hb"))
            sizes = [np.array([len(x) for x in side], float) for side in (one, two)]
            sketches = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ka", "kb")]
            likely = estimate(*sketches, *sizes) >= floor
            good = [bool(ok) and linked(x, y, percent) for ok, x, y in zip(likely, one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets, exactly.

    Elements of up to eight owners add their owner pairs one by one; the others, 1,024 at a time,
    are a product of 0/1 matrices over the sets that hold any of them.
    """
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    common = np.zeros((count, count), np.float32)
    order = np.argsort(ids, kind="stable")
    owner, held = owner[order], counts[ids[order]]
    for many in range(2, 9):
        owners = owner[held == many].reshape(-1, many)
        for i in range(many):
            for j in range(i + 1, many):
                common += np.bincount(owners[:, i] * count + owners[:, j], minlength=count * count).reshape(count, count)
    common += common.T
    owner, ids = owner[held > 8], np.unique(ids[order][held > 8], return_inverse=True)[1]
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 1024):
        a, b = np.searchsorted(ids, [low, low + 1024])
        rows, at = np.unique(owner[a:b], return_inverse=True)
        part = np.zeros((len(rows), 1024), np.float32)
        part[at, ids[a:b] - low] = 1
        common[np.ix_(rows, rows)] += part @ part.T
    return common.astype(np.int64)


def forest(sets: list[np.ndarray], wanted: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets`` that the symmetric matrix ``wanted`` asks for."""
    common = common_counts(sets)
    size = np.array([len(s) for s in sets], np.int64)
    link = wanted & (100 * common >= percent * (size[:, None] + size[None, :] - common))
    parent, out = list(range(len(sets))), []
    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        ri, rj = _find(parent, int(i)), _find(parent, int(j))
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
            out.append((int(i), int(j)))
    return out


def _cell_links(percent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").combine_chunks()
        own, block, component = (rows.column(c).to_numpy() for c in ("own", "block", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        wanted = (component[:, None] != component[None, :]) & (own[:, None] | own[None, :])
        if key[2].as_py() != key[3].as_py():
            wanted &= block[:, None] != block[None, :]
        edges = forest(sets, wanted, percent) if wanted.any() else []
        ends = [nodes.take(pa.array([e[k] for e in edges], pa.int64())) for k in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1]})

    return run


def _cells(members: DataFrame, first: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(bucket, class, i, j, node, own, component, block): what each task of the open buckets gets.

    A cell holds the sets of its class (``own``) and of the next one. Of equal cells one is kept.
    """
    width = -math.log((percent - 0.5) / 100)  # a little more than the ratio of the threshold
    labelled = staged(
        members.where("size > 2")
        .join(first, "node", "left")
        .select("bucket", "node", F.coalesce("component", "node").alias("component")),
        "labelled",
    )
    still = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    classes = sizes.select("node", "n", F.floor(F.ln("n") / width).cast("int").alias("own_class"))
    rows = staged(
        labelled.join(still.where("low < high").select("bucket"), "bucket")
        .join(classes, "node")
        .withColumn("class", F.explode(F.array(F.col("own_class"), F.col("own_class") - 1)))
        .select("bucket", "class", "node", "n", "component", (F.col("class") == F.col("own_class")).alias("own")),
        "cells",
    )
    parts = rows.groupBy("bucket", "class", "component").agg(
        F.count("*").alias("size"), F.sum("n").alias("weight"), F.sum(F.col("own").cast("long")).alias("owned"),
        F.sum(F.xxhash64("node", "own").cast("decimal(38,0)")).alias("signature"),
    )
    blocks = lambda size, weight: F.greatest(F.ceil(size / BLOCK), F.ceil(weight / WEIGHT)).cast("int")
    cells = (
        parts.groupBy("bucket", "class")
        .agg(
            F.count("*").alias("components"), F.sum("size").alias("size"), F.sum("weight").alias("weight"),
            F.sum("owned").alias("owned"), F.sum("signature").alias("signature"),
            F.max(F.struct("size", "weight", "component")).alias("most"),
        )
        .where("components > 1 and owned > 0")
        .groupBy("signature", "size")
        .agg(F.min_by(F.struct("bucket", "class", "weight", "most"), F.struct("bucket", "class")).alias("c"))
        .select(
            "c.bucket", "c.class", F.col("c.most.component").alias("main"),
            (blocks(F.col("size"), F.col("c.weight")) == 1).alias("small"),
            blocks(F.col("size") - F.col("c.most.size"), F.col("c.weight") - F.col("c.most.weight")).alias("outer"),
            blocks(F.col("c.most.size"), F.col("c.most.weight")).alias("inner"),
        )
    )
    # Blocks 0 .. outer - 1 hold outsiders, the next ones members of the largest component.
    outsider, spread = F.col("component") != F.col("main"), F.xxhash64("node")
    block = (
        F.when(F.col("small"), 0)
        .when(outsider, F.pmod(spread, "outer"))
        .otherwise(F.col("outer") + F.pmod(spread, "inner"))
        .cast("int")
    )
    last = F.when(F.col("small"), 0).when(outsider, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    return (
        rows.join(cells, ["bucket", "class"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "bucket", "class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "node", "own", "component", "block",
        )
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, n, digest, component_id, kept) of every row."""
    feats = staged(features(docs, id_col, text_col), "sketches")
    reps = staged(
        feats.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "sets",
    )
    rows = staged(reps.select("node", "sketch").mapInArrow(_buckets, "bucket long, node long"), "bands")
    heads = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = staged(rows.join(heads, "bucket").select("bucket", "node", "head", "size"), "members")
    pairs = members.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()

    wanted = members.select("node").distinct().join(reps.select("node", "rep"), "node").select("rep").distinct()
    own = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text"))
    # An id may repeat with another text: the digest tells whose set it is.
    sets = staged(
        _full_sets(own.join(wanted, "rep", "left_semi"), "rep", "text")
        .join(reps.select("node", "rep", "digest", "sketch"), ["rep", "digest"])
        .select("node", "hashes", "sketch")
        .dropDuplicates(["node"]),
        "members-sets",
    )
    side = lambda x: sets.select(
        F.col("node").alias(x), F.col("hashes").alias(f"h{x}"), F.col("sketch").alias(f"k{x}")
    )
    star = staged(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb", "ka", "kb")
        .mapInArrow(_verifier(percent), "a long, b long"),
        "star",
    )
    first = min_labels(star, "first")
    cells = _cells(members, first, reps.select("node", "n"), percent).join(sets.select("node", "hashes"), "node")
    rest = cells.groupBy("bucket", "class", "i", "j").applyInArrow(_cell_links(percent), "a long, b long")
    final = min_labels(star.union(rest), "final")

    linked_nodes = staged(reps.select("node", "digest", "rep").join(final, "node"), "linked")
    # Staged, so that both sides of the join on a large component are plain shuffles.
    lows = staged(linked_nodes.groupBy("component").agg(F.min("rep").alias("low")), "lows")
    low = linked_nodes.join(lows, "component").select("digest", "low")
    named = (
        reps.select("digest", "rep").join(low, "digest", "left")
        .select(F.col("digest").alias("set_digest"), F.coalesce("low", "rep").alias("component"))
    )
    return feats.join(named, feats.digest == named.set_digest, "left").select(
        "id", "n", "digest",
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id")).alias("component_id"),
        F.when(F.col("id").isNull(), F.lit(True)).otherwise(F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept."""
    return _labelled(docs, id_col, text_col, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept"
    )


def _digests(column: pa.Array) -> pa.Array:
    known: dict[bytes, int] = {}
    return pa.array([set_digest(shingle_set(x.as_py() or "", known)) for x in column], pa.binary())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns: the smallest id of each component.

    Where an id stands on different texts, each text is judged by itself. At 80 percent a pair shares
    no bucket with probability (1 - 0.8^7)^50 < 1e-5. The columns of ``docs`` pass in one struct, so
    none of them can clash with a name used here.
    """
    marks = staged(
        _labelled(docs, id_col, text_col, percent)
        .select(F.col("id").alias("mark_id"), F.col("digest").alias("mark_digest"), "kept").distinct(),
        "marks",
    )
    ids = marks.groupBy("mark_id").agg(F.min("kept").alias("whole"), F.max("kept").alias("some"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("own_text"))
    same = F.col("own_id").eqNullSafe(F.col("mark_id"))
    stay = rows.join(ids.where("whole"), same, "left_semi").select("row")
    mixed = staged(ids.where("some and not whole").select("mark_id"), "mixed")
    if not mixed.isEmpty():
        parted = rows.join(mixed, same, "left_semi").withColumn("own_digest", F.arrow_udf(_digests, "binary")("own_text"))
        good = marks.where("kept").join(mixed, "mark_id", "left_semi")
        own = same & F.col("own_digest").eqNullSafe(F.col("mark_digest"))
        stay = stay.union(parted.join(good, own, "left_semi").select("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
