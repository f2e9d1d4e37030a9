"""Nearest neighbours by randomly rotated one-bit codes.

A vector v is centred (c, the mean of a bounded sample), rotated by a random orthogonal matrix P
(a parameter of the index: seed and dimension) and kept as the signs of P(v - c), packed to bits,
with two correction scalars: the length |v - c| and the inner product of the unit vector with its
code. For a query q the inner product of the unit vectors is estimated as <code, q> / <code, v>;
its error is at most ``EPSILON`` * sqrt((1 - x^2) / x^2) / sqrt(d - 1), x the second scalar, with
overwhelming probability. That gives every candidate a lower and an upper bound of its distance.
A candidate is reranked on the original vector, in double precision, unless its lower bound
exceeds the k-th smallest upper bound.

Layout: vectors are dealt to cells of about ``CELL`` rows, queries to blocks of ``QUERY_BLOCK``;
a (cell, block) pair is one group: codes are built once per cell row, estimated in slices, and
k rows a query leave the group. A second aggregation keeps the k best of all cells. Nothing is
broadcast, and a vector that a third of all rows share fills cells like any other.

Defined results: null, zero and non-finite vectors, vectors with a null component and rows with a
null id take no part; vectors are compared with those of their own dimension; rows that share the
query's id are its own; a query id that repeats counts once (its smallest vector); ties go to the
smaller id; an empty table gives no rows. Only ``id_col`` and ``vector_col`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL, QUERY_BLOCK, SLICE = 16_384, 1_024, 64
SAMPLE = 4_096
EPSILON = 6.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed sign bits and correction scalars of a set of vectors."""

    def __init__(self, vectors: np.ndarray, center: np.ndarray, turn: np.ndarray) -> None:
        moved = vectors - center
        self.length = np.sqrt((moved * moved).sum(1))
        unit = moved / np.where(self.length > 0, self.length, 1.0)[:, None]
        turned = unit @ turn.T
        self.dim = vectors.shape[1]
        self.bits = np.packbits(turned > 0, axis=1)
        self.align = np.abs(turned).sum(1) / math.sqrt(self.dim)  # <code, unit vector>
        self.align = np.maximum(self.align, 1e-6)
        self.error = EPSILON * np.sqrt(np.maximum(1 - self.align**2, 0)) / self.align / math.sqrt(max(self.dim - 1, 1))

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances to rotated, centred queries (one a row)."""
        length = np.sqrt((query * query).sum(1))
        unit = query / np.where(length > 0, length, 1.0)[:, None]
        signs = np.unpackbits(self.bits, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        inner = (unit.astype(np.float32) @ signs.T) / math.sqrt(self.dim) / self.align
        base = length[:, None] ** 2 + self.length**2
        cross = 2 * length[:, None] * self.length
        slack = 1e-4 * base + 1e-9
        return base - cross * (inner + self.error) - slack, base - cross * (inner - self.error) + slack


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    diff = vectors - query
    return np.sqrt((diff * diff).sum(1))


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, center: np.ndarray,
    turn: np.ndarray,
) -> list[tuple[int, int, float]]:
    """(query id, id, distance): the k nearest of the block for each query."""
    codes = Codes(vectors, center, turn)
    out = []
    for low in range(0, len(queries), SLICE):
        some = queries[low : low + SLICE]
        least, most = codes.bounds((some - center) @ turn.T)
        for i, q in enumerate(query_ids[low : low + SLICE].tolist()):
            own = ids == q
            most[i][own] = np.inf
            if k < len(ids):
                bar = np.partition(most[i], k - 1)[k - 1]
                chosen = np.flatnonzero((least[i] <= bar) & ~own)
            else:
                chosen = np.flatnonzero(~own)
            distance = _exact(vectors[chosen], some[i])
            best = np.lexsort((ids[chosen], distance))[:k]
            out += [(q, int(ids[chosen[b]]), float(distance[b])) for b in best]
    return out


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(~bad)
        .where(F.exists("v", lambda x: x != 0))
    )


def search(
    rows: DataFrame, wanted: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score for every query (rows of ``rows`` where ``wanted`` holds)."""
    base = usable(rows, id_col, vector_col)
    queries = usable(rows.where(wanted), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    # Codes only steer the choice of what is reranked, so any centre is right; a bounded sample gives it.
    sizes = {r[0]: r[1] for r in base.groupBy(F.size("v")).count().collect()}
    centers = {}
    for dim in sizes:
        part = base.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v")
        centers[dim] = np.array([r[0] for r in part.collect()]).mean(0)
    asked = {r[0]: r[1] for r in queries.groupBy(F.size("v")).count().collect()}
    dims = [d for d in sizes if d in asked]
    schema = "query_id long, vec_id long, score double"
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def per_dim(counts: dict[int, int], each: int):
        return F.coalesce(
            *[F.when(F.size("v") == d, F.lit(max(1, math.ceil(counts[d] / each)))) for d in dims], F.lit(1)
        ).cast("int")

    cells = base.where(F.size("v").isin(dims)).select(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), per_dim(sizes, CELL)).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), per_dim(asked, QUERY_BLOCK) - 1)).alias("block"), F.lit(0).alias("kind"), "id", "v",
    )
    spread = queries.where(F.size("v").isin(dims)).select(
        F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), per_dim(sizes, CELL) - 1)).alias("cell"),
        F.pmod(F.xxhash64("id"), per_dim(asked, QUERY_BLOCK)).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "v",
    )

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        dim = rows.column("dim")[0].as_py()
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors, ids = flat.reshape(-1, dim), rows.column("id").to_numpy()
        found = []
        if (kind == 0).any() and (kind == 1).any():
            at, q = kind == 0, kind == 1
            found = search_block(ids[at], vectors[at], ids[q], vectors[q], k, centers[dim], rotation(dim, seed))
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    best = cells.union(spread).groupBy("dim", "cell", "block").applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
