"""Best-fit packing: a configuration linear program over the length histogram.

A document's ids and its end id are cut into pieces of ``capacity`` only if they are longer (the
first piece is the short one). The pieces' length histogram, at most ``capacity`` numbers, is all
the solver sees:

* a configuration is a multiset of lengths that fits one sequence; the program asks for the
  fewest configurations that cover every length's count,
* multiplicative weights: each length has a price, its size times a factor that falls
  exponentially with the share of its count covered so far; a knapsack dynamic program prices the
  best configuration, which then takes a step bounded by its scarcest length,
* rounding: the amounts of all configurations are cut to whole numbers and taken while counts
  last; what is left is placed by the same dynamic program under the remaining counts, largest
  length first, each configuration as often as the counts allow, so every step uses up a length.
  A second rounding takes only configurations that leave at most a thousandth of their sequence
  free. The plan with fewer sequences is used. Both run at every size of the table.

Placing is distributed: a piece's rank among its length is its rank in its task plus the counts
of the tasks before; the plan (bounded by ``capacity``, not by the table) maps rank intervals to
sequences and offsets.

Defined results: null text counts as empty and gives the end id alone; null and repeated ids
keep their rows; an empty table gives no rows; texts of any length are cut, never truncated.
Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestrank.llm.common import slices, staged, texts
from nestrank.llm.tokens import encoder as token_encoder

CAPACITY, END = 1024, 2
STEP, SHARPNESS, MAX_STEPS = 0.5, 4.0, 3000

Plan = list[tuple[tuple[int, ...], int]]


def knapsack(prices: np.ndarray, capacity: int) -> list[int]:
    """Lengths, with repeats, of the dearest configuration; ``prices[l]`` is -inf for absent lengths."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        total = prices[1 : room + 1] + best[room - 1 :: -1] if room > 1 else prices[1:2] + best[:1]
        top = int(np.argmax(total))
        if total[top] > best[room - 1]:
            best[room], pick[room] = total[top], top + 1
        else:
            best[room] = best[room - 1]
    out, room = [], capacity
    while room > 0:
        if pick[room] == 0:
            room -= 1
        else:
            out.append(int(pick[room]))
            room -= int(pick[room])
    return out


def fill(left: np.ndarray, first: int, capacity: int) -> list[int]:
    """``first`` and the remaining lengths that fill the rest of its sequence best (exact, by counts)."""
    rest = capacity - first
    best = np.zeros(rest + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for length in np.flatnonzero(left[: rest + 1])[::-1].tolist():
        copies, size = min(int(left[length]) - (length == first), rest // length), 1
        while copies > 0:
            size = min(size, copies)
            weight = size * length
            gain = best[: rest + 1 - weight] + weight * (1 + length / capacity**2)
            better = gain > best[weight:] + 1e-9
            best[weight:] = np.where(better, gain, best[weight:])
            taken.append((length, size, better))
            copies -= size
            size *= 2
        if best[rest] >= rest:
            break
    out, room = [first], rest
    for length, size, better in reversed(taken):
        if room >= size * length and better[room - size * length]:
            out += [length] * size
            room -= size * length
    return out


def program(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Configurations and their fractional amounts, largest first; no length is used more often than it is there."""
    need = left.astype(float)
    sizes = np.arange(capacity + 1, dtype=float)
    absent = need == 0
    covered = np.zeros(capacity + 1)
    amounts: dict[tuple[int, ...], float] = {}
    for _ in range(MAX_STEPS if left.any() else 0):
        low = covered[~absent].min()
        if low >= 1:
            break
        prices = np.where(absent, -np.inf, sizes * np.exp(SHARPNESS * np.clip(low - covered, -50, 0)))
        config = tuple(sorted(knapsack(prices, capacity), reverse=True))
        lengths, uses = np.unique(config, return_counts=True)
        step = STEP * float((need[lengths] / uses).min())
        amounts[config] = amounts.get(config, 0.0) + step
        covered[lengths] += step * uses / need[lengths]
    over = max(1.0, covered.max())
    return [(config, amount / over) for config, amount in sorted(amounts.items(), key=lambda x: -x[1])]


def rounded(amounts: list[tuple[tuple[int, ...], float]], left: np.ndarray, capacity: int, spare: int) -> Plan:
    """Whole numbers of the configurations with at most ``spare`` places free, then a fill of what is left."""
    left, plan = left.copy(), []
    for config, amount in amounts:
        if capacity - sum(config) > spare:
            continue
        lengths, uses = np.unique(config, return_counts=True)
        times = min(int(amount), int((left[lengths] // uses).min()))
        if times:
            plan.append((config, times))
            left[lengths] -= times * uses
    while left.any():
        config = tuple(fill(left, int(np.flatnonzero(left)[-1]), capacity))
        lengths, uses = np.unique(config, return_counts=True)
        times = int((left[lengths] // uses).min())
        plan.append((config, times))
        left[lengths] -= times * uses
    return plan


def sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations and how often each is used; together they hold exactly the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    whole: Plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    amounts = program(left, capacity)
    return whole + min((rounded(amounts, left, capacity, spare) for spare in (capacity // 1000, capacity)), key=sequences)


class Placement:
    """Rank intervals of each length and the sequences and offsets they map to."""

    def __init__(self, plan: Plan) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ends: dict[int, int] = {}
        sequence = 0
        for config, times in plan:
            offset = 0
            for length, uses in zip(*np.unique(config, return_counts=True), strict=True):
                length, uses = int(length), int(uses)
                rows.setdefault(length, []).append((ends.get(length, 0), sequence, uses, offset))
                ends[length] = ends.get(length, 0) + times * uses
                offset += length * uses
            sequence += times
        self.table = {length: np.array(r, np.int64) for length, r in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length).tolist():
            at = np.flatnonzero(length == value)
            table = self.table[value]
            start, base, uses, first = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1].T
            turn, copy = np.divmod(rank[at] - start, uses)
            sequence[at], offset[at] = base + turn, first + copy * value
        return sequence, offset


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 [, ids], task and rank in the task."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = token_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                row, number, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(texts(part, text_col))):
                    raw += tail
                    total, at, k = len(raw) // 4, 0, 0
                    size = total % capacity or capacity
                    while at < total:
                        own = raw[4 * at : 4 * (at + size)]
                        row.append(i), number.append(k), start.append(at), length.append(size)
                        crc.append(zlib.crc32(own)), rank.append(int(seen[size]))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                        seen[size] += 1
                        at, k, size = at + size, k + 1, capacity
                columns = [
                    part.column(id_col).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, schema + ", ids array<int>" * with_ids
    )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: id, piece, start, length, ids_crc32, sequence_id, offset [, ids]."""
    cut = staged(pieces(docs, tokenizer, id_col, text_col, capacity, end, with_ids), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placement = Placement(solve(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placement.place(
                batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            )
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    extra = ["ids"] * with_ids
    return (
        cut.join(firsts, ["length", "task"])
        .select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *extra, (F.col("first") + F.col("rank")).alias("rank"))
        .mapInArrow(
            place,
            f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, "
            + "ids array<int>, " * with_ids + "sequence_id long, offset long",
        )
    )
