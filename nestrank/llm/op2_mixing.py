"""Token-id files by an adaptive context-mixing range coder.

Ids of consecutive documents (each closed by an end id) are cut into blocks of ``BLOCK`` ids. Every
block starts from a reset model, so it is read without any other, and carries the CRC-32 of its
ids. An id is coded in up to three decisions:

* "is it the order-2 prediction?" The id last confirmed after the two ids before is proposed; its
  probability mixes three predictions in the logistic domain (order 2 by its confidence, order 1
  by its confidence and whether it agrees, order 0 by the recent hit rate) with weights that learn
  after each id;
* if not, "is it the order-1 prediction?", by its confidence;
* if not, the id's four half-bytes under adaptive order-0 counts.

All arithmetic is on integers, so any machine reads what another wrote. A task codes ``LANES``
blocks side by side: every numpy step advances all of them by one id.

The files are a Parquet table of blocks (shard, block, documents with ordinal, start, length in
the block, payload, checksum), shards in ascending id order. A block that fails its checksum
raises an error.

Defined results: null text counts as empty and gives the end id alone; null ids come first;
repeated ids are documents of their own; texts of any length span blocks; an empty table gives an
empty table. Only ``id_col`` and ``text_col`` are read.
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

BLOCK, LANES, END = 4096, 1024, 2
_TOP, _BOTTOM, _WORD = 1 << 24, 1 << 16, (1 << 32) - 1
_TABLE, _SURE = 4096, 15
_NODES = 1 + 16 + 256 + 4096  # contexts of the four half-bytes
_MOST = 1 << 13  # a context's counts are halved beyond this total

# Logistic tables in 12 bits: squash over -2047..2047 in eighths of a nat, stretch its inverse.
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256.0))), 1, 4095).astype(np.int64)
_STRETCH = np.clip(np.rint(256 * np.log(np.arange(1, 4096) / (4096 - np.arange(1, 4096)))), -2047, 2047).astype(np.int64)
_STRETCH = np.concatenate([_STRETCH[:1], _STRETCH])


class _Range:
    """Carry-less range coders, one a lane; writes when ``given`` is None, else reads."""

    def __init__(self, lanes: int, ids: int, given: list[bytes] | None) -> None:
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, _WORD, np.int64)
        self.at = np.zeros(lanes, np.int64)
        self.reads = given is not None
        if given is None:
            self.bytes = np.zeros((lanes, 5 * ids + 16), np.uint8)
        else:
            width = max(map(len, given)) + 8
            self.bytes = np.frombuffer(b"".join(g.ljust(width, b"\0") for g in given), np.uint8).reshape(lanes, width)
            self.code = np.zeros(lanes, np.int64)
            for k in range(4):
                self.code = self.code << 8 | self.bytes[:, k]
            self.at += 4

    def position(self, lanes: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        """Where in 0 .. total - 1 the next symbol lies (reading)."""
        step = self.range[lanes] // total
        return np.minimum((self.code[lanes] - self.low[lanes] & _WORD) // step, total - 1)

    def code_part(self, lanes: np.ndarray, below: np.ndarray, own: np.ndarray, total: np.ndarray | int) -> None:
        """Narrow each lane's range to the symbol's part."""
        step = self.range[lanes] // total
        low = self.low[lanes] + step * below & _WORD
        size = step * own
        while True:
            same = (low ^ (low + size & _WORD)) < _TOP
            short = ~same & (size < _BOTTOM)
            size = np.where(short, -low & (_BOTTOM - 1), size)
            move = same | short
            if move.all():
                self._shift(lanes, low)
                low, size = low << 8 & _WORD, size << 8 & _WORD
            elif move.any():
                go = np.flatnonzero(move)
                self._shift(lanes[go], low[go])
                low[go] = low[go] << 8 & _WORD
                size[go] = size[go] << 8 & _WORD
            else:
                break
        self.low[lanes], self.range[lanes] = low, size

    def _shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        if self.reads:
            self.code[lanes] = (self.code[lanes] << 8 | self.bytes[lanes, at]) & _WORD
        else:
            self.bytes[lanes, at] = low >> 24
        self.at[lanes] = at + 1

    def written(self) -> list[bytes]:
        for _ in range(4):
            lanes = np.arange(len(self.low))
            self._shift(lanes, self.low)
            self.low = self.low << 8 & _WORD
        return [row[:n].tobytes() for row, n in zip(self.bytes, self.at.tolist(), strict=True)]


class _Model:
    """Predictions of all lanes, from the reset state on."""

    def __init__(self, lanes: int) -> None:
        self.guess = [np.zeros((lanes, _TABLE), np.uint16) for _ in (1, 2)]
        self.sure = [np.zeros((lanes, _TABLE), np.uint8) for _ in (1, 2)]
        self.hit2 = np.full((lanes, 16), 1 << 15, np.int64)
        self.agree = np.full((lanes, 32), 1 << 15, np.int64)
        self.hit0 = np.full(lanes, 1 << 13, np.int64)
        self.hit1 = np.full((lanes, 16), 1 << 14, np.int64)
        self.weights = np.full((lanes, 3), 24_000, np.int64)
        self.counts = np.ones((lanes, _NODES, 16), np.uint16)


def _one_bit(coder: _Range, lanes: np.ndarray, chance: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
    """Code or read one decision of probability ``chance`` / 4096."""
    if bit is None:
        bit = coder.position(lanes, 4096) < chance
    coder.code_part(lanes, np.where(bit, 0, chance), np.where(bit, chance, 4096 - chance), 4096)
    return bit


def _literal(coder: _Range, model: _Model, lanes: np.ndarray, value: np.ndarray | None) -> np.ndarray:
    """Code or read an id's half-bytes under the order-0 counts."""
    done = np.zeros(len(lanes), np.int64)
    first = 0
    for level in range(4):
        node = first + done
        counts = model.counts[lanes, node].astype(np.int64)
        ends = counts.cumsum(1)
        total = ends[:, -1]
        if value is None:
            half = (ends <= coder.position(lanes, total)[:, None]).sum(1)
        else:
            half = value >> 4 * (3 - level) & 15
        rows = np.arange(len(lanes))
        own = counts[rows, half]
        coder.code_part(lanes, ends[rows, half] - own, own, total)
        counts[rows, half] += 32
        full = total + 32 > _MOST
        if full.any():
            counts[full] = (counts[full] + 1) >> 1
        model.counts[lanes, node] = counts
        first += 16**level
        done = done << 4 | half
    return done


def _advance(
    coder: _Range, model: _Model, lanes: np.ndarray, one: np.ndarray, two: np.ndarray, ids: np.ndarray | None
) -> np.ndarray:
    """Code or read the next id of each lane after the ids ``one`` and ``two`` (the latest first)."""
    slots = [(one * 40503 >> 4) & (_TABLE - 1), (one * 40503 + two * 30011 + (two >> 3) >> 3) & (_TABLE - 1)]
    guess1, guess2 = (g[lanes, s].astype(np.int64) for g, s in zip(model.guess, slots, strict=True))
    sure1, sure2 = (c[lanes, s].astype(np.int64) for c, s in zip(model.sure, slots, strict=True))
    at1 = sure1 + 16 * (guess1 == guess2)
    chances = (model.hit0[lanes], model.agree[lanes, at1], model.hit2[lanes, sure2])
    inputs = np.stack([_STRETCH[np.clip(c >> 4, 1, 4095)] for c in chances], 1)
    weights = model.weights[lanes]
    chance = _SQUASH[np.clip((weights * inputs).sum(1) >> 16, -2047, 2047) + 2047]
    hit = _one_bit(coder, lanes, chance, None if ids is None else ids == guess2)
    miss = (hit.astype(np.int64) << 12) - chance
    model.weights[lanes] = weights + (inputs * miss[:, None] + (1 << 9) >> 10)
    goal = hit.astype(np.int64) * 65535
    model.hit0[lanes] += goal - chances[0] >> 5
    model.agree[lanes, at1] += goal - chances[1] >> 4
    model.hit2[lanes, sure2] += goal - chances[2] >> 4
    value = np.where(hit, guess2, -1)
    rest = np.flatnonzero(~hit & (guess1 != guess2))
    if len(rest):
        some, level = lanes[rest], sure1[rest]
        chance1 = model.hit1[some, level]
        bit = _one_bit(coder, some, np.clip(chance1 >> 4, 1, 4095), None if ids is None else ids[rest] == guess1[rest])
        model.hit1[some, level] = chance1 + (bit.astype(np.int64) * 65535 - chance1 >> 4)
        value[rest[bit]] = guess1[rest[bit]]
    rest = np.flatnonzero(value < 0)
    if len(rest):
        value[rest] = _literal(coder, model, lanes[rest], None if ids is None else ids[rest])
    for guess, sure, slot, old, level in zip(model.guess, model.sure, slots, (guess1, guess2), (sure1, sure2), strict=True):
        right = value == old
        guess[lanes, slot] = np.where(right | (level > 0), old, value)
        sure[lanes, slot] = np.where(right, np.minimum(level + 1, _SURE), level >> 1)
    return value


def _run(lengths: list[int], ids: list[np.ndarray] | None, payloads: list[bytes] | None) -> tuple[_Range, np.ndarray]:
    """Code or read blocks side by side, longest first, so that the open lanes are a prefix."""
    order = np.argsort([-n for n in lengths], kind="stable")
    sizes = np.array(lengths)[order]
    most = int(sizes[0])
    table = np.zeros((len(sizes), most), np.int64)
    if ids is not None:
        for row, i in enumerate(order.tolist()):
            table[row, : lengths[i]] = ids[i]
    coder = _Range(len(sizes), most, None if payloads is None else [payloads[i] for i in order.tolist()])
    model = _Model(len(sizes))
    one, two = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_lanes = np.searchsorted(-sizes, -np.arange(most), side="left")
    for t in range(most):
        lanes = np.arange(open_lanes[t])
        value = _advance(coder, model, lanes, one[lanes], two[lanes], None if ids is None else table[lanes, t])
        table[lanes, t] = value
        two[lanes] = one[lanes]
        one[lanes] = value
    back = np.argsort(order)
    return coder, table[back]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of ids (0 .. 65535)."""
    out: list[bytes] = []
    for low in range(0, len(blocks), LANES):
        some = blocks[low : low + LANES]
        order = np.argsort([-len(b) for b in some], kind="stable")
        written = _run([len(b) for b in some], some, None)[0].written()
        out += [written[i] for i in np.argsort(order).tolist()]
    return out


def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each block."""
    out: list[np.ndarray] = []
    for low in range(0, len(payloads), LANES):
        sizes = lengths[low : low + LANES]
        table = _run(sizes, None, payloads[low : low + LANES])[1]
        out += [row[:n].astype(np.uint16) for row, n in zip(table, sizes, strict=True)]
    return out


_FILE = "shard int, block int, documents array<struct<doc:{kind},ordinal:long,start:long,length:int>>, length int, ids_crc32 long, payload binary"


def write_blocks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Write the block files of ``docs`` in ascending id order; returns them, read back as a table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = token_encoder(tokenizer), TaskContext.get().partitionId()
        blocks: list[np.ndarray] = []
        notes: list[list[dict]] = []
        parts: list[np.ndarray] = []
        note: list[dict] = []
        room, start, ordinal, number = BLOCK, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows = {
                "shard": pa.array([shard] * len(blocks), pa.int32()),
                "block": pa.array(range(number, number + len(blocks)), pa.int32()),
                "documents": pa.array(notes, file_type),
                "length": pa.array(map(len, blocks), pa.int32()),
                "ids_crc32": pa.array([zlib.crc32(b.astype("<u4").tobytes()) for b in blocks], pa.int64()),
                "payload": pa.array(encode_blocks(blocks), pa.binary()),
            }
            number += len(blocks)
            blocks.clear(), notes.clear()
            return pa.RecordBatch.from_pydict(rows)

        file_type = None
        for batch in batches:
            file_type = pa.list_(
                pa.struct([("doc", batch.column(id_col).type), ("ordinal", pa.int64()), ("start", pa.int64()), ("length", pa.int32())])
            )
            for part in slices(batch, text_col, 2 << 20):
                for doc, raw in zip(part.column(id_col).to_pylist(), coder.encode(texts(part, text_col)), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end)).astype(np.uint16)
                    while len(ids):
                        own, ids = ids[:room], ids[room:]
                        note.append({"doc": doc, "ordinal": ordinal, "start": start, "length": len(own)})
                        parts.append(own)
                        start, room = start + len(own), room - len(own)
                        if not room:
                            blocks.append(np.concatenate(parts)), notes.append(note)
                            parts, note, room = [], [], BLOCK
                    ordinal += 1
                    if len(blocks) >= LANES:
                        yield flush()
        if parts:
            blocks.append(np.concatenate(parts)), notes.append(note)
        if blocks:
            yield flush()

    ordered = docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).repartitionByRange(id_col).sortWithinPartitions(id_col)
    return staged(ordered.mapInArrow(run, _FILE.format(kind=kind)), "token-blocks")


def read_blocks(files: DataFrame) -> DataFrame:
    """One row per document part in a block: shard, ordinal, doc, start, length, ids (packed 16-bit)."""
    kind = files.schema["documents"].dataType.elementType["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, LANES):
                some = batch.slice(low, LANES)
                decoded = decode_blocks(some.column("payload").to_pylist(), some.column("length").to_pylist())
                rows = []
                for shard, crc, docs, ids in zip(
                    some.column("shard").to_pylist(), some.column("ids_crc32").to_pylist(), some.column("documents").to_pylist(), decoded, strict=True
                ):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                        raise ValueError(f"block of shard {shard} fails its checksum")
                    at = 0
                    for d in docs:
                        rows.append((shard, d["ordinal"], d["doc"], d["start"], d["length"], ids[at : at + d["length"]].tobytes()))
                        at += d["length"]
                columns = list(zip(*rows, strict=True))
                doc_type = some.column("documents").type.value_type.field("doc").type
                kinds = (pa.int32(), pa.int64(), doc_type, pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "ordinal", "doc", "start", "length", "ids"]
                )

    return files.mapInArrow(run, f"shard int, ordinal long, doc {kind}, start long, length int, ids binary")


def join_crc32(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of joined byte strings from each one's (length, CRC-32); the code is linear."""
    crc = 0
    for size, own in parts:
        zeros = bytes(size)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own
    return crc


def document_digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from its parts in the files."""
    kind = files.schema["documents"].dataType.elementType["doc"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, np.uint16).astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            kept = batch.select(["shard", "ordinal", "doc", "start", "length"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(crc, pa.int64())], [*kept.schema.names, "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [join_crc32([(4 * p["length"], p["crc"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
            kept = batch.select(["shard", "doc", "start", "n_tokens"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(crc, pa.int64())], [*kept.schema.names, "crc"])

    parts = read_blocks(files).mapInArrow(summed, f"shard int, ordinal long, doc {kind}, start long, length int, crc long")
    whole = (
        parts.groupBy("shard", "ordinal")
        .agg(
            F.first("doc").alias("doc"), F.min("start").alias("start"), F.sum("length").cast("long").alias("n_tokens"),
            F.array_sort(F.collect_list(F.struct("start", "length", "crc"))).alias("parts"),
        )
        .mapInArrow(joined, f"shard int, doc {kind}, start long, n_tokens long, crc long")
    )
    # One row a shard: as many as the writing job had tasks.
    sizes = files.groupBy("shard").agg(F.sum("length").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return whole.join(firsts, "shard").select(
        F.col("doc").alias(id_col), (F.col("first") + F.col("start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )
