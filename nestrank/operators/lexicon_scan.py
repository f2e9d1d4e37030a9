"""Large lexicons: texts are read where they lie, and only what was found leaves a task.

A text of n characters holds far more places than hits, so nothing is shuffled per place.  A bit
filter of the lexicon, of bounded size, says of every byte string whether it may be a term, and for
some lengths whether it may begin one; a task walks all places of its texts at once, a byte a step,
and drops those at which no term can go on.  What the filter lets through is compared with the
lexicon once: the distinct strings found in any text are anti-joined with the terms, and the few that
are none are taken from the hits.  So a lexicon that outgrows the filter costs time, never rows.

UTF-8 strings are searched as bytes.  Inside one part of a text, strings of one term are told by their
64-bit hashes when repetitions are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.session import shared_folder

STEM = 64  # characters of a term that are searched; what is longer is compared with the text
# Lengths in bytes at which the filter knows what begins a term.
STEPS = frozenset((3, 4, 5, 6, 8, 10, 12, 15, 18, 22, 27, 33, 40, 50, 64, 80, 100, 128, 160, 200))
BITS_A_TERM, MOST_WORDS = 48, 1 << 23  # of 64 bits: 64 MB
TERMS_A_TASK, TEXT_A_TASK, PART = 2_000_000, 2 << 20, 1 << 20
SEGMENT = 1 << 13  # words of the filter in a row
MOST_SEEN = 2_000_000  # hashes a task remembers
FEW_WRONG = 1_000_000  # strings that are no terms, which every task can hold
_END = 0xFF  # no byte of UTF-8

_U = np.uint64
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _places(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and the mixed bits of each hash."""
    mixed = h * _MIX
    mixed ^= mixed >> _U(32)
    mixed *= _MIX
    return (mixed >> _U(64 - (words - 1).bit_length())).astype(np.int64), mixed


def _begins(mixed: np.ndarray) -> np.ndarray:
    return (_U(1) << (mixed & _U(63))) | (_U(1) << (mixed >> _U(6) & _U(63)))


def _is_term(mixed: np.ndarray) -> np.ndarray:
    return (_U(1) << (mixed >> _U(12) & _U(63))) | (_U(1) << (mixed >> _U(18) & _U(63))) | (_U(1) << (mixed >> _U(24) & _U(63)))


def _data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings without nulls, and where each starts and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), ends


def filter_of(terms: list[bytes], words: int) -> np.ndarray:
    """The filter of some terms: a bit pattern for each, and for its beginnings of ``STEPS`` bytes."""
    bits = np.zeros(words, _U)
    left = np.fromiter(map(len, terms), np.int64, len(terms))
    pos = np.concatenate([[0], np.cumsum(left)[:-1]]).astype(np.int64)
    data, h, size = np.frombuffer(b"".join(terms), np.uint8), np.zeros(len(terms), _U), 0
    while len(pos):
        h = h * _BASE + data[pos + size] + _U(1)
        size += 1
        word, mixed = _places(h, words)
        last = left == size
        np.bitwise_or.at(bits, word[last], _is_term(mixed[last]))
        on = ~last
        if size in STEPS:
            np.bitwise_or.at(bits, word[on], _begins(mixed[on]))
        pos, h, left = pos[on], h[on], left[on]
    return bits


def _walk(data: np.ndarray, pos: np.ndarray, bits: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, hash) of what the filter takes for a term, from places ``pos`` on."""
    found, h = [], np.zeros(len(pos), _U)
    for size in range(1, longest + 1):
        byte = data[pos + (size - 1)]
        inside = byte != _END
        if not inside.all():
            pos, h, byte = pos[inside], h[inside], byte[inside]
        h = h * _BASE + byte + _U(1)
        word, mixed = _places(h, len(bits))
        word = bits[word]
        want = _is_term(mixed)
        hit = np.flatnonzero((word & want) == want)
        found.append((pos[hit], np.full(len(hit), size), h[hit]))
        if size in STEPS:
            want = _begins(mixed)
            on = np.flatnonzero((word & want) == want)
            pos, h = pos[on], h[on]
        if not len(pos):
            break
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _parts(column: pa.Array, longest: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starting places, their rows) of about ``part`` bytes; a long text is several parts."""
    data, ends = _data(column)
    end, pieces, starts, rows, at = np.full(longest, _END, np.uint8), [], [], [], 0
    for row, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        while low < high:
            stop = min(high, low + part)
            piece = data[low : min(high, stop + longest)]
            begin = np.flatnonzero((piece[: stop - low] & 0xC0) != 0x80)
            pieces += piece, end[:1]
            starts.append(begin + at)
            rows.append(np.full(len(begin), row))
            at, low = at + len(piece) + 1, stop
            if at >= part and sum(map(len, starts)):
                yield np.concatenate([*pieces, end]), np.concatenate(starts), np.concatenate(rows)
                pieces, starts, rows, at = [], [], [], 0
    if sum(map(len, starts)):
        yield np.concatenate([*pieces, end]), np.concatenate(starts), np.concatenate(rows)


def _strings(data: np.ndarray, pos: np.ndarray, size: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[p : p + n] for p, n in zip(pos.tolist(), size.tolist(), strict=True)], pa.binary())


def _without(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which hashes are not among the sorted ones."""
    at = np.searchsorted(seen, h)
    at[at == len(seen)] = 0
    return seen[at] != h if len(seen) else np.ones(len(h), bool)


def lexicon_filter(stems: DataFrame, count: int) -> np.ndarray:
    """The filter of all ``stems``: tasks fill one each, rows of the same segment are united."""
    words = SEGMENT
    while words < MOST_WORDS and 64 * words < BITS_A_TERM * count:
        words *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, _U)
        for batch in batches:
            bits |= filter_of(batch.column(0).cast(pa.binary()).to_pylist(), words)
        for k in range(0, words, SEGMENT):
            if bits[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([bits[k : k + SEGMENT].astype("<u8").tobytes()], pa.binary())], ["first", "bits"]
                )

    def united(table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, "<u8")
        for row in table.column("bits").to_pylist():
            bits |= np.frombuffer(row, "<u8")
        return pa.table({"first": table.column("first")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    kind = "first long, bits binary"
    out = np.zeros(words, _U)
    filled = stems.coalesce(1 + count // TERMS_A_TASK).mapInArrow(fill, kind)
    for row in filled.groupBy("first").applyInArrow(united, kind).toLocalIterator():
        out[row.first : row.first + SEGMENT] = np.frombuffer(row.bits, "<u8")
    return out


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def tabled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/nestrank-lexicon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term) for every term of ``terms`` (term: distinct, not empty) inside a text of ``texts`` (key, text)."""
    spark = texts.sparkSession
    texts = texts.where("length(text) > 0")
    known = terms.select("term", F.substring("term", 1, STEM).alias("stem"))
    count, longest, most = known.agg(F.count("*"), F.max(F.octet_length("stem")), F.max(F.length("term"))).first()
    if not count:
        return texts.where("false").select("key", F.col("text").alias("term"))
    bits = spark.sparkContext.broadcast(lexicon_filter(known.select("stem"), count))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, _U)
        for batch in batches:
            for data, pos, _ in _parts(batch.column(0), longest, PART):
                pos, size, h = _walk(data, pos, bits.value, longest)
                h, at = np.unique(h, return_index=True)
                new = _without(h, seen)
                h, at = h[new], at[new]
                yield pa.RecordBatch.from_arrays([_strings(data, pos[at], size[at])], ["stem"])
                seen = np.union1d(seen, h) if len(seen) < MOST_SEEN else h

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, _U)  # the key that may go on, and what was found in its texts
        for batch in batches:
            names = batch.column(0).to_pylist()
            group = np.cumsum([0, *(not _same(a, b) for a, b in zip(names, names[1:], strict=False))])
            for data, starts, rows in _parts(batch.column(1), longest, PART):
                pos, size, h = _walk(data, starts, bits.value, longest)
                row = rows[np.searchsorted(starts, pos)]
                _, at = np.unique((h ^ group[row].astype(_U) * _MIX) * _BASE, return_index=True)
                first, final = rows[0], rows[-1]
                if len(seen) and _same(last, names[first]):
                    at = at[(group[row[at]] != group[first]) | _without(h[at], seen)]
                else:
                    seen = seen[:0]
                pos, size, h, row = pos[at], size[at], h[at], row[at]
                own = np.sort(h[group[row] == group[final]])
                last, seen = names[final], np.union1d(seen, own) if group[first] == group[final] else own
                _, at, code = np.unique(h, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), _strings(data, pos[at], size[at]).take(pa.array(code))], ["key", "stem"])

    # What the filter took for a term and is none.
    maybe = texts.select("text").mapInArrow(distinct, "stem binary").select(F.col("stem").cast("string")).distinct()
    wrong = tabled(maybe.join(known.select("stem").distinct().hint("merge"), "stem", "left_anti"))
    many = wrong.limit(FEW_WRONG + 1).count()
    # Texts of one key go to one task, in a row; a task holds few enough that its hits need not spill.
    tasks = 1 + (texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // TEXT_A_TASK
    keyed = texts.repartition(tasks, "key").sortWithinPartitions("key")
    kind = texts.schema["key"].dataType.simpleString()
    found = keyed.mapInArrow(hits, f"key {kind}, stem binary").select("key", F.col("stem").cast("string"))
    if many:
        found = found.join(wrong.hint("broadcast" if many <= FEW_WRONG else "merge"), "stem", "left_anti")
    if most < STEM:
        return found.select("key", F.col("stem").alias("term"))
    cut = found.where(F.length("stem") == STEM).join(known.where(F.length("term") >= STEM).hint("merge"), "stem").join(
        texts.hint("merge"), "key"
    ).where(F.contains("text", F.col("term")))
    return found.where(F.length("stem") < STEM).select("key", F.col("stem").alias("term")).union(cut.select("key", "term").distinct())
