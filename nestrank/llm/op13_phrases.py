"""Phrase collocations by dynamic itemset counting.

Texts are packed once into dictionary-encoded blocks of words, dealt to ``shards`` shards.  Rounds
scan one shard each, in a cycle, and count phrases of several lengths at once: single words from
the first round on, a longer phrase from the round after both its subphrases (without the last,
without the first word) have reached the threshold, until it has been counted for one full cycle.
A phrase that appears at least ``min_count`` times has subphrases that do, so every such phrase is
activated and counted exactly once over every shard.

What tasks know of the state is one bitmap per round and length: which phrases reached the
threshold in that round.  Bitmaps are built once and never change, so every task and round derives
the same first round for a phrase; a false hit only starts a phrase's cycle earlier than need be,
and its count is as exact.  Phrases are keyed by their text, never by a hash.  A phrase whose cycle
ends below the threshold leaves the state.

A block ends anywhere: the next one of that language starts with up to three words of context,
which are not counted as ends, so a piece of any length is counted whole.  Counts are combined per
block and per task before they are shuffled.

Defined cases: null text is empty; null language is ``und``; rows may repeat and need no id; empty
tables give no phrase; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestrank.llm.common import mix64, staged

LONGEST = 4
SHARDS = 2
BLOCK_WORDS = 1 << 19
CHUNK = 1 << 15  # words added at once: fewer than a block has distinct words
VOCABULARY = (1 << 16) - 1
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26  # of one bitmap: 8 KB to 8 MB
BREAK = b"\xff"  # between pieces; no UTF-8 text holds it
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
)

BLOCKS = "shard int, lang string, skip int, vocabulary binary, ids binary"
COUNTS = "lang string, n int, phrase string, since int, a long"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in order, ``BREAK`` between and after pieces."""
    return (text.translate(_TABLE).replace(b"\n", b" \xff ") + b" \xff").split()


class Block:
    """Words of one language, as 16-bit ids of a local dictionary; id 0 is a break."""

    def __init__(self, context: list[bytes] = ()) -> None:
        self.known, self.parts, self.size, self.skip = {BREAK: 0}, [], 0, len(context)
        self.tail = list(context)
        if context:
            self.add(context)

    def add(self, words: list[bytes]) -> bool:
        """False if the words don't fit any more; then nothing is added."""
        new = set(words).difference(self.known)
        if self.size + len(words) > BLOCK_WORDS or len(self.known) + len(new) > VOCABULARY:
            return False
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.uint16, count=len(words)))
        self.size += len(words)
        self.tail = (self.tail + words[-LONGEST:])[-(LONGEST - 1):]
        return True

    def context(self) -> list[bytes]:
        last = max((i for i, w in enumerate(self.tail) if w == BREAK), default=-1)
        return self.tail[last + 1:]

    def row(self, shard: int, lang: str) -> dict:
        names = list(self.known)[1:]
        return {
            "shard": shard, "lang": lang, "skip": self.skip, "vocabulary": b" ".join(names),
            "ids": np.concatenate(self.parts).tobytes(),
        }


def _pack(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    task, made, open_blocks = TaskContext.get().partitionId(), 0, {}

    def closed(lang: str) -> pa.RecordBatch:
        nonlocal made
        made += 1
        row = open_blocks.pop(lang).row((task + made) % shards, lang)
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, value in zip(batch.column("lang").to_pylist(), texts):
            words = words_of(value.as_py() or b"")
            for start in range(0, len(words), CHUNK):
                part = words[start:start + CHUNK]
                block = open_blocks.setdefault(lang, Block())
                if not block.add(part):
                    context = block.context()
                    yield closed(lang)
                    open_blocks[lang] = Block(context)
                    open_blocks[lang].add(part)
            if sum(b.size for b in open_blocks.values()) > 4 * BLOCK_WORDS:  # many languages at once
                for name in list(open_blocks):
                    yield closed(name)
    for name in list(open_blocks):
        yield closed(name)


_BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("skip", pa.int32()), ("vocabulary", pa.binary()), ("ids", pa.binary()),
])
_COUNT_SCHEMA = pa.schema([
    ("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("since", pa.int32()), ("a", pa.int64()),
])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _start(lang: str) -> np.ndarray:
    return mix64(_word_hashes([lang.encode()]))


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


NEVER = 1 << 20


def _reached(bitmaps: list[tuple[int, np.ndarray]], hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """First round whose bitmap holds each hash, ``NEVER`` if none does."""
    first = np.full(len(hashes), NEVER, dtype=np.int32)
    for step, bitmap in sorted(bitmaps, key=lambda x: -x[0]):
        first[_held(bitmap, hashes)] = step
    first[~whole] = NEVER
    return first


def block_counts(row: dict, step: int, shards: int, bitmaps: dict) -> Iterator[tuple[int, list[bytes], int, np.ndarray]]:
    """(length, phrases, first round of their cycle, counts) of one block scanned in round ``step``.

    ``bitmaps`` has (round, bitmap) pairs by length.  Length 0 is the number of all words.
    """
    names = [BREAK, *row["vocabulary"].split(b" ")] if row["vocabulary"] else [BREAK]
    ids, skip = np.frombuffer(row["ids"], dtype=np.uint16), row["skip"]
    if step < shards:
        counts = np.bincount(ids[skip:], minlength=len(names))
        counts[0] = 0
        found = np.flatnonzero(counts)
        yield 0, [b""], 0, counts.sum(keepdims=True)
        yield 1, [names[i] for i in found.tolist()], 0, counts[found]
    hashes, codes = _word_hashes(names), ids.astype(np.uint64)
    gram = mix64(_start(row["lang"]) ^ hashes[ids])
    whole, ends = ids != 0, np.arange(len(ids))
    for n in range(2, LONGEST + 1):
        if not bitmaps.get(n - 1):
            return
        reach = _reached(bitmaps[n - 1], gram, whole)
        # from grams of n-1 words at i to grams of n words at i
        last = ids[n - 1:]
        gram = mix64(gram[:-1] ^ hashes[last])
        codes = codes[:-1] | (last.astype(np.uint64) << np.uint64(16 * (n - 1)))
        whole = whole[:-1] & (last != 0)
        ends = ends[1:]
        since = np.maximum(reach[:-1], reach[1:]) + 1
        for first in range(max(0, step - shards + 1), step + 1):
            found, counts = np.unique(codes[(since == first) & whole & (ends >= skip)], return_counts=True)
            columns = [((found >> np.uint64(16 * k)) & np.uint64(0xFFFF)).tolist() for k in range(n)]
            yield n, [b" ".join(map(names.__getitem__, p)) for p in zip(*columns)], first, counts


def _scan(batches: Iterator[pa.RecordBatch], step: int, shards: int, bitmaps) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for n, phrases, since, counts in block_counts(row, step, shards, bitmaps.value):
                if phrases:
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(row["lang"], len(phrases)), pa.repeat(pa.scalar(n, pa.int32()), len(phrases)),
                        pa.array(phrases, pa.binary()).cast(pa.string()),
                        pa.repeat(pa.scalar(since, pa.int32()), len(phrases)), pa.array(counts, pa.int64()),
                    ], schema=_COUNT_SCHEMA)


def _bits(batches: Iterator[pa.RecordBatch], mask: int) -> Iterator[pa.RecordBatch]:
    """(n, slot, bits) of phrases."""
    for batch in batches:
        groups: dict = {}
        for lang, n, phrase in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "phrase"))):
            groups.setdefault((lang, n), []).append(phrase.encode().split(b" "))
        for (lang, n), phrases in groups.items():
            gram = np.broadcast_to(_start(lang), len(phrases))
            for k in range(n):
                gram = mix64(gram ^ _word_hashes([p[k] for p in phrases]))
            at = (gram & np.uint64(mask)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "n": pa.repeat(pa.scalar(n, pa.int32()), len(phrases)), "slot": pa.array(at >> 6),
                "bits": pa.array(np.left_shift(np.int64(1), at & 63)),
            })


def _bitmaps(reached: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """A bitmap by length of the given phrases: 16 bits a phrase up to ``MAX_BITS``.

    The driver gets its words (``MAX_BITS`` / 64 rows a length at most); beyond that size tasks
    count more phrases than they need.
    """
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(sizes.values())).bit_length()))
    rows = reached.select("lang", "n", "phrase").mapInArrow(
        lambda it: _bits(it, bits - 1), "n int, slot long, bits long"
    ).groupBy("n", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    n, slot, held = (rows.column(c).to_numpy() for c in ("n", "slot", "bits"))
    out = {}
    for length in sizes:
        out[length] = np.zeros(bits // 64, dtype=np.uint64)
        out[length][slot[n == length]] = held[n == length].view(np.uint64)
    return out


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, shards: int = SHARDS
) -> DataFrame:
    """(lang, n, phrase, a): exact counts of all phrases of up to ``LONGEST`` words that appear
    ``min_count`` times or more, and of all words of a language as the empty phrase (n = 0)."""
    context = docs.sparkSession.sparkContext
    plain = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    blocks = staged(plain.mapInArrow(lambda it: _pack(it, shards), BLOCKS), "op13-blocks", "shard")
    bitmaps: dict[int, list] = {n: [] for n in range(1, LONGEST)}
    key, open_rows, done, last, step = ("lang", "n", "phrase", "since"), None, [], -1, 0
    ended = F.col("since") + shards
    while step < shards or step <= last + shards:
        shared = context.broadcast(bitmaps)
        scanned = blocks.where(F.col("shard") == step % shards).mapInArrow(
            lambda it, shared=shared, step=step: _scan(it, step, shards, shared), COUNTS
        ).withColumn("reach", F.lit(None).cast("int"))
        both = scanned if open_rows is None else open_rows.unionByName(scanned)
        reach = F.coalesce("reach", F.when(F.col("a") >= min_count, F.lit(step)))
        state = both.groupBy(*key).agg(F.sum("a").alias("a"), F.min("reach").alias("reach")).withColumn("reach", reach)
        over = ended <= step + 1  # the cycle ends with this round; what is too rare by then goes
        state = staged(state.where(~over | (F.col("a") >= min_count) | (F.col("n") == 0)), "op13-state")
        open_rows, new = state.where(~over), state.where((F.col("reach") == step) & F.col("n").between(1, LONGEST - 1))
        done.append(state.where(over))
        sizes = {r.n: r["count"] for r in new.groupBy("n").count().collect()}  # a row a length
        if sizes:
            last = step
            for n, bitmap in _bitmaps(new, sizes).items():
                bitmaps[n].append((step, bitmap))
        shared.unpersist()
        step += 1
    return reduce(DataFrame.union, done).drop("since", "reach")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, cover: int = 80, limit: int = 2000,
    shards: int = SHARDS,
) -> DataFrame:
    """The best ``limit`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase scores floor(2,000,000 a / (l + r)) at its worst cut; it goes if a longer candidate
    holds it and has at least ``cover`` percent of its count.
    """
    totals = staged(phrase_counts(docs, text, lang, min_count, shards), "op13-totals")
    found = totals.where("n > 0")
    candidates = found.where("n > 1").select("lang", "n", "phrase", "a")
    exact = "decimal(20,0)"

    longer = candidates.where("n > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "n")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("n") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")
    )))
    covered = longer.select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    left = candidates.join(covered, ["lang", "phrase"], "left").where(
        F.col("_most").isNull() | (F.col("_most").cast(exact) * 100 < F.col("a").cast(exact) * cover)
    )

    parts = found.where(F.col("n") < LONGEST)
    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).withColumn(
        "_l", F.expr("substring_index(phrase, ' ', k)")
    ).withColumn("_r", F.expr("substring(phrase, length(_l) + 2)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_l"), F.col("a").alias("l")), ["lang", "_l"]).join(
        parts.select("lang", F.col("phrase").alias("_r"), F.col("a").alias("r")), ["lang", "_r"]
    )
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    rank = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    )
    ranked = worst.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", rank).where(F.col("rank") <= limit)
    words = totals.where("n = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
