"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a text's bytes cuts it into chunks wherever the hash of the last ``WINDOW``
bytes falls on a mark, so passages that documents share give equal chunks whatever stands around
them. A chunk that occurs twice or more in the corpus is encoded once, by the task that owns its
first occurrence; its ids are joined to every place where it stands. A chunk that occurs once is
encoded where it stands.

Joining two encoded chunks is repaired: a pre-token may cross the cut, or white space before it
may split otherwise. From the first pre-token on that the cut may have changed, the joined text is
split again until a split falls on a split of the right chunk; from there on both agree, since the
pattern looks only ahead. The ids of the re-encoded part replace those of both sides. If the right
chunk ends before they agree, it is taken into the part and the next chunk is tried.

Rows meet by a 128-bit digest of the text, so a text that a third of all rows share is encoded
once and ids are never needed to be unique or set. Texts move between tasks compressed.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows
repeat; characters outside the plain Latin range and special tokens in a text send the text to
the tokenizers library as a whole, as one chunk. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import mix64, slices, staged, texts
from nestrank.llm.tokens import WordEncoder, encoder

WINDOW, MASK_BITS, LEAST = 16, 11, 256
_ODDS = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def _marks(raw: bytes) -> np.ndarray:
    """Places where the rolling hash of the ``WINDOW`` bytes up to there falls on a mark.

    The hash of a window is the sum of its bytes' random numbers, each turned by its place.
    """
    data = np.frombuffer(raw, np.uint8)
    rolled = _ODDS[data]
    width = 1
    while width < WINDOW:  # doubling: each step joins two windows of half the width
        before = rolled[:-width]
        rolled[width:] += (before << np.uint32(width)) + (before >> np.uint32(32 - width))
        width *= 2
    return np.flatnonzero(rolled < np.uint32(1 << (32 - MASK_BITS)))


def cuts(raws: list[bytes]) -> list[list[int]]:
    """Ends of the content-defined chunks of each UTF-8 text; the last end is its length.

    Cuts lie on ASCII bytes only and at least ``LEAST`` bytes apart. The texts are hashed in
    one row: a cut's window is shorter than ``LEAST``, so it never reaches into another text.
    """
    if not raws:
        return []
    starts = np.cumsum([0, *map(len, raws)])
    row = b"".join(raws)
    marks = _marks(row) if len(row) > LEAST else np.zeros(0, np.int64)
    bounds = np.searchsorted(marks, starts).tolist()
    places, found = marks.tolist(), []
    for raw, start, low, high in zip(raws, starts.tolist(), bounds, bounds[1:]):
        ends, last, size = [], 0, len(raw)
        for mark in places[low:high]:
            end = mark - start + 1
            if end - last >= LEAST and end < size and raw[end] < 128 and raw[end - 1] < 128:
                ends.append(end)
                last = end
        found.append([*ends, size] if size else [])
    return found


ROW = 1 << 15  # bytes hashed in one row; its arrays stay in the cache


def _chunked(items: list[str]) -> Iterator[tuple[bool, list[str]]]:
    """Of each text: does the library take it whole, and its chunks."""
    low = 0
    while low < len(items):
        part, held = [], 0
        while low < len(items) and (not part or held < ROW):
            part.append(items[low])
            held += len(items[low])
            low += 1
        whole = list(map(_is_whole, part))
        raws = [b"" if w else t.encode("utf-8") for t, w in zip(part, whole, strict=True)]
        for text, w, raw, ends in zip(part, whole, raws, cuts(raws), strict=True):
            yield w, [text] if w else [raw[a:b].decode("utf-8") for a, b in zip([0, *ends[:-1]], ends)]


def _hash(chunk: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk.encode("utf-8"))


def join_chunks(coder: WordEncoder, chunks: list[str], ids: list[bytes]) -> bytes:
    """Ids of the joined text from the ids of its chunks, each join repaired."""
    find = coder.find.__self__.finditer
    out: list[bytes] = []
    held, held_ids = chunks[0], ids[0]  # text whose ids are known, not yet written
    for chunk, chunk_ids in zip(chunks[1:], ids[1:], strict=True):
        # The left side's first split that following text may change: it ends the text, or starts so
        # late that a longer branch ('ll) may still match. The pattern runs over the last words only.
        start = max(held.rfind(" ", 0, max(len(held) - 1, 0)), 0)
        while start > 0 and held[start - 1].isspace():
            start -= 1
        spans = [m.span() for m in find(held, start)]
        late = [s for s in spans if s[1] == len(held) or s[0] + 3 > len(held)]
        last = late[0][0]
        right = iter(m.end() for m in find(chunk))
        joined = held[last:] + chunk
        offset = len(held) - last
        ends, agreed = [], None
        target = next(right, None)
        for m in find(joined):
            ends.append(m.end())
            at = m.end() - offset
            while target is not None and target < at:
                target = next(right, None)
            # What is written out must not depend on the chunk after this one either.
            settled = m.start() + 3 <= len(joined) and m.end() < len(joined)
            if settled and at == target and at > 0:
                agreed = at
                break
        tail = coder.few_ids([held[a:b] for a, b in late])
        kept = held_ids[: len(held_ids) - len(tail)]
        if agreed is None:
            words = coder.pre_tokens(joined)
            out.append(kept)
            held, held_ids = joined, coder.few_ids(words)
            continue
        words = [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        skipped = coder.few_ids(coder.pre_tokens(chunk[:agreed]))
        out += [kept, coder.few_ids(words)]
        held, held_ids = chunk[agreed:], chunk_ids[len(skipped) :]
    out.append(held_ids)
    return b"".join(out)


def _is_whole(text: str) -> bool:
    return not WordEncoder.plain(text)


def _listed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, hashes) of every row: the digest of its text and of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                keys, hashes = [], []
                items = list(texts(part, text_col))
                for text, (_, chunks) in zip(items, _chunked(items), strict=True):
                    keys.append(hashlib.blake2b(text.encode("utf-8"), digest_size=16).digest())
                    hashes.append(b"".join(map(_hash, chunks)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], ["id", "key", "hashes"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"id {kind}, key binary, hashes binary"
    )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a text: its hash, the text's key, its place."""
    for batch in batches:
        rows, hashes, places = [], [], []
        for i, packed in enumerate(batch.column("hashes").to_pylist()):
            found = [packed[a : a + 16] for a in range(0, len(packed), 16)]
            rows += [i] * len(found)
            hashes += found
            places += range(len(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.binary()), batch.column("key").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32())],
            ["hash", "key", "place"],
        )


def _packed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, body): each row's text, compressed for the way between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, text_col):
                raws = [text.encode("utf-8") for text in texts(part, text_col)]
                keys = [hashlib.blake2b(raw, digest_size=16).digest() for raw in raws]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(map(pack, raws), pa.binary())], ["key", "body"]
                )

    return docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "key binary, body binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for i, body in enumerate(batch.column("body").to_pylist()):
        yield i, unpack(body).decode("utf-8")


def _encode_chunk(coder: WordEncoder, chunks: list[str], whole: bool) -> list[bytes]:
    return coder.by_library(chunks) if whole else coder.word_ids([coder.pre_tokens(c) for c in chunks])


def _owned(tokenizer: str):
    """(hash, ids) of the shared chunks that a text owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, "body", 2 << 20)):
            hashes, ids = [], []
            for i, (whole, chunks) in enumerate(_chunked([text for _, text in _unpacked(batch)])):
                own = [chunks[p] for p in batch.column("places")[i].as_py()]
                hashes += map(_hash, own)
                ids += _encode_chunk(coder, own, whole)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(map(_shrunk, ids), pa.binary())], ["hash", "ids"])

    return run


def _shrunk(ids: bytes) -> bytes:
    """Ids as 16-bit numbers where all fit; a leading byte tells."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids


def _widened(packed: bytes) -> bytes:
    return np.frombuffer(packed[1:], "<u2").astype("<u4").tobytes() if packed[0] == 2 else packed[1:]


def _joined(tokenizer: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        pieces = coder.id_bytes()
        digits = list(map(str, range(len(pieces))))
        for batch in (part for whole in batches for part in slices(whole, "body", 2 << 20)):
            given = batch.column("given").to_pylist()
            items = [text for _, text in _unpacked(batch)]
            found = [(text, whole, chunks) for text, (whole, chunks) in zip(items, _chunked(items), strict=True)]
            ids = [{g["place"]: _widened(g["ids"]) for g in some or ()} for some in given]
            done: list[bytes] = []
            for low in range(0, len(found), 128):
                some = range(low, min(low + 128, len(found)))
                alone = [(i, p) for i in some if not found[i][1] for p in range(len(found[i][2])) if p not in ids[i]]
                for (i, p), own in zip(alone, coder.word_ids([coder.pre_tokens(found[i][2][p]) for i, p in alone]), strict=True):
                    ids[i][p] = own
                for i in some:
                    text, whole, chunks = found[i]
                    if whole and 0 not in ids[i]:
                        ids[i][0] = coder.by_library([text])[0]
                    done.append(join_chunks(coder, chunks, [ids[i][p] for p in range(len(chunks))]) if chunks else b"")
                    ids[i] = {}
            lists = [np.frombuffer(x, "<u4").tolist() for x in done]
            decoded = [b"".join(map(pieces.__getitem__, x)).decode("utf-8", "replace") for x in lists]
            columns = [
                batch.column("key"),
                pa.array(map(len, lists), pa.int64()),
                pa.array([hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in lists], pa.string()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_decode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]."""
    listed = staged(_listed(docs, id_col, text_col), "chunks")
    distinct = listed.groupBy("key").agg(F.first("hashes").alias("hashes"))
    places = distinct.select("key", "hashes").mapInArrow(_places, "hash binary, key binary, place int")
    shared = staged(
        places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("owner")).where("n > 1"),
        "shared",
    )
    owners = shared.groupBy(F.col("owner.key").alias("key")).agg(F.collect_list("owner.place").alias("places"))
    bodies = _packed_texts(docs, text_col).groupBy("key").agg(F.first("body").alias("body"))
    encoded = staged(bodies.join(owners, "key").select("body", "places").mapInArrow(_owned(tokenizer), "hash binary, ids binary"), "ids")
    given = (
        places.join(encoded, "hash").groupBy("key").agg(F.collect_list(F.struct("place", "ids")).alias("given"))
    )
    extra = ", ids array<int>, decoded string" * with_ids
    results = bodies.join(given, "key", "left").select("key", "body", "given").mapInArrow(
        _joined(tokenizer, with_ids), f"key binary, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"
    )
    return listed.select(F.col("id").alias(id_col), "key").join(results, "key").drop("key")
