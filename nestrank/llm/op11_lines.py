"""Line dedup by range-sorted hashes; the decision is a keep bitmap per document, not text.

Lines become (hash, document, position) rows.  They are range-partitioned by hash with a
secondary sort by document (largest id first) and position, and streamed once: of a key found in
``min_docs`` documents or more, the lines of the first document stay and all later ones go.  What
goes is folded into bitmaps of 64 lines a word; words without a dropped line are left out, so a
clean document has an empty bitmap.  Built-in columns only, no Python on the data's path.

Hot lines.  A line may stand in a third of all documents.  Its rows are split by document into as
many pieces as there are shuffle partitions, and each piece is streamed on its own: all but the two
first documents of a piece are decided there.  The rest, two documents a piece at most, is streamed
once more over all pieces of the key.

Defined cases: a null or empty text is one empty line; a null id is an id of its own, below all
others; rows that share an id count as one document, and each keeps its own text; keys are 128-bit
hashes of the stripped line with A-Z lower-cased; lines shorter than ``min_chars`` code points
always stay; columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.llm.common import staged

MIN_CHARS, MIN_DOCS = 20, 3
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEEP = "array<struct<word:int,bits:bigint>>"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; plain ASCII takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _pair(*values: Column) -> list[Column]:
    """128 bits as two longs."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(row, u1, u2): the document's own columns in one struct, and the hash of its id and text."""
    row = docs.select(F.struct("*").alias("row"))
    u1, u2 = _pair(F.col("row")[doc_id], _text(text))
    return row.select("row", u1.alias("u1"), u2.alias("u2"))


def _text(text: str) -> Column:
    return F.coalesce(F.col("row")[text], F.lit(""))


def _lines(text: str) -> Column:
    return F.split(_text(text), "\n", -1)


def line_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(u1, u2, doc, pos, h1, h2): every line whose key has ``min_chars`` code points or more."""
    found = _rows(docs, text, doc_id).select(
        "u1", "u2", F.col("row")[doc_id].alias("doc"), F.posexplode(_lines(text)).alias("pos", "line")
    )
    found = found.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.length("line") >= min_chars)
    h1, h2 = _pair(ascii_lower(F.col("line")))
    return found.select("u1", "u2", "doc", "pos", h1.alias("h1"), h2.alias("h2"))


def _streamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``nth`` (number of the row's document inside its key, largest id first) and ``more``
    (a later document follows)."""
    whole = Window.partitionBy(*keys)
    doc = F.struct(F.col("doc").isNotNull(), F.col("doc"))
    nth = F.dense_rank().over(whole.orderBy(F.col("doc").desc_nulls_last()))
    return rows.withColumns({"nth": nth, "_last": F.min(doc).over(whole)}).withColumn(
        "more", F.col("_last") < doc
    ).drop("_last")


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of ``lines`` that go: (u1, u2, pos)."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    pieces = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.pmod(F.xxhash64("doc"), F.lit(pieces)).cast("int")
    ranged = lines.withColumn("piece", piece).repartitionByRange("h1", "h2", "piece")
    # the secondary sort; it also serves the windows below, which need no exchange of their own
    ranged = ranged.sortWithinPartitions("h1", "h2", "piece", F.col("doc").desc_nulls_last(), "pos")
    # decided inside a piece: a document with ``min_docs`` - 1 others before it; the first
    # ``min_docs`` - 1 documents of each piece are streamed again, with whether more follow
    inside = _streamed(ranged, ["h1", "h2", "piece"])
    inside = staged(inside.select("u1", "u2", "doc", "pos", "h1", "h2", "nth", "more"), "op11-inside")
    again = inside.where(F.col("nth") < min_docs).withColumnRenamed("nth", "_nth").withColumn(
        # only the last open document of a piece tells that the piece goes on
        "beyond", (F.col("_nth") == min_docs - 1) & F.col("more")
    ).drop("more")
    key = Window.partitionBy("h1", "h2")
    again = _streamed(again, ["h1", "h2"]).withColumns(
        {"most": F.max("nth").over(key), "any_beyond": F.max("beyond").over(key)}
    )
    repeated = (F.col("most") >= min_docs) | F.col("any_beyond")
    return (
        inside.where(F.col("nth") >= min_docs).select("u1", "u2", "pos")
        .union(again.where(repeated & (F.col("nth") > 1)).select("u1", "u2", "pos"))
    )


def _bitmaps(gone: DataFrame) -> DataFrame:
    """(u1, u2, n_dropped, keep): words of 64 lines in order, a cleared bit for a dropped line."""
    word = F.col("pos").bitwiseAND(F.lit(-64)) / 64
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("u1", "u2", word.cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct("word", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("u1", "u2").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("keep")
    )


def _with_bitmaps(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    lines = staged(line_rows(docs, text, doc_id, min_chars), "op11-lines")
    maps = staged(_bitmaps(dropped_lines(lines, min_docs)), "op11-keep")
    joined = _rows(docs, text, doc_id).join(maps.hint("shuffle_hash"), ["u1", "u2"], "left")
    return joined.select(
        "row", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("keep", F.array().cast(KEEP)).alias("keep"),
    )


def keep_bitmaps(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per document: its id, ``n_lines``, ``n_dropped`` and ``keep``.

    ``keep`` lists (word, bits) for words of 64 lines that lost one; bit i of word w tells whether
    line 64 w + i stays, and words that are not listed stay whole.
    """
    return _with_bitmaps(docs, text, doc_id, min_chars, min_docs).select(
        F.col("row")[doc_id].alias(doc_id), F.size(_lines(text)).cast("long").alias("n_lines"), "n_dropped", "keep"
    )


def _kept_text(text: str) -> Column:
    """The text without its dropped lines.  Gaps between listed words are filled with whole words,
    so each line finds its word by index."""
    def entry(i: Column) -> Column:
        return F.get("keep", i)

    filled = F.flatten(
        F.transform("keep", lambda e, i: F.concat(
            F.array_repeat(F.lit(-1).cast("long"), e["word"] - F.coalesce(entry(i - 1)["word"], F.lit(-1)) - 1),
            F.array(e["bits"]),
        ))
    )
    # both arrays are bound once, not computed anew for each line
    parts = F.array(F.struct(_lines(text).alias("lines"), filled.alias("words")))
    kept = F.get(F.transform(parts, lambda p: F.filter(p["lines"], lambda x, i: F.coalesce(
        F.getbit(F.get(p["words"], F.floor(i / 64).cast("int")), i % 64) == 1, F.lit(True)
    ))), F.lit(0))
    return F.when(F.size("keep") == 0, _text(text)).otherwise(F.array_join(kept, "\n"))


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; a text that loses none stays as it is (null too)."""
    found = _with_bitmaps(docs, text, doc_id, min_chars, min_docs)
    after = F.when(F.col("n_dropped") > 0, _kept_text(text)).otherwise(F.col("row")[text])
    return found.select(*[(after if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every document, by its bitmap."""
    return _with_bitmaps(docs.select(doc_id, text), text, doc_id, MIN_CHARS, MIN_DOCS).select(
        F.col("row")[doc_id].alias(doc_id), F.size(_lines(text)).cast("long").alias("n_lines"), "n_dropped",
        F.sha2(_kept_text(text), 256).alias("kept_sha256"),
    )
