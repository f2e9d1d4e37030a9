"""Lexicons as tables: which terms occur in which texts, by a gram index and an equi join.

Every term of a lexicon is filed under short grams of itself; a text is cut into blocks of the same
length, each with its surroundings; a term can only occur where one of its grams is a block.  So the
search is one equi join on (block length, gram), and the surroundings decide almost every candidate
on the spot.  Neither the lexicon nor the texts pass the driver, and a term is never part of a
regular expression.  The join is a broadcast of the index; where that is too large, blocks are not
shuffled, since they outweigh the texts many times: ``lexicon_scan`` reads the texts in place.

Block lengths.  A term of 2 b - 1 characters or more holds a whole aligned block of length b,
wherever it starts; it is filed under its grams at offsets 0 to b - 1.  Longer terms take longer
blocks, which are rarer and fewer: a text of n characters gives n / b blocks of length b.  A gram is
a block and the character before it, or after it at offset 0; so a block has two grams, and each is
a tenth as common as the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions.text import lowered
from nestrank.operators.lexicon_scan import scan_hits, tabled

# Block length -> (shortest term that uses it, characters kept after the block).  A term that fits
# in what is kept is decided by the join itself.
BLOCKS = {1: (1, 1), 2: (3, 2), 3: (5, 3), 4: (7, 4), 5: (9, 20)}
FEW_GRAMS = 100_000  # rows of a gram index that every task can hold
PAD = "￿"  # no character of Unicode text


def _width(size: int) -> int:
    """Characters kept of a block: what can precede it inside a term, itself, what follows."""
    return size - 1 + size + BLOCKS[size][1]


def term_index(terms: DataFrame, term: str = "term") -> DataFrame:
    """(size, gram, offset, term): where each distinct, non-empty term of a lexicon is filed."""
    return _filed(_distinct(terms, term))


def _distinct(terms: DataFrame, term: str) -> DataFrame:
    return terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()


def _filed(known: DataFrame) -> DataFrame:
    size = F.lit(None).cast("int")
    for b, (shortest, _) in BLOCKS.items():
        size = F.when(F.length("term") >= shortest, F.lit(b)).otherwise(size)
    return known.withColumn("size", size).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).select(
        "size", F.expr(
            "CASE WHEN size = 1 THEN substring(term, 1, 1) WHEN offset = 0 THEN concat('>', substring(term, 1, size + 1)) "
            "ELSE concat('<', substring(term, offset, size + 1)) END"
        ).alias("gram"), "offset", "term",
    )


def text_blocks(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, size, gram, around): the distinct blocks of every text with their surroundings."""
    def cut(size: int) -> Column:
        padded = F.concat(F.lit(PAD * (size - 1)), text, F.lit(PAD * _width(size)))
        around = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{_width(size)}}})).{{{size}}}"), F.lit(1))
        return F.transform(F.array_distinct(around), lambda w: F.struct(F.lit(size).alias("size"), w.alias("around")))

    blocks = texts.select(F.col(key).alias("key"), F.inline(F.concat(*map(cut, BLOCKS))))
    grams = F.expr(
        "CASE WHEN size = 1 THEN array(substring(around, 1, 1)) ELSE array(concat('>', substring(around, size, size + 1)), "
        "concat('<', substring(around, size - 1, size + 1))) END"
    )
    return blocks.select("key", "size", F.explode(grams).alias("gram"), "around")


def lexicon_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, term) for every term of ``terms`` that occurs in the lower-cased text of a row.

    Substring matching: ``den`` is found in ``garden``.  Terms are taken as written, so one with a
    capital letter is never found; null and empty texts hold none, null and empty terms are never
    found.  Rows of ``texts`` that share a key count as one text, and rows without a key as none.
    """
    plain = texts.where(F.col(key).isNotNull()).select(key, lowered(F.col(text)).alias("_text"))
    known = tabled(_distinct(terms, term))  # read more than once
    index = _filed(known)
    # characters of the term that the surroundings can confirm, counted from the term's start
    kept = F.lit(0)
    for size in BLOCKS:
        kept = F.when(F.col("size") == size, F.lit(_width(size) - size + 1)).otherwise(kept)
    seen = F.least(F.length("term"), kept + F.col("offset"))
    index = index.withColumn("seen", seen).withColumn("whole", F.col("seen") == F.length("term"))
    agrees = F.expr("substring(around, size - offset, seen) = substring(term, 1, seen)")
    if index.limit(FEW_GRAMS + 1).count() > FEW_GRAMS:  # blocks would have to be shuffled
        texts = plain.select(F.col(key).alias("key"), F.col("_text").alias("text"))
        return scan_hits(texts, known).select(F.col("key").alias(key), F.col("term").alias(term))
    # The planner takes the blocks for as small as the rows they are cut from; it would broadcast them.
    found = text_blocks(plain, key, F.col("_text")).join(index.hint("broadcast"), ["size", "gram"]).where(agrees)
    found = found.groupBy("key", "term").agg(F.max("whole").alias("whole"))
    # terms longer than their surroundings: the few candidates left meet the text itself
    rest = found.where(~F.col("whole")).join(
        plain.select(F.col(key).alias("key"), "_text").hint("merge"), "key"
    ).where(F.contains("_text", F.col("term")))
    return found.where("whole").select("key", "term").union(rest.select("key", "term").distinct()).select(
        F.col("key").alias(key), F.col("term").alias(term)
    )


def lexicon_groups(
    texts: DataFrame, key: str, text: str, lexicon: DataFrame, by: Sequence[str] = ("grp",), term: str = "term"
) -> DataFrame:
    """(key, *by, hits): how many terms of each group of a lexicon table occur in each text.

    A term may stand in many groups; each text is matched once against the distinct terms, and only
    what was found meets the groups.
    """
    postings = lexicon.select(*by, term).distinct()
    return lexicon_hits(texts, key, text, lexicon, term).join(postings, term).groupBy(key, *by).agg(
        F.count(F.lit(1)).alias("hits")
    )
