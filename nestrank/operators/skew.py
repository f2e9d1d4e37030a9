"""Ordered operators over keys that may hold a large share of the rows.

An ordered operator over one key (previous row, running state) cannot be combined before the
shuffle. A key of up to ``WHOLE_ROWS`` rows is one window; a larger one is cut into pieces of the
order, so a key that holds a third of the table is as many windows as it has pieces. The number of
larger keys is bounded by the rows over ``WHOLE_ROWS``, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_SECONDS = 6 * 3600
WHOLE_ROWS = 100_000  # of a key that is one window


def previous(
    df: DataFrame, key: str, order: list[str], value: Column, piece: Column, name: str = "_prev", whole: int = WHOLE_ROWS
) -> DataFrame:
    """Add the ``value`` of the previous row of the same key in ``order``.

    ``piece`` is monotone in the order and cuts keys of more than ``whole`` rows. Each (key, piece)
    is one window, with the last value of the nearest earlier piece put before its rows. The rows
    themselves are shuffled once; last values come from the rows of cut keys only, one a piece, and
    only those are ordered per key.
    """
    large = df.groupBy(key).count().where(F.col("count") > whole).select(F.col(key).alias("_large"), F.lit(True).alias("_is_large"))
    cut = df.withColumns({"_value": value, "_piece": piece})
    cut = cut.join(F.broadcast(large), cut[key].eqNullSafe(large["_large"]), "left").withColumn(
        "_piece", F.when(F.col("_is_large"), F.col("_piece"))
    )
    tails = cut.where("_is_large").groupBy(key, "_piece").agg(F.max_by("_value", F.struct(*order)).alias("_tail"))
    before = Window.partitionBy(key).orderBy("_piece")
    carried = tails.select(key, "_piece", F.lag("_tail").over(before).alias("_value")).where("_value IS NOT NULL")
    rows = cut.select(*df.columns, "_value", "_piece", F.lit(1).alias("_row"))
    both = rows.unionByName(carried.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    window = Window.partitionBy(key, "_piece").orderBy("_row", *order)
    return both.withColumn(name, F.lag("_value").over(window)).where("_row = 1").select(*df.columns, name)
