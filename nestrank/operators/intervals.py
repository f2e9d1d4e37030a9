"""Stabbing joins: every point with every interval that holds it, as an equi join on cells.

Cells are cut at quantiles of the points, so each holds about as many points, and an interval is
repeated for the cells it touches: two more than its share of the points, whatever the values are.
A value that many points share appears several times among the quantiles; its points are spread
over all cells between those, and every interval that holds the value touches all of them.  So a
hot value is salted in proportion to its weight, with no threshold and no second plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 256
_STEP = 16


def split_points(points: DataFrame, value: str, cells: int = CELLS) -> DataFrame:
    """One row, one array: ``cells`` - 1 quantiles of the known values, over all rows."""
    shares = [i / cells for i in range(1, cells)]
    return points.agg(F.coalesce(
        F.percentile_approx(F.col(value).cast("double"), shares, F.lit(40 * cells)), F.array().cast("array<double>")
    ).alias("splits"))


def _count(splits: Column, test) -> Column:
    """How many of the ordered split points pass a test that only a leading part passes: whole
    steps first, then single ones, so few of them are looked at."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(splits) / F.lit(_STEP)).cast("int")), lambda i: i * _STEP)
    base = F.size(F.filter(steps, lambda i: (i > 0) & F.coalesce(test(F.get(splits, i - 1)), F.lit(False)))) * _STEP
    return base + F.size(F.filter(F.slice(splits, base + 1, F.lit(_STEP)), test))


def _cell_of(v: Column) -> tuple[Column, Column]:
    """First and last cell of a known value; several where the value is a repeated split point."""
    return _count(F.col("_splits"), lambda s: s < v), _count(F.col("_splits"), lambda s: s <= v)


def with_cell(points: DataFrame, value: str, cells: int, name: str, *spread: str, splits: DataFrame | None = None) -> DataFrame:
    """Add the cell of each point: 0 to ``cells`` - 1 by quantile, equal values dealt by the
    ``spread`` columns; -1 to -``cells`` for unknown values."""
    deal = F.xxhash64(*(spread or points.columns))
    v = F.col(value).cast("double")
    first, last = _cell_of(v)
    cut = split_points(points, value, cells) if splits is None else splits
    found = points.withColumn("_splits", cut.scalar()).withColumns({"_first": first, "_last": last})
    cell = F.when(v.isNull(), -F.pmod(deal, F.lit(cells)) - 1).otherwise(
        F.col("_first") + F.pmod(deal, F.col("_last") - F.col("_first") + 1)
    )
    return found.withColumn(name, cell.cast("int")).drop("_splits", "_first", "_last")


def stab_join(
    points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, cells: int = CELLS, spread: str | None = None
) -> DataFrame:
    """Columns of ``points`` and ``intervals`` for every pair with low <= value <= high.

    A null bound does not bind.  A null value meets the intervals that have no bound at all.  Column
    names of the two sides must differ.  ``spread`` is the column by which points of one value are
    dealt to their cells (default: all columns).
    """
    splits = split_points(points, value, cells)
    left = with_cell(points, value, cells, "_cell", *([spread] if spread else []), splits=splits)
    v = F.col(value).cast("double")

    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    right = intervals.withColumn("_splits", splits.scalar())
    start = F.when(lo.isNull() & hi.isNull(), F.lit(-cells)).when(lo.isNull(), F.lit(0)).otherwise(_cell_of(lo)[0])
    end = F.when(hi.isNull(), F.size("_splits")).otherwise(_cell_of(hi)[1])
    right = right.withColumns({"_from": start, "_to": end}).where(
        (F.col("_from") <= F.col("_to")) & (lo.isNull() | hi.isNull() | (lo <= hi))
    ).withColumn("_cell", F.explode(F.sequence("_from", "_to"))).drop("_splits", "_from", "_to")
    holds = (lo.isNull() | F.coalesce(v >= lo, F.lit(False))) & (hi.isNull() | F.coalesce(v <= hi, F.lit(False)))
    # The planner takes the repeated intervals for as small as they were before and would broadcast
    # them, so the join is a merge of one partition a cell; it holds the points of a cell (an equal
    # share of all) while its intervals stream by.
    left, right = left.repartition(cells, "_cell"), right.repartition(cells, "_cell")
    pairs = right.hint("merge").join(left, "_cell").where(holds)
    return pairs.select(*points.columns, *intervals.columns)
