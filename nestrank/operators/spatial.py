"""Spatial joins with layers that are tables.

For the built-in layers ``functions.geo`` is enough; these take layers of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestrank.functions import geo

CELL = 0.01  # degrees


def tiles(spark: SparkSession, bbox: tuple[float, float, float, float], step: float = 0.02) -> DataFrame:
    """Tile grid over (lat_low, lon_low, lat_high, lon_high); the last row and column are
    clipped to the box.  Positions come from whole steps, so no error adds up."""
    lat_lo, lon_lo, lat_hi, lon_hi = bbox
    rows = max(1, math.ceil(round((lat_hi - lat_lo) / step, 9)))
    cols = max(1, math.ceil(round((lon_hi - lon_lo) / step, 9)))

    def edge(index: Column, low: float, high: float) -> Column:
        return F.least(F.lit(low) + index * F.lit(step), F.lit(high))

    grid = spark.range(rows).select(F.col("id").cast("int").alias("row")).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    )
    return grid.select(
        "row", "col",
        edge(F.col("row"), lat_lo, lat_hi).alias("lat_low"), edge(F.col("col"), lon_lo, lon_hi).alias("lon_low"),
        edge(F.col("row") + 1, lat_lo, lat_hi).alias("lat_high"), edge(F.col("col") + 1, lon_lo, lon_hi).alias("lon_high"),
    )


def _cell(col: Column) -> Column:
    return F.floor(col / F.lit(CELL)).cast("int")


def _cover(df: DataFrame, lat_low: Column, lat_high: Column, lon_low: Column, lon_high: Column) -> DataFrame:
    return df.withColumn("_row", F.explode(F.sequence(_cell(lat_low), _cell(lat_high)))).withColumn(
        "_col", F.explode(F.sequence(_cell(lon_low), _cell(lon_high)))
    )


def _placed(points: DataFrame) -> DataFrame:
    known = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.withColumns({"_row": _cell(F.col("lat")), "_col": _cell(F.col("lon"))})


def hood_box_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, *map(float, box)) for i, (name, *box, _) in enumerate(geo.HOOD_BOXES)]
    return spark.createDataFrame(
        rows, "ord int, name string, lat_min double, lat_max double, lon_min double, lon_max double"
    )


def boxes_of_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """First box (by ``ord``) holding each point; points outside all boxes are left out."""
    cells = _cover(boxes, F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(
        F.col("lon_min"), F.col("lon_max")
    )
    joined = _placed(points).join(cells, ["_row", "_col"]).filter(inside)
    return joined.groupBy("id").agg(F.min_by("name", "ord").alias("hood"))


def segment_table(spark: SparkSession, layer: str) -> DataFrame:
    rows = [
        (city, *map(lambda v: v, seg)) for city in geo.LAYERS for seg in geo.layer_segments(city, layer)
    ]
    return spark.createDataFrame(
        rows,
        "city string, ord int, name string, severity double, lat1 double, lon1 double, lat2 double, lon2 double",
    )


def nearest_within(points: DataFrame, segments: DataFrame, metres: float) -> DataFrame:
    """Nearest segment closer than ``metres`` for each point inside a coverage box.

    Each segment covers the grid cells it can reach, so the join is an equi join on the
    cell and the distance is the residual test; adaptive execution splits hot cells, and
    the per-point minimum is combined on the map side.
    """
    margin = metres * 1.1 / 110_000.0
    wide = margin / F.cos(F.radians(F.greatest(F.abs("lat1"), F.abs("lat2")) + 1.0))
    cells = _cover(
        segments,
        F.least("lat1", "lat2") - margin, F.greatest("lat1", "lat2") + margin,
        F.least("lon1", "lon2") - wide, F.greatest("lon1", "lon2") + wide,
    )
    located = _placed(points).withColumn("city", geo.coverage(F.col("lat"), F.col("lon")))
    joined = located.join(cells, ["city", "_row", "_col"])
    distance = geo.segment_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    near = joined.withColumn("distance_m", distance).filter(F.col("distance_m") < metres)
    return near.groupBy("id").agg(F.min(F.struct("distance_m", "ord", "name", "severity")).alias("s")).select("id", "s.*")
