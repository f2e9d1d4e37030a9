"""Nearest member of a layer of any size, at any distance: branch and bound down a tree of boxes.

Segments are sorted into a tree by their midpoints, 16 children a node, each node with the box of all
its segments.  Places (points that share coordinates are one) are gathered into blocks, the occupied
cells of the leaves' grid, and only the blocks go down the tree, one level a round; a node stays a
candidate of a block while its box could hold something nearer to it than the worst case of the
block's best node.  So a block keeps a handful of nodes per level wherever it lies, next to the layer
or an ocean away; a place drops those of its block's last boxes that are too far for it, and meets
only the segments of the others.  No distance limit, no layer at the driver, no point x segment
product: every round is an equi join on node keys, and the points themselves are in none of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.functions import geo

LEVELS = 9  # leaves of 360 / 4**9 degrees, about 150 metres
ENDS = ("lat1", "lon1", "lat2", "lon2")
BOX = ("south", "north", "west", "east")


def _half_square(degrees: Column) -> Column:
    return F.pow(F.sin(F.radians(degrees) / 2), 2)


def _metres(dlat: Column, dlon_square: Column, cosine: Column) -> Column:
    a = F.least(F.lit(1.0), _half_square(dlat) + cosine * cosine * dlon_square)
    return F.lit(geo.EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def box_bounds(here: Sequence[Column], there: Sequence[Column]) -> tuple[Column, Column]:
    """No places of two boxes (see ``BOX``) are nearer than the first, none are farther than the second (metres).

    Haversine grows with the difference in latitude, and with that in longitude up to 180 degrees,
    after which it falls; so its extremes over boxes are at their edges or at 180.
    """
    (south, north, west, east), (south2, north2, west2, east2) = here, there
    zero = F.lit(0.0)
    cosines = [F.cos(F.radians(x)) for x in (south, north, south2, north2)]
    equator = ((south <= 0) & (north >= 0)) | ((south2 <= 0) & (north2 >= 0))
    widest = F.when(equator, F.lit(1.0)).otherwise(F.greatest(*cosines))
    least = F.greatest(zero, west2 - east, west - east2)
    most = F.greatest(F.abs(east - west2), F.abs(east2 - west))
    ends = _half_square(least), _half_square(most)
    across = F.when((least <= 180) & (most >= 180), F.lit(1.0)).otherwise(F.greatest(*ends))
    near = _metres(F.greatest(zero, south2 - north, south - north2), F.least(*ends), F.greatest(zero, F.least(*cosines)))
    far = _metres(F.greatest(F.abs(north - south2), F.abs(north2 - south)), across, widest)
    # some room for the rounding of either formula
    return near * (1 - 1e-9), far * (1 + 1e-9) + 1e-3


def _cell(level: int, lat: Column, lon: Column) -> Column:
    """Node key of a place: row and column of the level's grid in one number."""
    size = 360.0 / 4**level
    row, column = F.floor((lat + 90.0) / size), F.floor((lon + 180.0) / size)
    return row * F.lit(4**level + 1) + column


def box_tree(segments: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Per level (parent, node, box) of the occupied nodes; a segment is in one node a level."""
    lat1, lon1, lat2, lon2 = (F.col(c) for c in ENDS)
    middle = (lat1 + lat2) / 2, (lon1 + lon2) / 2
    out = []
    for level in range(1, levels + 1):
        out.append(segments.groupBy(_cell(level - 1, *middle).alias("parent"), _cell(level, *middle).alias("node")).agg(
            F.min(F.least(lat1, lat2)).alias("south"), F.max(F.greatest(lat1, lat2)).alias("north"),
            F.min(F.least(lon1, lon2)).alias("west"), F.max(F.greatest(lon1, lon2)).alias("east"),
        ))
    return out


def nearest_segments(points: DataFrame, segments: DataFrame, key: str = "id", levels: int = LEVELS) -> DataFrame:
    """(key, segment_id, distance_m) of the nearest segment of every located point.

    ``points``: key, lat, lon; ``segments``: segment_id, lat1, lon1, lat2, lon2.  Distances are those
    of ``geo.segment_m``; of equally near segments the smaller id wins.  Points without coordinates
    have no row; rows that share a key count as one point if their places are equal.
    """
    lat, lon = F.col("lat"), F.col("lon")
    located = segments.dropna(subset=["segment_id", *ENDS]).select("segment_id", *ENDS)
    asked = points.select(F.col(key).alias("key"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).dropna().distinct()
    places = asked.select("lat", "lon").distinct().withColumn("block", _cell(levels, lat, lon))
    edges = F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")
    blocks = places.groupBy("block").agg(F.struct(*[e.alias(c) for e, c in zip(edges, BOX)]).alias("_around"))
    around = [F.col("_around")[c] for c in BOX]
    whole = located.select(_cell(0, F.lit(0.0), F.lit(0.0)).alias("node")).distinct()  # one row, or none
    open_nodes = blocks.withColumn("node", whole.scalar())
    for tree in box_tree(located, levels):
        near, far = box_bounds(around, [F.col(c) for c in BOX])
        down = open_nodes.withColumnRenamed("node", "parent").join(tree.hint("merge"), "parent").withColumns({"_near": near, "_far": far})
        down = down.withColumn("_reach", F.min("_far").over(Window.partitionBy("block")))
        open_nodes = down.where(F.col("_near") <= F.col("_reach")).select("block", "_around", "node", *BOX)
        last, open_nodes = open_nodes, open_nodes.drop(*BOX)
    # the boxes left to a block, in one row: each place looks through them where it is
    boxes = last.groupBy("block").agg(F.collect_list(F.struct("node", *BOX)).alias("_boxes"))

    def bounded(box: Column) -> Column:
        near, far = box_bounds((lat, lat, lon, lon), [box[c] for c in BOX])
        return F.struct(box["node"].alias("node"), near.alias("near"), far.alias("far"))

    near_by = places.join(boxes.hint("merge"), "block").select("lat", "lon", F.transform("_boxes", bounded).alias("_boxes"))
    near_by = near_by.withColumn("_reach", F.array_min(F.transform("_boxes", lambda b: b["far"])))
    left = near_by.select("lat", "lon", F.explode(F.transform(
        F.filter("_boxes", lambda b: b["near"] <= F.col("_reach")), lambda b: b["node"]
    )).alias("node"))
    lat1, lon1, lat2, lon2 = (F.col(c) for c in ENDS)
    leaves = located.withColumn("node", _cell(levels, (lat1 + lat2) / 2, (lon1 + lon2) / 2))
    met = left.join(leaves.hint("merge"), "node").withColumn("distance_m", geo.segment_m(lat, lon, lat1, lon1, lat2, lon2))
    best = met.groupBy("lat", "lon").agg(F.min(F.struct("distance_m", "segment_id")).alias("_best"))
    return asked.join(best.hint("merge"), ["lat", "lon"]).select(
        F.col("key").alias(key), F.col("_best.segment_id").alias("segment_id"), F.col("_best.distance_m").alias("distance_m")
    )
