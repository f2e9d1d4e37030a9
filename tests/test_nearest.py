"""Nearest segment at any distance, against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from nestrank.operators.nearest import nearest_segments


def metres(lat, lon, lat1, lon1, lat2, lon2):
    sx, sy = lon2 - lon1, lat2 - lat1
    length = sx * sx + sy * sy
    t = max(0.0, min(1.0, ((lon - lon1) * sx + (lat - lat1) * sy) / length)) if length else 0.0
    a2, b2 = lat1 + t * sy, lon1 + t * sx
    a = math.sin(math.radians(a2 - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a2)) * math.sin(math.radians(b2 - lon) / 2) ** 2
    return 6371000.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


@pytest.mark.parametrize("world", [True, False])
def test_nearest_against_all_pairs(spark, world):
    rng = random.Random(world)

    def place():
        if world:
            return rng.uniform(-89, 89), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)])
        return 40.6 + rng.random() / 5, -74 + rng.random() / 5

    segments = []
    for i in range(400):
        lat, lon = place()
        reach = rng.choice([0.0, 0.001, 0.5])
        segments.append((i, lat, lon, lat + rng.uniform(-reach, reach), lon + rng.uniform(-reach, reach)))
    segments += [(1000, *segments[3][1:]), (1001, None, 1.0, 2.0, 3.0), (None, 1.0, 1.0, 2.0, 3.0)]
    points = [(i, *place()) for i in range(150)] + [(500, segments[3][1], segments[3][2]), (501, None, 1.0), (502, -80.0, 10.0), (502, -80.0, 10.0)]
    got = nearest_segments(
        spark.createDataFrame(points, "id long, lat double, lon double"),
        spark.createDataFrame(segments, "segment_id long, lat1 double, lon1 double, lat2 double, lon2 double"),
    ).collect()
    whole = [s for s in segments if None not in s]
    want = {i: min((metres(lat, lon, *s[1:]), s[0]) for s in whole) for i, lat, lon in points if lat is not None}
    assert len(got) == len(want)
    for r in got:
        distance, segment = want[r.id]
        assert abs(r.distance_m - distance) < 1e-4, r
        assert r.segment_id == segment or abs(metres(*[p for p in points if p[0] == r.id][0][1:], *segments[r.segment_id][1:]) - distance) < 1e-4


def test_nearest_of_nothing(spark):
    kind = "segment_id long, lat1 double, lon1 double, lat2 double, lon2 double"
    points = spark.createDataFrame([(1, 1.0, 2.0)], "id long, lat double, lon double")
    assert nearest_segments(points, spark.createDataFrame([], kind)).count() == 0
    assert nearest_segments(points.limit(0), spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], kind)).count() == 0


def test_points_do_not_go_down_the_tree(spark):
    """Rounds carry blocks of places; points meet only their place's result, and nothing is broadcast."""
    points = spark.range(500).selectExpr("id", "40.7D + (id % 7) / 10000D AS lat", "-74D + (id % 5) / 10000D AS lon")
    segments = spark.range(300).selectExpr(
        "id AS segment_id", "40.6D + id / 1000D AS lat1", "-74.1D + id / 1500D AS lon1", "40.6D + id / 1000D AS lat2", "-74.1D + id / 1400D AS lon2"
    )
    found = nearest_segments(points, segments)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(block" in plan and "windowspecdefinition(key" not in plan and "BroadcastHashJoin" not in plan
    rows, layer = found.collect(), [tuple(r) for r in segments.collect()]
    assert len(rows) == 500
    places = {r.id: (r.lat, r.lon) for r in points.collect()}
    for r in rows[::25]:
        assert abs(r.distance_m - min(metres(*places[r.id], *s[1:]) for s in layer)) < 1e-4
