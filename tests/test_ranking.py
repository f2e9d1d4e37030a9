"""Per-user ranking: bounds never lose a winner, whatever the cells, ties and signs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.functions import scoring as SC
from nestrank.operators import ranking as R
from nestrank.sources.profiles import rental_profile

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def listings(spark):
    df = FX.listings(spark, SF)
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def scores(spark, listings):
    p = rental_profile()
    cand = R.with_scores(R.candidates(listings, p), p)
    return [(r.id, [r[f"s_{c.key}"] for c in SC.CRITERIA], r.pen) for r in cand.withColumn("pen", SC.penalties(p)).collect()]


@pytest.mark.parametrize("cells,k", [(1, 3), (7, 5), (64, 1), (16, 10_000)])
def test_rank_per_user(spark, listings, scores, cells, k):
    rng, users = random.Random(k), {}
    for u in range(25):
        users[u] = [0.0] * len(SC.CRITERIA) if u == 0 else [rng.choice([0.0, 1.0, 7.5, -2.0, 20.0]) for _ in SC.CRITERIA]
    users[24] = users[23]
    rows = [(u, c.key, w) for u, ws in users.items() for c, w in zip(SC.CRITERIA, ws)] + [(3, "no such criterion", 50.0)]
    got = R.rank_per_user(listings, rental_profile(), spark.createDataFrame(rows, "user_id long, criterion string, weight double"), k, cells=cells)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    mine = {}
    for r in got.collect():
        mine.setdefault(r.user_id, []).append((r.rank, r.id, r.points))
    assert scores and set(mine) == set(users)
    for u, ws in users.items():
        points = []
        for i, ss, pen in scores:
            total = 0.0
            for s, w in zip(ss, ws):
                total += s / 10.0 * w
            points.append((-max(0.0, total - pen), i))
        want = [(n, i, -p) for n, (p, i) in enumerate(sorted(points)[:k], 1)]
        assert sorted(mine[u]) == want, u


def test_rank_without_listings(spark, listings):
    weights = spark.createDataFrame([(1, "views", 2.0)], "user_id long, criterion string, weight double")
    assert R.rank_per_user(listings.where(F.lit(False)), rental_profile(), weights, 3).count() == 0
    assert R.rank_per_user(listings, rental_profile(), weights.limit(0), 3).count() == 0
    top = R.rank(listings, rental_profile(), limit=3).collect()
    assert [r.points for r in top] == sorted((r.points for r in top), reverse=True)


def test_band_keeps_every_winner(spark):
    """Only listings that k others beat are left out, and they are: few of the many meet the vectors."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)], float(rng.randrange(2))) for i in range(700)] + [(3, [2.0] * 4, 0.0)]
    scored = spark.createDataFrame(rows, "id long, scores array<double>, penalty double")
    band = [(r.id, r.scores, r.penalty) for r in R._band(scored, 3, [0, 1, 3]).collect()]
    assert len(band) < 250 and all(b in rows for b in band)
    for _ in range(200):
        weights = [rng.choice([0.0, 0.5, 3.0, 7.0]), rng.random(), 0.0, rng.randrange(3)]

        def best(some):
            return sorted((-max(0.0, sum(s / 10.0 * w for s, w in zip(ss, weights)) - pen), i) for i, ss, pen in some)[:3]

        assert best(band) == best(rows)


def test_best_of_a_group_needs_no_full_product():
    """The k best of a group equal the plain sort, whatever the ties, and far more rows than a stretch."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    scores, penalty = rng.integers(0, 9, (3000, 5)) * 1.25, rng.integers(0, 3, 3000) * 1.0
    weights = np.concatenate([rng.integers(-2, 9, (60, 5)) * 0.3, np.zeros((1, 5)), rng.integers(0, 9, (60, 5)) * 0.3])
    listings = pa.table({"id": pa.array(rng.permutation(3000)), "scores": pa.array(scores.tolist()), "penalty": penalty})
    vectors = pa.table({"vector_id": pa.array(range(len(weights))), "weights": pa.array(weights.tolist())})
    ids = listings.column("id").to_numpy()
    for digits in (None, 1):
        got = R._best_of(listings, vectors, 4, digits, 64).to_pylist()
        for v, w in enumerate(weights):
            points = np.zeros(3000)
            for j in range(5):
                points += scores[:, j] / 10.0 * w[j]
            points = np.maximum(0.0, points - penalty)
            points = points if digits is None else np.rint(points * 10.0) / 10.0
            want = sorted(zip(-points, ids))[:4]
            assert [(-r["points"], r["id"]) for r in got if r["vector_id"] == v] == want


def test_user_weights_are_combined_before_the_shuffle(spark, listings):
    """Weights are plain aggregates, a user's second weight for a criterion is an error, vectors are joined by a number first."""
    kind = "user_id long, criterion string, weight double"
    rows = [(1, "views", 2.0), (1, "storage", None), (1, "odd", 9.0), (2, "views", 2.0), (None, "views", 3.0)]
    ranked = R.rank_per_user(listings, rental_profile(), spark.createDataFrame(rows, kind), 2)
    assert "_hash" in ranked._jdf.queryExecution().optimizedPlan().toString()
    got = ranked.collect()
    assert sorted((r.user_id or 0, r.rank) for r in got) == [(u, k) for u in (0, 1, 2) for k in (1, 2)]
    assert {(r.rank, r.id, r.points) for r in got if r.user_id == 1} == {(r.rank, r.id, r.points) for r in got if r.user_id == 2}
    with pytest.raises(Exception, match="several weights"):
        R.rank_per_user(listings, rental_profile(), spark.createDataFrame([*rows, (2, "views", 2.0)], kind), 2).collect()
