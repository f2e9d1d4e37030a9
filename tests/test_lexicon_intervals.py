"""Lexicon index, stabbing join and many-profile scoring against plain versions."""

from __future__ import annotations

import random

import pytest

from nestrank.operators.intervals import stab_join
from nestrank.operators.lexicon import lexicon_groups, lexicon_hits

TEXTS = [
    (1, "The garden is during the long-lasting renovation of everything around the beautiful courtyard"), (2, ""), (3, None),
    (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"), (5, "É über Straße 😀😀 naïve"), (6, "a"), (7, "line one\nline two\ttabbed"),
    (8, "x" * 5000 + "needle in a very long haystack of text that goes on" + "y" * 4000), (1, "same key, other text"), (None, "garden"),
]
TERMS = [
    "den", "ring", "the", "a", "é", "😀", "😀😀", "straße", "garden", "rden is", "during the long-lasting renovation of everything",
    "during the long-lasting renovation of everybody", "a" * 40, "a" * 39 + "b", "aab", "b", "e\nl", "\t", "needle in a very long haystack of text that goes o",
    "xxxxx", "yy", "Garden", "nowhere", "", None, "the", "courtyard", "ourtyard ", "naïve", "aïv",
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(t, f"g{i % 3}", 1.0) for i, t in enumerate(TERMS)], "term string, grp string, weight double")


def brute_hits():
    out = set()
    for key, text in TEXTS:
        if key is not None:
            out |= {(key, t) for t in TERMS if t and t in (text or "").lower()}
    return out


def test_lexicon_hits(spark, lexicon):
    texts = spark.createDataFrame(TEXTS, "key long, around string")
    got = [tuple(r) for r in lexicon_hits(texts, "key", "around", lexicon).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_hits()
    groups = lexicon_groups(texts, "key", "around", lexicon).collect()
    want = {}
    for key, term in brute_hits():
        for grp in {f"g{i % 3}" for i, t in enumerate(TERMS) if t == term}:
            want[key, grp] = want.get((key, grp), 0) + 1
    assert {(r.key, r.grp): r.hits for r in groups} == want
    assert lexicon_hits(texts, "key", "around", lexicon.limit(0)).count() == 0
    assert lexicon_hits(texts.limit(0), "key", "around", lexicon).count() == 0


def test_lexicon_random_terms(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    terms = {"".join(rng.choice("abc é") for _ in range(rng.randrange(1, 14))) for _ in range(300)}
    terms |= {t[5:5 + n] for _, t in texts for n in (1, 2, 3, 4, 5, 8, 9, 24, 25, 29, 30, 60) if t[5:5 + n]}
    got = lexicon_hits(
        spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([(t,) for t in terms], "term string")
    ).collect()
    assert {tuple(r) for r in got} == {(i, t) for i, x in texts for t in terms if t in x}


def test_large_lexicon_shuffles_no_blocks(spark, monkeypatch):
    from nestrank.operators import lexicon as LXT
    from nestrank.operators import lexicon_scan as scan

    monkeypatch.setattr(LXT, "FEW_GRAMS", 0)
    rng = random.Random(2)
    pool = ["a", "b", "c", " ", "é", "😀", "ab"]
    texts = [(rng.choice([None, *range(12)]), "".join(rng.choices(pool, k=rng.randrange(300))) or None) for _ in range(60)]
    texts += [(7, "c" * 70 + "x" + "ab" * 50), (13, ("ab" * 40 + "é") * 9)]
    terms = {"".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(400)} | {"c" * 70, "c" * 64, "c" * 71, "ab" * 32, "ab" * 40, "Ab", ""}
    want = {(k, t) for k, x in texts for t in terms if k is not None and x and t and t in x}
    tables = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in [*terms, None]], "term string")
    # whole parts and tasks; texts cut into parts; a filter so full that it lets nearly everything through
    for part, words in ((1 << 20, 1 << 23), (40, 1 << 23), (1 << 20, 8)):
        monkeypatch.setattr(scan, "PART", part)
        monkeypatch.setattr(scan, "MOST_WORDS", words)
        monkeypatch.setattr(scan, "SEGMENT", min(words, 1 << 13))
        found = lexicon_hits(tables[0], "id", "text", tables[1])
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "gram" not in found._jdf.queryExecution().toString()
    assert lexicon_hits(*tables[:1], "id", "text", tables[1].limit(0)).count() == 0
    assert lexicon_hits(tables[0].limit(0), "id", "text", tables[1]).count() == 0


@pytest.mark.parametrize("cells", [1, 4, 64])
def test_stab_join(spark, cells):
    rng = random.Random(cells)
    points = [(i, 1000.0 if i % 3 == 0 else None if i % 17 == 0 else float(rng.choice([rng.randrange(5000), 4_000_000 + i]))) for i in range(600)]
    spans = [
        (100, None, None), (101, 1000.0, 1000.0), (102, None, 999.0), (103, 1001.0, None), (104, 500.0, 100.0), (105, -5.0, -1.0),
        (106, 3_900_000.0, None), (107, 0.0, 1e9),
    ] + [(200 + i, float(a), float(a + rng.randrange(2000))) for i, a in enumerate(rng.choices(range(5000), k=40))]
    left = spark.createDataFrame(points, "id long, price double")
    right = spark.createDataFrame(spans, "span long, low double, high double")
    got = [(r.id, r.span) for r in stab_join(left, right, "price", "low", "high", cells).collect()]
    want = {
        (i, s) for i, v in points for s, lo, hi in spans
        if (lo is None or (v is not None and v >= lo)) and (hi is None or (v is not None and v <= hi))
    }
    assert len(got) == len(set(got)) and set(got) == want
    assert stab_join(left.limit(0), right, "price", "low", "high", cells).count() == 0


def test_stab_join_broadcasts_no_intervals(spark):
    left = spark.range(40).selectExpr("id", "CAST(id AS DOUBLE) AS price")
    right = spark.range(9).selectExpr("id AS span", "CAST(NULL AS DOUBLE) AS low", "CAST(id * 4 AS DOUBLE) AS high")
    joined = stab_join(left, right, "price", "low", "high", 8)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.columns == ["id", "price", "span", "low", "high"]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == sum(min(40, 4 * k + 1) for k in range(9))



def test_hot_value_is_spread(spark):
    """A third of the points share one value: the fullest cell stays near the others."""
    left = spark.range(9000).selectExpr("id", "CAST(if(id % 3 = 0, 7, id) AS DOUBLE) AS price")
    right = spark.createDataFrame([(1, 0.0, 9000.0)], "span long, low double, high double")
    rows = stab_join(left, right, "price", "low", "high", 32)
    join = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in join and rows.count() == 9000
    from nestrank.operators.intervals import _count, split_points
    from pyspark.sql import functions as F

    cut = split_points(left, "price", 32).scalar()
    cells = left.withColumn("_splits", cut)
    first, last = (_count(F.col("_splits"), t) for t in (lambda s: s < F.col("price"), lambda s: s <= F.col("price")))
    cells = cells.withColumns({"a": first, "b": last}).withColumn("c", F.col("a") + F.pmod(F.xxhash64("id"), F.col("b") - F.col("a") + 1))
    sizes = [r["count"] for r in cells.groupBy("c").count().collect()]
    assert max(sizes) < 2.5 * 9000 / 32


def _profiles():
    from nestrank.sources.profiles import Profile, purchase_profile, rental_profile

    rental, buy = rental_profile(), purchase_profile()
    rng, out = random.Random(4), {"rental": rental, "empty": Profile(), "bare": Profile(weights={"views": 3.0, "storage": 2})}
    for i in range(5):
        base = rental if i % 2 == 0 else buy
        signals = {
            polarity: {
                g: {"keywords": [w for w in body["keywords"] if rng.random() < 0.8], "weight": round(rng.uniform(0.4, 1.6), 2)}
                for g, body in base.nlp_signals[polarity].items()
            }
            for polarity in ("positive", "negative")
        }
        hard = {"price_max": rng.choice([None, 3000, 6000]), "bedrooms_min": rng.choice([0, 1, 2]), "sqft_min": rng.choice([None, 700])}
        if i != 3:
            hard["neighborhoods"] = rng.sample(["Williamsburg", "SoHo", "Park Slope", "Potrero", "Brooklyn", "Chelsea"], 3)
        out[f"p{i}"] = Profile(
            hard_filters=hard, soft_caps={"price_soft": rng.choice([1000, 2500])} if i != 2 else {},
            weights={k: rng.randrange(0, 15) / 2 for k in base.weights}, nlp_signals=signals,
            location_modifiers={
                "boost_streets": ["Berry St", "PERRY"], "penalize_streets": ["Canal St", "bowery", "Elm"],
                "penalize_conditions": rng.sample(["adjacent_to_bar", "on_major_thoroughfare", "first_floor_busy_street"], 2),
            },
            mode=base.mode,
        )
    return out


def test_many_profiles_equal_single_scoring(spark):
    from nestrank import fixtures as FX
    from nestrank.operators.many_profiles import score_many_profiles
    from nestrank.operators.ranking import score_rows
    from nestrank.sources.profiles import profile_tables

    df = FX.listings(spark, "/root/testdata/sf0.001")
    profiles = _profiles()
    got = {}
    for r in score_many_profiles(df, profile_tables(spark, profiles)).collect():
        assert (r.profile_id, r.id) not in got
        got[r.profile_id, r.id] = (r.points, r.percent)
    for pid in ("rental", "empty", "p0", "p1", "p3"):
        want = {r.id: (r.points, r.percent) for r in score_rows(df, profiles[pid]).where("points IS NOT NULL").collect()}
        mine = {i: v for (p, i), v in got.items() if p == pid}
        assert mine == want, pid
        assert want or pid == "rental"


def test_text_blocks_are_not_broadcast(spark):
    texts = spark.createDataFrame([(1, "a garden den"), (2, "none"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("den",), ("a garden den",)], "term string")
    hits = lexicon_hits(texts, "id", "text", terms)
    assert sorted((r.id, r.term) for r in hits.collect()) == [(1, "a garden den"), (1, "den")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "BuildLeft" not in hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and plan.count("strategy=merge") == 1


def test_pairs_of_a_neighbourhood_are_not_broadcast(spark):
    from nestrank.operators.many_profiles import candidate_pairs

    listings = spark.createDataFrame(
        [(i, 100.0 * i if i % 5 else None, i % 3, 1.0, 500, "AB"[i % 2] if i % 7 else None) for i in range(40)],
        "id long, price double, beds int, baths double, sqft int, neighborhood string",
    )
    rows = [(f"p{k}", 900.0 * k if k % 3 else None, 1.0 if k % 2 else None, None, None, [["A"], ["A", "B"], []][k % 3]) for k in range(9)]
    profiles = spark.createDataFrame(
        rows, "profile_id string, _price_max double, _beds_min double, _baths_min double, _sqft_min double, _hoods array<string>"
    )
    pairs = candidate_pairs(listings, profiles)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    want = sorted(
        (p, r.id) for p, high, beds, _, _, hoods in rows for r in listings.collect()
        if (high is None or (r.price is not None and r.price <= high)) and (beds is None or r.beds >= beds)
        and (not hoods or r.neighborhood in hoods)
    )
    assert sorted((r.profile_id, r.id) for r in pairs.collect()) == want and want


def test_profiles_are_not_broadcast(spark):
    """Only the rows of the two kinds are; whatever there is a row of for every buyer is merged."""
    from nestrank.catalog.many_queries import buyer_tables
    from nestrank.operators.many_profiles import keyword_groups, profile_rows

    tables = buyer_tables(spark, "/root/testdata/sf0.001")
    for name in ("profile_keywords", "profile_streets"):
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == plan.count("BuildRight") == 1, plan
    tables = {n: spark.createDataFrame(t.limit(900).collect(), t.schema) for n, t in tables.items()}
    rows = profile_rows(tables, keyword_groups(tables["profile_keywords"]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 4
    assert rows.count() == rows.select("profile_id").distinct().count() > 0


def test_pairs_are_scored_in_batches(spark, monkeypatch):
    """No join forms a row a pair; small groups and batches, odd streets and keywords give the scores of single profiles."""
    from nestrank import fixtures as FX
    from nestrank.operators import many_profiles as MP
    from nestrank.operators.ranking import score_rows
    from nestrank.sources.profiles import profile_tables

    df = FX.listings(spark, "/root/testdata/sf0.001")
    profiles = {k: v for k, v in _profiles().items() if k in ("empty", "p1", "p3")}
    for p in profiles.values():
        if p.location_modifiers:
            p.location_modifiers["boost_streets"] += ["berry st", "", "Nowhere"]
    monkeypatch.setattr(MP, "HELD", 1)
    monkeypatch.setattr(MP, "DEALT", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scored = MP.score_many_profiles(df, profile_tables(spark, profiles))
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        got = {(r.profile_id, r.id): (r.points, r.percent) for r in scored.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for pid in ("p1", "p3"):
        want = {(pid, r.id): (r.points, r.percent) for r in score_rows(df, profiles[pid]).where("points IS NOT NULL").collect()}
        assert want and {k: v for k, v in got.items() if k[0] == pid} == want
