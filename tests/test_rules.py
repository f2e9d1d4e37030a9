"""Literal cases of the rules."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.functions import lexicon as LX
from nestrank.functions import text as TX
from nestrank.operators import changes as CH
from nestrank.operators import ingest as IN
from nestrank.operators import skew
from nestrank.operators.filters import hard_failures, with_signal_failures
from nestrank.operators.ranking import with_scores
from nestrank.operators.signals import apply_flags, extract_flags
from nestrank.sources import pages as PG
from nestrank.sources.profiles import compile_profile

PROFILE = {
    "hard_filters": {"price_max": 3500000, "bedrooms_min": 3, "bathrooms_min": 2, "sqft_min": 1600, "neighborhoods": ["Noe Valley"]},
    "soft_caps": {"price_soft": 3000000},
    "weights": {"natural_light": 10, "outdoor_space": 9, "character_soul": 8, "kitchen_quality": 7},
    "nlp_signals": {
        "positive": {
            "light": {"keywords": ["natural light", "sunny", "bright"], "weight": 1.0},
            "outdoor": {"keywords": ["balcony", "terrace", "deck", "garden"], "weight": 1.0},
            "outdoor_private": {"keywords": ["private terrace", "private balcony"], "weight": 1.0},
        },
        "negative": {
            "dark": {"keywords": ["dark", "dim", "cozy"], "weight": 0.6},
            "no_pets": {"keywords": ["no pets"], "weight": 0.0},
            "weak_outdoor": {"keywords": ["juliet balcony"], "weight": 0.8},
        },
    },
}
TEXTS = [
    (1, 4000000.0, "Sunny home with deck."),
    (2, 2200000.0, "Cozy and dark interior with dim lighting."),
    (3, 2200000.0, "Bright home with natural light and a private terrace off the living room."),
    (4, 2200000.0, "Bright home with natural light and a juliet balcony."),
    (5, 2200000.0, "Bright home with natural light and garden deck. No pets allowed."),
]


def _listings(spark):
    return spark.createDataFrame(TEXTS, "id long, price double, description string").selectExpr(
        "*", "3 AS beds", "2D AS baths", "1700 AS sqft", "'Noe Valley' AS neighborhood", "CAST(NULL AS STRING) AS listing_status"
    )


def test_rejections(spark):
    p = compile_profile(PROFILE)
    df = with_signal_failures(_listings(spark), p).withColumn("hard", hard_failures(p))
    rows = {r.id: r for r in df.collect()}
    assert rows[1].hard == ["price above max"]
    assert rows[2].signal_failures == ["dark interior signals"]
    assert rows[3].hard == [] and rows[3].signal_failures == []
    assert rows[5].signal_failures == ["no pets allowed"]


def test_outdoor_tiers(spark):
    scores = {r.id: r.s_outdoor_space for r in with_scores(_listings(spark), compile_profile(PROFILE)).select("id", "s_outdoor_space").collect()}
    assert scores[3] >= 7.0 and scores[4] <= 6.5


def test_term_index_finds_nested_and_overlapping_terms(spark):
    groups = {"a": ["deck", "deck area", "roof deck", "ring"], "b": ["during", "área", "a.b"], "c": []}
    texts = ["roof deck area during", "a.b axb", "ÁREA", "", None]
    index = TX.TermIndex(groups)
    df = index.with_words(spark.createDataFrame([(t,) for t in texts], "t string"), TX.lowered(F.col("t")))
    got = df.select(index.count("a").alias("a"), index.count("b").alias("b"), index.any("c").alias("c")).collect()
    for text, row in zip(texts, got):
        low = (text or "").lower()
        assert row.a == sum(k in low for k in groups["a"])
        assert row.b == sum(k in low for k in groups["b"])
        assert row.c is False


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="denrig abk-", max_size=40), min_size=1, max_size=20))
def test_scan_equals_contains(spark, texts):
    terms = ["den", "ring", "garden", "d", "ri", "rin", "a b", "-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", TX.found_hits(TX.scan(F.col("t"), terms), terms).alias("h")).collect():
        assert row.h == [k for k in terms if k in row.t]


def test_deciding_terms():
    assert LX.deciding_terms(["deck", "roof deck", "patio"]) == ["deck", "patio"]


def test_explicit_flag_beats_text(spark):
    df = spark.createDataFrame([(1, True, "Quiet home."), (2, None, "Doorman building.")], "id long, has_doorman_keywords boolean, description string")
    rows = {r.id: r for r in apply_flags(extract_flags(df)).collect()}
    assert rows[1].has_doorman_keywords is True and rows[2].has_doorman_keywords is True
    assert rows[1].is_price_reduced is None and rows[1].has_gym_keywords is False


def test_canonical_url(spark):
    cases = {
        "http://www.site.com/building/138-frost-street/1/rental/123?utm=1#p": "https://site.com/building/138-frost-street/1/rental/123",
        "https://site.com.evil.com/building/x/rental/1": None,
        "https://site.com/building/four-wharf/702?featured=1": "https://site.com/building/four-wharf/702",
        "https://site.com/rental/4329421?card=1": "https://site.com/rental/4329421",
        "https://site.com/building/four-wharf": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for row in df.select("u", CO.canonical_url(F.col("u"), "site.com", CO.UNIT_PATH).alias("c")).collect():
        assert row.c == cases[row.u], row.u


def test_targeting_and_amenities(spark):
    html = (
        '<meta property="og:title" content="416 Kent Avenue #2207N in Williamsburg | X" />'
        'setTargeting("price", "4605");setTargeting("bd", "2");setTargeting("ba", "2.5");setTargeting("sqft", "1200");setTargeting("hood", "williamsburg");'
    )
    row = PG.mine_targeting(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row.price, row.beds, row.baths, row.sqft, row.neighborhood, row.address) == (4605.0, 2, 2.5, 1200, "Williamsburg", "416 Kent Avenue #2207N")
    df = spark.createDataFrame([("Outdoor Bike Storage",), ("Private Terrace Gym",)], "t string")
    assert [r.has_outdoor_space_keywords for r in PG.mine_detail_text(df, "t").collect()] == [None, True]


def test_previous_row_of_hot_keys(spark):
    rows = [(k, d, i, float(i * d + k)) for k in (1, 2) for d in (1, 3, 4) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, d int, i int, v double")
    whole = Window.partitionBy("k").orderBy("d", "i")
    plain = sorted(map(str, df.withColumn("_prev", F.lag("v").over(whole)).collect()))
    for piece in (F.col("d"), F.lit(0), F.col("d") * 10 + F.col("i")):  # days, one piece, a piece per row
        cut = skew.previous(df, "k", ["d", "i"], F.col("v"), piece)
        assert sorted(map(str, cut.collect())) == plain


def test_previous_row_of_cut_keys(spark):
    rows = [(k, d, i, None if d == 3 and i == 2 else float(i * 7 + (d or 0))) for k in (1, 2, None) for d in (None, 1, 3, 4) for i in range(3) if k != 2 or i == 0]
    df = spark.createDataFrame(rows, "k long, d int, i int, v double")
    plain = sorted(map(str, df.withColumn("_prev", F.lag("v").over(Window.partitionBy("k").orderBy("d", "i"))).collect()))
    for whole in (0, 4, 100):  # every key is cut, some are, none is
        cut = skew.previous(df, "k", ["d", "i"], F.col("v"), F.col("d"), whole=whole)
        assert sorted(map(str, cut.collect())) == plain
    plan = skew.previous(df, "k", ["d", "i"], F.col("v"), F.col("d"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # rows are not shuffled again to meet what is carried


def test_dedupe_twice_is_once(spark):
    rows = [("a", "1", None, None, 1), ("a", "1", None, None, 2), ("a", None, None, None, 3), ("a", None, None, None, 4)]
    df = spark.createDataFrame(rows, "source string, source_listing_id string, listing_id string, url string, seq int")
    once = IN.dedupe_first(df, ["seq"])
    assert sorted(r.seq for r in once.collect()) == [1, 3, 4]
    assert sorted(r.seq for r in IN.dedupe_first(once, ["seq"]).collect()) == [1, 3, 4]


def test_change_kinds(spark):
    rows = [(1, 1, 10.0, "Pending"), (1, 2, 8.0, "active"), (1, 3, 8.0, "active"), (1, 4, 9.0, "active")]
    obs = spark.createDataFrame(rows, "listing_id long, day int, price double, listing_status string").selectExpr(
        "*", "timestamp_seconds(day * 86400) AS at", "'' AS photos_hash", "'' AS description_hash"
    )
    got = [r.event_type for r in CH.detect_changes(obs, ["at"]).orderBy("at", "seq").collect()]
    assert got == ["new_listing", "price_drop", "back_on_market", "price_increase"]


def test_upsert_keeps_rows_without_a_key(spark):
    listings = spark.createDataFrame(
        [(5, "a", "1", "a:1", "u1", "1 Elm", 10.0, [], [])],
        "id long, source string, source_listing_id string, listing_id string, url string, address string, price double, photos array<string>, sources_seen array<string>",
    )
    rows = [(None, None, None, None, "2 Oak", 1.0, 1), (None, None, None, "", "2 Oak", 2.0, 2), (None, None, None, None, "3 Ash", 3.0, 3),
            (None, None, None, "u1", "1 Elm", 11.0, 4), (None, None, None, "u9", "9 Fir", 4.0, 5), (None, None, None, "u9", "9 Fir", 5.0, 6)]
    batch = spark.createDataFrame(
        rows, "source string, source_listing_id string, listing_id string, url string, address string, price double, k int"
    ).withColumn("photos", F.array().cast("array<string>"))
    out = IN.upsert(listings, batch, ["k"], F.current_timestamp()).collect()
    assert sorted((r.address, r.price) for r in out) == [("1 Elm", 11.0), ("2 Oak", 1.0), ("2 Oak", 2.0), ("3 Ash", 3.0), ("9 Fir", 5.0)]
    assert len({r.id for r in out}) == 5 and [r.id for r in out if r.address == "1 Elm"] == [5]


def test_ordering_criteria_reads_no_evidence(spark):
    """Evidence and confidence are not built for the names of the best and worst criteria."""
    from nestrank.catalog import all_queries

    ranked = all_queries()["top_bottom_criteria"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        plan = ranked._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "top3" in plan and "location_quiet" in plan and "evidence" not in plan


def test_listings_outside_the_limits_are_not_read(spark):
    """What breaks a limit never passes, so its text is not scanned (here reading it would fail)."""
    from nestrank import fixtures as FX
    from nestrank.operators.alerts import passing_rows
    from nestrank.operators.ranking import score_rows
    from nestrank.sources.profiles import rental_profile

    listings = FX.raw_listings(spark, "/root/testdata/sf0.001")
    trap = F.concat("description", F.expr("CAST(0 div if(price > 9500, 0, 1) AS STRING)"))
    plain = F.concat("description", F.lit("0"))
    got = passing_rows(listings.withColumn("description", trap), rental_profile()).select("id", "points", "percent").collect()
    want = score_rows(listings.withColumn("description", plain), rental_profile()).filter("passes")
    assert listings.where("price > 9500").count() > 0
    assert sorted(got) == sorted(want.select("id", "points", "percent").collect()) and got


def test_append_log_in_pieces_leaves_no_shuffle_files(spark, tmp_path):
    """Pieces together are the log; what was shuffled for one is gone before the next is written."""
    import time
    from datetime import datetime

    from pyspark.sql import functions as F

    from nestrank.sources.tables import append_log

    def shuffled() -> int:
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return sum(str(blocks.apply(i)).startswith("shuffle_") for i in range(blocks.size()))

    rows = [(f"{i}-{k}", i if i % 7 else None, datetime(2024, 1, 1 + i % 3) if i % 5 else None) for i in range(60) for k in range(2)]
    events = spark.createDataFrame(rows, "event_id string, listing_id long, created_at timestamp")
    before, path = shuffled(), str(tmp_path / "log")
    append_log(events, path, "listing_id", 3)
    append_log(events, path)
    for _ in range(50):  # removal is asked for at the end of the write and done beside it
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    log = spark.read.parquet(path)
    assert sorted(map(str, log.select(events.columns).collect())) == sorted(map(str, events.union(events).collect()))
    assert log.where(~F.col("day").eqNullSafe(F.to_date("created_at"))).count() == 0
