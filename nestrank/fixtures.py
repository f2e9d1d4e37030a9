"""Listings, observations, feedback and payloads derived from the driver tables.

The driver data has no real-estate words, so every row of a source table becomes one
row of a view whose columns follow from its keys.  Expressions that read the same in
Spark SQL and in the checking engine are kept as text and used by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestrank.operators.signals import apply_flags, extract_flags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, modulus: int, *texts: str | None, rest: str | None = None) -> str:
    """CASE over ``key % modulus``; a None text leaves that branch NULL."""
    whens = " ".join(
        f"WHEN {i} THEN '{t}'" if t is not None else f"WHEN {i} THEN NULL" for i, t in enumerate(texts)
    )
    tail = f" ELSE '{rest}'" if rest else ""
    return f"CASE {key} % {modulus} {whens}{tail} END"


K = "o_orderkey"
LISTING_EXPRS = {
    "id": K,
    "source": _pick(K, 3, "alpha", "beta", rest="gamma"),
    "source_listing_id": f"concat('L', CAST({K} AS VARCHAR(20)))",
    "listing_id": f"concat({_pick(K, 3, 'alpha', 'beta', rest='gamma')}, ':L', CAST({K} AS VARCHAR(20)))",
    "address": f"concat(CAST(100 + {K} % 890 AS VARCHAR(20)), ' ', "
    + _pick(K, 6, "Berry St", "Canal St", "Perry St", "Bowery", "Hicks St", rest="Elm St") + ")",
    "url": f"concat('https://www.example.com/building/unit-', CAST({K} AS VARCHAR(20)), '/', CAST({K} % 40 AS VARCHAR(20)), '?utm=1#p')",
    "price": f"CASE WHEN {K} % 53 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 40) AS DOUBLE) END",
    "beds": f"CAST({K} % 5 AS INT)",
    "baths": f"CAST(2 + {K} % 4 AS DOUBLE) / 2",
    "sqft": f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE CAST(400 + ({K} * 37) % 1600 AS INT) END",
    "neighborhood": _pick(
        K, 9, "Williamsburg", "SoHo", "Park Slope", "DUMBO", "Potrero",
        "north of panhandle", "Brooklyn", "Chelsea",
    ),
    "listing_status": _pick(K, 17, "Pending", "off-market", None, rest="Active"),
    "lat": f"CASE WHEN {K} % 41 = 0 THEN NULL WHEN {K} % 7 = 6 THEN CAST(377500 + ({K} * 7919) % 800 AS DOUBLE) / 10000 "
    f"WHEN {K} % 7 = 5 THEN CAST(415000 AS DOUBLE) / 10000 ELSE CAST(406200 + ({K} * 7919) % 1800 AS DOUBLE) / 10000 END",
    "lon": f"CASE WHEN {K} % 41 = 0 THEN NULL WHEN {K} % 7 = 6 THEN CAST(-1225000 + ({K} * 104729) % 1400 AS DOUBLE) / 10000 "
    f"WHEN {K} % 7 = 5 THEN CAST(-750000 AS DOUBLE) / 10000 ELSE CAST(-740500 + ({K} * 104729) % 1500 AS DOUBLE) / 10000 END",
    "year_built": f"CAST(1890 + {K} % 130 AS INT)",
    "days_on_market": f"CAST(({K} * 31) % 97 AS INT)",
    "visual_quality_score": f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE CAST(({K} * 13) % 101 AS INT) END",
    "brightness": f"CASE WHEN {K} % 5 = 1 THEN CAST(({K} * 19) % 101 AS INT) END",
    "hoa_fee": f"CASE WHEN {K} % 10 < 6 THEN NULL ELSE CAST(300 + ({K} * 17) % 900 AS DOUBLE) END",
    "parking_type": _pick(K, 12, "Garage", "street", "driveway"),
    "price_reduction_amount": f"CASE WHEN {K} % 8 = 0 THEN CAST(50 + {K} % 400 AS DOUBLE) END",
    "n_photos": f"CAST({K} % 18 AS INT)",
    "description": "concat_ws(' ', 'Apartment for rent.', "
    + ", ".join(
        [
            _pick(
                K, 13, "Sun-filled corner unit with natural light and oversized windows.",
                "Bright and airy.", "Cozy north-facing room.", "Penthouse with skylights, wall of windows.",
            ),
            _pick(
                K, 19, "Private terrace and backyard.", "Shared rooftop and juliet balcony.",
                "Large terrace, private garden, roof deck.", "Patio.",
            ),
            _pick(
                K, 23, "Pet friendly with dog run.", "Sorry, no pets allowed.",
                "Pets welcome, dogs allowed.", "Street parking only, ground floor above bar.",
            ),
            _pick(
                K, 29, "Prewar loft with exposed brick, original details, character.",
                "Luxury high-rise tower, doorman, concierge.", "Non-doorman walkup, no concierge.",
                "Full-time doorman and live-in super.", "Virtual doorman, home office, 10 ft ceilings, vaulted.",
            ),
            _pick(
                K, 31, "Renovated kitchen with gas range, dishwasher, island.",
                "Needs work, as-is.", "Move-in ready, updated, turnkey.",
                "Newly renovated, move-in ready, handyman special.", "Opens to the deck, seamless flow to patio.",
            ),
            _pick(
                K, 37, "Railroad layout, narrow hallway.", "Open concept great room, loft-like.",
                "Washer/dryer, central air, gym, yoga studio.", "Price improvement! Back on market.",
                "Shared laundry, no parking, walk-in closet storage.",
            ),
        ]
    )
    + ")",
}


def select_sql(exprs: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {source}"


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per order, without derived flags."""
    df = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in LISTING_EXPRS.items()])
    photo = F.concat(F.lit("https://img.example.com/"), F.col("id").cast("string"), F.lit("/"))
    count = F.col("n_photos")
    return df.withColumns(
        {
            "photos": F.when(
                count > 0,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                    lambda i: F.concat(photo, i.cast("string"), F.lit(".jpg")),
                ),
            ).otherwise(F.array().cast("array<string>")),
            "visual_assessment": F.when(
                F.col("brightness").isNotNull(),
                F.struct(F.create_map(F.lit("brightness"), F.col("brightness")).alias("dimensions")),
            ),
        }
    ).drop("n_photos", "brightness")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_listings`` with the flags its descriptions give."""
    return apply_flags(extract_flags(raw_listings(spark, sf_dir), "description"))


OBSERVATION_EXPRS = {
    "listing_id": "l_orderkey",
    "observed_at": "l_shipdate",
    "line_no": "l_linenumber",
    "part_no": "l_partkey",
    "supp_no": "l_suppkey",
    "price": "l_extendedprice",
    "listing_status": "CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'pending' END",
    "photos_hash": "CAST(l_suppkey % 7 AS VARCHAR(20))",
    "description_hash": "CAST(l_partkey % 5 AS VARCHAR(20))",
}
OBSERVATION_ORDER = ["observed_at", "line_no", "part_no", "supp_no", "price"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item; the order columns are unique inside a listing."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in OBSERVATION_EXPRS.items()])


FEEDBACK_EXPRS = {
    "user_id": "user_id",
    # a third of all feedback is about one listing, the rest spreads over all keys
    "listing_id": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id END",
    "feedback_type": "CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' "
    "WHEN 'view' THEN 'neutral' WHEN 'signup' THEN 'delete' ELSE 'like' END",
    "ts": "ts",
}


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in FEEDBACK_EXPRS.items()])


CRITERIA_EXPRS = {
    "id": "c_custkey",
    "user_id": "c_custkey",
    "price_min": "CASE WHEN c_custkey % 4 = 0 THEN CAST(1000 AS DOUBLE) END",
    "price_max": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(1500 + c_custkey % 2500 AS DOUBLE) END",
    "beds_min": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1 + c_custkey % 4 AS INT) END",
    "baths_min": "CAST(1 + c_custkey % 2 AS DOUBLE)",
    "sqft_min": "CAST(400 + 100 * (c_custkey % 6) AS INT)",
    "require_natural_light": "c_custkey % 3 = 0",
}


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in CRITERIA_EXPRS.items()])


SCOUT_EXPRS = {
    "scout_id": "s_suppkey",
    "user_id": "s_suppkey",
    "is_active": "s_suppkey % 11 <> 0",
    "min_match_score": "CAST(10 * (s_suppkey % 5) AS DOUBLE)",
    "max_results_per_alert": "CAST(5 + s_suppkey % 10 AS INT)",
    "alert_frequency": _pick("s_suppkey", 4, "instant", "daily", "weekly", rest="never"),
    "last_run": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE "
    "CAST(concat('2024-01-', CASE s_suppkey % 5 WHEN 0 THEN '01' WHEN 1 THEN '08' WHEN 2 THEN '13' WHEN 3 THEN '14' ELSE '15' END, ' 00:00:00') AS TIMESTAMP) END",
}
NOW = "2024-01-15 02:00:00"


def scouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {n}" for n, e in SCOUT_EXPRS.items()])


def scout_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (supplier, order) pair of the line items counts as shown before."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS scout_id", "l_orderkey AS listing_id").distinct()


PHOTO_SCORE_EXPRS = {
    "listing_id": "l_orderkey",
    "modernity": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST((l_partkey * 7) % 101 AS INT) END",
    "condition": "CAST((l_partkey * 11) % 101 AS INT)",
    "brightness": "CAST((l_suppkey * 13) % 101 AS INT)",
    "staging": "CAST((l_suppkey * 17) % 101 AS INT)",
    "cleanliness": "CAST((l_partkey * 19) % 101 AS INT)",
    "flag": _pick("l_partkey", 6, "dark_interior", "lvp_flooring", "visible_damage", "something_else"),
    "highlight": _pick("l_suppkey", 5, "natural_light_visible", "open_layout", "warm_materials"),
}


def photo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PHOTO_SCORE_EXPRS.items()])
    return df.withColumns(
        {"red_flags": F.array_compact(F.array("flag")), "highlights": F.array_compact(F.array("highlight"))}
    ).drop("flag", "highlight")


def pages_with_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver pages with a linked-data, meta or app-state block put into the head, by
    ``page_id % 4`` (0 leaves the page as it is)."""
    pages = table(spark, sf_dir, "pages")
    num = F.col("page_id").cast("string")
    linked = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Apartment","address":{"streetAddress":"'),
        num, F.lit(' Main St","addressLocality":"Springfield"},"offers":{"price":"$'),
        (F.col("page_id") * 10 + 1000).cast("string"),
        F.lit(',000"},"numberOfBedrooms":2,"geo":{"latitude":40.7,"longitude":-73.9},"image":["https://img.example.com/'),
        num, F.lit('.jpg"]},{"@type":"ItemList","itemListElement":[{"url":"https://example.com/l/'), num,
        F.lit('"},{"item":{"url":"https://example.com/m/'), num, F.lit('"}}]}]}</script>'),
    )
    meta = F.concat(
        F.lit('<meta property="og:title" content="Unit '), num,
        F.lit('"><meta content="40.71" property="place:location:latitude"><meta property="place:location:longitude" content="-73.95">'),
    )
    state = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[{"fullAddress":"'), num,
        F.lit(' Oak Ave","listPrice":{"value":'), (F.col("page_id") + 2000).cast("string"),
        F.lit('},"bedrooms":3,"bathrooms":1.5,"livingArea":900}]}}</script>'),
    )
    block = (
        F.when(F.col("page_id") % 4 == 1, linked).when(F.col("page_id") % 4 == 2, meta)
        .when(F.col("page_id") % 4 == 3, state).otherwise(F.lit(""))
    )
    head = F.locate("</head>", F.col("html"))
    html = F.when(
        head > 0,
        F.concat(F.expr("substring(html, 1, locate('</head>', html) - 1)"), block, F.expr("substring(html, locate('</head>', html))")),
    ).otherwise(F.concat(block, F.col("html")))
    return pages.withColumn("html", html)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of the observations with a stable event id and time."""
    from nestrank.operators.changes import detect_changes

    changes = detect_changes(observations(spark, sf_dir), OBSERVATION_ORDER)
    key = F.concat_ws("-", "listing_id", F.unix_timestamp("observed_at"), "line_no", "part_no", "supp_no", F.rint(F.coalesce(F.col("price"), F.lit(0.0)) * 100).cast("bigint"), "seq")
    return changes.select(
        key.alias("event_id"), "listing_id", "event_type", "old_price", "new_price", "old_text", "new_text",
        "amount", "percent", F.col("observed_at").alias("created_at"),
    )
