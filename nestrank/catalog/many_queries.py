"""Queries over lexicons and profiles that are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog import sqltext as S
from nestrank.catalog.registry import query
from nestrank.catalog.score_queries import BUY, KEYS, RENTAL
from nestrank.catalog.text_queries import _quality_sql
from nestrank.functions import lexicon as LX
from nestrank.functions import sql_functions as SF
from nestrank.operators.lexicon import lexicon_groups, lexicon_hits
from nestrank.operators.many_profiles import score_many_profiles
from nestrank.operators.nearest import nearest_segments
from nestrank.sources.profiles import profile_tables

# A lexicon of tens of thousands of terms: the words of all conversations, and pairs of neighbours.
LEXICON = (
    "words AS (SELECT regexp_extract_all(lower(text), '[^ .,\\n]+'{all}) AS w FROM conversations WHERE text IS NOT NULL), "
    "terms AS (SELECT DISTINCT term FROM ({one} UNION ALL {two}) WHERE term <> '')"
)
LEXICON_DUCK = LEXICON.format(
    all="", one="SELECT unnest(w) AS term FROM words",
    two="SELECT unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS term FROM words",
)


def conversation_lexicon(spark, sf_dir):
    words = FX.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        F.regexp_extract_all(F.lower("text"), F.lit(r"[^ .,\n]+"), F.lit(0)).alias("w")
    )
    pairs = F.transform(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1))
    )
    both = words.select(F.explode("w").alias("term")).union(words.select(F.explode(pairs).alias("term")))
    return both.where("term <> ''").distinct()


@query(
    "lexicon_hits",
    f"WITH {LEXICON_DUCK}, d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), "
    "h AS (SELECT doc_id, term FROM d JOIN terms ON contains(t, term)) "
    "SELECT doc_id, count(*) AS terms, sum(length(term))::BIGINT AS chars, min(term) AS first_term, max(term) AS last_term, "
    "max(length(term)) AS longest FROM h GROUP BY doc_id",
)
def lexicon_hits_query(spark, sf_dir):
    found = lexicon_hits(FX.table(spark, sf_dir, "documents"), "doc_id", "text", conversation_lexicon(spark, sf_dir))
    size = F.length("term").cast("long")
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum(size).alias("chars"), F.min("term").alias("first_term"),
        F.max("term").alias("last_term"), F.max(size).alias("longest"),
    )


def _lexicon_rows() -> list[tuple[str, str]]:
    named = {**LX.FLAG_GROUPS, **{f"good_{k}": v for k, v in LX.POSITIVE_GROUPS.items()}, **{f"bad_{k}": v for k, v in LX.RED_FLAG_GROUPS.items()}}
    return [(group, term) for group, terms in named.items() for term in dict.fromkeys(terms)]


@query(
    "lexicon_groups",
    f"WITH {S.RAW}, lex(grp, term) AS (VALUES {', '.join(f'({S.q(g)}, {S.q(t)})' for g, t in _lexicon_rows())}), "
    "t AS (SELECT id, lower(description) AS t FROM raw) "
    "SELECT id, grp, count(*) AS hits FROM t JOIN lex ON contains(t, term) GROUP BY id, grp",
)
def lexicon_groups_query(spark, sf_dir):
    lexicon = spark.createDataFrame(_lexicon_rows(), "grp string, term string")
    return lexicon_groups(FX.raw_listings(spark, sf_dir).select("id", "description"), "id", "description", lexicon)


# --- many profiles -------------------------------------------------------------
# Every customer is a buyer: the words of one of two profiles, own limits, caps and weights.
HOODS = ("Williamsburg", "SoHo", "Park Slope", "DUMBO", "Potrero", "north of panhandle", "Brooklyn", "Chelsea")
PRICE_MAX = "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(2000 + (c_custkey * 37) % 5000 AS DOUBLE) END"
PRICE_SOFT = "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1500 + c_custkey % 1000 AS DOUBLE) END"
BEDS, BATHS = "CAST(c_custkey % 4 AS DOUBLE)", "CASE WHEN c_custkey % 2 = 0 THEN CAST(1.5 AS DOUBLE) END"
SQFT = "CASE WHEN c_custkey % 3 = 0 THEN CAST(600 AS DOUBLE) END"
LIMITED = {"price_max": PRICE_MAX, "price_soft": PRICE_SOFT, "bedrooms_min": BEDS, "bathrooms_min": BATHS, "sqft_min": SQFT}
KINDS = {0: RENTAL, 1: BUY}
STEP = {k: 3 + 2 * i for i, k in enumerate(KEYS)}


def _weight(key: str) -> str:
    kinds = " ".join(f"WHEN {t} THEN {float(p.weights.get(key, 0) or 0)!r}" for t, p in KINDS.items())
    return f"CAST(CASE c_custkey % 2 {kinds} END AS DOUBLE) * (1 + (c_custkey * {STEP[key]}) % 7)"


def _hood(expr: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {S.q(h)}" for i, h in enumerate(HOODS)) + " END"


HOOD_A, HOOD_B = _hood("c_custkey % 8"), _hood("(c_custkey * 3 + 1) % 8")


def buyer_tables(spark, sf_dir):
    buyers = FX.table(spark, sf_dir, "customer").selectExpr(
        "concat('p', CAST(c_custkey AS STRING)) AS profile_id", "c_custkey", "CAST(c_custkey % 2 AS STRING) AS kind_id",
        *[f"{e} AS {n}" for n, e in LIMITED.items()], f"{HOOD_A} AS hood_a", f"{HOOD_B} AS hood_b",
    )
    kinds = profile_tables(spark, {str(t): p for t, p in KINDS.items()})

    def own(name: str):
        rows = kinds[name].withColumnRenamed("profile_id", "kind_id")  # of two profiles; the buyers grow
        return buyers.select("profile_id", "kind_id").join(F.broadcast(rows), "kind_id").drop("kind_id")

    weights = F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("criterion"), F.expr(_weight(k)).alias("weight")) for i, k in enumerate(KEYS)
    ]))
    none, limited = F.lit(None), buyers.where("c_custkey % 25 <> 0")
    numbers = F.inline(F.array(*[
        F.struct(
            F.lit("soft_caps" if n == "price_soft" else "hard_filters").alias("section"), F.lit(n).alias("name"),
            F.col(n).alias("value"), none.cast("string").alias("item"),
        )
        for n in LIMITED
    ]))
    filters = buyers.select("profile_id", numbers)
    for hood in ("hood_a", "hood_b"):
        filters = filters.union(limited.select(
            "profile_id", F.lit("hard_filters"), F.lit("neighborhoods"), none.cast("double"), F.col(hood)
        ))
    return {
        "profile_weights": buyers.select("profile_id", weights),
        "profile_keywords": own("profile_keywords"), "profile_streets": own("profile_streets"),
        "profile_filters": filters.union(own("profile_filters").where("section = 'mode'").select(filters.columns)),
    }


def _many_sql() -> str:
    scored = " UNION ALL ".join(
        f"SELECT * FROM ({S.score_ctes(p)} SELECT {t} AS kind, id, price, beds, baths, sqft, neighborhood, "
        f"{'0e0' if p.mode == 'rent' else 'hoa_pen'} AS fees, {', '.join(f's_{k}' for k in KEYS)} FROM pts WHERE {S.signal_sql(p)} "
        f"AND NOT {S.any_of('lower(coalesce(listing_status, chr(32)))', LX.INACTIVE_STATUSES)})"
        for t, p in KINDS.items()
    )
    total = " + ".join(f"s_{k} / 10e0 * w_{k}" for k in KEYS)
    pen = (
        "CASE WHEN price_soft IS NULL OR price IS NULL OR price <= price_soft THEN 0e0 WHEN price >= coalesce(price_max, price_soft) THEN 10e0 "
        "WHEN coalesce(price_max, price_soft) > price_soft THEN 10e0 * ((price - price_soft) / (coalesce(price_max, price_soft) - price_soft)) ELSE 10e0 END"
    )
    return (
        "WITH buyers AS (SELECT concat('p', c_custkey) AS profile_id, c_custkey, c_custkey % 2 AS kind, "
        + ", ".join(f"{e} AS {n}" for n, e in LIMITED.items())
        + f", {HOOD_A} AS hood_a, {HOOD_B} AS hood_b, " + ", ".join(f"{_weight(k)} AS w_{k}" for k in KEYS)
        + f" FROM customer), scored AS MATERIALIZED ({scored}), pairs AS (SELECT profile_id, id, "
        f"greatest(0e0, {total} - ({pen}) - fees) AS points, {' + '.join(f'w_{k}' for k in KEYS)} AS total "
        "FROM buyers b JOIN scored s ON b.kind = s.kind AND (price_max IS NULL OR price <= price_max) "
        "AND beds >= bedrooms_min AND (bathrooms_min IS NULL OR baths >= bathrooms_min) AND (sqft_min IS NULL OR sqft IS NULL OR sqft >= sqft_min) "
        "AND (c_custkey % 25 = 0 OR neighborhood = hood_a OR neighborhood = hood_b)) "
        "SELECT profile_id, count(*) AS listings, sum(CAST(round_even(points * 1e6, 0) AS BIGINT))::BIGINT AS micro_points, round(max(points), 6) AS best_points, "
        "round(max(points / total * 100), 4) AS best_percent, round(avg(points / total * 100), 4) AS mean_percent, "
        "min(id) AS first_id, max(id) AS last_id FROM pairs GROUP BY profile_id"
    )


@query("score_many_profiles", _many_sql())
def score_many_profiles_query(spark, sf_dir):
    pairs = score_many_profiles(FX.listings(spark, sf_dir), buyer_tables(spark, sf_dir))
    return pairs.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("listings"), F.sum(F.rint(F.col("points") * 1e6).cast("long")).alias("micro_points"),
        F.round(F.max("points"), 6).alias("best_points"), F.round(F.max("percent"), 4).alias("best_percent"),
        F.round(F.avg("percent"), 4).alias("mean_percent"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )


# --- nearest of a large layer ----------------------------------------------------
# A segment per event: most around two cities, one in 40 far away from every listing.
SEGMENTS = {
    "segment_id": "event_id",
    "lat1": "CASE WHEN event_id % 40 = 7 THEN CAST(480000 + (event_id * 37) % 30000 AS DOUBLE) / 10000 WHEN event_id % 3 = 0 "
    "THEN CAST(377000 + (event_id * 7919) % 1700 AS DOUBLE) / 10000 ELSE CAST(405800 + (event_id * 7919) % 2600 AS DOUBLE) / 10000 END",
    "lon1": "CASE WHEN event_id % 40 = 7 THEN CAST(20000 + (event_id * 53) % 90000 AS DOUBLE) / 10000 WHEN event_id % 3 = 0 "
    "THEN CAST(-1225200 + (event_id * 104729) % 1900 AS DOUBLE) / 10000 ELSE CAST(-740900 + (event_id * 104729) % 2300 AS DOUBLE) / 10000 END",
}
BEND = {"lat2": "lat1 + CAST((segment_id * 31) % 21 - 10 AS DOUBLE) / 10000", "lon2": "lon1 + CAST((segment_id * 17) % 25 - 12 AS DOUBLE) / 10000"}


def _nearest_sql() -> str:
    along = (
        "coalesce(greatest(0e0, least(1e0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / "
        "nullif((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1), 0e0))), 0e0)"
    )
    dist = S.haversine("lat", "lon", "lat1 + k * (lat2 - lat1)", "lon1 + k * (lon2 - lon1)")
    return (
        f"WITH {S.RAW}, a AS ({FX.select_sql(SEGMENTS, 'events')}), s AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in BEND.items())
        + f" FROM a), m AS (SELECT id, segment_id, lat, lon, lat1, lon1, lat2, lon2, {along} AS k FROM raw, s WHERE lat IS NOT NULL AND lon IS NOT NULL) "
        f"SELECT id, round(min({dist}), 3) AS distance_m FROM m GROUP BY id"
    )


@query("nearest_of_large_layer", _nearest_sql())
def nearest_of_large_layer(spark, sf_dir):
    ends = FX.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in SEGMENTS.items()])
    segments = ends.selectExpr("*", *[f"{e} AS {n}" for n, e in BEND.items()])
    found = nearest_segments(FX.raw_listings(spark, sf_dir).select("id", "lat", "lon"), segments)
    return found.select("id", F.round("distance_m", 3).alias("distance_m"))


# --- functions for SQL users ------------------------------------------------------
@query(
    "sql_functions",
    f"WITH {S.LISTINGS}, {S.GEO}, q AS ({_quality_sql('raw', 'id', 'description')}) "
    f"SELECT id, round({S.haversine('lat', 'lon', '40.7e0', '(-74e0)')}, 3) AS from_centre, text_quality, "
    f"CASE WHEN lat IS NULL THEN 50 ELSE {S.QUIET} END AS quiet FROM fx JOIN q USING (id) {S.GEO_JOIN}",
)
def sql_functions_query(spark, sf_dir):
    SF.register(spark)
    return spark.sql(
        "SELECT id, round(haversine_m(lat, lon, 40.7D, -74D), 3) AS from_centre, round(text_quality(description), 6) AS text_quality, "
        "tranquility(lat, lon) AS quiet FROM {raw}", raw=FX.raw_listings(spark, sf_dir),
    )
