"""Queries over storage, payloads, new listings and what follows a match."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog import sqltext as S
from nestrank.catalog.log_queries import PASSING, CANDIDATES, RENTAL, r6
from nestrank.catalog.registry import joined, query
from nestrank.functions import columns as CO
from nestrank.operators import alerts as AL
from nestrank.operators import changes as CH
from nestrank.operators import filters as FL
from nestrank.operators import ingest as IN
from nestrank.operators import joins as J
from nestrank.operators import learning as LE
from nestrank.operators import ranking as R
from nestrank.operators import reports as RP
from nestrank.operators import signals as SG
from nestrank.operators import text_model as TM
from nestrank.session import shared_folder
from nestrank.sources import feeds as FD
from nestrank.sources import pages as PG
from nestrank.sources import tables as TB

OBSERVATIONS_A_PIECE = 24_000_000  # whose events are shuffled at once, about 4 GB
STORED = ["id", "source", "listing_id", "address", "price", "beds", "listing_status", "days_on_market"]


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


# --- storage ------------------------------------------------------------------
@query("stored_listings", f"WITH {S.RAW} SELECT {', '.join(STORED)}, n_photos AS photos FROM raw WHERE source = 'beta'")
def stored_listings(spark, sf_dir):
    """Written by source and read back with the declared schema; one folder is read."""
    path = _scratch(spark, "listings")
    TB.write_listings(FX.raw_listings(spark, sf_dir).drop("visual_assessment"), path)
    kept = TB.read_listings(spark, path).filter(F.col("source") == "beta")
    return kept.select(*STORED, F.size("photos").alias("photos"))


@query("appended_log", f"WITH {S.EVENTS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, event_type, CAST(2 * count(*) AS BIGINT) AS events FROM ev GROUP BY 1, 2")
def appended_log(spark, sf_dir):
    """Two appends of one log, counted by its day folders."""
    path, events = _scratch(spark, "events"), FX.events_of(spark, sf_dir)
    pieces = 1 + FX.observations(spark, sf_dir).count() // OBSERVATIONS_A_PIECE
    TB.append_log(events, path, "listing_id", pieces)
    TB.append_log(events, path, "listing_id", pieces)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "json_round_trip",
    f"WITH {S.RAW} SELECT id, address, CASE WHEN id % 2 = 0 THEN price + 1 ELSE price END AS price, listing_status, "
    "id % 2 = 0 AS imported, CASE WHEN id % 2 = 0 THEN '2024-01-15 02:00:00.123456' END AS seen FROM raw",
)
def json_round_trip(spark, sf_dir):
    """Half of the rows exported with new prices and imported over the table."""
    raw = FX.raw_listings(spark, sf_dir).drop("visual_assessment")
    path = _scratch(spark, "export")
    stamp = F.to_timestamp(F.lit("2024-01-15 02:00:00.123456"))
    half = raw.filter("id % 2 = 0").withColumns({"price": F.col("price") + 1, "last_seen_at": stamp})
    TB.export_json({"property_listings": TB.conform(half)}, path)
    merged = TB.import_json(spark, path, "property_listings", raw)
    return merged.select(
        "id", "address", "price", "listing_status", F.col("last_seen_at").isNotNull().alias("imported"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen"),
    )


# --- payloads -----------------------------------------------------------------
DETAIL_A = (
    "to_json(named_struct('property_description', description, 'year_built', year_built, 'property_images', CASE WHEN id % 3 = 0 THEN array(url, NULL, address) END, "
    "'property_image', CASE WHEN id % 3 = 1 THEN url WHEN id % 3 = 2 THEN '' END, 'latitude', lat, 'listing_days', days_on_market, 'neighborhood', CASE WHEN id % 2 = 0 THEN '' ELSE neighborhood END, 'city', 'Town'))"
)


@query(
    "feed_a_detail",
    f"WITH {S.RAW} SELECT CAST(id AS VARCHAR) AS source_listing_id, description, year_built, lat, days_on_market, CASE WHEN id % 2 = 0 THEN 'Town' ELSE coalesce(neighborhood, 'Town') END AS neighborhood, "
    "CASE id % 3 WHEN 0 THEN concat(url, '|', address) WHEN 1 THEN url END AS photos FROM raw",
)
def feed_a_detail(spark, sf_dir):
    out = FD.normalize_detail_a(FX.raw_listings(spark, sf_dir).select(F.col("id").alias("listing_id"), F.expr(DETAIL_A).alias("payload")))
    return out.select("source_listing_id", "description", "year_built", "lat", "days_on_market", "neighborhood", joined("photos").alias("photos"))


DETAIL_B = (
    "to_json(named_struct('remarks', CASE WHEN id % 2 = 0 THEN description END, 'description', 'plain', 'price', price, 'bedrooms', beds, 'baths', CASE WHEN id % 5 = 0 THEN 0D END, 'bathrooms', baths, "
    "'livingArea', sqft, 'address', named_struct('streetLine', address, 'city', 'Town', 'zip', ' '), 'photos', array(named_struct('url', url), named_struct('url', concat(url, '2'))), 'yearBuilt', year_built))"
)


@query(
    "feed_b_detail",
    f"WITH {S.RAW} SELECT CAST(id AS VARCHAR) AS source_listing_id, CASE WHEN id % 2 = 0 THEN description ELSE 'plain' END AS description, price, beds, baths, sqft, "
    "concat(address, ', Town') AS address, concat(url, '|', url, '2') AS photos, year_built FROM raw",
)
def feed_b_detail(spark, sf_dir):
    out = FD.normalize_detail_b(FX.raw_listings(spark, sf_dir).select(F.col("id").alias("listing_id"), F.expr(DETAIL_B).alias("payload")))
    return out.select("source_listing_id", "description", "price", "beds", "baths", "sqft", "address", joined("photos").alias("photos"), "year_built")


@query(
    "curated_rows",
    "SELECT concat('curated-', CASE WHEN s_suppkey % 5 = 0 THEN 'curated' ELSE concat('my-list-', s_suppkey % 3) END) AS source, "
    "CASE s_suppkey % 4 WHEN 0 THEN concat('https://e.com/', s_suppkey) WHEN 1 THEN concat('i', s_suppkey) WHEN 2 THEN s_name ELSE "
    "concat('curated-', CASE WHEN s_suppkey % 5 = 0 THEN 'curated' ELSE concat('my-list-', s_suppkey % 3) END, ':', s_suppkey) END AS source_listing_id, s_acctbal AS price FROM supplier",
)
def curated_rows(spark, sf_dir):
    k = "s_suppkey"
    rows = FX.table(spark, sf_dir, "supplier").selectExpr(
        f"CASE WHEN {k} % 5 = 0 THEN ' !? ' ELSE concat('  My List! ', {k} % 3, '.') END AS source_name", f"CAST({k} AS INT) AS position",
        f"CASE WHEN {k} % 4 = 0 THEN concat('https://e.com/', {k}) WHEN {k} % 4 = 1 THEN '' END AS url", f"CASE WHEN {k} % 4 = 1 THEN concat('i', {k}) END AS id",
        f"CASE WHEN {k} % 4 < 3 THEN s_name END AS address", "s_acctbal AS price", "1 AS beds", "1D AS baths", "500 AS sqft", "'d' AS description",
    )
    return FD.normalize_curated(rows).select("source", "source_listing_id", "price")


# --- pages --------------------------------------------------------------------
@query(
    "page_structured",
    "SELECT page_id, CASE page_id % 4 WHEN 1 THEN concat(page_id, ' Main St, Springfield') WHEN 2 THEN concat('Unit ', page_id) WHEN 3 THEN concat(page_id, ' Oak Ave') END AS address, "
    "CASE page_id % 4 WHEN 1 THEN CAST((page_id * 10 + 1000) * 1000 AS DOUBLE) WHEN 3 THEN CAST(page_id + 2000 AS DOUBLE) END AS price, "
    "CAST(CASE page_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 3 END AS INTEGER) AS beds, CASE WHEN page_id % 4 = 3 THEN 1.5e0 END AS baths, CAST(CASE WHEN page_id % 4 = 3 THEN 900 END AS INTEGER) AS sqft, "
    "CASE page_id % 4 WHEN 1 THEN 40.7e0 WHEN 2 THEN 40.71e0 END AS lat, CASE page_id % 4 WHEN 1 THEN -73.9e0 WHEN 2 THEN -73.95e0 END AS lon, "
    "CASE WHEN page_id % 4 = 1 THEN concat('https://img.example.com/', page_id, '.jpg') ELSE '' END AS photos, CASE WHEN page_id % 4 = 1 THEN 'Apartment' END AS property_type FROM pages",
)
def page_structured(spark, sf_dir):
    out = PG.extract_page_listing(FX.pages_with_blocks(spark, sf_dir))
    return out.select(
        "page_id", "address", "price", "beds", "baths", "sqft", "lat", "lon",
        F.coalesce(joined("photos"), F.lit("")).alias("photos"), "property_type",
    )


TARGETING = (
    "concat('<script>ads.setTargeting(\"price\", \"', CASE WHEN page_id % 3 = 0 THEN '0' ELSE CAST(page_id + 900 AS STRING) END, '\"); ads.setTargeting(\"bd\", \"9\"); ads.setTargeting(\"bd\",\"', page_id % 4, '\"); "
    "ads.setTargeting(\"ba\", \"', CASE WHEN page_id % 5 = 0 THEN 'null' ELSE '1.5' END, '\"); ads.setTargeting(\"hood\", \"', CASE WHEN page_id % 2 = 0 THEN 'soho' ELSE 'upper-east-side' END, '\"); "
    "var x = {\"offers\": {\"@type\": \"Offer\", \"price\": \"7,', 100 + page_id % 800, '\"}}</script><meta property=\"og:title\" content=\"', page_id, ' Elm St #2 in SoHo\">', html)"
)


@query(
    "page_targeting",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 7100e0 + page_id % 800 ELSE page_id + 900e0 END AS price, CAST(page_id % 4 AS INTEGER) AS beds, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 1.5e0 END AS baths, "
    "CAST(NULL AS INTEGER) AS sqft, CASE WHEN page_id % 2 = 0 THEN 'SoHo' ELSE 'Upper East Side' END AS neighborhood, concat(page_id, ' Elm St #2') AS address FROM pages",
)
def page_targeting(spark, sf_dir):
    return PG.mine_targeting(FX.table(spark, sf_dir, "pages").select("page_id", F.expr(TARGETING).alias("html")))


LINKS = (
    "concat('<a href=\"/building/', page_id, '-main-street/4b?x=1\">a</a><a href=\"https://www.homes.example/building/', page_id, '-main-street/4b/\">b</a> see https://sub.homes.example/building/elm-house/', page_id, "
    "' or <a href=\"/about\">c</a> https://other.test/building/q/1 ')"
)


@query(
    "harvested_links",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'SoHo' ELSE 'East Harlem' END AS neighborhood, CASE n WHEN 0 THEN concat('https://homes.example/building/', page_id, '-main-street/4b') "
    "ELSE concat('https://sub.homes.example/building/elm-house/', page_id) END AS url, CASE n WHEN 0 THEN concat(page_id, ' Main Street #4B') ELSE concat('Elm House #', page_id) END AS address FROM pages, range(0, 2) t(n)",
)
def harvested_links(spark, sf_dir):
    slug = F.when(F.col("page_id") % 2 == 0, "soho").otherwise("east-harlem")
    pages = FX.table(spark, sf_dir, "pages").select("page_id", F.expr(LINKS).alias("html"), slug.alias("slug"))
    return PG.harvest_links(pages, "homes.example", CO.UNIT_PATH, F.col("slug"))


SCRAPED = (
    "concat('<div class=\"home-main-stats\"><span> $', 1 + page_id % 9, ',', 100 + page_id % 800, '</span></div><p>Days on market <b class=\"value\"> ', page_id % 77, '</b>', CASE WHEN page_id % 2 = 0 THEN "
    "'{\"latitude\":40.5,\"longitude\":73.25}' ELSE '' END, '<img src=\"https://i.test/a//photos/', page_id, '/600x400.jpg?z\"><img alt=\"x\" src=\"/plain.png\">')"
)


@query(
    "page_scrape",
    "SELECT page_id, CAST((1 + page_id % 9) * 1000 + 100 + page_id % 800 AS DOUBLE) AS price, CAST(page_id % 77 AS DOUBLE) AS days_on_market, CASE WHEN page_id % 2 = 0 THEN 40.5e0 END AS lat, "
    "CASE WHEN page_id % 2 = 0 THEN 73.25e0 END AS lon, concat('https:/i.test/a/photos/', page_id, '.jpg|/plain.png') AS photos FROM pages",
)
def page_scrape(spark, sf_dir):
    out = PG.mine_listing_page(FX.table(spark, sf_dir, "pages").select("page_id", F.expr(SCRAPED).alias("html")))
    return out.withColumn("photos", joined("photos"))


# --- column rules ---------------------------------------------------------------
@query(
    "column_rules",
    "SELECT p_partkey, concat(p_partkey, ' Elm St') AS home, concat('Elm ', p_partkey) AS detail, concat('Elm Ave ', p_partkey) AS dashes, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'Park Slope' ELSE concat('Foo Bar', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' Hill' END) END AS hood, "
    "concat('src:', CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE substr(sha256(concat('src:', repeat('x', 70), p_partkey)), 1, 59) END) AS built, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'extra' ELSE p_name END AS filled, CASE p_partkey % 4 WHEN 0 THEN '$1.25M' WHEN 1 THEN '$2M' WHEN 2 THEN '$7,500' ELSE 'Price n/a' END AS shown FROM part",
)
def column_rules(spark, sf_dir):
    """Addresses in urls of three styles, slugs, long ids, filled gaps, prices of a million."""
    part = FX.table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")

    def url(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    even = F.col("p_partkey") % 2 == 0
    slug = F.when(even, "park-slope").when(F.col("p_partkey") % 3 == 0, "foo-bar").otherwise("foo-bar-hill")
    ident = F.when(even, k).otherwise(F.concat(F.repeat(F.lit("x"), 70), k))
    price = F.element_at(F.array(F.lit(1250000.0), F.lit(2000000.0), F.lit(7500.0), F.lit(None).cast("double")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(
        "p_partkey",
        CO.address_from_url(url("https://e.com/b/", k, "-Elm-St_rb/home/9"), "home").alias("home"),
        CO.address_from_url(url("https://e.com/d/Elm_", k, "_M12?x"), "detail").alias("detail"),
        CO.address_from_url(url("https://e.com/Elm-Ave_", k, "--z/"), "dashes").alias("dashes"),
        CO.hood_from_slug(slug).alias("hood"), CO.build_listing_id(F.lit("src"), ident).alias("built"),
        CO.fill_missing(F.when(even, F.lit("")).otherwise(F.col("p_name")), F.lit("extra"), "text").alias("filled"),
        CO.format_price(price).alias("shown"),
    )


@query(
    "snapshot_hashes",
    f"WITH {S.RAW} SELECT id AS listing_id, sha256(concat_ws(chr(1), coalesce(CAST(CAST(price AS BIGINT) AS VARCHAR) || '.0', chr(0)), coalesce(lower(trim(listing_status)), chr(0)), "
    "CASE WHEN n_photos = 0 THEN '' ELSE sha256(concat('[\"', array_to_string(list_sort(photos), '\", \"'), '\"]')) END, sha256(description))) AS snapshot_hash FROM raw",
)
def snapshot_hashes(spark, sf_dir):
    return CH.snapshot_cols(FX.raw_listings(spark, sf_dir)).select("listing_id", "snapshot_hash")


@query(
    "explicit_flags",
    f"WITH {S.LISTINGS} SELECT id, CASE id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE has_parking_keywords END AS parking, has_view_keywords AS views FROM fx",
)
def explicit_flags(spark, sf_dir):
    """A flag the source gives wins over the text; NULL leaves it to the text."""
    raw = FX.raw_listings(spark, sf_dir)
    given = F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False)
    out = SG.apply_flags(SG.extract_flags(raw.withColumn("has_parking_keywords", given), "description"))
    return out.select("id", F.col("has_parking_keywords").alias("parking"), F.col("has_view_keywords").alias("views"))


# --- ingest -------------------------------------------------------------------
@query(
    "active_sources",
    f"WITH {S.RAW} SELECT id, source, CASE WHEN source = 'beta' THEN sqft END AS sqft FROM raw WHERE source IN ('alpha', 'beta') "
    f"UNION ALL SELECT id, source, CAST(NULL AS INTEGER) FROM raw WHERE source = 'gamma' AND id % 2 = 0",
)
def active_sources(spark, sf_dir):
    raw = FX.raw_listings(spark, sf_dir)
    frames = {n: raw.filter(F.col("source") == n) for n in ("alpha", "beta", "gamma")}
    chosen = IN.union_sources({**frames, "alpha": frames["alpha"].drop("sqft")}, [" Beta", "alpha", "unknown", ""])
    return IN.union_all([chosen, frames["gamma"].filter("id % 2 = 0").drop("sqft")]).select("id", "source", "sqft")


WHO = {  # of a batch row: found by its natural key, by listing_id, by url, or new
    "source": "CASE WHEN o_orderkey % 4 = 0 THEN (CASE o_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END) WHEN o_orderkey % 4 = 3 THEN 'delta' END",
    "source_listing_id": "CASE WHEN o_orderkey % 4 = 0 THEN concat('L', CAST(o_orderkey AS VARCHAR(20))) WHEN o_orderkey % 4 = 3 THEN concat('N', CAST(o_orderkey % 50 AS VARCHAR(20))) END",
    "listing_id": f"CASE WHEN o_orderkey % 4 = 1 THEN {FX.LISTING_EXPRS['listing_id']} END",
    "url": f"CASE WHEN o_orderkey % 4 = 2 THEN {FX.LISTING_EXPRS['url']} END",
}


@query(
    "resolved_by_each_key",
    f"WITH {S.RAW}, b AS ({FX.select_sql({'k': 'o_orderkey', **WHO}, 'orders')}) SELECT k, CASE WHEN k % 4 < 3 THEN k END AS existing_id FROM b",
)
def resolved_by_each_key(spark, sf_dir):
    batch = FX.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", *[f"{e} AS {n}" for n, e in WHO.items()])
    return J.resolve_ids(batch, FX.raw_listings(spark, sf_dir)).select("k", "existing_id")


@query(
    "upsert_keyless",
    "WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_custkey % 40, ' Lane') END AS address, c_acctbal AS price, "
    "CASE WHEN c_custkey % 3 = 0 THEN concat('https://e.com/', c_custkey % 50) END AS url FROM customer), n AS (SELECT * FROM b WHERE address <> '') "
    "SELECT address, price, url FROM n WHERE url IS NULL "
    "UNION ALL SELECT arg_max(address, k), arg_max(price, k), url FROM n WHERE url IS NOT NULL GROUP BY url",
)
def upsert_keyless(spark, sf_dir):
    """Address-only rows are inserted one by one, rows with a url merge by it."""
    listings = FX.raw_listings(spark, sf_dir).withColumns(
        {"sources_seen": F.array().cast("array<string>"), "last_seen_at": F.lit(None).cast("timestamp")}
    ).drop("visual_assessment")
    none = F.lit(None).cast("string")
    batch = FX.table(spark, sf_dir, "customer").select(
        none.alias("source"), none.alias("source_listing_id"), none.alias("listing_id"), F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat((F.col("c_custkey") % 40).cast("string"), F.lit(" Lane"))).alias("address"),
        F.col("c_acctbal").alias("price"), F.array().cast("array<string>").alias("photos"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://e.com/"), (F.col("c_custkey") % 50).cast("string")))
        .when(F.col("c_custkey") % 3 == 1, "").alias("url"),
    )
    out = IN.upsert(listings, batch, ["k"], F.to_timestamp(F.lit(FX.NOW)))
    return out.where("last_seen_at IS NOT NULL").select("address", "price", F.nullif("url", F.lit("")).alias("url"))


@query(
    "upsert_insert",
    f"WITH {S.RAW}, b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS old_id, CASE WHEN o_orderkey % 4 = 3 THEN concat('N', o_orderkey % 50) END AS fresh, {WHO['source']} AS src FROM orders WHERE o_orderkey % 8 < 4), "
    "n AS (SELECT fresh, max(k) AS k, max(CASE WHEN k % 3 <> 0 THEN k END) AS pk FROM b WHERE fresh IS NOT NULL GROUP BY 1) "
    "SELECT id AS old_id, CASE WHEN b.k IS NOT NULL THEN 'moved' ELSE raw.address END AS address, CASE WHEN b.k IS NOT NULL THEN b.k + 0.5e0 ELSE raw.price END AS price, "
    "CASE WHEN b.k % 3 <> 0 THEN concat('p', b.k) ELSE array_to_string(photos, '|') END AS photos, CASE WHEN b.src IS NOT NULL THEN concat('old|', b.src) ELSE 'old' END AS seen, 1 AS ids "
    "FROM raw LEFT JOIN b ON b.old_id = raw.id UNION ALL "
    "SELECT NULL, 'moved', k + 0.5e0, CASE WHEN pk IS NULL THEN '' ELSE concat('p', pk) END, 'delta', 1 FROM n",
)
def upsert_insert(spark, sf_dir):
    """Updates found by each key, inserts with duplicates in the batch, photos and sources."""
    raw = FX.raw_listings(spark, sf_dir).withColumn("sources_seen", F.array(F.lit("old"))).drop("visual_assessment")
    k = F.col("k")
    batch = (
        FX.table(spark, sf_dir, "orders").filter("o_orderkey % 8 < 4")
        .selectExpr("o_orderkey AS k", *[f"{e} AS {n}" for n, e in WHO.items()])
        .withColumns({
            "address": F.lit("moved"), "price": k + F.lit(0.5),
            "photos": F.when(k % 3 != 0, F.array(F.concat(F.lit("p"), k.cast("string")))).otherwise(F.array().cast("array<string>")),
        })
    )
    out = IN.upsert(raw, batch, ["k"], F.to_timestamp(F.lit(FX.NOW)))
    known = raw.select("id", F.lit(True).alias("_known"))
    same_id = out.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("ids"))
    return out.join(known, "id", "left").join(same_id, "id").select(
        F.when(F.col("_known"), F.col("id")).alias("old_id"), "address", "price",
        F.coalesce(joined("photos"), F.lit("")).alias("photos"), joined("sources_seen").alias("seen"), "ids",
    )


# --- what follows a match -----------------------------------------------------
SENT = "sent AS (SELECT event_id, 'immediate' AS channel FROM ev WHERE listing_id % 2 = 0 UNION ALL SELECT event_id, 'digest' FROM ev WHERE listing_id % 3 = 0)"


@query(
    "alerts_not_sent",
    f"{PASSING}, {S.EVENTS}, {SENT}, f AS (SELECT event_id, max(channel = 'immediate') AS was_now, max(channel = 'digest') AS was_digest FROM sent GROUP BY 1), "
    "r AS (SELECT ev.event_id, ev.listing_id AS listing_id, CASE "
    "WHEN event_type = 'new_listing' AND NOT coalesce(was_now, FALSE) AND ok.percent >= 76 THEN 'immediate' "
    "WHEN event_type = 'new_listing' AND NOT coalesce(was_now, FALSE) AND NOT coalesce(was_digest, FALSE) THEN 'digest' "
    "WHEN event_type = 'price_drop' AND ev.percent >= 3 AND NOT coalesce(was_now, FALSE) THEN 'immediate' "
    "WHEN event_type = 'price_drop' AND ev.percent >= 3 AND NOT coalesce(was_digest, FALSE) THEN 'digest' "
    "WHEN event_type = 'back_on_market' AND NOT coalesce(was_now, FALSE) THEN 'immediate' END AS channel "
    "FROM ev JOIN ok ON ok.id = ev.listing_id LEFT JOIN f ON f.event_id = ev.event_id) SELECT * FROM r WHERE channel IS NOT NULL",
)
def alerts_not_sent(spark, sf_dir):
    """Every channel fires once per event."""
    events = FX.events_of(spark, sf_dir)
    sent = events.filter("listing_id % 2 = 0").select("event_id", F.lit("immediate").alias("channel")).unionByName(
        events.filter("listing_id % 3 = 0").select("event_id", F.lit("digest").alias("channel"))
    )
    return AL.route_alerts(events, FX.listings(spark, sf_dir), RENTAL, sent).select("event_id", "listing_id", "channel")


@query(
    "stale_alerts",
    f"{PASSING}, {S.EVENTS} SELECT id AS listing_id, 'digest' AS channel, concat('DOM ', days_on_market) AS reason, round(points, 6) AS points FROM ok WHERE days_on_market >= 45 "
    "AND id NOT IN (SELECT listing_id FROM ev WHERE event_type = 'price_drop')",
)
def stale_alerts(spark, sf_dir):
    marks = FX.events_of(spark, sf_dir).filter("event_type = 'price_drop'").withColumn("event_type", F.lit("dom_stale"))
    return AL.stale_alerts(FX.listings(spark, sf_dir), marks, RENTAL).select("listing_id", "channel", "reason", r6("points"))


PRICE = "CASE WHEN price IS NULL THEN 'Price n/a' WHEN price >= 1000 THEN concat('$', CAST(CAST(price AS BIGINT) // 1000 AS VARCHAR), ',', lpad(CAST(CAST(price AS BIGINT) % 1000 AS VARCHAR), 3, '0')) ELSE concat('$', CAST(price AS BIGINT)) END"


def _alerts(spark, sf_dir):
    k = F.col("id")
    return FX.raw_listings(spark, sf_dir).withColumns({
        "channel": F.when(k % 4 == 0, "immediate").otherwise("daily_digest"),
        "address": F.when(k % 10 == 0, " ").otherwise(F.col("address")),
        "match_score": F.when(k % 7 != 0, (k % 100).cast("double")), "score_points": (k % 50).cast("double") + 0.5,
        "score_tier": F.when(k % 5 == 0, "").otherwise("Strong"), "reason": F.when(k % 2 == 0, "New listing").otherwise(""),
        "top_positives": F.when(k % 3 == 0, F.array(*[F.lit(w) for w in "abcd"])).otherwise(F.array().cast("array<string>")),
        "key_tradeoff": F.when(k % 6 == 0, "High HOA"), "why_now": F.when(k % 8 == 1, "Back on market"),
    })


@query(
    "alert_lines",
    f"WITH {S.RAW} SELECT id, concat('- ', CASE WHEN id % 10 = 0 THEN 'Address n/a' ELSE address END, ' — ', {PRICE}, ' — ', CASE WHEN id % 7 = 0 THEN 'n/a' ELSE concat(id % 100, '.0%') END, ' (', id % 50, '.5 pts, ', "
    "CASE WHEN id % 5 = 0 THEN 'tier n/a' ELSE 'Strong' END, ')', CASE WHEN id % 2 = 0 THEN ' — New listing' ELSE '' END, ' — ', url) AS line, "
    "'  ' || nullif(concat_ws(' | ', CASE WHEN id % 3 = 0 THEN 'Top: a, b, c' END, CASE WHEN id % 6 = 0 THEN 'Tradeoff: High HOA' END, CASE WHEN id % 8 = 1 THEN 'Why now: Back on market' END), '') AS detail FROM raw",
)
def alert_lines(spark, sf_dir):
    return AL.alert_lines(_alerts(spark, sf_dir)).select("id", "line", "detail")


@query(
    "alert_subjects",
    "SELECT channel, count(*) AS listings, concat('[nestrank] ', CASE channel WHEN 'immediate' THEN 'Immediate' ELSE 'Daily Digest' END, ' alert: ', count(*), CASE WHEN count(*) = 1 THEN ' listing' ELSE ' listings' END) AS subject "
    "FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'immediate' ELSE 'daily_digest' END AS channel FROM orders) GROUP BY 1",
)
def alert_subjects(spark, sf_dir):
    return AL.alert_subjects(_alerts(spark, sf_dir)).select("channel", "listings", "subject")


SCOUT_FRESH = (
    f"{CANDIDATES}, {S.SCOUTS}, pool AS (SELECT *, row_number() OVER (ORDER BY points DESC, id) AS rank FROM cand QUALIFY rank <= 100), "
    "m AS (SELECT scout_id, max_results_per_alert AS most, id AS listing_id, rank FROM scouts JOIN pool ON percent >= CASE WHEN min_match_score = 0 THEN 30 ELSE min_match_score END), "
    "seen AS (SELECT DISTINCT l_suppkey AS scout_id, l_orderkey AS listing_id FROM lineitem), fresh AS (SELECT * FROM m ANTI JOIN seen USING (scout_id, listing_id))"
)


@query(
    "scout_alerts",
    f"{SCOUT_FRESH} SELECT scout_id, listing_id, CAST(rank AS INTEGER) AS rank FROM fresh QUALIFY row_number() OVER (PARTITION BY scout_id ORDER BY rank) <= most",
)
def scout_alerts(spark, sf_dir):
    out = AL.run_scouts(FX.scouts(spark, sf_dir), FX.listings(spark, sf_dir), RENTAL, FX.scout_seen(spark, sf_dir))
    return out["alerts"].select("scout_id", "listing_id", "rank")


@query("scout_seen", f"{SCOUT_FRESH} SELECT scout_id, listing_id FROM seen UNION SELECT scout_id, listing_id FROM fresh")
def scout_seen(spark, sf_dir):
    out = AL.run_scouts(FX.scouts(spark, sf_dir), FX.listings(spark, sf_dir), RENTAL, FX.scout_seen(spark, sf_dir))
    return out["seen"].select("scout_id", "listing_id")


RUNS = {
    "id": "event_id", "scout_id": "user_id", "started_at": "ts", "completed_at": "ts", "top_score": "value",
    "average_score": "value / 2", "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END",
}


@query(
    "latest_scout_run",
    f"WITH r AS ({FX.select_sql(RUNS, 'events')}) SELECT scout_id, id, top_score FROM r WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY scout_id ORDER BY started_at DESC, id DESC) = 1",
)
def latest_scout_run(spark, sf_dir):
    runs = FX.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in RUNS.items()])
    return AL.latest_run(runs).select("scout_id", "id", "top_score")


@query(
    "one_scouts_runs",
    f"WITH r AS ({FX.select_sql(RUNS, 'events')}) SELECT id, status FROM r WHERE scout_id = 7 ORDER BY started_at DESC, id DESC LIMIT 10",
)
def one_scouts_runs(spark, sf_dir):
    runs = FX.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in RUNS.items()])
    return AL.scout_runs(runs, 7).select("id", "status")


@query(
    "visual_cost",
    f"WITH {S.RAW} SELECT count(*) AS needs_analysis, CAST(sum(least(n_photos, 3)) AS BIGINT) AS images, round(sum(least(n_photos, 3)) * 0.25e0, 2) AS estimated_cost FROM raw WHERE n_photos > 0",
)
def visual_cost(spark, sf_dir):
    return RP.visual_cost(RP.visual_queue(FX.raw_listings(spark, sf_dir), F.to_timestamp(F.lit(FX.NOW)), everything=True), 3, 0.25)


@query(
    "model_candidates",
    f"WITH {S.RAW}, t AS (SELECT id, concat(description, ' ', description, ' ', description) AS description, CAST((id * 7) % 100 AS DOUBLE) AS points FROM raw ORDER BY points DESC, id LIMIT 400) SELECT id, points, CASE WHEN points >= 90 THEN 'hard' ELSE 'standard' END AS model "
    "FROM t WHERE len(regexp_extract_all(description, '\\S+')) >= 40",
)
def model_candidates(spark, sf_dir):
    rows = FX.raw_listings(spark, sf_dir).withColumns({
        "points": ((F.col("id") * 7) % 100).cast("double"), "description": F.concat_ws(" ", *["description"] * 3),
    })
    return TM.model_candidates(rows, 400).select("id", "points", "model")


@query(
    "merged_results",
    f"WITH {S.RAW} SELECT id, CASE WHEN id % 6 = 0 THEN 'p|q|r' ELSE 'own' END AS positives, CASE WHEN id % 4 = 0 THEN 'Small rooms' ELSE 'Low on views' END AS tradeoff, "
    "CASE WHEN id % 10 = 0 THEN 'Rare' ELSE 'Seen' END AS why_now, id % 2 <> 0 AS uncached FROM raw",
)
def merged_results(spark, sf_dir):
    """Stored model results over computed texts; the rest has no result yet."""
    k = F.col("id")
    ranked = FX.raw_listings(spark, sf_dir).select(
        "id", F.sha2(k.cast("string"), 256).alias("payload_hash"), F.array(F.lit("own")).alias("top_positives"),
        F.lit("Low on views").alias("key_tradeoff"), F.lit("Seen").alias("why_now"),
    )
    results = ranked.filter("id % 2 = 0").select(
        "payload_hash",
        F.when(k % 6 == 0, F.array(*[F.lit(w) for w in "pqrs"])).otherwise(F.array().cast("array<string>")).alias("positives"),
        F.array(F.when(k % 4 == 0, "Small rooms").otherwise("Lovely")).alias("tradeoffs"),
        F.when(k % 10 == 0, "Rare").otherwise("").alias("reason_now"),
    )
    missing = TM.uncached(ranked, results).select("id", F.lit(True).alias("uncached"))
    return TM.merge_results(ranked, results).join(missing, "id", "left").select(
        "id", joined("top_positives").alias("positives"), F.col("key_tradeoff").alias("tradeoff"), "why_now",
        F.coalesce("uncached", F.lit(False)).alias("uncached"),
    )


@query(
    "feedback_with_scores",
    f"WITH {S.RAW}, {S.FEEDBACK} SELECT user_id, fb.listing_id AS listing_id, feedback_type, price FROM fb JOIN raw ON raw.id = fb.listing_id",
)
def feedback_with_scores(spark, sf_dir):
    log = LE.latest_feedback(FX.feedback_log(spark, sf_dir))
    out = J.feedback_with_scores(log, FX.raw_listings(spark, sf_dir).select("id", "price"))
    return out.select("user_id", "listing_id", "feedback_type", "price")


@query("customer_nations", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def customer_nations(spark, sf_dir):
    nations = FX.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(FX.table(spark, sf_dir, "customer"), nations, "c_nationkey").select("c_custkey", "n_name")


LEARNED = {"user_id": "c_custkey % 97", "criterion": "CASE c_custkey % 4 WHEN 0 THEN 'views' WHEN 1 THEN 'parking' WHEN 2 THEN 'storage' ELSE 'dishwasher' END"}


@query(
    "learning_lists",
    f"WITH l AS (SELECT DISTINCT {LEARNED['user_id']} AS user_id, {LEARNED['criterion']} AS criterion FROM customer), m AS (SELECT *, CASE criterion WHEN 'views' THEN 1.75e0 WHEN 'parking' THEN 1.25e0 WHEN 'storage' THEN 0.75e0 ELSE 1e0 END AS x FROM l), "
    "n AS (SELECT *, CASE criterion WHEN 'views' THEN 'Views' WHEN 'parking' THEN 'Parking' WHEN 'storage' THEN 'Storage' END AS label FROM m) "
    "SELECT user_id, coalesce(string_agg(CASE WHEN x > 1.1 THEN concat(label, ' ', CAST((x - 1) * 100 AS INTEGER), ' 3') END, '|' ORDER BY x DESC), '') AS up, "
    "coalesce(string_agg(CASE WHEN x < 0.9 THEN concat(label, ' ', CAST((1 - x) * 100 AS INTEGER), ' 3') END, '|' ORDER BY x), '') AS down, count(*) AS preferences_learned FROM n GROUP BY 1",
)
def learning_lists(spark, sf_dir):
    rows = FX.table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in LEARNED.items()]).distinct()
    c = F.col("criterion")
    stored = rows.withColumns({
        "multiplier": F.when(c == "views", 1.75).when(c == "parking", 1.25).when(c == "storage", 0.75).otherwise(1.0),
        "signal_count": F.lit(3),
    })

    def listed(col: str, name: str):
        return F.array_join(F.transform(col, lambda e: F.concat_ws(" ", e.criterion, e[name].cast("string"), e.signals.cast("string"))), "|")

    return LE.learning_summary(stored).select(
        "user_id", listed("strengthened_preferences", "boost_percent").alias("up"),
        listed("weakened_preferences", "reduction_percent").alias("down"), "preferences_learned",
    )


def _sorted_signals(mode: str, column: str, default: str, value: str):
    @query(
        f"sort_{mode}",
        f"WITH {S.RAW} SELECT id FROM (SELECT *, {value} AS v FROM raw) ORDER BY coalesce(v, {default}) DESC, id LIMIT 500",
    )
    def run(spark, sf_dir):
        rows = FX.raw_listings(spark, sf_dir).withColumn(column, F.expr(value))
        return FL.sort_matches(rows, mode).limit(500).select("id")

    return run


for _args in (
    ("score", "match_score", "0", "CASE WHEN id % 3 <> 0 THEN CAST(id % 101 AS DOUBLE) END"),
    ("light", "light_potential_score", "50", "CASE WHEN id % 5 <> 0 THEN CAST(id % 101 AS INT) END"),
    ("tranquility", "tranquility_score", "50", "CASE WHEN id % 7 <> 0 THEN CAST((id * 3) % 101 AS INT) END"),
):
    _sorted_signals(*_args)


def _sorted_whole(mode: str, default: str, value: str, down: bool):
    column = FL.SORTS[mode][0]

    @query(
        f"sort_{mode}_all",
        f"WITH {S.RAW} SELECT id, coalesce(v, {default}) AS sort_value FROM (SELECT id, {value} AS v FROM raw) ORDER BY sort_value{' DESC' if down else ''}, id",
    )
    def run(spark, sf_dir):
        rows = FX.raw_listings(spark, sf_dir).withColumn(column, F.expr(value))
        return FL.sort_matches(rows, mode).select("id", FL.sort_value(mode).alias("sort_value"))

    return run


# every row, with the value that fixes its place; prices of every seventh row are missing
_PRICE = "CASE WHEN id % 7 <> 0 THEN price END"
for _whole in (
    ("score", "0", "CASE WHEN id % 3 <> 0 THEN CAST(id % 101 AS DOUBLE) END", True),
    ("price_low", "CAST('Infinity' AS DOUBLE)", _PRICE, False),
    ("price_high", "0", _PRICE, True),
    ("light", "50", "CASE WHEN id % 5 <> 0 THEN CAST(id % 101 AS INT) END", True),
    ("tranquility", "50", "CASE WHEN id % 7 <> 0 THEN CAST((id * 3) % 101 AS INT) END", True),
    ("newest", "999", "days_on_market", False),
):
    _sorted_whole(*_whole)
