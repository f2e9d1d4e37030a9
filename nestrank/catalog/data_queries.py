"""Ingest, feed and table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog import sqltext as S
from nestrank.catalog.registry import joined, query
from nestrank.catalog.text_queries import hood_point_sql
from nestrank.operators import ingest as IN
from nestrank.operators import joins as J
from nestrank.operators import reports as RP
from nestrank.operators import text_model as TM
from nestrank.sources import feeds as FD

SUMMARY = {
    "seq": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_extendedprice)",
    "source": "CASE WHEN l_suppkey % 3 = 0 THEN 'alpha' ELSE 'beta' END",
    "source_listing_id": "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN '' ELSE CAST(l_orderkey AS VARCHAR(20)) END",
    "listing_id": "CASE WHEN l_partkey % 5 = 1 THEN concat('x', CAST(l_orderkey AS VARCHAR(20))) END",
    "url": "CASE WHEN l_linenumber > 5 THEN NULL ELSE concat(' https://e.com/', CAST(l_partkey AS VARCHAR(20)), ' ') END",
    "price": "l_extendedprice",
}


def _summaries(spark, sf_dir):
    return FX.table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in SUMMARY.items()])


@query(
    "dedupe_first",
    f"WITH s AS ({FX.select_sql(SUMMARY, 'lineitem')}), k AS (SELECT *, coalesce(nullif(source_listing_id, ''), listing_id, nullif(trim(url), '')) AS k FROM s) "
    "SELECT source, k IS NULL AS keyless, count(*) AS kept, min(seq) AS first_seq, round(sum(round(price, 2)), 2) AS total FROM "
    "(SELECT * FROM k QUALIFY k IS NULL OR row_number() OVER (PARTITION BY source, k ORDER BY seq) = 1) GROUP BY 1, 2",
)
def dedupe_first(spark, sf_dir):
    kept = IN.dedupe_first(_summaries(spark, sf_dir), ["seq"]).withColumn("keyless", IN.summary_key().isNull())
    cents = F.sum(F.rint(F.round("price", 2) * 100).cast("bigint")) / 100
    return kept.groupBy("source", "keyless").agg(
        F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first_seq"), F.round(cents, 2).alias("total")
    )


@query(
    "dedupe_by_url",
    f"WITH s AS ({FX.select_sql(SUMMARY, 'lineitem')}) SELECT coalesce(nullif(source_listing_id, ''), nullif(url, '')) AS k, min(seq) AS seq FROM s WHERE coalesce(nullif(source_listing_id, ''), nullif(url, '')) IS NOT NULL GROUP BY 1",
)
def dedupe_by_url(spark, sf_dir):
    kept = IN.dedupe_by_url(_summaries(spark, sf_dir), ["seq"])
    return kept.select(F.coalesce(F.nullif("source_listing_id", F.lit("")), F.nullif("url", F.lit(""))).alias("k"), "seq")


@query(
    "enrichment_queue",
    f"WITH {S.RAW} SELECT source, id, CAST(rn AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN price <= 5000 AND price <> 0 THEN 0 ELSE 1 END, n_photos DESC, id) AS rn FROM raw) "
    "WHERE rn <= CASE source WHEN 'alpha' THEN 10 ELSE 60 END",
)
def enrichment_queue(spark, sf_dir):
    return IN.enrichment_queue(FX.raw_listings(spark, sf_dir), 60, {"alpha": 10}, 5000).select("source", "id", "priority")


@query(
    "merge_detail",
    f"WITH {S.RAW}, d AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE price + 1 END AS price, CASE id % 3 WHEN 0 THEN 'Brooklyn' WHEN 1 THEN 'Soho East' END AS hood FROM raw WHERE beds > 1) "
    "SELECT raw.id, coalesce(d.price, raw.price) AS price, CASE WHEN raw.neighborhood IS NOT NULL AND d.hood = 'Brooklyn' THEN raw.neighborhood ELSE coalesce(d.hood, raw.neighborhood) END AS neighborhood, "
    "CASE WHEN d.id IS NOT NULL THEN 0 ELSE n_photos END AS photos FROM raw LEFT JOIN d USING (id)",
)
def merge_detail(spark, sf_dir):
    raw = FX.raw_listings(spark, sf_dir)
    details = raw.filter("beds > 1").select(
        "source", "source_listing_id", F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE price + 1 END AS price"),
        F.expr("CASE id % 3 WHEN 0 THEN 'Brooklyn' WHEN 1 THEN 'Soho East' END AS neighborhood"),
        F.lit(None).cast("array<string>").alias("photos"),
    )
    out = IN.merge_detail(raw, details)
    return out.select("id", "price", "neighborhood", F.size("photos").alias("photos"))


BATCH_ORDER = ["observed_at", "line_no", "part_no", "supp_no", "price"]


@query(
    "upsert_merge",
    f"WITH {S.RAW}, {S.OBS}, b AS (SELECT listing_id AS id, max_by(struct_pack(p := price, s := listing_status), struct_pack({', '.join(f'c{i} := {c}' for i, c in enumerate(BATCH_ORDER))})) AS r FROM obs GROUP BY 1) "
    "SELECT raw.source_listing_id, CASE WHEN b.id IS NOT NULL THEN r.p ELSE price END AS price, CASE WHEN b.id IS NOT NULL THEN r.s ELSE listing_status END AS listing_status, n_photos AS photos, "
    f"CASE WHEN b.id IS NOT NULL THEN coalesce(neighborhood, {hood_point_sql()}) ELSE neighborhood END AS neighborhood, b.id IS NOT NULL AS seen FROM raw LEFT JOIN b USING (id)",
)
def upsert_merge(spark, sf_dir):
    listings = FX.raw_listings(spark, sf_dir).withColumns(
        {"sources_seen": F.array().cast("array<string>"), "last_seen_at": F.lit(None).cast("timestamp")}
    ).drop("visual_assessment")
    obs = FX.observations(spark, sf_dir)
    key = F.col("listing_id")
    batch = obs.select(
        F.when(key % 3 == 0, "alpha").when(key % 3 == 1, "beta").otherwise("gamma").alias("source"),
        F.concat(F.lit("L"), key.cast("string")).alias("source_listing_id"), F.lit(None).cast("string").alias("listing_id"),
        F.lit(None).cast("string").alias("url"), F.lit("somewhere").alias("address"), "listing_status",
        F.array().cast("array<string>").alias("photos"), *BATCH_ORDER,
    )
    kept = [c for c in listings.columns if c not in ("url", "address")]
    out = IN.upsert(listings.select("url", "address", *kept), batch, BATCH_ORDER, F.to_timestamp(F.lit(FX.NOW)))
    return out.select(
        "source_listing_id", "price", "listing_status", F.size("photos").alias("photos"), "neighborhood",
        F.col("last_seen_at").isNotNull().alias("seen"),
    )


@query(
    "resolved_ids",
    f"WITH {S.RAW} SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (SELECT id FROM raw WHERE raw.id = c_custkey) WHEN 1 THEN (SELECT id FROM raw r WHERE r.id = c_custkey + 1) ELSE NULL END AS existing_id FROM customer",
)
def resolved_ids(spark, sf_dir):
    k = F.col("c_custkey")
    source = F.when(k % 3 == 0, "alpha").when(k % 3 == 1, "beta").otherwise("gamma")
    nxt = k + 1
    nxt_source = F.when(nxt % 3 == 0, "alpha").when(nxt % 3 == 1, "beta").otherwise("gamma")
    batch = FX.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 == 0, source).otherwise("none").alias("source"),
        F.concat(F.lit("L"), k.cast("string")).alias("source_listing_id"),
        F.when(k % 3 == 1, F.concat(nxt_source, F.lit(":L"), nxt.cast("string"))).alias("listing_id"),
        F.lit("https://nowhere.example.com").alias("url"),
    )
    return J.resolve_ids(batch, FX.raw_listings(spark, sf_dir)).select("c_custkey", "existing_id")


@query(
    "photo_sample",
    f"WITH {S.RAW}, s AS (SELECT id, list_slice(list_concat(list_filter([0, 2, 4], lambda i: i < n_photos), list_filter(range(0, n_photos), lambda i: i NOT IN (0, 2, 4))), 1, 3) AS pick FROM raw WHERE n_photos > 0) "
    "SELECT id, CAST(n - 1 AS INTEGER) AS sample_no, CAST(pick[n] AS INTEGER) AS photo_ix FROM s, range(1, 4) t(n) WHERE n <= len(pick)",
)
def photo_sample(spark, sf_dir):
    return IN.photo_sample(FX.raw_listings(spark, sf_dir)).select("id", "sample_no", "photo_ix")


@query(
    "payload_hash",
    f"WITH {S.RAW}, {S.EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, event_id DESC) AS rn FROM ev), "
    "t AS (SELECT listing_id, string_agg(CASE event_type WHEN 'price_drop' THEN concat('Price drop: ', CAST(CAST(round_even(percent, 0) AS BIGINT) AS VARCHAR), '%') WHEN 'back_on_market' THEN 'Back on market' "
    "WHEN 'new_listing' THEN 'New listing' ELSE replace(event_type, '_', ' ') END, chr(10) ORDER BY rn) AS lines FROM n WHERE rn <= 5 GROUP BY 1), "
    "x AS (SELECT raw.*, t.lines, CASE WHEN price IS NULL THEN 'n/a' WHEN price >= 1000 THEN concat('$', CAST(CAST(price AS BIGINT) // 1000 AS VARCHAR), ',', lpad(CAST(CAST(price AS BIGINT) % 1000 AS VARCHAR), 3, '0')) ELSE concat('$', CAST(CAST(price AS BIGINT) AS VARCHAR)) END AS pt FROM raw LEFT JOIN t ON t.listing_id = raw.id) "
    "SELECT id, sha256(concat_ws(chr(10), '# Listing', concat('Address: ', address), concat('Price: ', pt), concat('Beds: ', coalesce(CAST(nullif(beds, 0) AS VARCHAR), 'n/a')), concat('Baths: ', CAST(baths AS VARCHAR)), "
    "concat('Sqft: ', coalesce(CAST(sqft AS VARCHAR), 'n/a')), concat('Neighborhood: ', coalesce(neighborhood, 'n/a')), concat('Days on market: ', coalesce(CAST(nullif(days_on_market, 0) AS VARCHAR), 'n/a')), "
    "'', '# Description', description, '', '# Timeline', coalesce(lines, 'No recent events.'))) AS payload_hash FROM x",
)
def payload_hash(spark, sf_dir):
    return TM.text_payload(FX.raw_listings(spark, sf_dir), FX.events_of(spark, sf_dir)).select("id", "payload_hash")


FEED_A = (
    "to_json(named_struct('property_list', array(named_struct('property_id', CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id AS STRING) END, 'property_price', price, 'property_address', address, "
    "'bedrooms_count', beds, 'bathrooms_count', baths, 'latitude', lat, 'longitude', lon, 'neighborhood', neighborhood, 'property_image', CASE WHEN id % 2 = 0 THEN url END))))"
)


@query(
    "feed_a_search",
    f"WITH {S.RAW} SELECT CAST(id AS VARCHAR) AS source_listing_id, address, price, beds, lat, CASE WHEN id % 4 = 0 AND (neighborhood IS NULL OR neighborhood = 'Brooklyn') THEN 'DUMBO' ELSE neighborhood END AS neighborhood, "
    "CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS photos FROM raw WHERE id % 10 <> 0",
)
def feed_a_search(spark, sf_dir):
    raw = FX.raw_listings(spark, sf_dir).select(
        F.expr(FEED_A).alias("payload"), F.when(F.col("id") % 4 == 0, "dumbo-brooklyn-new-york-ny").otherwise("elsewhere").alias("slug")
    )
    out = FD.normalize_search_a(raw)
    return out.select("source_listing_id", "address", "price", "beds", "lat", "neighborhood", F.size("photos").alias("photos"))


FEED_B = (
    "concat('{}&&', to_json(named_struct('homes', array(named_struct('propertyId', CAST(id AS STRING), 'streetLine', CASE WHEN id % 9 = 0 THEN NULL ELSE address END, 'city', 'Town', 'zip', CAST(10000 + id % 90 AS STRING), "
    "'listPrice', price, 'bedrooms', beds, 'baths', baths, 'sqFt', sqft, 'latitude', lat, 'url', concat('/home/', CAST(id AS STRING)))))))"
)


@query(
    "feed_b_search",
    f"WITH {S.RAW} SELECT CAST(id AS VARCHAR) AS source_listing_id, concat_ws(', ', CASE WHEN id % 9 = 0 THEN NULL ELSE address END, 'Town', CAST(10000 + id % 90 AS VARCHAR)) AS address, price, beds, baths, sqft, lat, "
    "concat('https://www.redfin.com/home/', id) AS url FROM raw",
)
def feed_b_search(spark, sf_dir):
    out = FD.normalize_search_b(FX.raw_listings(spark, sf_dir).select(F.expr(FEED_B).alias("payload")))
    return out.select("source_listing_id", "address", "price", "beds", "baths", "sqft", "lat", "url")


@query(
    "source_audit",
    f"WITH {S.RAW}, up AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source, count(*) AS upserts, count(DISTINCT l_orderkey) AS unique_listings FROM lineitem GROUP BY 1) "
    "SELECT raw.source, count(*) AS listings, max(upserts) AS upserts, max(unique_listings) AS unique_listings, count(*) >= 300 AS count_ok FROM raw JOIN up USING (source) GROUP BY 1",
)
def source_audit(spark, sf_dir):
    raw = FX.table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source", "l_orderkey AS source_listing_id"
    )
    listings = FX.raw_listings(spark, sf_dir)
    baseline = listings.select("source").distinct().withColumn("baseline", F.lit(100))
    return RP.source_audit(raw, listings, baseline).select("source", "listings", "upserts", "unique_listings", "count_ok")


@query(
    "run_counters",
    "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS run_id, l_returnflag AS source, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS summary_count, count(CASE WHEN l_linestatus <> 'O' THEN 1 END) AS upsert_count FROM lineitem GROUP BY 1, 2",
)
def run_counters(spark, sf_dir):
    rows = FX.table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS run_id", "l_returnflag AS source",
        "CASE WHEN l_linestatus = 'O' THEN 'summary' ELSE 'upsert' END AS stage",
    )
    return RP.run_counters(rows).select("run_id", "source", "summary_count", "upsert_count")


@query(
    "run_freshness",
    "SELECT CASE WHEN h < 6 THEN 'up_to_date' WHEN h < 24 THEN 'stale' ELSE 'outdated' END AS status, round_even(h * 10e0, 0) / 10e0 AS hours_since_update FROM "
    "(SELECT (epoch(TIMESTAMP '2026-01-01 00:00:00') - floor(epoch(max(o_orderdate)))) / 3600e0 AS h FROM orders)",
)
def run_freshness(spark, sf_dir):
    runs = FX.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ended_at"))
    return RP.freshness(runs, F.to_timestamp(F.lit("2026-01-01 00:00:00"))).select("status", "hours_since_update")
