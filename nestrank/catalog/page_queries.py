"""Web page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog.registry import query
from nestrank.functions import columns as CO
from nestrank.sources import pages as PG

HREF = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']"


@query(
    "page_links",
    f"SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS pos, unnest(hrefs) AS href FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS hrefs FROM pages)",
)
def page_links(spark, sf_dir):
    return PG.page_links(FX.table(spark, sf_dir, "pages"))


@query(
    "canonical_page_urls",
    "SELECT page_id, concat('https://', regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^www\\.', ''), regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')) AS url "
    "FROM pages WHERE regexp_extract(lower(url), '^https?://([^/?#]+)', 1) LIKE '%.example.com'",
)
def canonical_page_urls(spark, sf_dir):
    url = CO.canonical_url(F.col("url"), "example.com")
    return FX.table(spark, sf_dir, "pages").select("page_id", url.alias("url")).filter(F.col("url").isNotNull())


@query(
    "page_item_urls",
    "SELECT page_id, CAST(n AS INTEGER) AS pos, concat('https://example.com/', CASE n WHEN 0 THEN 'l/' ELSE 'm/' END, page_id) AS url FROM pages, range(0, 2) t(n) WHERE page_id % 4 = 1",
)
def page_item_urls(spark, sf_dir):
    return PG.extract_item_urls(FX.pages_with_blocks(spark, sf_dir))


@query(
    "page_linked_data",
    "SELECT page_id, concat(page_id, ' Main St, Springfield') AS address, CAST((page_id * 10 + 1000) * 1000 AS DOUBLE) AS price, CAST(2 AS INTEGER) AS beds, 40.7e0 AS lat, concat('https://img.example.com/', page_id, '.jpg') AS photo, "
    "'Apartment' AS property_type FROM pages WHERE page_id % 4 = 1",
)
def page_linked_data(spark, sf_dir):
    out = PG.linked_data(FX.pages_with_blocks(spark, sf_dir))
    return out.select("page_id", "address", "price", "beds", "lat", F.array_join("photos", "|").alias("photo"), "property_type")


@query(
    "page_app_state",
    "SELECT page_id, concat(page_id, ' Oak Ave') AS address, CAST(page_id + 2000 AS DOUBLE) AS price, CAST(3 AS INTEGER) AS beds, 1.5e0 AS baths, CAST(900 AS INTEGER) AS sqft FROM pages WHERE page_id % 4 = 3",
)
def page_app_state(spark, sf_dir):
    return PG.extract_embedded(FX.pages_with_blocks(spark, sf_dir)).select("page_id", "address", "price", "beds", "baths", "sqft")


# A state block per page: two equal objects, the later one under the smaller name, at a depth by page.
STATE_PAGE = (
    "concat('<script>window.__INITIAL_STATE__ = ', repeat('{\"k\":', CAST(page_id % 10 AS INT)), '{\"z\":{\"address\":\"first ', page_id, "
    "'\",\"price\":1,\"beds\":2},\"a\":{\"address\":\"second ', page_id, '\",\"price\":', page_id + 1000, "
    "',\"beds\":\"{beds}\"}}', repeat('}', CAST(page_id % 10 AS INT)), ';</script>', html)"
)


@query(
    "page_state_depth",
    "SELECT page_id, concat('second ', page_id) AS address, CAST(page_id + 1000 AS DOUBLE) AS price FROM pages WHERE page_id % 10 <= 7",
)
def page_state_depth(spark, sf_dir):
    pages = FX.table(spark, sf_dir, "pages").selectExpr("page_id", f"{STATE_PAGE} AS html")
    return PG.extract_embedded(pages).select("page_id", "address", "price")


@query(
    "detail_text",
    "SELECT doc_id, coalesce(regexp_matches(t, 'parking|garage'), FALSE) AS parking, coalesce(regexp_matches(t, '\\bgym\\b|fitness'), FALSE) AS gym, "
    "TRY_CAST(nullif(regexp_extract(t, '(\\d+)\\s*(?:bed|br|bedroom)', 1), '') AS INTEGER) AS beds, TRY_CAST(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(?:bath|ba)', 1), '') AS DOUBLE) AS baths "
    "FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
)
def detail_text(spark, sf_dir):
    out = PG.mine_detail_text(FX.table(spark, sf_dir, "documents"), "text")
    return out.select(
        "doc_id", F.coalesce("has_parking_keywords", F.lit(False)).alias("parking"),
        F.coalesce("has_gym_keywords", F.lit(False)).alias("gym"), "beds", "baths",
    )
