"""Raw feed payloads (one JSON text per row) to listing rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.sources.profiles import parse_profile_text

SEARCH_A = """
struct<property_list: array<struct<property_id: string, zpid: string, property_price: double,
  price: double, property_address: string, latitude: double, longitude: double,
  bedrooms_count: int, bathrooms_count: double, property_dimensions: int,
  property_url: string, property_status: string, property_type: string,
  neighborhood: string, city: string, property_image: string>>>
"""
DETAIL_A = """
struct<property_description: string, year_built: int, property_images: array<string>,
  property_image: string, latitude: double, longitude: double, listing_days: int,
  neighborhood: string, city: string>
"""
# Feed B spells the same field with different case (sqft, sqFt), so a home is a map.
SEARCH_B = "struct<homes: array<map<string, string>>>"
DETAIL_B = """
struct<remarks: string, description: string, price: double, beds: int, bedrooms: int,
  baths: double, bathrooms: double, sqft: int, livingArea: int, lat: double,
  latitude: double, lng: double, longitude: double, address: string, photos: string,
  yearBuilt: int>
"""


def _parsed(raw: Column, ddl: str) -> Column:
    return F.from_json(raw, " ".join(ddl.split()), {"mode": "PERMISSIVE"})


def _number(*cols: Column) -> Column:
    """First number that is neither NULL nor zero, else the last one given."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("double")) for c in cols], cols[-1])


def normalize_search_a(raw: DataFrame, raw_col: str = "payload", slug_col: str = "slug", slugs: Mapping[str, str] = CO.LOCATION_SLUGS) -> DataFrame:
    """Search payloads of feed A to summaries.

    Rows without an id are dropped; when the feed only names a borough, the
    neighbourhood of the search area takes its place.
    """
    rows = raw.withColumn("_j", _parsed(F.col(raw_col), SEARCH_A)).select(
        F.col(slug_col).alias("_slug"), F.inline("_j.property_list")
    )
    ident = CO.first_true(F.col("property_id"), F.col("zpid"))
    area = F.element_at(F.create_map(*[F.lit(v) for item in slugs.items() for v in item]), F.col("_slug"))
    named = CO.first_true(F.col("neighborhood"), F.col("city"))
    vague = named.isNull() | F.lower(named).isin(*CO.SEARCH_GENERIC)
    none = F.array().cast("array<string>")
    return rows.filter(ident.isNotNull()).select(
        F.lit("zillow").alias("source"),
        ident.alias("source_listing_id"),
        ident.alias("listing_id"),
        F.col("property_address").alias("address"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        _number(F.col("property_price"), F.col("price")).alias("price"),
        F.col("bedrooms_count").alias("beds"),
        F.col("bathrooms_count").alias("baths"),
        F.col("property_dimensions").alias("sqft"),
        F.col("property_url").alias("url"),
        F.col("property_status").alias("listing_status"),
        "property_type",
        F.when(area.isNotNull() & vague, area).otherwise(named).alias("neighborhood"),
        F.when(F.nullif("property_image", F.lit("")).isNotNull(), F.array("property_image"))
        .otherwise(none).alias("photos"),
    )


def normalize_detail_a(raw: DataFrame, raw_col: str = "payload", id_col: str = "listing_id") -> DataFrame:
    """Detail payloads of feed A; photos are the list, else the single image, else NULL."""
    j = raw.withColumn("_j", _parsed(F.col(raw_col), DETAIL_A)).filter(F.col("_j").isNotNull())
    images = F.filter("_j.property_images", lambda p: p.isNotNull())
    single = F.nullif("_j.property_image", F.lit(""))
    photos = F.when(F.col("_j.property_images").isNotNull(), F.when(F.size(images) > 0, images)).when(
        single.isNotNull(), F.array(single)
    )
    return j.select(
        F.lit("zillow").alias("source"),
        F.col(id_col).cast("string").alias("source_listing_id"),
        F.col("_j.property_description").alias("description"),
        F.col("_j.year_built").alias("year_built"),
        F.col("_j.latitude").alias("lat"),
        F.col("_j.longitude").alias("lon"),
        F.col("_j.listing_days").alias("days_on_market"),
        CO.first_true(F.col("_j.neighborhood"), F.col("_j.city")).alias("neighborhood"),
        photos.alias("photos"),
    )


def normalize_search_b(raw: DataFrame, raw_col: str = "payload", base: str = "https://www.redfin.com") -> DataFrame:
    """Search payloads of feed B: guard prefix off, alternates per field; rows without an
    id or an address are dropped."""
    body = F.regexp_replace(F.col(raw_col), r"^\{\}&&", "")
    h = raw.withColumn("_j", _parsed(body, SEARCH_B)).select(F.explode("_j.homes").alias("h")).filter(
        F.col("h").isNotNull()
    )

    def text(*names: str) -> Column:
        return CO.first_true(*[F.element_at("h", F.lit(n)) for n in names])

    def either(*names: str) -> Column:
        return _number(*[F.element_at("h", F.lit(n)).try_cast("double") for n in names])

    link = text("url", "listingUrl", "urlV2")
    url = F.when(F.startswith(link, F.lit("/")), F.concat(F.lit(base), link)).otherwise(link)
    street = text("streetLine", "address", "streetAddress")
    address = CO.format_address(street, text("city"), text("state"), text("zip", "zipCode"))
    ident = F.coalesce(text("propertyId", "listingId"), url)
    photo = text("photoUrl", "photo_url", "imageUrl")
    return h.select(
        F.lit("redfin").alias("source"),
        ident.alias("source_listing_id"),
        F.coalesce(address, street).alias("address"),
        either("price", "listPrice").alias("price"),
        either("beds", "bedrooms").cast("int").alias("beds"),
        either("baths", "bathrooms").alias("baths"),
        either("sqft", "sqFt", "livingArea").cast("int").alias("sqft"),
        either("lat", "latitude").alias("lat"),
        either("lng", "longitude").alias("lon"),
        url.alias("url"),
        text("status").alias("listing_status"),
        text("propertyType").alias("property_type"),
        F.when(photo.isNotNull(), F.array(photo)).otherwise(F.array().cast("array<string>")).alias("photos"),
    ).filter(F.col("source_listing_id").isNotNull() & F.col("address").isNotNull())


def photo_urls(raw: Column) -> Column:
    """Urls of a JSON list whose entries are texts or objects with ``url`` or ``href``."""
    items = F.from_json(raw, "array<string>")
    return F.filter(
        F.transform(
            items,
            lambda i: F.when(
                F.startswith(i, F.lit("{")),
                CO.first_true(F.get_json_object(i, "$.url"), F.get_json_object(i, "$.href")),
            ).otherwise(i),
        ),
        lambda u: u.isNotNull(),
    )


def normalize_detail_b(raw: DataFrame, raw_col: str = "payload", id_col: str = "listing_id") -> DataFrame:
    j = raw.withColumn("_j", _parsed(F.col(raw_col), DETAIL_B)).filter(F.col("_j").isNotNull())
    addr = F.col("_j.address")

    def part(name: str) -> Column:
        return F.get_json_object(addr, f"$.{name}")

    joined = CO.format_address(part("streetLine"), part("city"), part("state"), part("zip"))

    def either(*names: str) -> Column:
        return _number(*[F.col(f"_j.{n}").cast("double") for n in names])

    return j.select(
        F.lit("redfin").alias("source"),
        F.col(id_col).cast("string").alias("source_listing_id"),
        CO.first_true(F.col("_j.remarks"), F.col("_j.description")).alias("description"),
        F.col("_j.price").alias("price"),
        either("beds", "bedrooms").cast("int").alias("beds"),
        either("baths", "bathrooms").alias("baths"),
        either("sqft", "livingArea").cast("int").alias("sqft"),
        either("lat", "latitude").alias("lat"),
        either("lng", "longitude").alias("lon"),
        F.when(F.startswith(addr, F.lit("{")), joined).otherwise(addr).alias("address"),
        F.coalesce(photo_urls(F.col("_j.photos")), F.array().cast("array<string>")).alias("photos"),
        F.col("_j.yearBuilt").alias("year_built"),
    )


SLUG_LENGTH = 24  # of a source key; None keeps long names apart


def source_slug(col: Column, longest: int | None = SLUG_LENGTH) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = slug if longest is None else F.substring(slug, 1, longest)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("curated"))


CURATED = (
    "source_name string, position int, url string, id string, address string, price double, "
    "beds int, baths double, sqft int, description string"
)


def curated_rows(spark: SparkSession, payload: Mapping) -> DataFrame:
    rows, position = [], 0
    for source in payload.get("sources") or []:
        for entry in source.get("listings") or []:
            rows.append(
                (
                    str(source.get("name") or "curated"), position, entry.get("url"),
                    None if entry.get("id") is None else str(entry["id"]), entry.get("address"),
                    *[None if entry.get(k) is None else float(entry[k]) for k in ("price",)],
                    entry.get("beds"),
                    None if entry.get("baths") is None else float(entry["baths"]),
                    entry.get("sqft"), entry.get("description"),
                )
            )
            position += 1
    return spark.createDataFrame(rows, CURATED)


def normalize_curated(rows: DataFrame) -> DataFrame:
    """Curated entries to listing rows: the id is the url, id, address or position."""
    key = F.concat(F.lit("curated-"), source_slug(F.col("source_name")))
    ident = F.coalesce(
        CO.first_true(F.col("url"), F.col("id"), F.col("address")),
        F.concat(key, F.lit(":"), F.col("position").cast("string")),
    )
    return rows.select(
        key.alias("source"), ident.alias("source_listing_id"),
        "url", "address", "price", "beds", "baths", "sqft", "description",
    )


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated sources from a hand-kept YAML or JSON file."""
    with open(path, encoding="utf-8") as handle:
        return normalize_curated(curated_rows(spark, parse_profile_text(handle.read(), path)))
