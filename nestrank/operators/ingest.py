"""From summaries and details to the current listing table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.functions import geo
from nestrank.operators.joins import resolve_ids
from nestrank.operators.signals import apply_flags, extract_flags, light_potential, tranquility


def summary_key() -> Column:
    """Identity of a summary inside its source: source id, listing id, or trimmed url."""
    return F.coalesce(
        F.nullif(F.col("source_listing_id"), F.lit("")),
        F.col("listing_id").cast("string"),
        CO.blank_to_null(F.col("url")),
    )


def dedupe_first(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First summary per (source, id) in arrival order; rows without an id all stay.

    Rows without an id get a key of their own (the order columns), so they spread over
    the shuffle instead of meeting in one task.
    """
    keyed = df.withColumn("_key", summary_key())
    lone = F.when(F.col("_key").isNull(), F.struct(*order))
    window = Window.partitionBy("source", "_key", "_lone").orderBy(*order)
    ranked = keyed.withColumn("_lone", lone).withColumn("_rn", F.row_number().over(window))
    return ranked.filter(F.col("_rn") == 1).drop("_key", "_lone", "_rn")


def dedupe_by_url(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row per url over all locations; rows without any url or id are dropped."""
    keyed = df.withColumn("_key", CO.first_true(F.col("source_listing_id"), F.col("url")))
    window = Window.partitionBy("_key").orderBy(*order)
    ranked = keyed.filter(F.col("_key").isNotNull()).withColumn("_rn", F.row_number().over(window))
    return ranked.filter(F.col("_rn") == 1).drop("_key", "_rn")


def enrichment_queue(summaries: DataFrame, cap: int, source_caps: Mapping[str, int] | None = None, price_max: float | None = None) -> DataFrame:
    """Which summaries get a detail call: in budget first, then most photos, at most
    min(cap, source cap) per source.

    The overall cap is a literal, so the window is cut on the map side before rows of a
    large source meet in one task.
    """
    in_budget = (
        F.when(F.coalesce(F.col("price"), F.lit(0.0)) == 0, 1).when(F.col("price") <= F.lit(float(price_max)), 0).otherwise(1)
        if price_max
        else F.lit(1)
    )
    photos = F.greatest(F.coalesce(F.size("photos"), F.lit(0)), F.lit(0))
    wanted = CO.first_true(F.col("source_listing_id"), F.col("listing_id").cast("string"))
    window = Window.partitionBy("source").orderBy(in_budget, photos.desc(), "id")
    queue = (
        summaries.filter(wanted.isNotNull())
        .withColumn("priority", F.row_number().over(window))
        .filter(F.col("priority") <= cap)
    )
    if source_caps:
        limits = F.create_map(*[v for s, n in source_caps.items() for v in (F.lit(s), F.lit(max(0, int(n))))])
        queue = queue.filter(F.col("priority") <= F.coalesce(F.element_at(limits, F.col("source")), F.lit(cap)))
    return queue


DETAIL_FIELDS = ("description", "price", "beds", "baths", "sqft", "lat", "lon", "address", "year_built", "days_on_market")


def merge_detail(summaries: DataFrame, details: DataFrame, key: Sequence[str] = ("source", "source_listing_id")) -> DataFrame:
    """Summaries with their detail rows: a detail value wins when it is not NULL."""
    fields = [f for f in (*DETAIL_FIELDS, "neighborhood", "photos") if f in details.columns]
    right = details.select(*key, *[F.col(f).alias(f"_d_{f}") for f in fields], F.lit(True).alias("_found"))
    joined = summaries.join(right, list(key), "left")
    none = F.array().cast("array<string>")
    exprs = {}
    for field in fields:
        base = F.col(field) if field in summaries.columns else F.lit(None)
        extra = F.col(f"_d_{field}")
        if field == "neighborhood":
            exprs[field] = CO.merged_hood(base, extra)
        elif field == "photos":
            exprs[field] = F.when(F.col("_found"), F.coalesce(extra, none)).otherwise(F.coalesce(base, none))
        else:
            exprs[field] = F.coalesce(extra, base)
    return joined.withColumns(exprs).drop("_found", *[f"_d_{f}" for f in fields])


def enrich(df: DataFrame) -> DataFrame:
    """Flags, tranquility, neighbourhood and light of the merged rows."""
    flagged = apply_flags(extract_flags(df, "description"))
    located = F.coalesce((F.col("lat") != 0) & (F.col("lon") != 0), F.lit(False))
    placed = tranquility(flagged).withColumns(
        {
            "tranquility_score": F.when(located, F.col("tranquility_score")),
            "tranquility_factors": F.when(located, F.col("tranquility_factors")),
            "neighborhood": F.coalesce(
                geo.resolve_hood(F.col("neighborhood"), F.col("lat"), F.col("lon")), F.col("neighborhood")
            ),
        }
    )
    return light_potential(placed).drop(
        "tranquility_warnings", "tranquility_confidence", "light_potential_confidence"
    )


NEW_ID_PIECES = 1 << 20


def upsert(listings: DataFrame, batch: DataFrame, order: Sequence[str], run_ts: Column, raw_source: str | None = None) -> DataFrame:
    """New version of the listing table after a batch.

    Rows without an address are skipped.  A row without source id, listing id and url is a listing
    of its own, so it is inserted; ``order`` has to tell such rows apart.  The last row of a listing wins field by field
    (NULL overwrites), but photos keep the last non-empty list and ``sources_seen`` is
    the union.  A new listing keeps its natural key and gets an id above the largest one
    of the table: ``NEW_ID_PIECES`` pieces by hash of the key, numbered inside each, so no
    two keys ever share an id and nothing is numbered in one task.  The batch is reduced to
    one row per listing by aggregates with a map-side combine before it meets the table.
    """
    rows = batch.filter(F.coalesce(F.col("address"), F.lit("")) != "")
    source_id = CO.first_true(F.col("source_listing_id"), F.col("listing_id").cast("string"))
    keyed = rows.withColumn("source_listing_id", source_id)
    built = CO.build_listing_id(F.col("source"), F.col("source_listing_id"), raw_source)
    keyed = keyed.withColumn(
        "listing_id",
        F.when(F.col("source").isNull() | F.col("source_listing_id").isNull(), F.col("listing_id"))
        .otherwise(F.coalesce(F.when(F.col("source") == F.lit(raw_source or ""), F.col("listing_id")), built)),
    )
    resolved = resolve_ids(keyed, listings)
    identity = F.concat_ws("\u0001", F.lit("id"), F.col("existing_id").cast("string"))
    natural = F.coalesce(
        F.when(F.col("source").isNotNull() & F.col("source_listing_id").isNotNull(),
               F.concat_ws("\u0001", F.lit("s"), "source", "source_listing_id")),
        F.concat(F.lit("l\u0001"), F.nullif("listing_id", F.lit(""))),
        F.concat(F.lit("u\u0001"), F.nullif("url", F.lit(""))),
        F.concat(F.lit("r\u0001"), F.to_json(F.struct(*order))),
    )
    resolved = resolved.withColumn(
        "_who", F.when(F.col("existing_id").isNotNull(), identity).otherwise(natural)
    )
    plain = [c for c in listings.columns if c in batch.columns and c not in ("id", "photos", "sources_seen")]
    stamp = F.struct(*order)
    shown = F.when(F.size("photos") > 0, stamp)
    merged = resolved.groupBy("_who").agg(
        F.max_by(F.struct("existing_id", *plain), stamp).alias("_last"),
        F.max_by("photos", shown).alias("_photos"),
        F.sort_array(F.collect_set("source")).alias("_sources"),  # bounded by the number of sources
    )
    piece = F.pmod(F.xxhash64("_who"), F.lit(NEW_ID_PIECES))
    window = Window.partitionBy("_piece").orderBy("_who")
    top = listings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    made = top + F.lit(1) + (F.col("_n") - 1) * F.lit(NEW_ID_PIECES) + F.col("_piece")
    known, fresh = F.col("_last.existing_id").isNotNull(), F.col("_last.existing_id").isNull()
    numbered = merged.filter(known).withColumn("id", F.col("_last.existing_id")).unionByName(
        merged.filter(fresh).withColumn("_piece", piece).withColumn("_n", F.row_number().over(window))
        .withColumn("id", made).drop("_piece", "_n")
    )
    incoming = numbered.select(
        "id",
        *[F.col(f"_last.{c}").alias(f"_n_{c}") for c in plain],
        "_photos", "_sources", F.lit(True).alias("_new"),
    )
    both = listings.join(incoming, "id", "full_outer")
    hit = F.col("_new").isNotNull()
    none = F.array().cast("array<string>")
    exprs: dict[str, Column] = {
        c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in plain
    }
    if "photos" in listings.columns:
        exprs["photos"] = F.coalesce(F.col("_photos"), F.col("photos"))
    if "sources_seen" in listings.columns:
        exprs["sources_seen"] = F.when(
            hit, F.array_union(F.coalesce("sources_seen", none), F.coalesce("_sources", none))
        ).otherwise(F.col("sources_seen"))
    if "last_seen_at" in listings.columns:
        exprs["last_seen_at"] = F.when(hit, run_ts).otherwise(F.col("last_seen_at"))
    out = both.withColumns(exprs)
    if {"neighborhood", "lat", "lon"} <= set(listings.columns):
        filled = F.coalesce(F.col("neighborhood"), geo.hood_from_point(F.col("lat"), F.col("lon")))
        out = out.withColumn("neighborhood", F.when(hit, filled).otherwise(F.col("neighborhood")))
    return out.select(*listings.columns)


def union_sources(frames: Mapping[str, DataFrame], active: Sequence[str] = (), default: str | None = None) -> DataFrame:
    """Rows of the active sources; unknown names are ignored, none left means the default."""
    names = [a.strip().lower() for a in active if a.strip()]
    chosen = [n for n in names if n in frames]
    if not chosen:
        chosen = [default or next(iter(frames))]
    out = frames[chosen[0]]
    for name in chosen[1:]:
        out = out.unionByName(frames[name], allowMissingColumns=True)
    return out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def photo_sample(df: DataFrame, n: int = 3) -> DataFrame:
    """One row per sampled photo: positions 0, 2 and 4 first, then the lowest others."""
    size = F.greatest(F.coalesce(F.size("photos"), F.lit(0)), F.lit(0))
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    liked = F.filter(F.array(F.lit(0), F.lit(2), F.lit(4)), lambda i: i < size)
    picks = F.slice(F.concat(liked, F.array_except(every, liked)), 1, n)
    return df.select("id", "photos", F.posexplode(picks).alias("sample_no", "photo_ix")).select(
        "id", "sample_no", "photo_ix", F.get("photos", F.col("photo_ix")).alias("photo_url")
    )
