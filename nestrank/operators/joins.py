"""Joins between listings, their logs, and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.operators.intervals import CELLS, stab_join


def change_feed(events: DataFrame, listings: DataFrame) -> DataFrame:
    """Every event with address, price and url of its listing."""
    facts = listings.select(
        F.col("id").alias("listing_id"), "address", F.col("price").alias("listing_price"), "url"
    )
    return events.join(facts, "listing_id")


def feedback_with_scores(feedback: DataFrame, scored: DataFrame) -> DataFrame:
    return feedback.join(scored.withColumnRenamed("id", "listing_id"), "listing_id")


def latest_event(events: DataFrame) -> DataFrame:
    """Last event per listing (time, then id): an aggregate with a map-side combine."""
    order = F.struct("created_at", "event_id")
    return events.groupBy("listing_id").agg(
        F.max_by("event_type", order).alias("latest_type"),
        F.max_by(F.struct("percent"), order)["percent"].alias("latest_percent"),
        F.max("created_at").alias("latest_at"),
    )


def with_latest(df: DataFrame, log: DataFrame, prefix: str = "latest") -> DataFrame:
    last = latest_event(log).select(
        F.col("listing_id").alias("id"),
        F.col("latest_type").alias(f"{prefix}_type"),
        F.col("latest_percent").alias(f"{prefix}_percent"),
    )
    return df.join(last, "id", "left")


def last_n(events: DataFrame, n: int = 5) -> DataFrame:
    """Newest n events per listing as one ordered array.

    ``row_number <= n`` is cut on the map side as well, so a listing with very many
    events sends at most n rows per task.
    """
    window = Window.partitionBy("listing_id").orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    top = events.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    packed = F.sort_array(F.collect_list(F.struct("_rn", "event_type", "percent", "created_at")))
    return top.groupBy("listing_id").agg(packed.alias("recent_events"))


def with_last_n(df: DataFrame, events: DataFrame, n: int = 5) -> DataFrame:
    return df.join(last_n(events, n).withColumnRenamed("listing_id", "id"), "id", "left")


def resolve_ids(batch: DataFrame, listings: DataFrame) -> DataFrame:
    """Add ``existing_id``: found by (source, source_listing_id), else by listing_id, else
    by url; the smallest id wins when a key is not unique.

    Each lookup is first reduced to the keys the batch holds, so a small batch does not
    shuffle the table.  Rows without a key, or found before, take a spread key that no
    listing has (it starts with a NUL) and so do not meet in one task.
    """
    every = ["source", "source_listing_id", "listing_id", "url"]
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*every), F.lit(4096)).cast("string"))
    legs = {"_natural": ("source", "source_listing_id"), "_listing": ("listing_id",), "_url": ("url",)}

    def key_of(names: tuple[str, ...]) -> Column:
        if len(names) == 1:
            return F.col(names[0])
        whole = F.concat_ws("\u0001", *names)
        return F.when(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull(), whole)

    out = batch.withColumn("existing_id", F.lit(None).cast(listings.schema["id"].dataType))
    for leg, names in legs.items():
        asked = batch.select(key_of(names).alias(leg)).filter(F.col(leg).isNotNull()).distinct()
        known = listings.select(key_of(names).alias(leg), "id").join(asked, leg, "left_semi")
        found = known.groupBy(leg).agg(F.min("id").alias("_found_id"))
        open_key = F.when(F.col("existing_id").isNull(), key_of(names))
        out = (
            out.withColumn(leg, F.coalesce(open_key, spread)).join(found, leg, "left")
            .withColumn("existing_id", F.coalesce("existing_id", "_found_id")).drop(leg, "_found_id")
        )
    return out


def stale_without_event(listings: DataFrame, events: DataFrame, days: int = 45) -> DataFrame:
    """Listings on the market for long without a ``dom_stale`` event."""
    marked = events.filter(F.col("event_type") == "dom_stale").select(F.col("listing_id").alias("id"))
    return listings.filter(F.col("days_on_market") >= days).join(marked, "id", "left_anti")


def new_matches(matches: DataFrame, seen: DataFrame) -> DataFrame:
    """Scout matches whose (scout_id, listing_id) was not shown before."""
    return matches.join(seen, ["scout_id", "listing_id"], "left_anti")


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join with a dimension; the planner broadcasts it when its size is known to be small."""
    return df.join(dim, key, "left")


def criteria_matches(listings: DataFrame, criteria: DataFrame, cells: int = CELLS) -> DataFrame:
    """All (criteria, listing) pairs that match: prices stab the price ranges, the rest is tested.

    Cells of the price follow its quantiles, so they hold like numbers of listings at any price
    level, and a price that many listings share is spread (see ``intervals``).  A row of criteria
    is repeated for the cells its range touches, in proportion to the listings in it.
    """
    from nestrank.operators.filters import criteria_condition

    def limit(name: str) -> Column:
        return F.col(f"_c.{name}") if name in criteria.columns else F.lit(None).cast("double")

    points = listings.select(F.struct("*").alias("_l")).withColumn("_price", F.col("_l.price"))
    spans = criteria.select(F.struct("*").alias("_c")).withColumns({"_low": limit("price_min"), "_high": limit("price_max")})
    c = {name: F.col("_c")[name] for name in criteria.columns}
    l = {name: F.col("_l")[name] for name in listings.columns}
    picked = [c[n].alias("criteria_id" if n == "id" else n) for n in criteria.columns]
    picked += [l[n].alias("listing_id" if n == "id" else n) for n in listings.columns if n not in criteria.columns or n == "id"]
    pairs = stab_join(points, spans, "_price", "_low", "_high", cells)
    return pairs.where(criteria_condition(c, l)).select(*picked)
