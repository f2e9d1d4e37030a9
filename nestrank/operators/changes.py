"""Snapshots of listings and the typed changes between them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.operators import skew

SNAPSHOT = ("price", "listing_status", "photos_hash", "description_hash")
CAME_BACK_FROM = ("pending", "contingent", "sold")


def snapshot_cols(df: DataFrame) -> DataFrame:
    """Snapshot of each listing row with its hash.  Days on market are stored, not hashed."""
    snap = df.select(
        F.col("id").alias("listing_id"),
        F.col("price").cast("double").alias("price"),
        CO.normal_status(F.col("listing_status")).alias("listing_status"),
        "days_on_market",
        CO.photos_hash(F.col("photos")).alias("photos_hash"),
        CO.text_hash(F.col("description")).alias("description_hash"),
    )
    return snap.withColumn("snapshot_hash", CO.snapshot_hash(*[F.col(c) for c in SNAPSHOT]))


def change_array(old: Column, new: Column) -> Column:
    """Changes from one snapshot to the next; no old snapshot gives ``new_listing``."""
    def event(kind: str | Column, old_price=None, new_price=None, old_text=None, new_text=None, amount=None, percent=None) -> Column:
        def typed(value, kind_):
            return F.lit(None).cast(kind_) if value is None else value.cast(kind_)

        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"),
            typed(old_price, "double").alias("old_price"),
            typed(new_price, "double").alias("new_price"),
            typed(old_text, "string").alias("old_text"),
            typed(new_text, "string").alias("new_text"),
            typed(amount, "double").alias("amount"),
            typed(percent, "double").alias("percent"),
        )

    delta = new.price - old.price
    percent = F.when(old.price != 0, F.abs(delta) / old.price * 100)
    back = (new.listing_status == "active") & old.listing_status.isin(*CAME_BACK_FROM)
    status_moved = F.coalesce(F.nullif(new.listing_status, F.lit("")), F.lit("")) != ""
    status_moved = status_moved & ~old.listing_status.eqNullSafe(new.listing_status)

    def text_moved(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (a != b)

    moves = F.array(
        F.when(delta < 0, event("price_drop", old.price, new.price, amount=F.abs(delta), percent=percent)),
        F.when(delta > 0, event("price_increase", old.price, new.price, amount=delta)),
        F.when(
            status_moved,
            event(
                F.when(back, "back_on_market").otherwise("status_change"),
                old_text=old.listing_status, new_text=new.listing_status,
            ),
        ),
        F.when(
            text_moved(old.photos_hash, new.photos_hash),
            event("photo_change", old_text=old.photos_hash, new_text=new.photos_hash),
        ),
        F.when(
            text_moved(old.description_hash, new.description_hash),
            event("description_change", old_text=old.description_hash, new_text=new.description_hash),
        ),
    )
    first = F.array(event("new_listing", new_price=new.price, new_text=new.listing_status))
    return F.when(old.isNull(), first).otherwise(F.filter(moves, lambda e: e.isNotNull()))


def observation_snapshots(obs: DataFrame) -> DataFrame:
    """Pack the observed values of each row into ``snap``; statuses are normalised."""
    return obs.withColumn("listing_status", CO.normal_status(F.col("listing_status"))).withColumn(
        "snap", F.struct(*SNAPSHOT)
    )


def prev_snapshot(obs: DataFrame, order: list[str], seconds: int = skew.PIECE_SECONDS) -> DataFrame:
    """Add ``prev``, the snapshot before this one of the same listing.

    Every listing is cut into pieces of ``seconds``; see ``skew``.
    """
    piece = F.floor(F.unix_timestamp(F.col(order[0]).cast("timestamp")) / F.lit(seconds))
    return skew.previous(obs, "listing_id", order, F.col("snap"), piece, "prev")


def detect_changes(obs: DataFrame, order: list[str], seconds: int = skew.PIECE_SECONDS) -> DataFrame:
    """Typed change events between consecutive observations, in ``order``.

    Shuffled by listing and piece.  Equal snapshots give no event; a first one gives
    ``new_listing``.  ``seq`` numbers the events of one observation.
    """
    paired = prev_snapshot(observation_snapshots(obs), order, seconds)
    changed = paired.filter(F.col("prev").isNull() | (F.col("prev") != F.col("snap")))
    moves = change_array(F.col("prev"), F.col("snap"))
    keys = ["listing_id", *order]
    return changed.select(*keys, F.posexplode(moves).alias("seq", "event")).select(*keys, "seq", "event.*")


def history(events: DataFrame, listing_id: int, limit: int | None = 50) -> DataFrame:
    """Changes of one listing, newest first; all of them without ``limit``."""
    found = events.filter(F.col("listing_id") == listing_id).orderBy(
        F.col("created_at").desc(), F.col("event_id").desc()
    )
    return found if limit is None else found.limit(limit)


def recent(events: DataFrame, since: datetime | Column) -> DataFrame:
    """Alert window: events from ``since`` on."""
    start = since if isinstance(since, Column) else F.lit(since)
    return events.filter(F.col("created_at") >= start)
