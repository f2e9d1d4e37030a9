"""Inputs and outputs of an external text model; the calls themselves are not ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.functions.text import is_tradeoff, word_count
from nestrank.operators.joins import with_last_n

MIN_WORDS, HARD_POINTS, FIRST = 40, 90.0, 5


def _shown(col: Column, kind: str = "string") -> Column:
    """Value as text; NULL, zero and the empty text read ``n/a``."""
    if kind == "number":
        return F.coalesce(F.nullif(col, F.lit(0)).cast("string"), F.lit("n/a"))
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("n/a"))


def timeline(events: Column) -> Column:
    """Lines for the newest events, at most five."""
    def line(e: Column) -> Column:
        percent = F.nullif(e.percent, F.lit(0.0))
        return (
            F.when(e.event_type == "price_drop",
                   F.coalesce(F.concat(F.lit("Price drop: "), CO.whole(percent), F.lit("%")), F.lit("Price drop")))
            .when(e.event_type == "back_on_market", "Back on market")
            .when(e.event_type == "new_listing", "New listing")
            .otherwise(F.regexp_replace(e.event_type, "_", " "))
        )

    text = F.array_join(F.transform(F.slice(events, 1, 5), line), "\n")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("No recent events."))


def text_payload(df: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``payload`` (facts, description, last five events) and its hash, the cache key."""
    joined = with_last_n(df, events, 5)
    payload = F.concat_ws(
        "\n",
        F.lit("# Listing"),
        F.concat(F.lit("Address: "), _shown(F.col("address"))),
        F.concat(F.lit("Price: "), CO.format_price(F.col("price"), "n/a")),
        F.concat(F.lit("Beds: "), _shown(F.col("beds"), "number")),
        F.concat(F.lit("Baths: "), _shown(F.col("baths"), "number")),
        F.concat(F.lit("Sqft: "), _shown(F.col("sqft"), "number")),
        F.concat(F.lit("Neighborhood: "), _shown(F.col("neighborhood"))),
        F.concat(F.lit("Days on market: "), _shown(F.col("days_on_market"), "number")),
        F.lit(""), F.lit("# Description"), _shown(F.col("description")),
        F.lit(""), F.lit("# Timeline"), timeline(F.col("recent_events")),
    )
    return joined.withColumn("payload", payload).withColumn("payload_hash", F.sha2("payload", 256)).drop("recent_events")


def model_candidates(ranked: DataFrame, n: int = FIRST) -> DataFrame:
    """Of the first n matches, those with enough words; the best go to the hard model."""
    first = ranked.orderBy(F.col("points").desc(), F.col("id")).limit(n)
    hard = F.coalesce(F.col("points"), F.lit(0.0)) >= HARD_POINTS
    return first.filter(word_count(F.col("description")) >= MIN_WORDS).withColumn(
        "model", F.when(hard, "hard").otherwise("standard")
    )


def uncached(payloads: DataFrame, results: DataFrame) -> DataFrame:
    """Payloads without a stored result."""
    return payloads.join(results.select("payload_hash"), "payload_hash", "left_anti")


def merge_results(ranked: DataFrame, results: DataFrame) -> DataFrame:
    """Stored model results over the computed texts: three positives, the first trade-off
    if it names a drawback, and the reason to look now.

    ``results``: (payload_hash, positives array, tradeoffs array, reason_now).
    """
    joined = ranked.join(results, "payload_hash", "left")
    first = F.get(F.col("tradeoffs"), F.lit(0))
    return joined.withColumns(
        {
            "top_positives": F.when(F.size("positives") > 0, F.slice("positives", 1, 3)).otherwise(F.col("top_positives")),
            "key_tradeoff": F.when(is_tradeoff(first), first).otherwise(F.col("key_tradeoff")),
            "why_now": F.coalesce(F.nullif("reason_now", F.lit("")), F.col("why_now")),
        }
    ).drop("positives", "tradeoffs", "reason_now")
