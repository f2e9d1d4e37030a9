"""Alert routing, digests and scouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.operators import filters as FL
from nestrank.operators.joins import new_matches, stale_without_event
from nestrank.operators.ranking import score_rows, top_points
from nestrank.functions import scoring as SC
from nestrank.session import cut_lineage
from nestrank.sources.profiles import Profile

# --- fixed values: thresholds used when a profile has none -------------------
NEW_LISTING_SCORE, PRICE_DROP_PERCENT, DIGEST_DROP_PERCENT, STALE_DAYS = 76, 5, 3, 45
ALERT_WINDOW_HOURS = 24
SCOUT_POOL, SCOUT_MIN_SCORE = 100, 30.0


def thresholds(p: Profile) -> tuple[float, float, int]:
    cfg = p.alerts or {}
    return (
        float((cfg.get("new_listing") or {}).get("score_threshold", NEW_LISTING_SCORE)),
        float((cfg.get("price_drop") or {}).get("percent_threshold", PRICE_DROP_PERCENT)),
        int((cfg.get("dom_stale") or {}).get("days", STALE_DAYS)),
    )


def passing_rows(listings: DataFrame, p: Profile) -> DataFrame:
    """The rows of ``score_rows`` that pass; a listing outside the limits is left out before its
    texts are read."""
    return score_rows(listings.filter(F.size(FL.hard_failures(p)) == 0), p).filter("passes")


def route_alerts(events: DataFrame, listings: DataFrame, p: Profile, sent: DataFrame | None = None) -> DataFrame:
    """Alerts due for the events: (event_id, listing_id, channel, reason, points, percent).

    ``sent`` (event_id, channel) makes every channel fire once per event.  Only listings
    named by a routable event are scored.
    """
    new_score, drop_percent, _ = thresholds(p)
    kinds = ("new_listing", "price_drop", "back_on_market")
    due = events.filter(F.col("event_type").isin(*kinds)).filter(
        (F.col("event_type") != "price_drop") | (F.col("percent") >= min(drop_percent, DIGEST_DROP_PERCENT))
    )
    if sent is not None:
        flags = sent.groupBy("event_id").agg(
            F.max((F.col("channel") == "immediate").cast("int")).alias("_was_now"),
            F.max((F.col("channel") == "digest").cast("int")).alias("_was_digest"),
        )
        due = due.join(flags, "event_id", "left")
    else:
        due = due.withColumns({"_was_now": F.lit(0), "_was_digest": F.lit(0)})
    fresh_now = F.coalesce(F.col("_was_now"), F.lit(0)) == 0
    fresh_digest = F.coalesce(F.col("_was_digest"), F.lit(0)) == 0
    wanted = due.select(F.col("listing_id").alias("id")).distinct()
    passing = passing_rows(listings.join(wanted, "id", "left_semi"), p).select(
        F.col("id").alias("listing_id"), "points", F.col("percent").alias("score_pct")
    )
    kind, drop = F.col("event_type"), F.col("percent")
    channel = (
        F.when((kind == "new_listing") & fresh_now & (F.col("score_pct") >= new_score), "immediate")
        .when((kind == "new_listing") & fresh_now & fresh_digest, "digest")
        .when((kind == "price_drop") & (drop >= drop_percent) & fresh_now, "immediate")
        .when((kind == "price_drop") & (drop >= DIGEST_DROP_PERCENT) & fresh_digest, "digest")
        .when((kind == "back_on_market") & fresh_now, "immediate")
    )
    reason = (
        F.when(kind == "new_listing", "New listing")
        .when(kind == "price_drop", F.concat(F.lit("Price drop "), CO.whole(drop), F.lit("%")))
        .otherwise("Back on market")
    )
    return (
        due.join(passing, "listing_id")
        .withColumns({"channel": channel, "reason": reason})
        .filter(F.col("channel").isNotNull())
        .select("event_id", "listing_id", "channel", "reason", "points", F.col("score_pct").alias("percent"))
    )


def stale_alerts(listings: DataFrame, events: DataFrame, p: Profile) -> DataFrame:
    """Digest alerts for listings long on the market; each also becomes a dom_stale event."""
    *_, days = thresholds(p)
    stale = stale_without_event(listings, events, days)
    return passing_rows(stale, p).select(
        F.col("id").alias("listing_id"),
        F.lit("digest").alias("channel"),
        F.concat(F.lit("DOM "), F.col("days_on_market").cast("string")).alias("reason"),
        "points", "percent",
    )


def alert_lines(alerts: DataFrame) -> DataFrame:
    """Text lines of explained alerts: one for the listing, one for details when present."""
    def shown(col: str, form: str) -> Column:
        return F.coalesce(F.format_string(form, F.col(col)), F.lit("n/a"))

    head = F.concat(
        F.lit("- "), F.coalesce(CO.blank_to_null(F.col("address")), F.lit("Address n/a")),
        F.lit(" — "), CO.format_price(F.col("price")), F.lit(" — "),
        F.when(F.col("match_score").isNull(), "n/a").otherwise(shown("match_score", "%.1f%%")),
        F.lit(" ("),
        F.when(F.col("score_points").isNull(), "n/a").otherwise(shown("score_points", "%.1f pts")),
        F.lit(", "), F.coalesce(F.nullif("score_tier", F.lit("")), F.lit("tier n/a")), F.lit(")"),
    )
    dash = F.lit(" — ")
    line = F.concat(
        head,
        F.coalesce(F.concat(dash, F.nullif("reason", F.lit(""))), F.lit("")),
        F.coalesce(F.concat(dash, F.nullif("url", F.lit(""))), F.lit("")),
    )
    details = F.concat_ws(
        " | ",
        F.when(F.size("top_positives") > 0, F.concat(F.lit("Top: "), F.array_join(F.slice("top_positives", 1, 3), ", "))),
        F.concat(F.lit("Tradeoff: "), F.col("key_tradeoff")),
        F.concat(F.lit("Why now: "), F.col("why_now")),
    )
    return alerts.withColumns(
        {"line": line, "detail": F.when(details != "", F.concat(F.lit("  "), details))}
    )


def alert_subjects(alerts: DataFrame, brand: str = "nestrank") -> DataFrame:
    """Subject per channel.  The body is the rows of ``alert_lines`` in order: it is not
    glued into one text, because one channel may hold most of the alerts."""
    label = F.initcap(F.regexp_replace("channel", "_", " "))
    return (
        alerts.groupBy("channel").agg(F.count(F.lit(1)).alias("listings"))
        .withColumn(
            "subject",
            F.concat(F.lit(f"[{brand}] "), label, F.lit(" alert: "), F.col("listings").cast("string"),
                     F.when(F.col("listings") == 1, " listing").otherwise(" listings")),
        )
    )


def scout_pool(listings: DataFrame, p: Profile, size: int = SCOUT_POOL) -> DataFrame:
    """The ``size`` best matches: every scout sees a prefix of this one ranking."""
    top = top_points(listings, p, size)
    window = Window.orderBy(F.col("points").desc(), F.col("id"))  # ``size`` rows
    return top.select("id", "points").select(
        F.col("id").alias("listing_id"), "points",
        SC.score_pct(F.col("points"), p.total_weight).alias("percent"),
        F.row_number().over(window).alias("rank"),
    )


def scout_matches(scouts: DataFrame, pool: DataFrame) -> DataFrame:
    """Pool rows at or above each scout's minimum (0 or NULL means 30)."""
    low = F.coalesce(F.nullif(F.col("min_match_score").cast("double"), F.lit(0.0)), F.lit(SCOUT_MIN_SCORE))
    packed = pool.agg(
        F.sort_array(F.collect_list(F.struct("rank", "listing_id", "points", "percent"))).alias("pool")
    )  # one row of at most 100 entries
    each = scouts.withColumn("_low", low).withColumn("_k", F.lit(1)).join(
        F.broadcast(packed.withColumn("_k", F.lit(1))), "_k"
    )
    kept = F.filter("pool", lambda m: m.percent >= F.col("_low"))
    return each.drop("_k").select(
        "scout_id", "max_results_per_alert", F.inline(kept)
    )


def scout_stats(matches: DataFrame, fresh: DataFrame) -> DataFrame:
    """Run statistics per scout over all its matches, and how many are new."""
    totals = matches.groupBy("scout_id").agg(
        F.count(F.lit(1)).alias("matches_found"),
        F.max("points").alias("top_score"),
        F.avg("points").alias("average_score"),
    )
    new = fresh.groupBy("scout_id").agg(F.count(F.lit(1)).alias("new_matches"))
    return totals.join(new, "scout_id", "left").withColumn(
        "new_matches", F.coalesce("new_matches", F.lit(0))
    )


def run_scouts(scouts: DataFrame, listings: DataFrame, p: Profile, seen: DataFrame, now: Column | None = None, pool_size: int = SCOUT_POOL) -> dict[str, DataFrame]:
    """One run of all given scouts: alerts (capped per scout), statistics, grown seen set."""
    pool = cut_lineage(scout_pool(listings, p, pool_size))  # a few rows, read by three results
    matches = scout_matches(scouts, pool)
    fresh = new_matches(matches, seen)
    window = Window.partitionBy("scout_id").orderBy("rank")  # at most ``pool_size`` rows per scout
    alerts = (
        fresh.withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") <= F.coalesce("max_results_per_alert", F.lit(10)))
        .drop("_rn")
    )
    runs = scouts.select("scout_id").join(scout_stats(matches, fresh), "scout_id", "left")
    runs = runs.withColumns(
        {
            "started_at": F.current_timestamp() if now is None else now,
            "status": F.lit("completed"),
            "matches_found": F.coalesce("matches_found", F.lit(0)),
            "new_matches": F.coalesce("new_matches", F.lit(0)),
        }
    )
    return {"alerts": alerts, "runs": runs, "seen": grow_seen(seen, fresh)}


def grow_seen(seen: DataFrame, fresh: DataFrame) -> DataFrame:
    pairs = ["scout_id", "listing_id"]
    return seen.select(*pairs).unionByName(fresh.select(*pairs)).distinct()


def scout_runs(runs: DataFrame, scout_id: int, n: int = 10) -> DataFrame:
    return runs.filter(F.col("scout_id") == scout_id).orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    """Latest completed run of every scout."""
    done = runs.filter(F.col("status") == "completed")
    return done.groupBy("scout_id").agg(
        F.max_by(F.struct("id", "completed_at", "top_score", "average_score"), F.struct("started_at", "id")).alias("run")
    ).select("scout_id", "run.*")


def scout_feedback(log: DataFrame) -> DataFrame:
    """Positive and negative listings of each scout, each once."""
    return log.dropDuplicates(["scout_id", "listing_id", "is_positive"]).groupBy("scout_id").agg(
        F.count(F.when(F.col("is_positive"), 1)).alias("positive"),
        F.count(F.when(~F.col("is_positive"), 1)).alias("negative"),
    )


def scout_feedback_sets(log: DataFrame) -> DataFrame:
    """As rows: (scout_id, listing_id, is_positive), each once."""
    return log.select("scout_id", "listing_id", "is_positive").distinct()
