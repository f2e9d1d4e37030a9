"""Changes, alerts, scouts, feedback and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog import sqltext as S
from nestrank.catalog.registry import joined, query
from nestrank.catalog.score_queries import CANDIDATES, RENTAL, r6
from nestrank.operators import alerts as AL
from nestrank.operators import changes as CH
from nestrank.operators import filters as FL
from nestrank.operators import joins as J
from nestrank.operators import learning as LE
from nestrank.operators import ranking as R
from nestrank.operators import reports as RP
from nestrank.operators.signals import stage

EVENT_COLS = ["event_id", "listing_id", "event_type", "old_price", "new_price", "old_text", "new_text"]


@query(
    "change_events",
    f"WITH {S.EVENTS} SELECT {', '.join(EVENT_COLS)}, round(amount, 4) AS amount, round(percent, 6) AS percent FROM ev",
)
def change_events(spark, sf_dir):
    return FX.events_of(spark, sf_dir).select(*EVENT_COLS, F.round("amount", 4).alias("amount"), r6("percent"))


@query("change_counts_hot_keys", f"WITH {S.EVENTS} SELECT event_type, count(*) AS events, round(sum(round(amount, 2)), 2) AS amount FROM ev GROUP BY 1")
def change_counts_hot_keys(spark, sf_dir):
    """Same events with pieces of five minutes instead of the default."""
    ev = CH.detect_changes(FX.observations(spark, sf_dir), FX.OBSERVATION_ORDER, seconds=300)
    cents = F.sum(F.rint(F.round("amount", 2) * 100).cast("bigint")) / 100
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(cents, 2).alias("amount"))


@query(
    "price_drops",
    f"WITH {S.EVENTS} SELECT listing_id, count(*) AS drops, round(max(percent), 6) AS largest FROM ev WHERE event_type = 'price_drop' AND percent >= 3 GROUP BY 1",
)
def price_drops(spark, sf_dir):
    drops = FX.events_of(spark, sf_dir).filter((F.col("event_type") == "price_drop") & (F.col("percent") >= 3))
    return drops.groupBy("listing_id").agg(F.count(F.lit(1)).alias("drops"), F.round(F.max("percent"), 6).alias("largest"))


@query(
    "latest_event",
    f"WITH {S.EVENTS} SELECT listing_id, max_by(event_type, struct_pack(c := created_at, i := event_id)) AS latest_type FROM ev GROUP BY 1",
)
def latest_event(spark, sf_dir):
    return J.latest_event(FX.events_of(spark, sf_dir)).select("listing_id", "latest_type")


@query(
    "last_five_events",
    f"WITH {S.EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, event_id DESC) AS rn FROM ev) "
    "SELECT listing_id, string_agg(event_type, '|' ORDER BY rn) AS recent FROM n WHERE rn <= 5 GROUP BY 1",
)
def last_five_events(spark, sf_dir):
    out = J.last_n(FX.events_of(spark, sf_dir), 5)
    return out.select("listing_id", joined(F.transform("recent_events", lambda e: e.event_type)).alias("recent"))


@query(
    "change_feed",
    f"WITH {S.RAW}, {S.EVENTS} SELECT event_id, ev.listing_id AS listing_id, event_type, address, raw.price AS listing_price, url FROM ev JOIN raw ON raw.id = ev.listing_id "
    "WHERE created_at >= TIMESTAMP '2000-01-01' AND event_type IN ('price_drop', 'back_on_market')",
)
def change_feed(spark, sf_dir):
    from datetime import datetime

    ev = CH.recent(FX.events_of(spark, sf_dir), datetime(2000, 1, 1)).filter(
        F.col("event_type").isin("price_drop", "back_on_market")
    )
    return J.change_feed(ev, FX.raw_listings(spark, sf_dir)).select(
        "event_id", "listing_id", "event_type", "address", "listing_price", "url"
    )


@query(
    "recent_changes",
    f"WITH {S.RAW}, {S.EVENTS} SELECT event_id, event_type, address FROM ev JOIN raw ON raw.id = ev.listing_id WHERE event_type IN ('price_drop', 'price_increase') "
    "ORDER BY created_at DESC, event_id DESC LIMIT 200",
)
def recent_changes(spark, sf_dir):
    feed = FL.changes(FX.events_of(spark, sf_dir), FX.raw_listings(spark, sf_dir), types="price_drop, price_increase", limit=200)
    return feed.select("event_id", "event_type", "address")


@query(
    "recent_changes_all",
    f"WITH {S.RAW}, {S.EVENTS} SELECT event_id, event_type, address, raw.price AS listing_price FROM ev JOIN raw ON raw.id = ev.listing_id",
)
def recent_changes_all(spark, sf_dir):
    feed = FL.changes(FX.events_of(spark, sf_dir), FX.raw_listings(spark, sf_dir), limit=None)
    return feed.select("event_id", "event_type", "address", "listing_price")


@query(
    "history",
    f"WITH {S.EVENTS} SELECT event_id, event_type FROM ev WHERE listing_id = (SELECT min(listing_id) FROM ev)",
)
def history(spark, sf_dir):
    events = FX.events_of(spark, sf_dir)
    first = events.agg(F.min("listing_id")).first()[0]
    return CH.history(events, first, limit=None).select("event_id", "event_type")


@query(
    "stale_without_event",
    f"WITH {S.RAW}, {S.EVENTS} SELECT id, days_on_market FROM raw WHERE days_on_market >= 45 AND id NOT IN (SELECT listing_id FROM ev WHERE event_type = 'price_drop')",
)
def stale_without_event(spark, sf_dir):
    # price drops stand in for the stale marks the observations do not have
    marks = FX.events_of(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("event_type") == "price_drop", "dom_stale").otherwise(F.col("event_type"))
    )
    return J.stale_without_event(FX.raw_listings(spark, sf_dir), marks).select("id", "days_on_market")


_, SOFT = S.reasons_sql(RENTAL)
HARD, _ = S.reasons_sql(RENTAL)
PASSING = f"{S.score_ctes(RENTAL)}, ok AS (SELECT * FROM pts WHERE len({HARD}) = 0 AND len({SOFT}) = 0)"


@query(
    "alerts_routed",
    f"{PASSING}, {S.EVENTS}, r AS (SELECT event_id, ev.listing_id AS listing_id, CASE event_type WHEN 'new_listing' THEN CASE WHEN ok.percent >= 76 THEN 'immediate' ELSE 'digest' END "
    "WHEN 'price_drop' THEN CASE WHEN ev.percent >= 3 THEN 'immediate' END WHEN 'back_on_market' THEN 'immediate' END AS channel, "
    "CASE event_type WHEN 'new_listing' THEN 'New listing' WHEN 'price_drop' THEN concat('Price drop ', CAST(CAST(round_even(ev.percent, 0) AS BIGINT) AS VARCHAR), '%') ELSE 'Back on market' END AS reason, "
    "round(ok.points, 6) AS points FROM ev JOIN ok ON ok.id = ev.listing_id) SELECT * FROM r WHERE channel IS NOT NULL",
)
def alerts_routed(spark, sf_dir):
    out = AL.route_alerts(FX.events_of(spark, sf_dir), FX.listings(spark, sf_dir), RENTAL)
    return out.select("event_id", "listing_id", "channel", "reason", r6("points"))


@query(
    "scout_matches",
    f"{CANDIDATES}, {S.SCOUTS}, pool AS (SELECT *, row_number() OVER (ORDER BY points DESC, id) AS rank FROM cand QUALIFY rank <= 100) "
    "SELECT scout_id, id AS listing_id, CAST(rank AS INTEGER) AS rank, round(points, 6) AS points FROM scouts JOIN pool ON percent >= CASE WHEN min_match_score = 0 THEN 30 ELSE min_match_score END",
)
def scout_matches(spark, sf_dir):
    out = AL.scout_matches(FX.scouts(spark, sf_dir), AL.scout_pool(FX.listings(spark, sf_dir), RENTAL))
    return out.select("scout_id", "listing_id", "rank", r6("points"))


@query(
    "scout_runs",
    f"{CANDIDATES}, {S.SCOUTS}, pool AS (SELECT *, row_number() OVER (ORDER BY points DESC, id) AS rank FROM cand QUALIFY rank <= 100), "
    "m AS (SELECT scout_id, id AS listing_id, points FROM scouts JOIN pool ON percent >= CASE WHEN min_match_score = 0 THEN 30 ELSE min_match_score END), "
    "seen AS (SELECT DISTINCT l_suppkey AS scout_id, l_orderkey AS listing_id FROM lineitem) "
    "SELECT s.scout_id, count(m.listing_id) AS matches_found, count(CASE WHEN m.listing_id IS NOT NULL AND seen.listing_id IS NULL THEN 1 END) AS new_matches, "
    "round(max(points), 6) AS top_score, round(avg(points), 4) AS average_score FROM scouts s LEFT JOIN m ON m.scout_id = s.scout_id "
    "LEFT JOIN seen ON seen.scout_id = m.scout_id AND seen.listing_id = m.listing_id GROUP BY 1",
)
def scout_runs(spark, sf_dir):
    out = AL.run_scouts(FX.scouts(spark, sf_dir), FX.listings(spark, sf_dir), RENTAL, FX.scout_seen(spark, sf_dir))
    return out["runs"].select(
        "scout_id", "matches_found", "new_matches", r6("top_score"), F.round("average_score", 4).alias("average_score")
    )


@query(
    "due_scouts",
    f"WITH {S.SCOUTS}, a AS (SELECT *, epoch(TIMESTAMP '{FX.NOW}') - epoch(last_run) AS idle FROM scouts) SELECT scout_id, alert_frequency FROM a WHERE is_active AND "
    "(last_run IS NULL OR (alert_frequency = 'instant' AND idle > 3600) OR (alert_frequency = 'daily' AND idle > 86400) OR (alert_frequency = 'weekly' AND idle > 604800))",
)
def due_scouts(spark, sf_dir):
    return FL.due_scouts(FX.scouts(spark, sf_dir), F.to_timestamp(F.lit(FX.NOW))).select("scout_id", "alert_frequency")


@query(
    "scout_feedback",
    "SELECT l_suppkey AS scout_id, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS positive, count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_orderkey END) AS negative FROM lineitem GROUP BY 1",
)
def scout_feedback(spark, sf_dir):
    log = FX.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS scout_id", "l_orderkey AS listing_id", "l_returnflag = 'A' AS is_positive")
    return AL.scout_feedback(log)


@query("latest_feedback", f"WITH {S.FEEDBACK} SELECT user_id, listing_id, feedback_type FROM fb")
def latest_feedback(spark, sf_dir):
    return LE.latest_feedback(FX.feedback_log(spark, sf_dir)).select("user_id", "listing_id", "feedback_type")


@query(
    "feedback_pivot",
    f"WITH {S.FEEDBACK} SELECT listing_id, count(CASE WHEN feedback_type = 'like' THEN 1 END) AS likes, count(CASE WHEN feedback_type = 'dislike' THEN 1 END) AS dislikes, "
    "count(CASE WHEN feedback_type = 'neutral' THEN 1 END) AS neutrals, max(CASE WHEN user_id = 7 THEN feedback_type END) AS user_feedback FROM fb GROUP BY 1",
)
def feedback_pivot(spark, sf_dir):
    return LE.feedback_pivot(LE.latest_feedback(FX.feedback_log(spark, sf_dir)), 7)


KEYS = [c.key for c in R.SC.CRITERIA]
TOP3 = (
    "list_transform(list_slice(list_sort(["
    + ", ".join(f"struct_pack(neg := -(s_{k} / 10e0 * {S.num(float(RENTAL.weights.get(k, 0)))}), o := {i}, c := {S.q(k)})" for i, k in enumerate(KEYS))
    + "]), 1, 3), lambda e: e.c)"
)
DELTAS = (
    f"{S.score_ctes(RENTAL)}, {S.FEEDBACK}, v AS (SELECT user_id, CASE feedback_type WHEN 'like' THEN 1 ELSE -1 END AS vote, {TOP3} AS top FROM fb JOIN sc ON sc.id = fb.listing_id "
    "WHERE feedback_type IN ('like', 'dislike')), gate AS (SELECT user_id FROM v GROUP BY 1 HAVING count(*) >= 5 AND count(CASE WHEN vote > 0 THEN 1 END) >= 3 AND count(CASE WHEN vote < 0 THEN 1 END) >= 2), "
    "e AS (SELECT user_id, vote, unnest(top) AS criterion FROM v JOIN gate USING (user_id)), "
    "d AS (SELECT user_id, criterion, greatest(-0.5e0, least(0.5e0, sum(vote) * 0.05e0)) AS delta, count(*) AS signal_count FROM e GROUP BY 1, 2)"
)


def _tops(spark, sf_dir):
    voted = LE.voted_listings(FX.listings(spark, sf_dir), LE.latest_feedback(FX.feedback_log(spark, sf_dir)))
    staged = stage(voted, RENTAL)
    scores = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(c.key).alias("criterion"), c.rounded(RENTAL).alias("score"),
                F.lit(float(RENTAL.weights.get(c.key, 0))).alias("weight"),
            )
            for i, c in enumerate(R.SC.CRITERIA)
        ]
    )
    return LE.scored_top(staged.select("id", R.sealed({"feature_scores": scores})))


@query("weight_deltas", f"{DELTAS} SELECT user_id, criterion, round(delta, 6) AS delta, signal_count FROM d")
def weight_deltas(spark, sf_dir):
    fb = LE.latest_feedback(FX.feedback_log(spark, sf_dir))
    return LE.weight_deltas(fb, _tops(spark, sf_dir)).select("user_id", "criterion", r6("delta"), "signal_count")


CURRENT = (
    "cur AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'natural_light' WHEN 1 THEN 'views' ELSE 'pet_friendly' END AS criterion, "
    "0.5e0 + (user_id % 16) / 10e0 AS multiplier, user_id % 9 AS signal_count FROM events)"
)
MULT = (
    f"{DELTAS}, {CURRENT}, m AS (SELECT coalesce(cur.user_id, d.user_id) AS user_id, coalesce(cur.criterion, d.criterion) AS criterion, "
    f"CASE WHEN d.delta IS NULL THEN multiplier ELSE {S.rnd('greatest(0.5e0, least(2e0, coalesce(multiplier, 1e0) + d.delta))', 3)} END AS multiplier, "
    "coalesce(d.signal_count, cur.signal_count) AS signal_count FROM cur FULL OUTER JOIN d ON cur.user_id = d.user_id AND cur.criterion = d.criterion)"
)


def _multipliers(spark, sf_dir):
    users = FX.table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    current = users.select(
        "user_id", F.when(u % 3 == 0, "natural_light").when(u % 3 == 1, "views").otherwise("pet_friendly").alias("criterion"),
        (F.lit(0.5) + (u % 16) / F.lit(10.0)).alias("multiplier"), (u % 9).alias("signal_count"),
        F.lit(None).cast("timestamp").alias("last_updated"),
    )
    fb = LE.latest_feedback(FX.feedback_log(spark, sf_dir))
    return LE.update_multipliers(current, LE.weight_deltas(fb, _tops(spark, sf_dir)))


@query("updated_multipliers", f"{MULT} SELECT user_id, criterion, round(multiplier, 6) AS multiplier, signal_count FROM m")
def updated_multipliers(spark, sf_dir):
    return _multipliers(spark, sf_dir).select("user_id", "criterion", r6("multiplier"), "signal_count")


BASE = ", ".join(f"({S.q(k)}, {S.num(float(w))})" for k, w in RENTAL.weights.items())


@query(
    "effective_weights",
    f"{MULT}, b(criterion, base_weight) AS (VALUES {BASE}), us AS (SELECT DISTINCT user_id FROM events) SELECT us.user_id, b.criterion, base_weight, "
    f"{S.rnd('base_weight * coalesce(m.multiplier, 1e0)', 2)} AS weight FROM us CROSS JOIN b LEFT JOIN m ON m.user_id = us.user_id AND m.criterion = b.criterion",
)
def effective_weights(spark, sf_dir):
    users = FX.table(spark, sf_dir, "events").select("user_id").distinct()
    out = LE.effective_weights(users, RENTAL.weights, _multipliers(spark, sf_dir))
    return out.select("user_id", "criterion", "base_weight", "weight")


@query(
    "learning_summary",
    f"WITH {CURRENT} SELECT user_id, CAST(signal_count AS BIGINT) AS total_signals, "
    "CASE WHEN multiplier > 1.1 THEN concat('Your feedback suggests ''', l, ''' matters more to you than average.') WHEN multiplier < 0.9 THEN "
    "concat('Your feedback suggests ''', l, ''' matters less to you than average.') ELSE 'Not enough feedback yet to identify clear preferences.' END AS insight, "
    "CASE WHEN multiplier > 1.1 THEN CAST(round_even((multiplier - 1e0) * 100e0, 0) AS INTEGER) END AS boost FROM "
    "(SELECT *, CASE criterion WHEN 'natural_light' THEN 'Natural light' WHEN 'views' THEN 'Views' ELSE 'Pet friendly' END AS l FROM cur)",
)
def learning_summary(spark, sf_dir):
    users = FX.table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    stored = users.select(
        "user_id", F.when(u % 3 == 0, "natural_light").when(u % 3 == 1, "views").otherwise("pet_friendly").alias("criterion"),
        (F.lit(0.5) + (u % 16) / F.lit(10.0)).alias("multiplier"), (u % 9).alias("signal_count"),
    )
    out = LE.learning_summary(stored)
    return out.select("user_id", "total_signals", "insight", F.get("strengthened_preferences", F.lit(0)).boost_percent.alias("boost"))


@query(
    "learning_status",
    f"WITH {S.FEEDBACK}, v AS (SELECT user_id, count(CASE WHEN feedback_type = 'like' THEN 1 END) AS total_likes, count(CASE WHEN feedback_type = 'dislike' THEN 1 END) AS total_dislikes FROM fb "
    "WHERE feedback_type IN ('like', 'dislike') AND listing_id IN (SELECT o_orderkey FROM orders) GROUP BY 1) SELECT user_id, total_likes, total_dislikes, "
    "total_likes + total_dislikes >= 5 AND total_likes >= 3 AND total_dislikes >= 2 AS weights_updated FROM v",
)
def learning_status(spark, sf_dir):
    known = FX.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"))
    out = LE.learning_status(LE.latest_feedback(FX.feedback_log(spark, sf_dir)), known)
    return out.select("user_id", "total_likes", "total_dislikes", "weights_updated")


def _photo_sql() -> str:
    dims = ", ".join(f"coalesce(CAST(floor(avg({d})) AS INTEGER), 50) AS {d}" for d in RP.DIMENSIONS)
    comp = " + ".join(f"{d} * {S.num(w)}" for d, w in RP.DIMENSIONS.items())

    def worth(col, table):
        return "(" + " + ".join(f"CASE WHEN list_contains({col}, {S.q(k)}) THEN {v} ELSE 0 END" for k, v in table.items()) + ")"

    return (
        f"WITH p AS ({FX.select_sql(FX.PHOTO_SCORE_EXPRS, 'lineitem')}), g AS (SELECT listing_id, {dims}, count(*) AS n, list_sort(list_distinct(list(flag))) AS rf, "
        f"list_sort(list_distinct(list(highlight))) AS hl FROM p GROUP BY 1) SELECT listing_id, n AS photos_analyzed, coalesce(array_to_string(rf, '|'), '') AS red_flags, coalesce(array_to_string(hl, '|'), '') AS highlights, "
        f"CAST(greatest(0, least(100, round_even({comp} + coalesce({worth('hl', RP.HIGHLIGHT_GAINS)}, 0) - coalesce({worth('rf', RP.FLAG_COSTS)}, 0), 0))) AS INTEGER) AS score, "
        "CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS confidence FROM g"
    )


@query("photo_aggregate", _photo_sql())
def photo_aggregate(spark, sf_dir):
    out = RP.photo_aggregate(FX.photo_scores(spark, sf_dir))
    return out.select(
        "listing_id", "photos_analyzed", joined("red_flags").alias("red_flags"), joined("highlights").alias("highlights"), "score", "confidence"
    )
