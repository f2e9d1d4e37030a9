"""Feedback and the bounded per-user weights learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestrank.functions.text import round_half_even
from nestrank.operators.ranking import label_of, top_criteria

# --- fixed values ------------------------------------------------------------
DELTA = 0.05
MAX_DELTA = 0.5
MIN_SIGNALS, MIN_LIKES, MIN_DISLIKES = 5, 3, 2
MULTIPLIER_MIN, MULTIPLIER_MAX = 0.5, 2.0
TOP_CRITERIA = 3
SHOWN = 5
FEEDBACK_TYPES = ("like", "dislike", "neutral")


def latest_feedback(log: DataFrame) -> DataFrame:
    """Current opinion per (user, listing); a delete as last entry means none."""
    order = F.struct("ts", "feedback_type")
    last = log.groupBy("user_id", "listing_id").agg(
        F.max_by("feedback_type", order).alias("feedback_type"), F.max("ts").alias("ts")
    )
    return last.filter(F.col("feedback_type") != "delete")


def user_feedback(log: DataFrame, user_id: int, feedback_type: str | None = None) -> DataFrame:
    """Opinions of one user, newest first."""
    mine = latest_feedback(log.filter(F.col("user_id") == user_id))
    if feedback_type:
        mine = mine.filter(F.col("feedback_type") == feedback_type)
    return mine.orderBy(F.col("ts").desc(), F.col("listing_id"))


def feedback_pivot(feedback: DataFrame, user_id: int | None = None) -> DataFrame:
    """Counts per listing and type with zeros, and one user's own opinion."""
    def count(kind: str) -> Column:
        return F.count(F.when(F.col("feedback_type") == kind, 1)).alias(f"{kind}s")

    aggs = [count(kind) for kind in FEEDBACK_TYPES]
    if user_id is not None:
        own = F.when(F.col("user_id") == user_id, F.col("feedback_type"))
        aggs.append(F.max(own).alias("user_feedback"))
    return feedback.groupBy("listing_id").agg(*aggs)


def voted_listings(listings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Listings with a like or dislike: only these need a scorecard to learn from."""
    votes = feedback.filter(F.col("feedback_type").isin("like", "dislike"))
    return listings.join(votes.select(F.col("listing_id").alias("id")).distinct(), "id", "left_semi")


def scored_top(scored: DataFrame, k: int = TOP_CRITERIA) -> DataFrame:
    """(listing_id, top) with the k leading criteria of a scorecard column."""
    return scored.filter(F.size("feature_scores") > 0).select(
        F.col("id").alias("listing_id"), top_criteria(F.col("feature_scores"), k).alias("top")
    )


def weight_deltas(feedback: DataFrame, tops: DataFrame) -> DataFrame:
    """Per (user, criterion): bounded delta and number of signals.

    A like adds 0.05 to the leading criteria of the listing, a dislike takes it away;
    users with too few signals, likes or dislikes learn nothing.  Votes are counted, so
    the sum is exact whatever the order.
    """
    vote = F.when(F.col("feedback_type") == "like", 1).when(F.col("feedback_type") == "dislike", -1)
    voted = feedback.withColumn("vote", vote).filter(F.col("vote").isNotNull())
    # listing_id may be skewed here: the join is left to adaptive skew handling, and
    # what follows is combined on the map side
    joined = voted.select("user_id", "listing_id", "vote").join(tops, "listing_id")
    # one extra entry (NULL criterion) per vote carries the totals of the user through
    # the same aggregation
    entries = joined.select(
        "user_id", "vote",
        F.explode(F.concat(F.col("top"), F.array(F.lit(None).cast("string")))).alias("criterion"),
    )
    counted = entries.groupBy("user_id", "criterion").agg(
        F.sum("vote").alias("net"),
        F.count(F.lit(1)).alias("signal_count"),
        F.count(F.when(F.col("vote") > 0, 1)).alias("likes"),
    )
    per_user = Window.partitionBy("user_id")  # at most 22 rows
    whole = F.col("criterion").isNull()
    gated = counted.withColumns(
        {
            "_signals": F.max(F.when(whole, F.col("signal_count"))).over(per_user),
            "_likes": F.max(F.when(whole, F.col("likes"))).over(per_user),
        }
    ).filter(
        ~whole
        & (F.col("_signals") >= MIN_SIGNALS)
        & (F.col("_likes") >= MIN_LIKES)
        & (F.col("_signals") - F.col("_likes") >= MIN_DISLIKES)
    )
    raw = F.col("net") * F.lit(DELTA)
    return gated.select(
        "user_id", "criterion",
        F.greatest(F.lit(-MAX_DELTA), F.least(F.lit(MAX_DELTA), raw)).alias("delta"),
        "signal_count",
    )


def learning_status(feedback: DataFrame, tops: DataFrame) -> DataFrame:
    """Per user: likes, dislikes, whether weights move, and the message."""
    votes = feedback.filter(F.col("feedback_type").isin("like", "dislike")).join(
        tops.select("listing_id"), "listing_id", "left_semi"
    )
    counts = votes.groupBy("user_id").agg(
        F.count(F.when(F.col("feedback_type") == "like", 1)).alias("total_likes"),
        F.count(F.when(F.col("feedback_type") == "dislike", 1)).alias("total_dislikes"),
    )
    likes, dislikes = F.col("total_likes"), F.col("total_dislikes")

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    message = (
        F.when(likes + dislikes < MIN_SIGNALS,
               text(f"Need {MIN_SIGNALS} total signals before learning (have ", likes + dislikes, ")"))
        .when(likes < MIN_LIKES, text(f"Need at least {MIN_LIKES} likes before learning (have ", likes, ")"))
        .when(dislikes < MIN_DISLIKES,
              text(f"Need at least {MIN_DISLIKES} dislikes before learning (have ", dislikes, ")"))
        .otherwise(text("Calculated weight adjustments from ", likes, " likes and ", dislikes, " dislikes"))
    )
    ready = (likes + dislikes >= MIN_SIGNALS) & (likes >= MIN_LIKES) & (dislikes >= MIN_DISLIKES)
    return counts.withColumns({"weights_updated": ready, "message": message})


def update_multipliers(current: DataFrame, deltas: DataFrame, now: Column | None = None) -> DataFrame:
    """Stored multipliers moved by the deltas, kept within 0.5 and 2; others stay."""
    now = F.current_timestamp() if now is None else now
    moved = deltas.select("user_id", "criterion", "delta", F.col("signal_count").alias("_signals"))
    both = current.join(moved, ["user_id", "criterion"], "full_outer")
    hit = F.col("delta").isNotNull()
    stepped = F.coalesce(F.col("multiplier"), F.lit(1.0)) + F.col("delta")
    bounded = F.greatest(F.lit(MULTIPLIER_MIN), F.least(F.lit(MULTIPLIER_MAX), stepped))
    return both.select(
        "user_id", "criterion",
        F.when(hit, round_half_even(bounded, 3)).otherwise(F.col("multiplier")).alias("multiplier"),
        F.when(hit, F.col("_signals")).otherwise(F.col("signal_count")).alias("signal_count"),
        F.when(hit, now).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def effective_weights(users: DataFrame, base: dict[str, float], multipliers: DataFrame) -> DataFrame:
    """Base weight times multiplier, two digits, for every user and base criterion."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("criterion"), F.lit(float(w)).alias("base_weight")) for c, w in base.items()]
    )
    grid = users.select("user_id", F.inline(entries))
    joined = grid.join(multipliers.select("user_id", "criterion", "multiplier"), ["user_id", "criterion"], "left")
    factor = F.coalesce("multiplier", F.lit(1.0))
    return joined.select(
        "user_id", "criterion", "base_weight", factor.alias("multiplier"),
        round_half_even(F.col("base_weight") * factor, 2).alias("weight"),
    )


def reset_weights(multipliers: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Drop what was learned for the given users."""
    return multipliers.join(user_ids.select("user_id").distinct(), "user_id", "left_anti")


def learning_summary(multipliers: DataFrame) -> DataFrame:
    """Per user: five most strengthened and weakened criteria with percent and signals,
    totals, and one sentence.  A user has at most 21 criteria, so the lists are small."""
    grouped = multipliers.groupBy("user_id").agg(
        F.coalesce(F.sum("signal_count"), F.lit(0)).alias("total_signals"),
        F.count(F.lit(1)).alias("preferences_learned"),
        F.collect_list(F.struct("multiplier", "criterion", "signal_count")).alias("all"),
    )

    def ordered(keep, sign: float) -> Column:
        return F.sort_array(
            F.transform(
                F.filter("all", keep),
                lambda m: F.struct(
                    (m.multiplier * F.lit(sign)).alias("key"), m.criterion.alias("criterion"),
                    m.multiplier.alias("multiplier"), m.signal_count.alias("signals"),
                ),
            )
        )

    listed = grouped.withColumns(
        {"up": ordered(lambda m: m.multiplier > 1.1, -1.0), "down": ordered(lambda m: m.multiplier < 0.9, 1.0)}
    )

    def shown(col: str, sign: int, name: str) -> Column:
        return F.transform(
            F.slice(col, 1, SHOWN),
            lambda m: F.struct(
                label_of(m.criterion).alias("criterion"),
                F.rint((m.multiplier - 1.0) * F.lit(100.0 * sign)).cast("int").alias(name),
                m.signals.alias("signals"),
            ),
        )

    def sentence(col: str, word: str) -> Column:
        return F.concat(
            F.lit("Your feedback suggests '"), label_of(F.get(F.col(col), F.lit(0)).criterion),
            F.lit(f"' matters {word} to you than average."),
        )

    return listed.select(
        "user_id", "total_signals", "preferences_learned",
        shown("up", 1, "boost_percent").alias("strengthened_preferences"),
        shown("down", -1, "reduction_percent").alias("weakened_preferences"),
        F.when(F.size("up") > 0, sentence("up", "more"))
        .when(F.size("down") > 0, sentence("down", "less"))
        .otherwise(F.lit("Not enough feedback yet to identify clear preferences."))
        .alias("insight"),
    )


def apply_presets(weights: DataFrame, presets: DataFrame) -> DataFrame:
    """Weights of every (profile, preset): the preset's weight wins where it has one.

    ``weights``: (profile_id, criterion, weight); ``presets``: (preset_id, criterion, weight).
    """
    pairs = weights.select("profile_id").distinct().join(
        F.broadcast(presets.select("preset_id").distinct()), how="cross"
    )  # three presets
    base = pairs.join(weights, "profile_id")
    over = pairs.join(F.broadcast(presets.withColumnRenamed("weight", "preset_weight")), "preset_id")
    keys = ["profile_id", "preset_id", "criterion"]
    return base.join(over, keys, "full_outer").select(
        *keys, F.coalesce("preset_weight", "weight").alias("weight")
    )
