"""Counts, distributions and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.functions.scoring import tier
from nestrank.functions.text import round_half_even
from nestrank.operators import filters as FL
from nestrank.operators.ranking import criterion_rows
from nestrank.sources.profiles import Profile


def hood_counts(matches: DataFrame) -> DataFrame:
    """Matches per neighbourhood, largest first, and the total (``All``)."""
    name = F.coalesce(F.nullif("neighborhood", F.lit("")), F.lit("Unknown"))
    return (
        matches.select(name.alias("hood")).rollup("hood").agg(F.count(F.lit(1)).alias("matches"))
        .withColumn("hood", F.coalesce("hood", F.lit("All")))
        .orderBy(F.col("matches").desc(), F.col("hood"))
    )


def source_counts(listings: DataFrame) -> DataFrame:
    """Listings per source and in total (``all``)."""
    return (
        listings.select(F.coalesce("source", F.lit("unknown")).alias("source"))
        .rollup("source").agg(F.count(F.lit(1)).alias("listings"))
        .withColumn("source", F.coalesce("source", F.lit("all")))
    )


# --- fixed values: photo dimensions and what flags are worth -----------------
DIMENSIONS = {"modernity": 0.25, "condition": 0.25, "brightness": 0.20, "staging": 0.15, "cleanliness": 0.15}
FLAG_COSTS = {
    "flipper_gray_palette": 5, "lvp_flooring": 5, "staged_furniture": 3, "over_staged": 2,
    "dark_interior": 5, "deferred_maintenance": 7, "ultra_wide_distortion": 2,
    "visible_damage": 6, "worn_finishes": 4,
}
HIGHLIGHT_GAINS = {
    "natural_light_visible": 4, "outdoor_greenery": 3, "original_details": 4,
    "warm_materials": 3, "high_ceilings_visible": 3, "open_layout": 2, "quality_kitchen": 3,
}


def photo_aggregate(analyses: DataFrame) -> DataFrame:
    """One assessment per listing from its photo analyses.

    Dimensions are truncated means over the photos that have them (50 when none has),
    flags are unions, and the composite is weighted, adjusted and clamped to 0-100.
    Flags come from a fixed vocabulary plus whatever the analyses hold; they are
    collected as distinct values, so their number is the vocabulary, not the photos.
    """
    means = [
        F.coalesce(F.floor(F.avg(F.col(d))).cast("int"), F.lit(50)).alias(d) for d in DIMENSIONS
    ]
    grouped = analyses.groupBy("listing_id").agg(*means, F.count(F.lit(1)).alias("photos_analyzed"))

    def union(col: str) -> DataFrame:
        flags = analyses.select("listing_id", F.explode(col).alias("flag")).distinct()
        return flags.groupBy("listing_id").agg(F.sort_array(F.collect_list("flag")).alias(col))

    joined = grouped.join(union("red_flags"), "listing_id", "left").join(union("highlights"), "listing_id", "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumns(
        {"red_flags": F.coalesce("red_flags", none), "highlights": F.coalesce("highlights", none)}
    )

    def worth(col: str, table: dict[str, int]) -> Column:
        values = F.create_map(*[F.lit(v) for item in table.items() for v in item])
        return F.aggregate(
            col, F.lit(0), lambda acc, flag: acc + F.coalesce(F.element_at(values, flag), F.lit(0))
        )

    composite = F.lit(0.0)
    for name, weight in DIMENSIONS.items():
        composite = composite + F.col(name) * F.lit(weight)
    composite = composite + worth("highlights", HIGHLIGHT_GAINS) - worth("red_flags", FLAG_COSTS)
    seen = F.col("photos_analyzed")
    return joined.withColumns(
        {
            "score": F.greatest(F.lit(0), F.least(F.lit(100), F.rint(composite).cast("int"))),
            "confidence": F.when(seen >= 3, "high").when(seen == 2, "medium").otherwise("low"),
        }
    )


def visual_queue(listings: DataFrame, now: Column, limit: int | None = None, everything: bool = False) -> DataFrame:
    """Listings whose photos need analysis, by id."""
    rows = listings.filter(F.size("photos") > 0)
    if not everything:
        rows = rows.filter(
            FL.needs_visual(now, F.col("photos"), F.col("photos_hash"), F.col("visual_analyzed_at"))
        )
    rows = rows.orderBy("id")
    return rows.limit(limit) if limit else rows


def visual_cost(queue: DataFrame, sample_size: int = 3, cost_per_image: float = 0.0) -> DataFrame:
    images = F.sum(F.least(F.size("photos"), F.lit(sample_size)))
    return queue.agg(
        F.count(F.lit(1)).alias("needs_analysis"),
        F.coalesce(images, F.lit(0)).alias("images"),
        (F.coalesce(images, F.lit(0)) * F.lit(float(cost_per_image))).alias("estimated_cost"),
    )


def run_counters(stage_rows: DataFrame) -> DataFrame:
    """Summaries, detail calls and upserts per run and source.

    ``stage_rows``: (run_id, source, stage) with one row per unit of work.
    """
    def count(stage: str) -> Column:
        return F.count(F.when(F.col("stage") == stage, 1))

    return stage_rows.groupBy("run_id", "source").agg(
        count("summary").alias("summary_count"),
        count("detail").alias("detail_calls"),
        count("upsert").alias("upsert_count"),
    )


def freshness(runs: DataFrame, now: Column) -> DataFrame:
    """How old the last finished run is."""
    last = runs.agg(F.max("ended_at").alias("last_run_end_time"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last_run_end_time")) / F.lit(3600)
    return last.withColumn("_h", hours).select(
        "last_run_end_time",
        round_half_even(F.col("_h"), 1).alias("hours_since_update"),
        CO.freshness_status(F.col("_h")).alias("status"),
        CO.freshness_text(F.col("_h")).alias("last_update_display"),
    )


def funnel(listings: DataFrame, p: Profile) -> DataFrame:
    """Listings per failure reason (a listing may fail several) and per stage."""
    checked = FL.with_signal_failures(listings, p).withColumn("hard_failures", FL.hard_failures(p))
    hard_ok, signal_ok = F.size("hard_failures") == 0, F.size("signal_failures") == 0
    stages = F.array(
        F.lit("stage: all"),
        F.when(hard_ok, "stage: hard filters passed"),
        F.when(hard_ok & signal_ok, "stage: all filters passed"),
    )
    steps = F.filter(F.concat(stages, F.col("hard_failures"), F.col("signal_failures")), lambda s: s.isNotNull())
    return checked.select(F.explode(steps).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("listings"))


def score_distribution(percents: DataFrame, column: str = "percent") -> DataFrame:
    """Min, quartiles, max and mean of a percentage, rounded to two digits first.

    Rounded percentages have at most 10,001 values, so the exact percentile runs over
    their counts and never buffers the rows.
    """
    counts = (
        percents.select(round_half_even(F.col(column), 2).alias("v"))
        .filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )

    def at(q: float) -> Column:
        return F.percentile("v", F.lit(q), F.col("n"))

    return counts.agg(
        F.sum("n").alias("matches"),
        F.min("v").alias("min_pct"),
        at(0.25).alias("p25_pct"),
        at(0.5).alias("median_pct"),
        at(0.75).alias("p75_pct"),
        F.max("v").alias("max_pct"),
        (F.sum((F.rint(F.col("v") * 100)).cast("bigint") * F.col("n")) / F.sum("n") / 100).alias("mean_pct"),
    )


def tier_counts(percents: DataFrame, column: str = "percent") -> DataFrame:
    return percents.select(tier(F.col(column)).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("listings"))


def criterion_activation(listings: DataFrame, p: Profile) -> DataFrame:
    """Per criterion: mean points and share of listings where it scores at all.

    Scores have two digits, so they are summed as whole hundredths: the same result in
    any order.
    """
    rows = criterion_rows(listings, p)
    hundredths = F.rint(F.col("score") * 100).cast("bigint")
    return rows.groupBy("ord", "criterion", "weight").agg(
        F.sum(hundredths).alias("_sum"),
        F.count(F.lit(1)).alias("listings"),
        F.count(F.when(F.col("score") > 0, 1)).alias("active"),
    ).select(
        "criterion", "weight", "listings", "active",
        (F.col("_sum") * F.col("weight") / F.lit(1000.0) / F.col("listings")).alias("avg_points"),
        (F.col("active") / F.col("listings")).alias("activation"),
    )


def source_audit(raw: DataFrame, listings: DataFrame, baseline: DataFrame, factor: float = 3.0, floor: int = 50) -> DataFrame:
    """Upserts against unique listings, description coverage, and whether the count is
    enough: at least ``factor`` times the baseline and at least ``floor``."""
    arrived = raw.groupBy("source").agg(
        F.count(F.lit(1)).alias("upserts"), F.countDistinct("source_listing_id").alias("unique_listings")
    )
    kept = listings.groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"),
        F.avg(F.when(F.coalesce(F.col("description"), F.lit("")) != "", 1.0).otherwise(0.0)).alias("with_description"),
    )
    joined = kept.join(arrived, "source", "left").join(baseline, "source", "left")
    enough = (F.col("listings") >= F.coalesce("baseline", F.lit(0)) * F.lit(factor)) & (F.col("listings") >= floor)
    return joined.withColumn("count_ok", enough)
