"""Scoring listings for many profiles in one job, with the profiles as tables.

The four tables of ``sources.profiles`` become one row a profile.  Keyword groups that hold the same
terms are one group for all profiles; the terms of all of them form one lexicon, matched once per
text (``lexicon.lexicon_hits``), and what was found meets the groups through its postings.  A
listing then carries the hit count of each group it touches, a profile the names of its groups, and
the score expressions are those of single-profile scoring with the profile's numbers as columns.

Pairs.  A profile meets the listings of its neighbourhoods, one without a list meets all.  Pieces of
the listings are dealt to blocks of the profiles, and a task holds a block while listings stream by
(``pair_scores``).  Limits, and signals that do not depend on the profile, are tested before anything
is scored, so no listing x profile product is formed.  What a pair asks of its profile lies at fixed
places of arrays, groups are numbers, and criteria that no profile changes are scored once a listing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestrank.functions import lexicon as LX
from nestrank.functions import scoring as SC
from nestrank.functions import text as TX
from nestrank.operators import signals as SG
from nestrank.operators.intervals import stab_join
from nestrank.operators.lexicon import lexicon_hits
from nestrank.operators.pair_scores import CONDITIONS, DOORMAN, GROUPS, MULTIPLIERS, NEGATIVE, OWN, POSITIVE, score_groups
from nestrank.session import cut_lineage
from nestrank.sources.profiles import Profile

# Filter rows that limit a listing's column: name -> profile column.  Fixed values.
LIMITS = {
    "price_max": "_price_max", "bedrooms_min": "_beds_min", "bathrooms_min": "_baths_min", "sqft_min": "_sqft_min",
    "price_soft": "_price_soft",
}
PIECES = 8  # of the listings, and of the profiles, of one neighbourhood
HELD, DEALT = 1024, 4096  # profiles that a task holds, and listings that it reads for them, on average
MOST_TASKS = 2048  # of all groups
# What is read of a listing beside its limits.
STAGED = (
    "id", "price", "beds", "baths", "sqft", "year_built", "hoa_fee", "visual_quality_score", "_light", "_quiet", "_bright",
    "_k_c_flow", "_k_c_layout", "_k_c_move_in", "_own", "_thin", "_blank", "_counts", "_found_streets",
    *[f"_r_{name}" for name in ("nightlife", "low_floor", "full_time", "part_time", "negated", "no_parking")],
    *[f"_f_{name}" for name in (
        "outdoor_space", "architectural_details", "busy_street", "pet_friendly", "no_pets", "gym_fitness", "building_quality",
        "doorman_concierge",
    )],
)
READ = ("price", "beds", "baths", "sqft", "neighborhood", "year_built", "hoa_fee", "visual_quality_score", "parking_type")


def _name(polarity: str | Column, grp: str | Column) -> Column:
    return F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x for x in (polarity, grp)])


def keyword_groups(keywords: DataFrame) -> DataFrame:
    """(profile_id, polarity, grp, grp_weight, gid, terms): one row a group of a profile.

    ``gid`` numbers the set of terms, so equal groups of different profiles share it; it is null for
    a group without terms.  The doorman terms among the amenities are a group of their own.
    """
    some = keywords.select("profile_id", "polarity", "grp", "grp_weight", F.nullif("keyword", F.lit("")).alias("keyword"))
    doorman = some.where((F.col("polarity") == POSITIVE) & (F.col("grp") == "amenities")).where(
        TX.any_term(F.col("keyword"), LX.DOORMAN_TERMS)
    ).withColumn("grp", F.lit(DOORMAN))
    packed = cut_lineage(some.union(doorman).groupBy("profile_id", "polarity", "grp").agg(
        F.max("grp_weight").alias("grp_weight"), F.sort_array(F.collect_set("keyword")).alias("terms")
    ))
    sets = packed.select("terms").where(F.size("terms") > 0).distinct()
    numbered = cut_lineage(sets.withColumn("gid", F.monotonically_increasing_id()))
    return cut_lineage(packed.join(numbered.hint("merge"), "terms", "left"))


def profile_rows(tables: Mapping[str, DataFrame], groups: DataFrame) -> DataFrame:
    """One row a profile: limits, weights by criterion, group names and multipliers by group."""
    def entries(key: Column, value: Column) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(key, value)))

    by_group = groups.groupBy("profile_id").agg(
        entries(_name(F.col("polarity"), F.col("grp")), F.col("gid")).alias("_gids"),
        entries(_name(F.col("polarity"), F.col("grp")), F.col("grp_weight")).alias("_mult"),
        F.collect_list(F.when((F.col("polarity") == POSITIVE) & (F.col("grp") != DOORMAN), F.col("gid"))).alias("_positive"),
    )
    weights = tables["profile_weights"].groupBy("profile_id").agg(
        entries(F.col("criterion"), F.coalesce("weight", F.lit(0.0))).alias("_weights"),
        # the order of summation is the profile's own
        F.aggregate(
            F.sort_array(F.collect_list(F.struct("ord", F.coalesce("weight", F.lit(0.0)).alias("w")))),
            F.lit(0.0), lambda total, e: total + e["w"],
        ).alias("_total"),
    ).withColumn("_total", F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0))

    def streets(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "street"))))["street"]

    places = tables["profile_streets"].groupBy("profile_id").agg(
        streets("boost_streets").alias("_boost"), streets("penalize_streets").alias("_penalize"),
        streets("penalize_conditions").alias("_conditions"),
    )
    hard = F.col("section") != "soft_caps"
    filters = tables["profile_filters"]
    limits = filters.groupBy("profile_id").agg(
        *[F.max(F.when((F.col("name") == n) & (hard | (n == "price_soft")), F.col("value"))).alias(c) for n, c in LIMITS.items()],
        F.collect_set(F.when(F.col("name") == "neighborhoods", F.col("item"))).alias("_hoods"),
        F.coalesce(F.max(F.when(F.col("section") == "mode", F.col("item"))), F.lit("rent")).alias("_mode"),
    )
    ids = limits.select("profile_id")
    for other in (weights, by_group, places):
        ids = ids.unionByName(other.select("profile_id"))
    out = ids.distinct()
    # The planner takes packed rows for as small as the rows they are packed from; it would broadcast them.
    for part in (limits, weights, by_group, places):
        out = out.join(part.hint("merge"), "profile_id", "left")
    return out.withColumns({
        "_mode": F.coalesce("_mode", F.lit("rent")), "_total": F.coalesce("_total", F.lit(1.0)),
        **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("_hoods", "_boost", "_penalize", "_conditions", "_positive")},
        "_gids": F.coalesce("_gids", F.create_map().cast("map<string,bigint>")),
        "_mult": F.coalesce("_mult", F.create_map().cast("map<string,double>")),
        "_weights": F.coalesce("_weights", F.create_map().cast("map<string,double>")),
    })


def placed(profiles: DataFrame) -> DataFrame:
    """Profile rows with what pairs look up at fixed places instead of under names."""
    def times(streets: str) -> Column:
        """How often each street, in lower case, stands in a list."""
        low = F.transform(F.filter(streets, lambda s: s.isNotNull()), F.lower)
        return F.map_from_entries(F.transform(F.array_distinct(low), lambda s: F.struct(s, F.size(F.filter(low, lambda t: t == s)))))

    def blank(streets: str) -> Column:
        return F.size(F.filter(streets, lambda s: s == ""))

    kept = ("_gids", "_mult", "_weights", "_boost", "_penalize", "_conditions")
    return profiles.select(
        *[c for c in profiles.columns if c not in kept],
        F.array(*[F.element_at("_gids", _name(*g)) for g in GROUPS]).alias("_groups"),
        F.array(*[F.coalesce(F.element_at("_mult", _name(*g)), F.lit(1.0)) for g in MULTIPLIERS]).alias("_mults"),
        F.array(*[F.array_contains("_conditions", c) for c in CONDITIONS]).alias("_asked"),
        F.array(*[F.coalesce(F.element_at("_weights", F.lit(c.key)), F.lit(0.0)) for c in SC.CRITERIA]).alias("_factors"),
        *[f(column).alias(f"{column}{name}") for column in ("_boost", "_penalize") for f, name in ((times, "_times"), (blank, "_blank"))],
    )


def group_counts(listings: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, counts): how many terms of each group occur in the description, for groups with any."""
    postings = groups.select("gid", F.explode("terms").alias("term")).distinct()
    hits = lexicon_hits(listings, "id", "description", postings)
    return hits.join(postings, "term").groupBy("id", "gid").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("gid", "n"))).alias("_counts")
    )


def street_hits(listings: DataFrame, streets: DataFrame) -> DataFrame:
    """(id, streets): lower-cased streets of any profile found in the address."""
    asked = streets.where(F.col("kind") != "penalize_conditions").select(F.lower("street").alias("street"))
    return lexicon_hits(listings, "id", "address", asked, "street").groupBy("id").agg(
        F.collect_list("street").alias("_found_streets")
    )


def open_listings(df: DataFrame) -> DataFrame:
    """Listings that no profile-independent rule takes out, with the staged signals scoring reads."""
    staged = SG.stage(df, Profile())
    status = F.lower(F.coalesce(F.col("listing_status"), F.lit("")))
    layout, quiet = F.col("_r_layout_bad"), F.coalesce(F.col("_quiet") < 40, F.lit(False))
    keep = ~TX.any_term(status, LX.INACTIVE_STATUSES) & ~F.col("_f_busy_street") & ~quiet & ~layout
    text = F.coalesce(F.col("description"), F.lit(""))
    wanted = [c for c in staged.columns if c.startswith(("_k_c_", "_r_", "_f_"))] + ["_light", "_quiet", "_bright"]
    own = {c.key: c.rounded(Profile()) / F.lit(10.0) for c in SC.CRITERIA if c.key in OWN}
    values = {
        **{c: F.col(c) for c in wanted}, "_own": F.array(*[own[key] for key in OWN]), "_thin": (TX.word_count(text) < 80) | (text == ""), "_blank": text == "", "_keep": keep,
    }
    return staged.select("id", *READ, TX.sealed(values)).where("_keep").drop("_keep")


def candidate_pairs(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every listing with every profile whose limits it meets."""
    with_hoods = profiles.where(F.size("_hoods") > 0).withColumn("_hood", F.explode("_hoods"))
    # Pieces of the profiles meet pieces of the listings, so neither is broadcast and no
    # neighbourhood is one task; a task holds a piece of the listings.
    every, keys = F.sequence(F.lit(0), F.lit(PIECES - 1)), ["_hood", "_piece", "_block"]

    def dealt(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(PIECES)).cast("int")

    left = listings.withColumns({"_hood": F.col("neighborhood"), "_piece": dealt("id"), "_block": F.explode(every)})
    right = with_hoods.withColumns({"_block": dealt("profile_id"), "_piece": F.explode(every)})
    local = right.repartition(4 * PIECES**2, *keys).hint("merge").join(left.repartition(4 * PIECES**2, *keys), keys).drop(*keys)
    anywhere = profiles.where(F.size("_hoods") == 0).withColumn("_low", F.lit(None).cast("double"))
    priced = stab_join(listings, anywhere, "price", "_low", "_price_max", spread="id").drop("_low")
    met = F.col("_price_max").isNull() | (F.col("price") <= F.col("_price_max"))
    for column, limit in (("beds", "_beds_min"), ("baths", "_baths_min")):
        met = met & (F.col(limit).isNull() | (F.col(column) >= F.col(limit)))
    met = met & (F.col("_sqft_min").isNull() | F.col("sqft").isNull() | (F.col("sqft") >= F.col("_sqft_min")))
    return local.unionByName(priced).where(met)


def grouped(listings: DataFrame, profiles: DataFrame) -> DataFrame | None:
    """Rows (_group, _side, _profile, _listing): what may meet has a group in common, profiles first.

    A neighbourhood is as many groups as it has pieces of ``DEALT`` listings and blocks of ``HELD``
    profiles; a listing is repeated for the blocks of its neighbourhood, a profile for the pieces.
    """
    def most(df: DataFrame, column: str) -> int:
        return df.groupBy(column).count().agg(F.max("count")).first()[0] or 0

    def parts(count: int, size: int) -> int:
        return max(1, -(-count // size))

    def dealt(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    some, here = profiles.where(F.size("_hoods") > 0), listings.where(F.col("neighborhood").isNotNull())
    hoods = some.select("profile_id", F.explode("_hoods").alias("_hood"))
    free = profiles.where(F.size("_hoods") == 0)
    rows, tasks = [], 1
    for left, right, hood, count, met in (
        (here.withColumn("_hood", F.col("neighborhood")), some.withColumn("_hood", F.explode("_hoods")), F.col("_hood"),
         most(here, "neighborhood"), most(hoods, "_hood")),
        (listings, free, F.lit(None).cast("string"), listings.count(), free.count()),
    ):
        pieces, blocks = parts(count, DEALT), parts(met, HELD)
        tasks = max(tasks, pieces * blocks)
        if not met:
            continue
        # null hoods leave an ending out, so no neighbourhood is taken for "all"
        name = F.concat_ws("/", F.col("_piece").cast("string"), F.col("_block").cast("string"), hood)
        profile, listing = F.struct(*[c for c in profiles.columns if c != "_hoods"]), F.struct(*STAGED)
        rows.append(right.withColumns({"_block": dealt("profile_id", blocks)}).withColumn("_piece", every(pieces)).select(
            name.alias("_group"), F.lit(0).alias("_side"), profile.alias("_profile"), F.lit(None).cast(_kind(listings, STAGED)).alias("_listing")
        ))
        rows.append(left.withColumns({"_piece": dealt("id", pieces)}).withColumn("_block", every(blocks)).select(
            name.alias("_group"), F.lit(1).alias("_side"), F.lit(None).cast(_kind(profiles.drop("_hoods"))).alias("_profile"), listing.alias("_listing")
        ))
    if not rows:
        return None
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    # a task may have many groups: it reads them one after the other
    return both.repartition(min(max(4 * PIECES**2, tasks), MOST_TASKS), "_group").sortWithinPartitions("_group", "_side")


def _kind(df: DataFrame, columns=None) -> T.StructType:
    return df.select(*(columns or df.columns)).schema


def score_many_profiles(df: DataFrame, tables: Mapping[str, DataFrame], min_pct: float = 0.0) -> DataFrame:
    """(profile_id, id, points, percent) of every listing that passes a profile's limits and signals.

    Equal to the rows of ``ranking.score_rows`` without a failure, for each profile of the tables.
    A profile without keywords, streets or weights scores like one that has none of them.
    """
    groups = keyword_groups(tables["profile_keywords"])
    profiles = cut_lineage(placed(profile_rows(tables, groups)))
    listings = open_listings(df)
    for extra in (group_counts(df, groups), street_hits(SG._complete(df), tables["profile_streets"])):
        listings = listings.join(extra.hint("merge"), "id", "left")
    listings = listings.withColumns({
        "_counts": F.coalesce("_counts", F.create_map().cast("map<bigint,int>")),
        "_found_streets": F.coalesce("_found_streets", F.array().cast("array<string>")),
    })
    met = grouped(cut_lineage(listings), profiles)
    kinds = profiles.schema["profile_id"].dataType.simpleString(), listings.schema["id"].dataType.simpleString()
    schema = f"profile_id {kinds[0]}, id {kinds[1]}, points double, percent double"
    out = df.sparkSession.createDataFrame([], schema) if met is None else met.mapInArrow(score_groups, schema)
    return out.where(F.col("percent") >= F.lit(float(min_pct))) if min_pct > 0 else out
