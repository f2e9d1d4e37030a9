"""Filters and predicates over listings, matches, changes and scouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions import columns as CO
from nestrank.functions import geo
from nestrank.functions import lexicon as LX
from nestrank.functions.text import TermIndex, any_term, let, lowered, sealed
from nestrank.operators.signals import _complete, _flag, quiet_score
from nestrank.sources.profiles import Profile


def _minimums(p: Profile) -> list[tuple[str, float, str]]:
    names = (
        ("beds", "bedrooms_min", "bedrooms below min"),
        ("baths", "bathrooms_min", "bathrooms below min"),
    )
    return [(c, p.hard_filters[k], why) for c, k, why in names if p.hard_filters.get(k) is not None]


def hard_filter(df: DataFrame, p: Profile) -> DataFrame:
    """Profile limits as one pushable conjunction.  Unknown size passes, and a status
    matches as a pattern, so ``off_market`` also takes ``off-market`` out."""
    cond = F.lit(True)
    hard = p.hard_filters
    if hard.get("price_max") is not None:
        cond = cond & (F.col("price") <= F.lit(float(hard["price_max"])))
    for column, low, _ in _minimums(p):
        cond = cond & (F.col(column) >= F.lit(low))
    if hard.get("sqft_min") is not None:
        cond = cond & (F.col("sqft").isNull() | (F.col("sqft") >= F.lit(hard["sqft_min"])))
    if p.neighborhoods:
        cond = cond & F.col("neighborhood").isin(*p.neighborhoods)
    active = F.lit(True)
    for status in LX.INACTIVE_STATUSES:
        active = active & ~F.col("listing_status").ilike(f"%{status}%")
    return df.filter(cond & (F.col("listing_status").isNull() | active))


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.filter(
        F.array(*[F.when(cond, F.lit(why)) for cond, why in pairs]), lambda r: r.isNotNull()
    )


def hard_failures(p: Profile) -> Column:
    """Reasons a listing breaks the limits; here a status is tested as a literal."""
    hard, pairs = p.hard_filters, []
    if hard.get("price_max") is not None:
        price = F.col("price")
        pairs.append((price.isNull() | (price > F.lit(float(hard["price_max"]))), "price above max"))
    for column, low, why in _minimums(p):
        pairs.append((F.col(column).isNull() | (F.col(column) < F.lit(low)), why))
    if hard.get("sqft_min") is not None:
        pairs.append((F.col("sqft").isNotNull() & (F.col("sqft") < F.lit(hard["sqft_min"])), "sqft below min"))
    if p.neighborhoods:
        hood = F.col("neighborhood")
        pairs.append((hood.isNull() | ~hood.isin(*p.neighborhoods), "neighborhood excluded"))
    status = F.lower(F.coalesce(F.col("listing_status"), F.lit("")))
    pairs.append((any_term(status, LX.INACTIVE_STATUSES), "inactive status"))
    return _reasons(*pairs)


def _gate(p: Profile) -> TermIndex:
    """The few term groups that can disqualify a listing; usually one word of bits."""
    rent = p.mode == "rent"
    return TermIndex(
        {
            "dark": p.keywords("negative", "dark"),
            "light": p.keywords("positive", "light"),
            "layout": LX.CRITERION_TERMS["layout_bad"],
            "last": p.keywords("negative", "no_pets") if rent else LX.CRITERION_TERMS["no_parking"],
        }
    )


def _text_pairs(p: Profile, index: TermIndex, word) -> list[tuple[Column, str]]:
    return [
        (index.any("dark", word) & ~index.any("light", word), "dark interior signals"),
        (index.any("layout", word), "layout red flags"),
        (index.any("last", word), "no pets allowed" if p.mode == "rent" else "no parking"),
    ]


def _place_pairs(df: DataFrame) -> list[tuple[Column, str]]:
    return [
        (_flag(df, "busy_street"), "busy street signal"),
        (F.coalesce(quiet_score(df) < 40, F.lit(False)), "low tranquility score"),
    ]


def with_signal_failures(df: DataFrame, p: Profile, name: str = "signal_failures") -> DataFrame:
    """Add the reasons a listing's text or place disqualifies it."""
    df = _complete(df)
    index = _gate(p)
    (dark, dark_why), (layout, layout_why), (last, last_why) = _text_pairs(p, index, lambda w: F.col(f"_w{w}"))
    if p.mode == "rent":
        last = last | _flag(df, "no_pets")
    (busy, busy_why), (loud, loud_why) = _place_pairs(df)
    pairs = ((dark, dark_why), (busy, busy_why), (loud, loud_why), (layout, layout_why), (last, last_why))
    staged = index.with_words(df, lowered(F.col("description")))
    return staged.select(*df.columns, sealed({name: _reasons(*pairs)}))


def signal_filter(df: DataFrame, p: Profile) -> DataFrame:
    """Drop listings with a disqualifying text or location signal.

    Flags and place come first, then one scan of the text for the gate terms.  The verdict is
    sealed: a filter pushed below the flags would carry a copy of their text scan for each flag.
    """
    df = _complete(df)
    keep = F.lit(True)
    for cond, _ in _place_pairs(df):
        keep = keep & ~cond
    if p.mode == "rent":
        keep = keep & ~_flag(df, "no_pets")

    index = _gate(p)

    def clean(masks: Column) -> Column:
        test = F.lit(True)
        for cond, _ in _text_pairs(p, index, lambda w: index.word(masks, w)):
            test = test & ~cond
        return test

    verdict = keep & let(index.masks(lowered(F.col("description"))), clean)
    return df.select(*df.columns, sealed({"_keep": verdict})).filter("_keep").drop("_keep")


def staged_verdict(p: Profile) -> Column:
    """The same test on columns that ``signals.stage`` has added: no scan of its own."""
    last = F.col("_f_no_pets") | (F.col("_k_n_no_pets") > 0) if p.mode == "rent" else F.col("_r_no_parking")
    loud = F.coalesce(F.col("_quiet") < 40, F.lit(False))
    return ~((F.col("_k_n_dark") > 0) | F.col("_f_busy_street") | loud | F.col("_r_layout_bad") | last)


# Criteria column -> (listing column, which side bounds).  Fixed values.
RANGES = (
    ("price_min", "price", ">="), ("price_max", "price", "<="),
    ("beds_min", "beds", ">="), ("baths_min", "baths", ">="), ("sqft_min", "sqft", ">="),
)
REQUIRED = (
    ("require_natural_light", "has_natural_light_keywords"),
    ("require_high_ceilings", "has_high_ceiling_keywords"),
    ("require_outdoor_space", "has_outdoor_space_keywords"),
)


def criteria_condition(crit: dict[str, Column], listing: dict[str, Column]) -> Column:
    """Criteria row against a listing; a NULL limit does not bind, a NULL value fails it."""
    cond = F.lit(True)
    for limit, column, side in RANGES:
        if limit in crit and column in listing:
            test = listing[column] >= crit[limit] if side == ">=" else listing[column] <= crit[limit]
            cond = cond & (crit[limit].isNull() | F.coalesce(test, F.lit(False)))
    for need, flag in REQUIRED:
        if need in crit and flag in listing:
            cond = cond & (~F.coalesce(crit[need], F.lit(False)) | F.coalesce(listing[flag], F.lit(False)))
    return cond


def criteria_filter(df: DataFrame, criteria: dict) -> DataFrame:
    """One criteria row, cheapest first with unknown prices last."""
    crit = {k: F.lit(v) for k, v in criteria.items() if v is not None and v is not False}
    listing = {c: F.col(c) for c in df.columns}
    return df.filter(criteria_condition(crit, listing)).orderBy(F.col("price").asc_nulls_last(), F.col("id"))


def listing_page(df: DataFrame, p: Profile, skip: int = 0, limit: int | None = 100) -> DataFrame:
    """A page of the catalog (all of it without ``limit``); unlike the matcher it drops listings of unknown size."""
    hard, cond = p.hard_filters, F.lit(True)
    if hard.get("price_max") is not None:
        cond = cond & (F.col("price") <= F.lit(float(hard["price_max"])))
    for column, low, _ in _minimums(p):
        cond = cond & (F.col(column) >= F.lit(low))
    if hard.get("sqft_min") is not None:
        cond = cond & (F.col("sqft") >= F.lit(hard["sqft_min"]))
    if p.neighborhoods:
        cond = cond & F.col("neighborhood").isin(*p.neighborhoods)
    page = df.filter(cond).orderBy("id")
    page = page.offset(skip) if skip else page
    return page if limit is None else page.limit(limit)


def preset_filters(base: Mapping[str, Any], preset: Mapping[str, Any] | None) -> dict[str, Any]:
    """Filters of a profile with a preset's on top; the preset's win where both are given."""
    return {**base, **(preset or {}).get("filters", {})}


def preset_filtered(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Listings that pass preset filters; a fact that is not known passes.

    ``include_price_reduced`` widens a search and so drops nothing.
    """
    cond = F.lit(True)
    for name, column in (("avoid_north_facing_only", "is_north_facing_only"), ("avoid_basement_units", "is_basement_unit")):
        if filters.get(name):
            cond = cond & ~F.coalesce(F.col(column), F.lit(False))
    for name, column in (("min_walk_score", "walk_score"), ("min_days_on_market", "days_on_market")):
        if filters.get(name) is not None:
            cond = cond & F.coalesce(F.col(column) >= F.lit(filters[name]), F.lit(True))
    if filters.get("property_types"):
        cond = cond & F.coalesce(F.lower("property_type").isin(*filters["property_types"]), F.lit(True))
    return df.filter(cond)


def workspace_filter(
    df: DataFrame,
    neighborhood: str | None = None,
    min_score: float = 0.0,
    natural_light: bool = False,
    outdoor_space: bool = False,
    quiet: bool = False,
    price_reduced: bool = False,
) -> DataFrame:
    """Filters of the match workspace; matches without a score pass the score filter."""
    cond = F.col("match_score").isNull() | (F.col("match_score") >= F.lit(float(min_score)))
    if neighborhood:
        cond = cond & (F.coalesce(F.nullif("neighborhood", F.lit("")), F.lit("Unknown")) == neighborhood)
    if natural_light:
        cond = cond & _flag(df, "natural_light")
    if outdoor_space:
        cond = cond & _flag(df, "outdoor_space")
    if quiet:
        cond = cond & (F.coalesce(F.col("tranquility_score"), F.lit(50)) >= 60)
    if price_reduced:
        cond = cond & _flag(df, "price_reduced")
    return df.filter(cond)


SORTS = {  # mode: column, value where it is missing, descending
    "score": ("match_score", 0.0, True),
    "price_low": ("price", float("inf"), False),
    "price_high": ("price", 0.0, True),
    "light": ("light_potential_score", 50, True),
    "tranquility": ("tranquility_score", 50, True),
    "newest": ("days_on_market", 999, False),
}


def sort_value(mode: str) -> Column:
    """What ``sort_matches`` compares, before the id."""
    column, default, _ = SORTS[mode]
    return F.coalesce(F.col(column), F.lit(default))


def sort_matches(df: DataFrame, mode: str = "score") -> DataFrame:
    """Six sort orders with their defaults for missing values, id last; every row stays."""
    if mode not in SORTS:
        return df
    value = sort_value(mode)
    return df.orderBy(value.desc() if SORTS[mode][2] else value.asc(), F.col("id"))


def changes(events: DataFrame, listings: DataFrame, since: datetime | None = None, types: str | None = None, limit: int | None = 100) -> DataFrame:
    """Newest changes (all without ``limit``) with address, price and url of the listing.

    The limit comes before the join: listing facts are fetched for the chosen events only.
    """
    feed = events
    if since is not None:
        feed = feed.filter(F.col("created_at") >= F.lit(since))
    wanted = [t.strip() for t in (types or "").split(",") if t.strip()]
    if wanted:
        feed = feed.filter(F.col("event_type").isin(*wanted))
    order = [F.col("created_at").desc(), F.col("event_id").desc()]
    known = listings.select(F.col("id").alias("listing_id"))
    top = feed.join(known, "listing_id", "left_semi")
    if limit is not None:
        top = top.orderBy(*order).limit(limit)
    facts = listings.select(
        F.col("id").alias("listing_id"), "address", F.col("price").alias("listing_price"), "url"
    )
    return facts.join(top, "listing_id").orderBy(*order)


def active_criteria(users: DataFrame, criteria: DataFrame) -> DataFrame:
    """One criteria row per user: the active one with the largest id, else the latest.

    Users without a row get the default one (no id yet); the row that is returned counts as
    active. Rows of a user are combined on the map side, so no user's history is gathered.
    """
    columns = [c for c in criteria.columns if c != "user_id"]
    rank = F.struct(F.coalesce("is_active", F.lit(False)), F.col("id"))
    chosen = criteria.groupBy("user_id").agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    row = users.select("user_id").distinct().join(chosen, "user_id", "left")
    named = {c: F.col("_row")[c] for c in columns}
    named["name"] = F.when(F.col("_row").isNull(), F.lit("Default Criteria")).otherwise(F.col("_row")["name"])
    named["is_active"] = F.lit(True)
    return row.select("user_id", *[v.alias(c) for c, v in named.items()])


def validate_criteria(df: DataFrame) -> DataFrame:
    """Normalise neighbourhood lists, keep the soft cap under the hard cap when both are
    given, and clear unknown modes."""
    soft, hard = F.col("price_soft_max"), F.col("price_max")
    both = (F.coalesce(soft, F.lit(0.0)) != 0) & (F.coalesce(hard, F.lit(0.0)) != 0)
    return df.withColumns(
        {
            "preferred_neighborhoods": geo.normalize_hoods(F.col("preferred_neighborhoods")),
            "avoid_neighborhoods": geo.normalize_hoods(F.col("avoid_neighborhoods")),
            "price_soft_max": F.when(both, F.least(soft, hard)).otherwise(soft),
            "neighborhood_mode": F.when(F.col("neighborhood_mode").isin("strict", "boost"), F.col("neighborhood_mode")),
            "recency_mode": F.when(
                F.col("recency_mode").isin("fresh", "balanced", "hidden_gems"), F.col("recency_mode")
            ),
        }
    )


def needs_visual(now: Column, photos: Column, known_hash: Column, analyzed_at: Column, max_age_days: int = 30) -> Column:
    """Never analysed, photos changed, or older than ``max_age_days`` whole days."""
    age_days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(analyzed_at)) / F.lit(86400))
    never = F.nullif(known_hash, F.lit("")).isNull() | analyzed_at.isNull()
    return never | (CO.photos_hash(photos) != known_hash) | (age_days > max_age_days)


def due_scouts(scouts: DataFrame, now: Column) -> DataFrame:
    """Active scouts whose interval has passed; unknown frequencies are never due."""
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_run")
    due = (
        F.when(F.col("last_run").isNull(), True)
        .when(F.col("alert_frequency") == "instant", idle > 3600)
        .when(F.col("alert_frequency") == "daily", idle > 86400)
        .when(F.col("alert_frequency") == "weekly", idle > 7 * 86400)
        .otherwise(False)
    )
    return scouts.filter(F.coalesce(F.col("is_active"), F.lit(False)) & due)


def generic_hood(col: Column, names: Sequence[str]) -> Column:
    return F.lower(F.coalesce(col, F.lit(""))).isin(*names)
