"""Search description in plain words -> criteria row, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions.geo import normalize_hood
from nestrank.functions.text import any_term

# --- fixed values: (column, value, terms); a later rule of a column wins -----
NUMBER_RULES = (
    ("price_min", 1000000.0, ("$1,000,000", "$1m", "1 million")),
    ("price_max", 2000000.0, ("$2,000,000", "$2m", "2 million")),
    ("price_max", 3000000.0, ("$3,000,000", "$3m", "3 million")),
    ("beds_min", 3, ("3 bedroom", "3 bed", "three bedroom")),
    ("beds_min", 4, ("4 bedroom", "4 bed", "four bedroom")),
    ("baths_min", 2.0, ("2 bath", "two bath")),
    ("baths_min", 2.5, ("2.5 bath",)),
    ("sqft_min", 1200, ("1,200", "1200 sq")),
    ("sqft_min", 1800, ("1,800", "1800 sq")),
    ("sqft_max", 2500, ("2,500", "2500 sq")),
    ("min_walk_score", 75, ("walkable", "walk score")),
    ("min_walk_score", 85, ("walk score 85",)),
)
SWITCH_RULES = (
    ("require_natural_light", ("natural light", "sun-drenched", "bright")),
    ("require_high_ceilings", ("high ceiling", "vaulted", "10-foot")),
    ("require_outdoor_space", ("outdoor", "deck", "patio", "yard")),
    ("require_parking", ("parking", "garage")),
    ("require_view", ("view",)),
    ("require_updated_systems", ("updated", "modern system", "renovated")),
    ("require_home_office", ("home office", "workspace", "work from home")),
    ("avoid_busy_streets", ("busy street",)),
    ("avoid_north_facing_only", ("north facing", "north-facing")),
    ("avoid_basement_units", ("basement", "garden level")),
)
TYPE_RULES = (
    ("single_family", ("single-family", "single family", "house")),
    ("condo", ("condo", "condominium")),
    ("townhouse", ("townhouse", "townhome")),
    ("loft", ("loft",)),
)
HOODS = (
    "pacific heights", "presidio heights", "nob hill", "russian hill", "marina",
    "cow hollow", "hayes valley", "noe valley", "castro", "mission", "potrero hill",
    "potrero", "dogpatch", "soma", "south beach", "richmond", "sunset",
    "cole valley", "haight", "haight-ashbury", "japantown", "western addition",
    "bernal heights", "glen park", "dolores heights", "nopa", "no pa",
    "north of panhandle",
)
STREET_TERMS = ("van ness", "geary", "19th ave")
STREETS = ("Van Ness", "Geary", "19th Ave")
# criterion -> (term, weight with the term, weight without)
WEIGHT_RULES = {
    "natural_light": ("natural light", 10, 7),
    "outdoor_space": ("outdoor", 9, 6),
    "high_ceilings": ("high ceiling", 8, 5),
    "view": ("view", 10, 4),
    "parking": ("garage", 8, 6),
    "updated_systems": ("updated", 7, 4),
    "walk_score": ("walkable", 9, 5),
}
NUMBER_TYPES = {
    "price_min": "double", "price_max": "double", "beds_min": "int", "baths_min": "double",
    "sqft_min": "int", "sqft_max": "int", "min_walk_score": "int",
}


def parse_search_description(df: DataFrame, text_col: str) -> DataFrame:
    """Add one criteria column per rule target; what the text does not name stays NULL."""
    staged = df.withColumn("_d", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    d = F.col("_d")
    cols: dict[str, Column] = {}
    for target, kind in NUMBER_TYPES.items():
        rules = [(v, terms) for name, v, terms in NUMBER_RULES if name == target]
        cols[target] = F.coalesce(
            *[F.when(any_term(d, terms), F.lit(v)) for v, terms in reversed(rules)], F.lit(None)
        ).cast(kind)
    for target, terms in SWITCH_RULES:
        cols[target] = F.when(any_term(d, terms), F.lit(True))
    kinds = F.filter(
        F.array(*[F.when(any_term(d, terms), F.lit(name)) for name, terms in TYPE_RULES]),
        lambda x: x.isNotNull(),
    )
    cols["property_types"] = F.when(F.size(kinds) > 0, kinds)
    hoods = F.transform(
        F.filter(F.array(*[F.lit(h) for h in HOODS]), lambda h: F.contains(d, h)), normalize_hood
    )
    cols["preferred_neighborhoods"] = F.when(F.size(hoods) > 0, hoods)
    cols["neighborhood_mode"] = F.when(F.size(hoods) > 0, F.lit("strict"))
    cols["excluded_streets"] = F.when(any_term(d, STREET_TERMS), F.array(*[F.lit(s) for s in STREETS]))
    cols["feature_weights"] = F.create_map(
        *[
            item
            for name, (term, with_it, without) in WEIGHT_RULES.items()
            for item in (F.lit(name), F.when(F.contains(d, F.lit(term)), with_it).otherwise(without))
        ]
    )
    return staged.withColumns(cols).drop("_d")
