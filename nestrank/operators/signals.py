"""Text, location and light signals added to a listings DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.functions import geo
from nestrank.functions import lexicon as LX
from nestrank.functions import scoring as SC
from nestrank.functions import text as TX
from nestrank.schema import FLAG_COLUMNS
from nestrank.sources.profiles import Profile


def with_text(df: DataFrame, text_col: str, name: str = "_t") -> DataFrame:
    return df.withColumn(name, TX.lowered(F.col(text_col)))


def with_found(df: DataFrame, text_col: str, terms: Sequence[str]) -> DataFrame:
    """Add ``_found``: the given terms that occur in the text."""
    return df.withColumn("_found", TX.scan(TX.lowered(F.col(text_col)), terms))


def extract_flags(df: DataFrame, text_col: str = "description", groups: Mapping[str, Sequence[str]] = LX.FLAG_GROUPS) -> DataFrame:
    """Add one boolean per flag (``flag_<name>``).  An empty text gives no flag at all
    (NULL), and the two deal flags are true or NULL."""
    index = TX.TermIndex({**TX.FLAG_RULES, **groups})
    staged = index.with_words(df, TX.lowered(F.col(text_col)))
    empty = F.coalesce(F.col(text_col), F.lit("")) == ""
    flags = {f"flag_{n}": F.when(~empty, expr) for n, expr in TX.flag_columns(index).items()}
    return staged.withColumns(flags).drop(*index.names())


def apply_flags(df: DataFrame) -> DataFrame:
    """Map ``flag_*`` onto the listing columns: an explicit non-NULL value wins."""
    exprs = {}
    for flag, column in FLAG_COLUMNS.items():
        found = F.col(f"flag_{flag}")
        exprs[column] = F.coalesce(F.col(column), found) if column in df.columns else found
    return df.withColumns(exprs).drop(*[f"flag_{f}" for f in FLAG_COLUMNS])


def keyword_hits(df: DataFrame, text_col: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``hits_<group>``: terms found, in list order, each once."""
    staged = with_found(df, text_col, [t for terms in groups.values() for t in terms])
    return staged.withColumns(
        {f"hits_{g}": TX.found_hits(F.col("_found"), terms) for g, terms in groups.items()}
    ).drop("_found")


def keyword_hit_rows(df: DataFrame, key: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """One row per (text, term found); for lexicons of thousands of terms, where one array
    per group is not wanted.  One pass per text, no text x term pairs."""
    return with_found(df, text_col, terms).select(key, F.explode("_found").alias("keyword"))


def text_signals(df: DataFrame, profile: Profile, text_col: str = "description") -> DataFrame:
    """Add ``positive_hits`` and ``negative_hits`` maps (group -> terms, groups without a
    hit left out).  ``dark`` is dropped when any ``light`` term is there."""
    positive, negative = profile.groups("positive"), profile.groups("negative")
    terms = [t for groups in (positive, negative) for ws in groups.values() for t in ws]
    staged = with_found(df, text_col, terms)
    found = F.col("_found")
    cols = {f"_p_{g}": TX.found_hits(found, ws) for g, ws in positive.items()}
    cols |= {f"_n_{g}": TX.found_hits(found, ws) for g, ws in negative.items()}
    staged = staged.withColumns(cols)

    def as_map(prefix: str, polarity: str) -> Column:
        entries = []
        for group in profile.groups(polarity):
            found = F.col(f"{prefix}{group}")
            if prefix == "_n_" and group == "dark" and "_p_light" in cols:
                found = F.when(F.size("_p_light") > 0, SC.no_evidence()).otherwise(found)
            entries.append(F.struct(F.lit(group).alias("k"), found.alias("v")))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e.v) > 0))

    return staged.withColumns(
        {"positive_hits": as_map("_p_", "positive"), "negative_hits": as_map("_n_", "negative")}
    ).drop("_found", *cols)


def is_generic(text: Column, positive_groups: Column) -> Column:
    """Empty, or under 80 words with fewer than two positive groups."""
    return (text == "") | ((TX.word_count(text) < 80) & (positive_groups < 2))


def text_quality(df: DataFrame, text_col: str, weights: Mapping[str, float] | None = None, name: str = "text_quality") -> DataFrame:
    index = TX.TermIndex(TX.QUALITY_RULES)
    staged = index.with_words(df, TX.lowered(F.col(text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return staged.withColumn(name, TX.text_quality(text, index, weights)).drop(*index.names())


def _flag(df: DataFrame, flag: str) -> Column:
    column = FLAG_COLUMNS[flag]
    return F.coalesce(F.col(column), F.lit(False)) if column in df.columns else F.lit(False)


def _light_inputs(df: DataFrame) -> tuple[Column, ...]:
    photos = F.coalesce(F.size("photos"), F.lit(0)) if "photos" in df.columns else F.lit(0)
    return (
        _flag(df, "natural_light"),
        _flag(df, "north_facing_only"),
        _flag(df, "basement_unit"),
        F.greatest(photos, F.lit(0)),
    )


def light_potential(df: DataFrame, text_col: str = "description") -> DataFrame:
    """Add light_potential_score, light_potential_signals and light_potential_confidence."""
    inputs = _light_inputs(df)
    index = TX.TermIndex(TX.LIGHT_RULES)
    staged = index.with_words(with_found(df, text_col, index.terms), TX.lowered(F.col(text_col)))
    signals = TX.light_signals(F.col("_found"), index, *inputs)
    return staged.withColumns(
        {
            "light_potential_score": TX.light_score(index, *inputs),
            "light_potential_signals": signals,
            "light_potential_confidence": TX.light_confidence(signals, inputs[1], inputs[2]),
        }
    ).drop("_found", *index.names())


def tranquility(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add tranquility_score, _factors, _warnings and _confidence.

    Missing coordinates score 50 with low confidence; outside coverage is NULL.
    """
    la, lo = F.col(lat), F.col(lon)
    staged = df.withColumn("_city", geo.coverage(la, lo))
    near = {
        f"_near_{layer}": geo.nearest_member(F.col("_city"), lat, lon, layer)
        for layer in ("street", "freeway", "fire")
    }
    staged = staged.withColumns(near)  # a projection of its own: generated code, split into small methods
    staged = staged.withColumns({name: geo.measured(F.col(name)) for name in near})
    street, freeway, fire = (F.col(c) for c in near)
    missing = la.isNull() | lo.isNull()
    inside = F.col("_city").isNotNull()

    def place(s: Column) -> Column:
        return F.struct(
            s["name"].alias("name"),
            TX.round_half_even(s.distance_m, 1).alias("distance_m"),
        )

    return staged.withColumns(
        {
            "tranquility_score": F.when(missing, F.lit(50))
            .when(inside, geo.tranquility_points(street, freeway, fire))
            .cast("int"),
            "tranquility_factors": F.when(
                inside & ~missing,
                F.struct(
                    place(street).alias("nearest_busy_street"),
                    place(freeway).alias("nearest_freeway"),
                    place(fire).alias("nearest_fire_station"),
                ),
            ),
            "tranquility_warnings": F.when(missing, F.array(F.lit("No location data available")))
            .when(inside, geo.tranquility_warnings(street, freeway, fire))
            .otherwise(F.array(F.lit("Outside coverage area"))),
            "tranquility_confidence": F.when(missing | ~inside, "low")
            .when(street.distance_m < 500, "high")
            .otherwise("medium"),
        }
    ).drop("_city", *near)


def quiet_score(df: DataFrame) -> Column:
    """Cached tranquility, else computed; zero coordinates count as missing (NULL)."""
    lat, lon = F.col("lat"), F.col("lon")
    city = F.when((lat != 0) & (lon != 0), geo.coverage(lat, lon))
    computed = geo.tranquility_of(city, "lat", "lon")
    if "tranquility_score" in df.columns:
        return F.coalesce(F.col("tranquility_score"), computed)
    return computed


# Groups the scorer reads even when a profile does not define them.
_READ_POSITIVE = (
    "light", "outdoor", "outdoor_private", "outdoor_premium", "character", "quality",
    "kitchen", "amenities", "pet", "gym",
)
_READ_NEGATIVE = (
    "dark", "weak_outdoor", "flipper", "location_noise", "condition", "no_pets",
    "gross_highrise",
)


# Listing columns the scorer names but a caller may leave out.
_OPTIONAL = {
    "address": "string", "description": "string", "parking_type": "string", "price": "double",
    "lat": "double", "lon": "double", "hoa_fee": "double", "year_built": "int",
    "visual_quality_score": "int", "days_on_market": "int",
}


def _complete(df: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in _OPTIONAL.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def stage(df: DataFrame, profile: Profile, only: Iterable[str] | None = None) -> DataFrame:
    """Add the staged columns ``functions.scoring`` reads.

    Unused ones are pruned by the optimizer, so the ranking stage pays only for the
    criteria that carry weight.
    """
    df = _complete(df)
    mods = profile.location_modifiers or {}
    positive, negative = profile.groups("positive"), profile.groups("negative")
    index = TX.TermIndex(
        {
            **{f"_p_{g}": ws for g, ws in positive.items()},
            **{f"_n_{g}": ws for g, ws in negative.items()},
            **{f"_c_{n}": ws for n, ws in LX.CRITERION_TERMS.items()},
            **{f"_r_{n}": ws for n, ws in SC.RULES.items()},
            "_doorman": [t for t in positive.get("amenities", []) if any(d in t for d in LX.DOORMAN_TERMS)],
            **TX.LIGHT_RULES,
        }
    )
    staged = index.with_words(with_found(df, "description", index.terms), TX.lowered(F.col("description")))
    found = F.col("_found")
    cols: dict[str, Column] = {}
    for prefix, wanted, groups in (("_p_", _READ_POSITIVE, positive), ("_n_", _READ_NEGATIVE, negative)):
        for group in dict.fromkeys((*wanted, *groups)):
            cols[f"_k{prefix}{group}"] = index.count(f"{prefix}{group}")
            cols[f"{prefix}{group}"] = TX.found_hits(found, groups.get(group, []))
    for name, words in LX.CRITERION_TERMS.items():
        cols[f"_k_c_{name}"] = index.count(f"_c_{name}")
        cols[f"_c_{name}"] = TX.found_hits(found, words)
    for name in SC.RULES:
        cols[f"_r_{name}"] = index.any(f"_r_{name}")
    cols["_k_doorman"] = index.count("_doorman")
    lit = index.any("_p_light")
    cols["_k_n_dark"] = F.when(lit, F.lit(0)).otherwise(cols["_k_n_dark"])
    cols["_n_dark"] = F.when(lit, SC.no_evidence()).otherwise(cols["_n_dark"])
    cols["_good_streets"] = SC.street_hits(F.col("address"), mods.get("boost_streets"))
    cols["_bad_streets"] = SC.street_hits(F.col("address"), mods.get("penalize_streets"))
    cols["_quiet"] = quiet_score(df)
    for flag in FLAG_COLUMNS:
        cols[f"_f_{flag}"] = _flag(df, flag)
    if "visual_assessment" in df.columns:
        cols["_bright"] = F.col("visual_assessment.dimensions")["brightness"]
    else:
        cols["_bright"] = F.lit(None).cast("int")
    staged = staged.withColumns(cols)

    computed = TX.light_score(index, *_light_inputs(df))
    light = (
        F.coalesce(F.col("light_potential_score"), computed)
        if "light_potential_score" in df.columns
        else computed
    )
    groups = F.lit(0)
    for group in profile.groups("positive"):
        groups = groups + (F.col(f"_k_p_{group}") > 0).cast("int")
    return staged.withColumns(
        {
            "_light": light,
            "_generic": is_generic(F.coalesce(F.col("description"), F.lit("")), groups) if profile.groups("negative").get("flipper") else F.lit(False),
            "_outdoor": SC.outdoor_raw(profile),
        }
    )


def staged_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_")]
