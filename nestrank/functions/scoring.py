"""The 21 score criteria as Column expressions over staged signal columns.

``operators.signals.stage`` provides the inputs: hit counts
``_k_p_<group>`` / ``_k_n_<group>`` of the profile, ``_k_c_<name>`` of the fixed lists, the
hit arrays of the same names without ``_k`` (read by evidence only), rules ``_r_<name>``,
boolean flags ``_f_<flag>``, ``_light`` and ``_quiet`` (0-100 or NULL), ``_bright``.
Every criterion yields a score of 0-10 rounded to two digits, evidence and confidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestrank.functions import lexicon as LX
from nestrank.functions.text import any_term, round_half_even
from nestrank.sources.profiles import Profile



# Rules that look for terms outside the groups of a profile.
RULES = {
    "nightlife": ("bar", "nightlife"),
    "low_floor": ("first floor", "ground floor"),
    "tall": LX.TALL_CEILING_TERMS,
    "full_time": LX.DOORMAN_FULL_TIME,
    "part_time": LX.DOORMAN_PART_TIME,
    "negated": LX.DOORMAN_NEGATIONS,
    **{name: terms for name, terms in LX.CRITERION_TERMS.items()},
}


def _c(name: str) -> Column:
    return F.col(name)


def _n(name: str) -> Column:
    return F.col(f"_k{name}")


def _has(name: str) -> Column:
    return _n(name) > 0


def _rule(name: str) -> Column:
    return F.col(f"_r_{name}")


def hit_score(count: Column) -> Column:
    """Four hits are full marks."""
    return F.least(F.lit(10.0), count * F.lit(2.5))


def _number(value: float | Column) -> Column:
    """A profile's number: a literal, or a column where profiles are rows."""
    return value if isinstance(value, Column) else F.lit(float(value))


def scaled(score: Column, factor: float | Column) -> Column:
    """Score times a profile multiplier, capped at ten."""
    return F.least(F.lit(10.0), score * _number(factor))


def floored(score: Column, cond: Column, low: float) -> Column:
    """At least ``low`` when the condition holds; names the score once."""
    return F.greatest(score, F.when(cond, F.lit(low)))


def factor(cond: Column, value: float | Column) -> Column:
    """Multiplier that is one unless the condition holds."""
    return F.when(cond, _number(value)).otherwise(F.lit(1.0))


def mentions(arr: Column, count: int, word: str = "mentions") -> Column:
    return F.transform(
        F.slice(arr, 1, count), lambda k: F.concat(F.lit(f"{word} '"), k, F.lit("'"))
    )


def notes(*items: Column) -> Column:
    """Array of the non-NULL texts."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def no_evidence() -> Column:
    return F.array().cast("array<string>")


# --- C1 ----------------------------------------------------------------------
def natural_light(p: Profile) -> Column:
    base = hit_score(_n("_p_light"))
    light, bright = _c("_light") / F.lit(10.0), _c("_bright") / F.lit(10.0)
    parts = base + F.coalesce(light, F.lit(0.0)) + F.coalesce(bright, F.lit(0.0))
    count = (
        F.lit(1)
        + F.when(_c("_light").isNotNull(), 1).otherwise(0)
        + F.when(_c("_bright").isNotNull(), 1).otherwise(0)
    )
    score = scaled(parts / count, p.multiplier("positive", "light"))
    return score * factor(_has("_n_dark"), p.multiplier("negative", "dark"))


def natural_light_evidence(p: Profile) -> Column:
    return F.concat(
        mentions(_c("_p_light"), 3),
        notes(
            F.concat(F.lit("light potential "), _c("_light").cast("string")),
            F.concat(F.lit("brightness "), _c("_bright").cast("string")),
        ),
    )


def natural_light_confidence(p: Profile) -> Column:
    sure = (_n("_p_light") >= 2) | (F.coalesce(_c("_light"), F.lit(0)) != 0)
    return F.when(sure, "high").otherwise("medium")


# --- C2 ----------------------------------------------------------------------
def outdoor_raw(p: Profile) -> Column:
    """Outdoor score before rounding; the indoor-outdoor rule reads this one."""
    general, private, premium = _n("_p_outdoor"), _n("_p_outdoor_private"), _n("_p_outdoor_premium")
    flag = _c("_f_outdoor_space")
    signal = (general > 0) | (private > 0) | (premium > 0) | flag
    score = F.when(signal, F.lit(5.5) + F.least(F.lit(2.0), general * F.lit(0.5))).otherwise(F.lit(0.0))
    score = floored(score, flag, 6.0)
    score = floored(score, private > 0, 7.0) + F.least(F.lit(1.0), private * F.lit(0.4))
    score = floored(score, premium > 0, 8.5) + F.least(F.lit(1.0), premium * F.lit(0.35))
    score = scaled(score, p.multiplier("positive", "outdoor"))
    weak = _has("_n_weak_outdoor")
    score = F.least(
        score * factor(weak, p.multiplier("negative", "weak_outdoor")), F.when(weak, F.lit(6.5))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))


def outdoor_space(p: Profile) -> Column:
    return _c("_outdoor")


def outdoor_space_evidence(p: Profile) -> Column:
    return F.concat(
        mentions(_c("_p_outdoor"), 2),
        mentions(_c("_p_outdoor_private"), 2, "private"),
        mentions(_c("_p_outdoor_premium"), 2, "premium"),
        notes(F.when(_c("_f_outdoor_space"), "provider outdoor amenity flag")),
        mentions(_c("_n_weak_outdoor"), 2, "weak"),
    )


# --- C3 ----------------------------------------------------------------------
def _flipped() -> Column:
    return _has("_n_flipper") & _c("_generic")


def character_soul(p: Profile) -> Column:
    score = hit_score(_n("_p_character") + _n("_p_quality"))
    score = floored(score, _c("_f_architectural_details"), 7.0)
    built = F.nullif(_c("year_built"), F.lit(0))
    age = F.when(built <= 1940, F.lit(2.0)).when(built <= 1960, F.lit(1.0)).otherwise(F.lit(0.0))
    score = scaled(F.least(F.lit(10.0), score + age), p.multiplier("positive", "character"))
    score = F.least(F.lit(10.0), score * factor(_has("_p_quality"), p.multiplier("positive", "quality")))
    return score * factor(_flipped(), p.multiplier("negative", "flipper"))


def character_soul_evidence(p: Profile) -> Column:
    built = F.coalesce(_c("year_built"), F.lit(0))
    return F.concat(
        mentions(F.concat(_c("_p_character"), _c("_p_quality")), 3),
        notes(F.when(built != 0, F.concat(F.lit("year built "), built.cast("string")))),
    )


# --- C4 ----------------------------------------------------------------------
def kitchen_quality(p: Profile) -> Column:
    return scaled(hit_score(_n("_p_kitchen")), p.multiplier("positive", "kitchen"))


# --- C5, G10 -----------------------------------------------------------------
def street_hits(address: Column, streets) -> Column:
    """Streets of the profile found in the address, as written in the profile."""
    if not streets:
        return no_evidence()
    pairs = F.array(*[F.struct(F.lit(s).alias("name"), F.lit(s.lower()).alias("key")) for s in streets])
    lowered = F.lower(F.coalesce(address, F.lit("")))
    return F.transform(F.filter(pairs, lambda s: F.contains(lowered, s.key)), lambda s: s["name"])


def location_parts(p: Profile) -> dict[str, Column]:
    """Conditions behind the location adjustment, each a boolean."""
    exposed = _c("_f_busy_street") | (F.size("_bad_streets") > 0)
    return {
        "nightlife": F.lit(p.penalizes("adjacent_to_bar"))
        & (_has("_n_location_noise") | _rule("nightlife")),
        "thoroughfare": F.lit(p.penalizes("on_major_thoroughfare")) & exposed,
        "first_floor": F.lit(p.penalizes("first_floor_busy_street"))
        & exposed
        & _rule("low_floor"),
    }


def location_adjustment(p: Profile) -> Column:
    parts = location_parts(p)
    return (
        F.size("_good_streets") * F.lit(1.5)
        - F.size("_bad_streets") * F.lit(1.5)
        - F.when(parts["nightlife"], F.lit(1.5)).otherwise(F.lit(0.0))
        - F.when(parts["thoroughfare"], F.lit(1.5)).otherwise(F.lit(0.0))
        - F.when(parts["first_floor"], F.lit(1.0)).otherwise(F.lit(0.0))
    )


def location_evidence(p: Profile) -> Column:
    parts = location_parts(p)
    return F.concat(
        F.transform(_c("_good_streets"), lambda s: F.concat(F.lit("boost street "), s)),
        F.transform(_c("_bad_streets"), lambda s: F.concat(F.lit("penalize street "), s)),
        notes(
            F.when(parts["nightlife"], "adjacent to nightlife"),
            F.when(parts["thoroughfare"], "major thoroughfare exposure"),
            F.when(parts["first_floor"], "first floor on busy street"),
        ),
    )


def location_quiet(p: Profile) -> Column:
    quiet = F.least(F.lit(10.0), F.coalesce(_c("_quiet") / F.lit(10.0), F.lit(5.0)))
    quiet = F.greatest(F.lit(0.0), quiet - F.when(_c("_f_busy_street"), F.lit(3.0)).otherwise(F.lit(0.0)))
    quiet = quiet * factor(_has("_n_location_noise"), p.multiplier("negative", "location_noise"))
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), quiet + location_adjustment(p)))


def location_quiet_evidence(p: Profile) -> Column:
    return F.concat(
        notes(
            F.concat(F.lit("tranquility "), _c("_quiet").cast("string")),
            F.when(_c("_f_busy_street"), "busy street signal"),
        ),
        mentions(_c("_n_location_noise"), 2),
        location_evidence(p),
    )


def location_quiet_confidence(p: Profile) -> Column:
    return F.when(_c("_quiet").isNotNull(), "high").otherwise("low")


# --- C6 to C17 ---------------------------------------------------------------
def office_space(p: Profile) -> Column:
    return floored(hit_score(_n("_c_office")), _c("_f_home_office"), 7.0)


def indoor_outdoor_flow(p: Profile) -> Column:
    implied = ~_has("_c_flow") & (_c("_outdoor") >= 6) & _has("_c_layout")
    return F.when(implied, F.lit(6.5)).otherwise(hit_score(_n("_c_flow")))


def high_ceilings(p: Profile) -> Column:
    return (
        F.when(_rule("tall"), F.lit(9.0))
        .when(_c("_f_high_ceilings"), F.lit(8.0))
        .otherwise(F.lit(0.0))
    )


def layout_intelligence(p: Profile) -> Column:
    return hit_score(_n("_c_layout"))


def _visual() -> Column:
    """Visual score with zero read as missing."""
    return F.nullif(_c("visual_quality_score"), F.lit(0))


def move_in_ready(p: Profile) -> Column:
    score = F.greatest(hit_score(_n("_c_move_in")), F.least(F.lit(10.0), F.coalesce(_visual() / F.lit(10.0), F.lit(0.0))))
    score = score * factor(_flipped(), 0.8)
    return score * factor(_has("_n_condition"), p.multiplier("negative", "condition"))


def views(p: Profile) -> Column:
    return F.when(_c("_f_view"), F.lit(8.0)).otherwise(F.lit(0.0))


def in_unit_laundry(p: Profile) -> Column:
    shared = ~_has("_c_laundry") & _rule("laundry_shared")
    return F.when(shared, F.lit(4.0)).otherwise(hit_score(_n("_c_laundry")))


def parking(p: Profile) -> Column:
    own = F.lower(F.coalesce(_c("parking_type"), F.lit(""))).isin("garage", "carport", "driveway")
    street = _rule("street_parking")
    return (
        F.when(own, F.lit(9.0)).when(_c("_f_parking"), F.lit(7.0)).when(street, F.lit(4.0)).otherwise(F.lit(0.0))
    )


def central_hvac(p: Profile) -> Column:
    return hit_score(_n("_c_hvac"))


def gas_stove(p: Profile) -> Column:
    return hit_score(_n("_c_gas"))


def dishwasher(p: Profile) -> Column:
    return hit_score(_n("_c_dishwasher"))


def storage(p: Profile) -> Column:
    return F.when(_c("_f_storage"), F.lit(8.0)).otherwise(F.lit(0.0))


# --- C18 to C21 --------------------------------------------------------------
def pet_friendly(p: Profile) -> Column:
    score = F.when(_c("_f_pet_friendly"), F.lit(10.0)).otherwise(hit_score(_n("_p_pet")))
    score = scaled(score, p.multiplier("positive", "pet"))
    return score * factor(_has("_n_no_pets"), p.multiplier("negative", "no_pets"))


def pet_friendly_evidence(p: Profile) -> Column:
    return F.concat(
        F.when(_c("_f_pet_friendly"), F.array(F.lit("pet_friendly flag"))).otherwise(
            mentions(_c("_p_pet"), 3)
        ),
        notes(F.when(_has("_n_no_pets"), "no pets signal")),
    )


def gym_fitness(p: Profile) -> Column:
    score = F.when(_c("_f_gym_fitness"), F.lit(10.0)).otherwise(hit_score(_n("_p_gym")))
    return scaled(score, p.multiplier("positive", "gym"))


def gym_fitness_evidence(p: Profile) -> Column:
    return F.when(_c("_f_gym_fitness"), F.array(F.lit("gym_fitness flag"))).otherwise(
        mentions(_c("_p_gym"), 3)
    )


def building_quality(p: Profile) -> Column:
    visual = _visual() / F.lit(10.0)
    score = (
        F.when(_c("_f_building_quality") & visual.isNotNull(), (F.lit(7.0) + visual) / F.lit(2.0))
        .when(_c("_f_building_quality"), F.lit(7.0))
        .otherwise(F.coalesce(visual, F.lit(0.0)))
    )
    score = scaled(score, p.multiplier("positive", "building_quality"))
    return score * factor(_has("_n_gross_highrise"), p.multiplier("negative", "gross_highrise"))


def building_quality_evidence(p: Profile) -> Column:
    return notes(
        F.when(_c("_f_building_quality"), "building_quality flag"),
        F.concat(F.lit("visual quality "), _visual().cast("string")),
        F.when(_has("_n_gross_highrise"), "gross high-rise signal"),
    )


def _doorman_hits() -> Column:
    return F.filter(_c("_p_amenities"), lambda h: any_term(h, LX.DOORMAN_TERMS))


def doorman_concierge(p: Profile) -> Column:
    score = F.greatest(
        F.when(_c("_f_doorman_concierge"), F.lit(8.0)).otherwise(F.lit(0.0)),
        hit_score(_n("_doorman")),
    )
    return (
        F.when(_rule("negated"), F.lit(0.0))
        .when(_rule("full_time"), F.lit(10.0))
        .when(_rule("part_time"), F.greatest(score, F.lit(6.0)))
        .otherwise(score)
    )


def doorman_concierge_evidence(p: Profile) -> Column:
    return F.when(
        _rule("negated"), F.array(F.lit("doorman explicitly excluded"))
    ).otherwise(
        F.concat(
            notes(F.when(_c("_f_doorman_concierge"), "doorman flag")),
            mentions(_doorman_hits(), 2),
            notes(F.when(_rule("full_time"), "24h/full-time doorman")),
        )
    )


@dataclass(frozen=True)
class Criterion:
    key: str
    label: str
    score: Callable[[Profile], Column]
    evidence: Callable[[Profile], Column] | None = None
    confidence: Callable[[Profile], Column] | None = None

    def rounded(self, p: Profile) -> Column:
        return round_half_even(self.score(p), 2)


def _listed(column: str, count: int) -> Callable[[Profile], Column]:
    return lambda p: mentions(_c(column), count)


def _noted(score: Callable[[Profile], Column], text: str) -> Callable[[Profile], Column]:
    return lambda p: notes(F.when(score(p) > 0, text))


# Order matters: it is the summation order of the points and decides ties.
CRITERIA = (
    Criterion("natural_light", "Natural light", natural_light, natural_light_evidence, natural_light_confidence),
    Criterion("outdoor_space", "Outdoor space", outdoor_space, outdoor_space_evidence),
    Criterion("character_soul", "Character & soul", character_soul, character_soul_evidence),
    Criterion("kitchen_quality", "Kitchen quality", kitchen_quality, _listed("_p_kitchen", 3)),
    Criterion("location_quiet", "Quiet location", location_quiet, location_quiet_evidence, location_quiet_confidence),
    Criterion("office_space", "Office space", office_space, _listed("_c_office", 3)),
    Criterion("indoor_outdoor_flow", "Indoor-outdoor flow", indoor_outdoor_flow, _listed("_c_flow", 2)),
    Criterion("high_ceilings", "High ceilings", high_ceilings, _noted(high_ceilings, "ceiling keywords")),
    Criterion("layout_intelligence", "Layout intelligence", layout_intelligence, _listed("_c_layout", 2)),
    Criterion(
        "move_in_ready", "Move-in ready", move_in_ready,
        lambda p: F.concat(
            mentions(_c("_c_move_in"), 2),
            notes(F.when(_has("_n_condition"), "condition concerns")),
        ),
    ),
    Criterion("views", "Views", views, _noted(views, "view keywords")),
    Criterion("in_unit_laundry", "In-unit laundry", in_unit_laundry, _listed("_c_laundry", 2)),
    Criterion("parking", "Parking", parking, _noted(parking, "parking mention")),
    Criterion("central_hvac", "Central HVAC", central_hvac, _listed("_c_hvac", 2)),
    Criterion("gas_stove", "Gas stove", gas_stove, _listed("_c_gas", 2)),
    Criterion("dishwasher", "Dishwasher", dishwasher, _listed("_c_dishwasher", 2)),
    Criterion("storage", "Storage", storage, _noted(storage, "storage mention")),
    Criterion("pet_friendly", "Pet friendly", pet_friendly, pet_friendly_evidence),
    Criterion("gym_fitness", "Gym / fitness", gym_fitness, gym_fitness_evidence),
    Criterion("building_quality", "Building quality", building_quality, building_quality_evidence),
    Criterion("doorman_concierge", "Doorman / concierge", doorman_concierge, doorman_concierge_evidence),
)
LABELS = {c.key: c.label for c in CRITERIA}


# --- C22 to C25 --------------------------------------------------------------
def price_penalty(price: Column, soft, hard) -> Column:
    """0-10, linear between the soft and the hard cap."""
    if soft is None:
        return F.lit(0.0)
    soft = float(soft)
    hard = float(hard or soft)
    span = hard - soft
    ramp = F.lit(10.0) * ((price - F.lit(soft)) / F.lit(span)) if span > 0 else F.lit(10.0)
    return (
        F.when(price.isNull() | (price <= soft), F.lit(0.0))
        .when(price >= hard, F.lit(10.0))
        .otherwise(ramp)
    )


def hoa_penalty(fee: Column) -> Column:
    return F.when(fee.isNull() | (fee <= 800), F.lit(0.0)).when(fee <= 1000, F.lit(5.0)).otherwise(F.lit(10.0))


def penalties(p: Profile) -> Column:
    """Points taken off: price always, HOA fees only when buying."""
    price = price_penalty(_c("price"), p.soft_caps.get("price_soft"), p.hard_filters.get("price_max"))
    return price + hoa_penalty(_c("hoa_fee")) if p.mode != "rent" else price


def total_points(p: Profile, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum in criterion order, penalties off, not below zero.

    Criteria without weight add an exact zero and are left out of the expression.
    """
    weights = p.weights if weights is None else weights
    total = F.lit(0.0)
    for criterion in CRITERIA:
        weight = float(weights.get(criterion.key, 0) or 0)
        if weight:
            total = total + criterion.rounded(p) / F.lit(10.0) * F.lit(weight)
    price = price_penalty(_c("price"), p.soft_caps.get("price_soft"), p.hard_filters.get("price_max"))
    hoa = hoa_penalty(_c("hoa_fee")) if p.mode != "rent" else F.lit(0.0)
    return F.greatest(F.lit(0.0), total - price - hoa)


def score_pct(points: Column, total: float) -> Column:
    return points / F.lit(float(total if total > 0 else 1.0)) * F.lit(100.0)


def percent_text(points: Column, total: float) -> Column:
    if total <= 0:
        return F.lit("0%")
    return F.concat(F.rint(points / F.lit(float(total)) * F.lit(100.0)).cast("bigint").cast("string"), F.lit("%"))


# --- P16 ---------------------------------------------------------------------
# Tier name -> ((lowest score, label), ...), the last label is the rest.  Fixed values.
TIERS = {
    "score": ((80, "Exceptional"), (70, "Strong"), (60, "Interesting"), (None, "Pass")),
    "light": ((75, "Excellent"), (55, "Good"), (35, "Moderate"), (None, "Limited")),
    "quiet": ((80, "Very Quiet"), (60, "Quiet"), (40, "Moderate"), (20, "Noisy"), (None, "Very Noisy")),
    "visual": ((85, "Stunning"), (70, "Very Appealing"), (55, "Average"), (40, "Below Average"), (None, "Needs Work")),
    "ui": ((80, "excellent"), (60, "good"), (40, "fair"), (None, "low")),
}


def tier(col: Column, kind: str = "score") -> Column:
    chain = F.when(col.isNull(), F.lit("Unknown" if kind == "visual" else None).cast("string"))
    for lowest, label in TIERS[kind]:
        chain = chain.otherwise(F.lit(label)) if lowest is None else chain.when(col >= lowest, label)
    return chain
