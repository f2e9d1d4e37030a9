"""Scores of listings for profiles that are rows, many pairs at a time.

Rows of profiles and listings that share a group come together, the profiles first; they are held, a
bounded number, and listings stream by in batches.  Limits are tested for whole blocks of profiles x
listings, and only pairs that meet them are scored.  The rules are those of ``functions.scoring``,
operation by operation in double precision, so points are equal to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from nestrank.functions import scoring as SC
from nestrank.operators import signals as SG

POSITIVE, NEGATIVE, DOORMAN = "positive", "negative", "_doorman"
# What scoring asks of a profile, by place: groups whose hits it counts, multipliers, conditions.
GROUPS = (
    *[(POSITIVE, g) for g in SG._READ_POSITIVE], *[(NEGATIVE, g) for g in SG._READ_NEGATIVE], (POSITIVE, DOORMAN),
)
MULTIPLIERS = (
    *[(POSITIVE, g) for g in ("light", "outdoor", "character", "quality", "kitchen", "pet", "gym", "building_quality")],
    *[(NEGATIVE, g) for g in SG._READ_NEGATIVE],
)
CONDITIONS = ("adjacent_to_bar", "on_major_thoroughfare", "first_floor_busy_street")
# Criteria that read nothing of a profile.
OWN = (
    "office_space", "high_ceilings", "layout_intelligence", "views", "in_unit_laundry", "parking", "central_hvac", "gas_stove",
    "dishwasher", "storage",
)
CELLS = 1 << 18  # pairs tested at once
ENTRIES = 1 << 22  # of the table of hits of some listings, about


def _hit(count: np.ndarray) -> np.ndarray:
    return np.minimum(10.0, count * 2.5)


def _least(a, b) -> np.ndarray:
    return np.fmin(a, b)  # as in SQL, not-a-number is the greatest


def _factor(cond: np.ndarray, value: np.ndarray | float) -> np.ndarray:
    return np.where(cond, value, 1.0)


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.rint(score * 100.0) / 100.0


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a numeric column as doubles, and which of them are null."""
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


def _square(column: pa.Array, width: int) -> pa.Array:
    flat = column.flatten()
    assert len(flat) == width * len(column)
    return flat


def _codes(known: dict, values: list) -> np.ndarray:
    """Numbers of values; those that are null or not known get the one after the last."""
    return np.array([known.get(v, len(known)) for v in values], dtype=np.int64)


def _padded(lists: list, known: dict, keep_unknown: bool = False) -> np.ndarray:
    """Numbers of the values of each list in a row, filled up with the number of no value."""
    rows = [[known[v] for v in x if v in known] for x in lists]
    out = np.full((len(rows), max(map(len, rows), default=0)), len(known), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class _Profiles:
    """Held profiles of one group as arrays."""

    def __init__(self, rows: pa.StructArray):
        def field(name: str) -> pa.Array:
            return rows.field(name)

        self.name, n = field("profile_id"), len(rows)
        self.limits = {c: _doubles(field(c)) for c in ("_price_max", "_beds_min", "_baths_min", "_sqft_min", "_price_soft")}
        self.total, self.rent = _doubles(field("_total"))[0], np.array(field("_mode").to_pylist()) == "rent"
        self.mults = _doubles(_square(field("_mults"), len(MULTIPLIERS)))[0].reshape(n, -1)
        self.factors = _doubles(_square(field("_factors"), len(SC.CRITERIA)))[0].reshape(n, -1)
        self.asked = _flags(_square(field("_asked"), len(CONDITIONS))).reshape(n, -1)
        gids, positive = _square(field("_groups"), len(GROUPS)).to_pylist(), field("_positive").to_pylist()
        self.gids = {g: i for i, g in enumerate(dict.fromkeys([*gids, *(g for x in positive for g in x)])) if g is not None}
        self.gids = {g: i for i, g in enumerate(self.gids)}
        self.groups = _codes(self.gids, gids).reshape(n, -1)
        self.positive = _padded(positive, self.gids)
        times = {kind: [dict(x) for x in field(f"{kind}_times").to_pylist()] for kind in ("_boost", "_penalize")}
        self.streets = {s: i for i, s in enumerate(dict.fromkeys(s for x in times.values() for d in x for s in d))}
        self.times = {}
        for kind, dicts in times.items():
            table = np.zeros((n, len(self.streets) + 1), np.int32)
            for i, d in enumerate(dicts):
                for s, count in d.items():
                    table[i, self.streets[s]] = count
            self.times[kind] = table, _doubles(field(f"{kind}_blank"))[0]


class _Listings:
    """A few listings as arrays, with what scoring takes from them alone."""

    def __init__(self, rows: pa.StructArray, of: _Profiles):
        def field(name: str) -> pa.Array:
            return rows.field(name)

        def flag(name: str) -> np.ndarray:
            return _flags(field(name))

        n = len(rows)
        self.name = field("id")
        self.values = {c: _doubles(field(c)) for c in ("price", "beds", "baths", "sqft")}
        own = _doubles(_square(field("_own"), len(OWN)))[0].reshape(n, -1)
        self.own = {key: own[:, i] for i, key in enumerate(OWN)}
        light, bright, quiet, visual, built = (
            _doubles(field(c)) for c in ("_light", "_bright", "_quiet", "visual_quality_score", "year_built")
        )
        self.light, self.bright = (np.where(null, 0.0, v / 10.0) for v, null in (light, bright))
        self.light_parts = 1.0 + ~light[1] + ~bright[1]
        self.flags = {c: flag(f"_f_{c}") for c in (
            "outdoor_space", "architectural_details", "busy_street", "pet_friendly", "no_pets", "gym_fitness",
        )}
        self.rules = {c: flag(f"_r_{c}") for c in ("nightlife", "low_floor", "full_time", "part_time", "negated", "no_parking")}
        year, no_year = built
        no_year = no_year | (year == 0)
        self.age = np.where(no_year, 0.0, np.where(year <= 1940, 2.0, np.where(year <= 1960, 1.0, 0.0)))
        calm = _least(10.0, np.where(quiet[1], 5.0, quiet[0] / 10.0))
        self.quiet = np.maximum(0.0, calm - np.where(self.flags["busy_street"], 3.0, 0.0))
        flow, layout, move_in = (_doubles(field(f"_k_c_{c}"))[0] for c in ("flow", "layout", "move_in"))
        self.flow, self.may_flow = _hit(flow), (flow <= 0) & (layout > 0)
        unseen = visual[1] | (visual[0] == 0)
        seen = np.where(unseen, 0.0, visual[0] / 10.0)
        self.move_in = np.maximum(_hit(move_in), _least(10.0, seen))
        sound = flag("_f_building_quality")
        self.building = np.where(sound, np.where(unseen, 7.0, (7.0 + seen) / 2.0), seen)
        self.doorman = np.where(flag("_f_doorman_concierge"), 8.0, 0.0)
        fee, no_fee = _doubles(field("hoa_fee"))
        self.fee = np.where(no_fee | (fee <= 800), 0.0, np.where(fee <= 1000, 5.0, 10.0))
        self.thin, self.blank = flag("_thin"), flag("_blank")
        # hits of each listing by the number of the group; the last column is of no group
        counts = field("_counts")
        self.counts = np.zeros((n, len(of.gids) + 1), np.int32)
        at = np.repeat(np.arange(n), np.diff(counts.offsets.to_numpy()))
        first, last = counts.offsets[0].as_py(), counts.offsets[-1].as_py()
        code = _codes(of.gids, counts.keys[first:last].to_pylist())
        self.counts[at, code] = _doubles(counts.items[first:last])[0]
        self.counts[:, -1] = 0
        self.streets = _padded(field("_found_streets").to_pylist(), of.streets)


def _met(p: _Profiles, some: slice, x: _Listings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (profile, listing) that meet the limits of the profile."""
    price, no_price = x.values["price"]
    high, no_high = (v[some, None] for v in p.limits["_price_max"])
    met = no_high | (~no_price & (price <= high))
    for column, limit in (("beds", "_beds_min"), ("baths", "_baths_min"), ("sqft", "_sqft_min")):
        v, unknown = x.values[column]
        low, none = (a[some, None] for a in p.limits[limit])
        above = (v >= low) | np.isnan(v)
        met &= none | (unknown | above if column == "sqft" else ~unknown & above)
    return np.nonzero(met)


def _scored(p: _Profiles, x: _Listings, pi: np.ndarray, li: np.ndarray) -> pa.RecordBatch:
    """(profile_id, id, points, percent) of pairs, without those that a signal takes out."""
    def count(polarity: str, grp: str) -> np.ndarray:
        return x.counts[li, p.groups[pi, GROUPS.index((polarity, grp))]]

    rent, lit, pets_out = p.rent[pi], count(POSITIVE, "light"), count(NEGATIVE, "no_pets")
    clean = (lit > 0) | (count(NEGATIVE, "dark") == 0)
    clean &= np.where(rent, ~(x.flags["no_pets"][li] | (pets_out > 0)), ~x.rules["no_parking"][li])
    pi, li, rent, lit, pets_out = (a[clean] for a in (pi, li, rent, lit, pets_out))

    def mult(polarity: str, grp: str) -> np.ndarray:
        return p.mults[pi, MULTIPLIERS.index((polarity, grp))]

    def flag(name: str) -> np.ndarray:
        return x.flags[name][li]

    def rule(name: str) -> np.ndarray:
        return x.rules[name][li]

    def streets(kind: str) -> np.ndarray:
        table, found = p.times[kind][0], p.times[kind][1][pi]
        for k in range(x.streets.shape[1]):
            found = found + table[pi, x.streets[li, k]]
        return found

    scores = {}
    light = _hit(lit) + x.light[li] + x.bright[li]
    scores["natural_light"] = _least(10.0, light / x.light_parts[li] * mult(POSITIVE, "light"))

    general, private, premium = (count(POSITIVE, g) for g in ("outdoor", "outdoor_private", "outdoor_premium"))
    told = flag("outdoor_space")
    outdoor = np.where((general > 0) | (private > 0) | (premium > 0) | told, 5.5 + np.minimum(2.0, general * 0.5), 0.0)
    outdoor = np.where(told, np.maximum(outdoor, 6.0), outdoor)
    outdoor = np.where(private > 0, np.maximum(outdoor, 7.0), outdoor) + np.minimum(1.0, private * 0.4)
    outdoor = np.where(premium > 0, np.maximum(outdoor, 8.5), outdoor) + np.minimum(1.0, premium * 0.35)
    outdoor = _least(10.0, outdoor * mult(POSITIVE, "outdoor"))
    weak = count(NEGATIVE, "weak_outdoor") > 0
    outdoor = np.where(weak, _least(outdoor * mult(NEGATIVE, "weak_outdoor"), 6.5), outdoor)
    outdoor = np.maximum(0.0, _least(10.0, outdoor))
    scores["outdoor_space"] = outdoor

    flipped = count(NEGATIVE, "flipper") > 0
    if flipped.any():
        of = np.flatnonzero(flipped & x.thin[li] & ~x.blank[li])
        touched = np.zeros(len(pi), np.int64)
        for k in range(p.positive.shape[1]):
            touched[of] += x.counts[li[of], p.positive[pi[of], k]] > 0
        flipped &= x.blank[li] | (x.thin[li] & (touched < 2))
    quality = count(POSITIVE, "quality")
    soul = _hit(count(POSITIVE, "character") + quality)
    soul = np.where(flag("architectural_details"), np.maximum(soul, 7.0), soul)
    soul = _least(10.0, _least(10.0, soul + x.age[li]) * mult(POSITIVE, "character"))
    soul = _least(10.0, soul * _factor(quality > 0, mult(POSITIVE, "quality")))
    scores["character_soul"] = soul * _factor(flipped, mult(NEGATIVE, "flipper"))

    scores["kitchen_quality"] = _least(10.0, _hit(count(POSITIVE, "kitchen")) * mult(POSITIVE, "kitchen"))

    noise = count(NEGATIVE, "location_noise") > 0
    good, bad = streets("_boost"), streets("_penalize")
    exposed = flag("busy_street") | (bad > 0)
    asked = p.asked[pi]
    moved = good * 1.5 - bad * 1.5 - np.where(asked[:, 0] & (noise | rule("nightlife")), 1.5, 0.0)
    moved = moved - np.where(asked[:, 1] & exposed, 1.5, 0.0) - np.where(asked[:, 2] & exposed & rule("low_floor"), 1.0, 0.0)
    quiet = x.quiet[li] * _factor(noise, mult(NEGATIVE, "location_noise"))
    scores["location_quiet"] = np.maximum(0.0, _least(10.0, quiet + moved))

    scores["indoor_outdoor_flow"] = np.where(x.may_flow[li] & (outdoor >= 6), 6.5, x.flow[li])
    scores["move_in_ready"] = x.move_in[li] * _factor(flipped, 0.8) * _factor(
        count(NEGATIVE, "condition") > 0, mult(NEGATIVE, "condition")
    )
    pet = np.where(flag("pet_friendly"), 10.0, _hit(count(POSITIVE, "pet")))
    scores["pet_friendly"] = _least(10.0, pet * mult(POSITIVE, "pet")) * _factor(pets_out > 0, mult(NEGATIVE, "no_pets"))
    gym = np.where(flag("gym_fitness"), 10.0, _hit(count(POSITIVE, "gym")))
    scores["gym_fitness"] = _least(10.0, gym * mult(POSITIVE, "gym"))
    building = _least(10.0, x.building[li] * mult(POSITIVE, "building_quality"))
    scores["building_quality"] = building * _factor(
        count(NEGATIVE, "gross_highrise") > 0, mult(NEGATIVE, "gross_highrise")
    )
    door = np.maximum(x.doorman[li], _hit(count(POSITIVE, DOORMAN)))
    door = np.where(rule("part_time"), np.maximum(door, 6.0), door)
    scores["doorman_concierge"] = np.where(rule("negated"), 0.0, np.where(rule("full_time"), 10.0, door))

    points = np.zeros(len(pi))
    for j, criterion in enumerate(SC.CRITERIA):  # criterion order, as in the single-profile sum
        own = x.own.get(criterion.key)
        tenth = _rounded(scores[criterion.key]) / 10.0 if own is None else own[li]
        points += tenth * p.factors[pi, j]

    price, no_price = (a[li] for a in x.values["price"])
    (soft, no_soft), (high, no_high) = ((a[pi] for a in p.limits[c]) for c in ("_price_soft", "_price_max"))
    hard = np.where(no_high | (high == 0), soft, high)
    with np.errstate(divide="ignore", invalid="ignore"):
        ramp = np.where(hard > soft, 10.0 * ((price - soft) / (hard - soft)), 10.0)
    off = np.where(no_soft | no_price | (price <= soft), 0.0, np.where((price >= hard) | np.isnan(price), 10.0, ramp))
    points = np.maximum(0.0, points - off - np.where(rent, 0.0, x.fee[li]))
    percent = points / p.total[pi] * 100.0
    return pa.RecordBatch.from_arrays(
        [p.name.take(pa.array(pi)), x.name.take(pa.array(li)), pa.array(points), pa.array(percent)], ["profile_id", "id", "points", "percent"]
    )


def score_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored pairs of rows (_group, _side, _profile, _listing), which come by group, profiles first."""
    group, rows, held = None, [], None
    for batch in batches:
        names, sides = np.array(batch.column("_group").to_pylist(), dtype=object), batch.column("_side").to_numpy()
        cuts = np.flatnonzero((names[1:] != names[:-1]) | (sides[1:] != sides[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if low == high:
                continue
            if names[low] != group:
                group, rows, held = names[low], [], None
            if not sides[low]:
                rows.append(batch.column("_profile").slice(low, high - low))
                continue
            if not rows:
                continue
            held = held or _Profiles(pa.concat_arrays(rows))
            listings, step = batch.column("_listing").slice(low, high - low), max(64, ENTRIES // (len(held.gids) + 1))
            for start in range(0, len(listings), step):
                some = _Listings(pa.concat_arrays([listings.slice(start, step)]), held)
                of = max(1, CELLS // len(some.name))
                for first in range(0, len(held.name), of):
                    pi, li = _met(held, slice(first, first + of), some)
                    if len(pi):
                        yield _scored(held, some, pi + first, li)
