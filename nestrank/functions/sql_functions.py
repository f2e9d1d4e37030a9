"""Scalar functions for SQL users: ``register(spark)``, then plain ``SELECT`` without Python.

They are SQL functions of the session, so their bodies are inlined into the query and optimized with
it; nothing runs in Python, and an argument is computed once whatever the body does with it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import SparkSession

from nestrank.functions import geo
from nestrank.functions import lexicon as LX
from nestrank.functions.text import QUALITY_RULES, quoted

# Cost bands of a distance: (below metres, points), nearest first.  Fixed values.
STREET_BANDS = ((30, 35), (75, 25), (150, 15), (300, 8))
FREEWAY_BANDS = ((100, 40), (200, 30), (300, 20), (500, 10))
FIRE_BANDS = ((150, 10), (300, 5))


def _holds(text: str, terms: Sequence[str]) -> str:
    """A lambda over one folded list: written out, the tests of all groups outgrow a generated method."""
    return f"exists(array({', '.join(map(quoted, LX.deciding_terms(terms)))}), k -> contains({text}, k))"


def _quality(text: str) -> str:
    """Weighted groups, plus 2 for a good and minus 5 for a bad sentiment group, as a percentage."""
    parts = []
    for name, terms in QUALITY_RULES.items():
        points = 2 if name.startswith("good_") else -5 if name.startswith("bad_") else LX.QUALITY_WEIGHTS.get(name, 1)
        parts.append(f"IF({_holds(text, terms)}, {float(points)!r}D, 0D)")
    best = float(sum(LX.QUALITY_WEIGHTS.values()) + 2 * len(LX.POSITIVE_GROUPS))
    share = f"greatest(0D, least(100D, ({' + '.join(parts)}) / {best!r}D * 100D))"
    return f"CASE WHEN {text} = '' THEN 0D ELSE {share} END"


def _member(layer: str, metres: float) -> str:
    """Nearest member of a layer around (lat, lon), in the layer's city.  The segments are one folded
    list under a lambda, so the function stays small wherever it is inlined."""
    whens = []
    for city in geo.LAYERS:
        rows = ", ".join(
            f"named_struct('ord', {ord_}, 'name', {quoted(name)}, 'severity', {float(severity)!r}D, 'a', {a!r}D, 'b', {b!r}D, 'c', {c!r}D, 'd', {d!r}D)"
            for ord_, name, severity, a, b, c, d in geo.layer_segments(city, layer)
        )
        whens.append(f"WHEN city = {quoted(city)} THEN array({rows})")
    reach = metres * 1.1 / 110_000.0
    wide = f"{reach!r}D / cos(radians(abs(lat) + 1D))"
    near = (
        f"lat BETWEEN least(s.a, s.c) - {reach!r}D AND greatest(s.a, s.c) + {reach!r}D AND "
        f"lon BETWEEN least(s.b, s.d) - {wide} AND greatest(s.b, s.d) + {wide}"
    )
    along = (
        "coalesce(greatest(0D, least(1D, ((lon - s.b) * (s.d - s.b) + (lat - s.a) * (s.c - s.a)) / "
        "nullif((s.d - s.b) * (s.d - s.b) + (s.c - s.a) * (s.c - s.a), 0D))), 0D)"
    )
    half_lat, half_lon = f"sin(radians(s.a + {along} * (s.c - s.a) - lat) / 2)", f"sin(radians(s.b + {along} * (s.d - s.b) - lon) / 2)"
    inner = f"{half_lat} * {half_lat} + cos(radians(lat)) * cos(radians(s.a + {along} * (s.c - s.a))) * ({half_lon} * {half_lon})"
    return (
        f"array_min(transform(filter(CASE {' '.join(whens)} END, s -> {near}), "
        f"s -> named_struct('inner', {inner}, 'ord', s.ord, 'name', s.name, 'severity', s.severity)))"
    )


def _cost(member: str, bands: Sequence[tuple[int, int]]) -> str:
    """Points of the band that the member's distance falls into, on the square it is computed from."""
    def limit(metres: int) -> float:
        return math.sin(metres / geo.EARTH_RADIUS_M / 2.0) ** 2

    return "CASE " + " ".join(f"WHEN {member}.inner < {limit(below)!r}D THEN {points}D" for below, points in bands) + " ELSE 0D END"


def _city() -> str:
    whens = " ".join(
        f"WHEN lat BETWEEN {a!r}D AND {b!r}D AND lon BETWEEN {c!r}D AND {d!r}D THEN {quoted(city)}"
        for city, (a, b, c, d) in geo.COVERAGE.items()
    )
    return f"CASE {whens} END"


def bodies(prefix: str) -> dict[str, tuple[str, str, str]]:
    """Function name -> (parameters, type, body), each after those that it calls."""
    half = "pow(sin(radians({b} - {a}) / 2), 2)"
    a = f"({half.format(a='lat1', b='lat2')} + cos(radians(lat1)) * cos(radians(lat2)) * {half.format(a='lon1', b='lon2')})"
    member = "STRUCT<inner: DOUBLE, ord: INT, name: STRING, severity: DOUBLE>"
    place = "lat DOUBLE, lon DOUBLE"
    near = {layer: f"{prefix}near_{layer}" for layer in geo.REACH_M}
    found = ", ".join(f"{name}(lat, lon, {prefix}city(lat, lon))" for name in near.values())
    return {
        f"{prefix}haversine_m": (
            "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
            f"{geo.EARTH_RADIUS_M!r}D * 2D * atan2(sqrt({a}), sqrt(1D - {a}))",
        ),
        f"{prefix}text_quality_of": ("t STRING", "DOUBLE", _quality("t")),
        f"{prefix}text_quality": ("body STRING", "DOUBLE", f"{prefix}text_quality_of(lower(coalesce(body, '')))"),
        f"{prefix}city": (place, "STRING", _city()),
        **{name: (f"{place}, city STRING", member, _member(layer, geo.REACH_M[layer])) for layer, name in near.items()},
        f"{prefix}quiet_points": (
            f"street {member}, freeway {member}, fire {member}", "INT",
            "CAST(greatest(0D, least(100D, rint(100D - "
            f"{_cost('street', STREET_BANDS)} * coalesce(street.severity, 0D) - {_cost('freeway', FREEWAY_BANDS)} - {_cost('fire', FIRE_BANDS)}"
            "))) AS INT)",
        ),
        f"{prefix}tranquility": (
            place, "INT",
            f"CASE WHEN lat IS NULL OR lon IS NULL THEN 50 WHEN {prefix}city(lat, lon) IS NOT NULL THEN {prefix}quiet_points({found}) END",
        ),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions for this session and return their names.

    ``haversine_m(lat1, lon1, lat2, lon2)`` metres between two places, ``text_quality(body)`` 0-100,
    ``tranquility(lat, lon)`` 0-100 (50 without a place, NULL outside coverage); the others are parts.
    """
    found = bodies(prefix)
    for name, (parameters, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(found)
