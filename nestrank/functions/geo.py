"""Distances, noise layers and neighbourhood boxes as Column algebra.

The layers are a few dozen segments, so they are literal arrays inside the
expression: no join, no shuffle.  ``operators.spatial`` has the grid join for layers
that are tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestrank.functions.text import let, quoted

EARTH_RADIUS_M = 6371000.0

# --- fixed values: coverage boxes (lat_min, lat_max, lon_min, lon_max) -------
COVERAGE = {
    "sf": (37.707, 37.83, -122.515, -122.355),
    "nyc": (40.62, 40.80, -74.05, -73.90),
}

# --- fixed values: noise layers, (name, severity, [(lat, lon), ...]) ---------
LAYERS = {
    "sf": {
        "street": [
            ("Van Ness Ave", 0.9, [(37.7949, -122.4217), (37.7549, -122.4217)]),
            ("Geary Blvd", 0.85, [(37.7852, -122.5034), (37.7852, -122.4034)]),
            ("19th Avenue", 0.85, [(37.7815, -122.4759), (37.7215, -122.4759)]),
            ("Mission Street", 0.75, [(37.7649, -122.4198), (37.7849, -122.4048)]),
            ("Market Street", 0.8, [(37.7879, -122.4074), (37.7649, -122.4352)]),
            ("Divisadero Street", 0.65, [(37.7849, -122.4399), (37.7449, -122.4399)]),
            ("Lombard Street (Marina)", 0.7, [(37.8005, -122.4185), (37.8005, -122.4485)]),
            ("Columbus Avenue", 0.65, [(37.7987, -122.4078), (37.8057, -122.4178)]),
            ("Folsom Street", 0.6, [(37.7799, -122.4058), (37.7639, -122.4198)]),
            ("Broadway", 0.7, [(37.7977, -122.4058), (37.7977, -122.4258)]),
        ],
        "freeway": [
            ("US-101 (Central)", 1.0, [(37.7749, -122.4094), (37.7649, -122.3994), (37.7549, -122.3894)]),
            ("I-280", 0.95, [(37.7349, -122.4094), (37.7249, -122.4194), (37.7149, -122.4294)]),
            ("I-80 (Bay Bridge approach)", 0.95, [(37.7879, -122.3894), (37.7879, -122.3794)]),
        ],
        "fire": [
            ("Station 1 (Embarcadero)", 1.0, [(37.7949, -122.3934)]),
            ("Station 2 (Chinatown)", 1.0, [(37.7949, -122.4084)]),
            ("Station 3 (Marina)", 1.0, [(37.8004, -122.4354)]),
            ("Station 7 (Mission)", 1.0, [(37.7629, -122.4154)]),
            ("Station 10 (Potrero)", 1.0, [(37.7579, -122.3994)]),
            ("Station 13 (SOMA)", 1.0, [(37.7829, -122.4034)]),
            ("Station 36 (Castro)", 1.0, [(37.7619, -122.4354)]),
            ("Station 38 (Noe Valley)", 1.0, [(37.7519, -122.4324)]),
        ],
    },
    "nyc": {
        "street": [
            ("Broadway (Manhattan)", 0.85, [(40.7061, -74.0131), (40.7580, -73.9855), (40.7831, -73.9712)]),
            ("Canal Street", 0.9, [(40.7195, -74.0066), (40.7166, -73.9982), (40.7149, -73.9909)]),
            ("Houston Street", 0.8, [(40.7268, -74.0078), (40.7227, -73.9952), (40.7209, -73.9828)]),
            ("Bowery", 0.75, [(40.7149, -73.9974), (40.7242, -73.9927), (40.7316, -73.9892)]),
            ("Delancey Street", 0.85, [(40.7188, -73.9989), (40.7178, -73.9878), (40.7148, -73.9778)]),
            ("Flatbush Avenue", 0.8, [(40.6905, -73.9764), (40.6832, -73.9773), (40.6705, -73.9631)]),
            ("Atlantic Avenue (Brooklyn)", 0.75, [(40.6863, -73.9781), (40.6848, -73.9685), (40.6822, -73.9549)]),
            ("4th Avenue (Brooklyn)", 0.7, [(40.6863, -73.9781), (40.6746, -73.9831), (40.6656, -73.9880)]),
        ],
        "freeway": [
            ("BQE (Brooklyn-Queens Expressway)", 1.0, [(40.6891, -73.9979), (40.6938, -73.9923), (40.6996, -73.9862), (40.7024, -73.9847)]),
            ("FDR Drive", 0.95, [(40.7096, -73.9752), (40.7210, -73.9740), (40.7350, -73.9730), (40.7550, -73.9660)]),
        ],
        "fire": [
            ("FDNY Engine 205/Ladder 118 (DUMBO)", 1.0, [(40.6988, -73.9872)]),
            ("FDNY Engine 224 (Brooklyn Heights)", 1.0, [(40.6933, -73.9930)]),
            ("FDNY Engine 229 (Williamsburg)", 1.0, [(40.7114, -73.9572)]),
            ("FDNY Engine 207/Ladder 110 (Fort Greene)", 1.0, [(40.6898, -73.9753)]),
            ("FDNY Engine 33/Ladder 9 (East Village)", 1.0, [(40.7274, -73.9876)]),
            ("FDNY Engine 55 (SoHo)", 1.0, [(40.7230, -73.9985)]),
            ("FDNY Engine 24/Ladder 5 (Chelsea)", 1.0, [(40.7395, -73.9998)]),
            ("FDNY Engine 14 (East Village/Gramercy)", 1.0, [(40.7322, -73.9859)]),
        ],
    },
}

# --- fixed values: neighbourhood boxes, in lookup order ----------------------
# (name, lat_min, lat_max, lon_min, lon_max, aliases)
HOOD_BOXES = [
    ("Dolores Heights", 37.7540, 37.7665, -122.4385, -122.4245, ("dolores heights", "dolores")),
    ("Potrero Hill", 37.7480, 37.7665, -122.4165, -122.3890, ("potrero hill", "potrero", "portrero")),
    ("Cole Valley", 37.7600, 37.7725, -122.4565, -122.4450, ("cole valley", "cole")),
    ("Haight-Ashbury", 37.7660, 37.7785, -122.4525, -122.4320, ("haight-ashbury", "haight ashbury", "haight")),
    ("NoPa", 37.7720, 37.7825, -122.4470, -122.4270, ("nopa", "no pa", "north of panhandle", "north panhandle")),
]
GENERIC_HOODS = (
    "san francisco", "sf", "san-francisco", "san francisco ca", "new york",
    "new york city", "nyc", "brooklyn", "manhattan", "queens", "bronx",
    "staten island",
)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * (F.sin(half_dlon) * F.sin(half_dlon))
    return F.lit(EARTH_RADIUS_M) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a segment, projected in raw degrees; a point segment is a point."""
    sx, sy = lon2 - lon1, lat2 - lat1
    length_sq = sx * sx + sy * sy
    along = F.coalesce(
        F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), ((lon - lon1) * sx + (lat - lat1) * sy) / F.nullif(length_sq, F.lit(0.0))),
        ),
        F.lit(0.0),
    )
    return let(along, lambda t: haversine_m(lat, lon, lat1 + t * sy, lon1 + t * sx))


def polyline_m(lat: Column, lon: Column, segments: Column) -> Column:
    """Smallest distance to an array of segments; infinite when there is none."""
    return F.coalesce(
        F.array_min(
            F.transform(segments, lambda s: segment_m(lat, lon, s.lat1, s.lon1, s.lat2, s.lon2))
        ),
        F.lit(float("inf")),
    )


def layer_segments(city: str, layer: str) -> list[tuple[int, str, float, float, float, float, float]]:
    """(ord, name, severity, lat1, lon1, lat2, lon2) of every segment of a layer."""
    rows = []
    for ord_, (name, severity, points) in enumerate(LAYERS[city][layer]):
        pairs = list(zip(points, points[1:])) or [(points[0], points[0])]
        for (lat1, lon1), (lat2, lon2) in pairs:
            rows.append((ord_, name, severity, lat1, lon1, lat2, lon2))
    return rows


def layer_array(city: str, layer: str) -> Column:
    names = ("lat1", "lon1", "lat2", "lon2")
    rows = [
        "named_struct('ord', %d, 'name', %s, 'severity', %rD, " % (o, quoted(name), float(severity))
        + ", ".join(f"'{n}', {v!r}D" for n, v in zip(names, ends)) + ")"
        for o, name, severity, *ends in layer_segments(city, layer)
    ]
    return F.expr(f"array({', '.join(rows)})")


def coverage(lat: Column, lon: Column) -> Column:
    """'sf', 'nyc' or NULL outside both."""
    chain = None
    for city, (lat_min, lat_max, lon_min, lon_max) in COVERAGE.items():
        inside = lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)
        chain = F.when(inside, city) if chain is None else chain.when(inside, city)
    return chain


def _inner(lat: str, lon: str, segment: tuple) -> str:
    """Haversine term of the distance to one literal segment: grows with the distance."""
    _, _, _, lat1, lon1, lat2, lon2 = segment
    sy, sx = lat2 - lat1, lon2 - lon1
    length_sq = sx * sx + sy * sy
    to_lat, to_lon = f"{lat1!r}D", f"{lon1!r}D"
    if length_sq:
        along = (
            f"greatest(0D, least(1D, (({lon} - {lon1!r}D) * {sx!r}D + ({lat} - {lat1!r}D) * {sy!r}D) / {length_sq!r}D))"
        )
        to_lat, to_lon = f"({to_lat} + {along} * {sy!r}D)", f"({to_lon} + {along} * {sx!r}D)"
    half_dlat, half_dlon = f"sin(radians({to_lat} - {lat}) / 2)", f"sin(radians({to_lon} - {lon}) / 2)"
    return (
        f"({half_dlat} * {half_dlat} + cos(radians({lat})) * cos(radians({to_lat})) * ({half_dlon} * {half_dlon}))"
    )


def _around(lat: str, lon: str, segment: tuple, metres: float) -> str:
    """Cheap test that holds for every point within ``metres`` of the segment."""
    _, _, _, lat1, lon1, lat2, lon2 = segment
    dlat = metres / 110_000.0
    dlon = metres / (110_000.0 * math.cos(math.radians(max(abs(lat1), abs(lat2)) + 1.0)))
    return (
        f"{lat} BETWEEN {min(lat1, lat2) - dlat!r}D AND {max(lat1, lat2) + dlat!r}D AND "
        f"{lon} BETWEEN {min(lon1, lon2) - dlon!r}D AND {max(lon1, lon2) + dlon!r}D"
    )


def _metres(inner: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * (F.lit(2.0) * F.atan2(F.sqrt(inner), F.sqrt(F.lit(1.0) - inner)))


def _best_member(lat: str, lon: str, segments: list[tuple], within: float | None) -> str:
    entries = []
    for segment in segments:
        ord_, name, severity = segment[:3]
        entry = (
            f"named_struct('inner', {_inner(lat, lon, segment)}, 'ord', {ord_}, 'name', {quoted(name)}, "
            f"'severity', {float(severity)!r}D)"
        )
        entries.append(f"CASE WHEN {_around(lat, lon, segment, within)} THEN {entry} END" if within else entry)
    return f"least({', '.join(entries)})" if len(entries) > 1 else entries[0]


def nearest_member(city: Column, lat: str, lon: str, layer: str, within: float | None = None) -> Column:
    """Nearest member of the layer of the row's city, not yet in metres; see ``measured``.

    ``lat`` and ``lon`` name columns.  Ties go to the earlier member.  The segments are
    unrolled into generated code: for layers of this size that is far faster than a
    lambda over an array, and no lambda is around them, which would leave generated code.
    With ``within`` only members around the point are measured, and a point with none
    gets NULL.
    """
    chain = None
    for name in LAYERS:
        best = F.expr(_best_member(lat, lon, layer_segments(name, layer), within))
        chain = F.when(city == name, best) if chain is None else chain.when(city == name, best)
    return chain


def measured(member: Column) -> Column:
    """struct(distance_m, name, severity) of a ``nearest_member``, best a staged column."""
    return F.when(
        member.isNotNull(),
        F.struct(
            _metres(member.inner).alias("distance_m"), member["name"].alias("name"), member.severity.alias("severity")
        ),
    )


def nearest_in_city(city: Column, lat: str, lon: str, layer: str, within: float | None = None) -> Column:
    """``measured(nearest_member)`` as one expression, where there is no place to stage it."""
    return let(nearest_member(city, lat, lon, layer, within), measured)


# No band of the score reaches further than this.
REACH_M = {"street": 300.0, "freeway": 500.0, "fire": 300.0}


def tranquility_of(city: Column, lat: str, lon: str) -> Column:
    """Score of a point from the layers within reach; NULL outside coverage.

    Beyond the reach a layer costs nothing, so far members need no trigonometry; the
    margin of the cheap test keeps every member that could count.
    """
    near = [nearest_member(city, lat, lon, layer, reach * 1.1) for layer, reach in REACH_M.items()]
    points = let(
        F.struct(*[member.alias(layer) for member, layer in zip(near, REACH_M)]),
        lambda s: tranquility_points(*[measured(s[layer]) for layer in REACH_M]),
    )
    return F.when(city.isNotNull(), points)


def tranquility_points(street: Column, freeway: Column, fire: Column) -> Column:
    """0-100 from the three nearest-member structs."""
    def street_cost(s: Column) -> Column:
        band = (
            F.when(s.distance_m < 30, F.lit(35.0)).when(s.distance_m < 75, F.lit(25.0))
            .when(s.distance_m < 150, F.lit(15.0)).when(s.distance_m < 300, F.lit(8.0)).otherwise(F.lit(0.0))
        )
        return band * F.coalesce(s.severity, F.lit(0.0))

    def freeway_cost(s: Column) -> Column:
        return (
            F.when(s.distance_m < 100, F.lit(40.0)).when(s.distance_m < 200, F.lit(30.0))
            .when(s.distance_m < 300, F.lit(20.0)).when(s.distance_m < 500, F.lit(10.0)).otherwise(F.lit(0.0))
        )

    def fire_cost(s: Column) -> Column:
        return F.when(s.distance_m < 150, F.lit(10.0)).when(s.distance_m < 300, F.lit(5.0)).otherwise(F.lit(0.0))

    score = F.lit(100.0) - street_cost(street) - freeway_cost(freeway) - fire_cost(fire)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(score))).cast("int")


def tranquility_warnings(street: Column, freeway: Column, fire: Column) -> Column:
    s, w, f = street.distance_m, freeway.distance_m, fire.distance_m
    return F.filter(
        F.array(
            F.when(s < 30, F.concat(F.lit("On "), street["name"], F.lit(" (high traffic)")))
            .when(s < 75, F.concat(F.lit("Near "), street["name"])),
            F.when(w < 100, F.concat(F.lit("Adjacent to "), freeway["name"]))
            .when(w < 200, F.concat(F.lit("Very close to "), freeway["name"])),
            F.when(f < 150, F.concat(F.lit("Near "), fire["name"])),
        ),
        lambda x: x.isNotNull(),
    )


def normalize_hood(raw: Column) -> Column:
    """Canonical neighbourhood name: generic names are NULL, unknown ones are trimmed."""
    cleaned = F.lower(F.trim(raw))
    chain = F.when(raw.isNull() | (cleaned == "") | cleaned.isin(*GENERIC_HOODS), F.lit(None).cast("string"))
    for name, *_, aliases in HOOD_BOXES:
        test = cleaned == name.lower()
        for alias in aliases:
            test = test | F.contains(cleaned, F.lit(alias))
        chain = chain.when(test, F.lit(name))
    return chain.otherwise(F.trim(raw))


def normalize_hoods(names: Column) -> Column:
    """List form: first occurrences of the canonical names."""
    return F.array_distinct(F.filter(F.transform(names, normalize_hood), lambda x: x.isNotNull()))


def hood_from_point(lat: Column, lon: Column) -> Column:
    """Neighbourhood box holding the point; boxes overlap and the first one wins."""
    chain = None
    for name, lat_min, lat_max, lon_min, lon_max, _ in HOOD_BOXES:
        inside = lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain


def resolve_hood(raw: Column, lat: Column, lon: Column) -> Column:
    return F.coalesce(normalize_hood(raw), hood_from_point(lat, lon))


def near(lat: Column, lon: Column, layer: str, metres: float) -> Column:
    """Is any layer member closer than ``metres``?  Outside NYC the SF layer is used."""
    in_nyc = F.coalesce(coverage(lat, lon) == "nyc", F.lit(False))

    def closer(city: str) -> Column:
        return F.exists(
            layer_array(city, layer),
            lambda s: segment_m(lat, lon, s.lat1, s.lon1, s.lat2, s.lon2) < F.lit(metres),
        )

    return F.when(in_nyc, closer("nyc")).otherwise(closer("sf"))


def tile_of(col: Column, low: float, high: float, step: float) -> Column:
    """Index of the tile a coordinate falls in; the last tile is closed, outside is NULL."""
    last = max(0, math.ceil(round((high - low) / step, 9)) - 1)
    return F.when(
        col.between(low, high),
        F.least(F.floor((col - F.lit(low)) / F.lit(step)), F.lit(last)).cast("int"),
    )
