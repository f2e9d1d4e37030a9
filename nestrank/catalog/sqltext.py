"""Pieces of the checking SQL, stated from the rules and not from the Spark code."""

from __future__ import annotations

from nestrank import fixtures as FX
from nestrank.functions import geo
from nestrank.functions import lexicon as LX
from nestrank.schema import FLAG_COLUMNS
from nestrank.sources.profiles import Profile


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(terms) -> str:
    return "[" + ", ".join(q(t) for t in terms) + "]" if terms else "CAST([] AS VARCHAR[])"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")" if terms else "FALSE"


def hits(text: str, terms) -> str:
    return f"list_filter({lst(dict.fromkeys(terms))}, lambda k: contains({text}, k))"


def rnd(expr: str, digits: int) -> str:
    scale = f"{10**digits}e0"
    return f"(round_even(CAST(({expr}) AS DOUBLE) * {scale}, 0) / {scale})" if digits else f"round_even(CAST(({expr}) AS DOUBLE), 0)"


def num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


# raw listings, with photos
RAW = (
    "raw AS (SELECT *, list_transform(range(0, n_photos), lambda i: "
    "concat('https://img.example.com/', id, '/', i, '.jpg')) AS photos FROM ("
    + FX.select_sql(FX.LISTING_EXPRS, "orders") + "))"
)


def flag_exprs(t: str) -> dict[str, str]:
    out = {name: any_of(t, terms) for name, terms in LX.FLAG_GROUPS.items()}
    for name, terms in LX.DEAL_FLAGS.items():
        out[name] = f"CASE WHEN {any_of(t, terms)} THEN TRUE END"
    for name in ("north_facing_only", "basement_unit"):
        out[name] = any_of(t, LX.RED_FLAG_GROUPS[name])
    return out


LISTINGS = (
    RAW
    + ", low AS MATERIALIZED (SELECT *, lower(coalesce(description, '')) AS t FROM raw), fx AS MATERIALIZED (SELECT *, "
    + ", ".join(f"{e} AS {FLAG_COLUMNS[n]}" for n, e in flag_exprs("t").items())
    + " FROM low)"
)
OBS = "obs AS (" + FX.select_sql(FX.OBSERVATION_EXPRS, "lineitem") + ")"
FEEDBACK = (
    "fb_log AS (" + FX.select_sql(FX.FEEDBACK_EXPRS, "events") + "), fb AS (SELECT user_id, listing_id, "
    "arg_max(feedback_type, struct_pack(ts := ts, f := feedback_type)) AS feedback_type, max(ts) AS ts "
    "FROM fb_log GROUP BY 1, 2 HAVING arg_max(feedback_type, struct_pack(ts := ts, f := feedback_type)) <> 'delete')"
)
CRITERIA = "crit AS (" + FX.select_sql(FX.CRITERIA_EXPRS, "customer") + ")"
SCOUTS = "scouts AS (" + FX.select_sql(FX.SCOUT_EXPRS, "supplier") + ")"

ORDER = ", ".join(FX.OBSERVATION_ORDER)
EVENTS = (
    OBS
    + f""", lagged AS (SELECT *, row_number() OVER w AS rn, lag(price) OVER w AS p0, lag(listing_status) OVER w AS s0,
  lag(photos_hash) OVER w AS f0, lag(description_hash) OVER w AS d0 FROM obs WINDOW w AS (PARTITION BY listing_id ORDER BY {ORDER})),
moves AS (
  SELECT *, 'new_listing' AS event_type, 1 AS kind FROM lagged WHERE rn = 1
  UNION ALL SELECT *, CASE WHEN price < p0 THEN 'price_drop' ELSE 'price_increase' END, 1 FROM lagged WHERE rn > 1 AND price <> p0
  UNION ALL SELECT *, CASE WHEN listing_status = 'active' AND s0 IN ('pending', 'contingent', 'sold') THEN 'back_on_market' ELSE 'status_change' END, 2
    FROM lagged WHERE rn > 1 AND listing_status <> s0
  UNION ALL SELECT *, 'photo_change', 3 FROM lagged WHERE rn > 1 AND photos_hash <> f0
  UNION ALL SELECT *, 'description_change', 4 FROM lagged WHERE rn > 1 AND description_hash <> d0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY listing_id, {ORDER} ORDER BY kind) - 1 AS seq FROM moves),
ev AS (SELECT concat(listing_id, '-', epoch_us(observed_at) // 1000000, '-', line_no, '-', part_no, '-', supp_no, '-',
    CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), '-', seq) AS event_id,
  listing_id, event_type, observed_at AS created_at, seq, line_no, part_no, supp_no, price,
  CASE WHEN event_type LIKE 'price%' THEN p0 END AS old_price,
  CASE WHEN event_type LIKE 'price%' OR event_type = 'new_listing' THEN price END AS new_price,
  CASE kind WHEN 2 THEN s0 WHEN 3 THEN f0 WHEN 4 THEN d0 END AS old_text,
  CASE WHEN event_type = 'new_listing' THEN listing_status WHEN kind = 2 THEN listing_status WHEN kind = 3 THEN photos_hash WHEN kind = 4 THEN description_hash END AS new_text,
  CASE WHEN event_type LIKE 'price%' THEN abs(price - p0) END AS amount,
  CASE WHEN event_type = 'price_drop' AND p0 <> 0 THEN abs(price - p0) / p0 * 100 END AS percent FROM numbered)"""
)


# --- location -----------------------------------------------------------------
def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(6371000e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def layer_rows(layer: str) -> str:
    rows = [
        f"({q(city)}, {ord_}, {q(name)}, {num(sev)}, {num(a)}, {num(b)}, {num(c)}, {num(d)})"
        for city in geo.LAYERS
        for ord_, name, sev, a, b, c, d in geo.layer_segments(city, layer)
    ]
    return f"(VALUES {', '.join(rows)}) AS v(city, ord, name, severity, lat1, lon1, lat2, lon2)"


CITY = (
    "CASE WHEN lat BETWEEN 37.707 AND 37.83 AND lon BETWEEN -122.515 AND -122.355 THEN 'sf' "
    "WHEN lat BETWEEN 40.62 AND 40.80 AND lon BETWEEN -74.05 AND -73.90 THEN 'nyc' END"
)


def near_cte(layer: str, source: str, city: str = "c.city = v.city") -> str:
    """(id, dist, name, severity) of the nearest member per listing."""
    along = (
        "CASE WHEN (lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1) = 0 THEN 0e0 ELSE "
        "greatest(0e0, least(1e0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / "
        "((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)))) END"
    )
    dist = haversine("lat", "lon", "lat1 + k * (lat2 - lat1)", "lon1 + k * (lon2 - lon1)")
    return (
        f"near_{layer} AS (SELECT id, arg_min(struct_pack(dist := d, name := name, severity := severity), struct_pack(d := d, o := ord)) AS s "
        f"FROM (SELECT *, {dist} AS d FROM (SELECT c.id, c.lat, c.lon, v.* EXCLUDE (city), {along} AS k "
        f"FROM (SELECT id, lat, lon, {CITY} AS city FROM {source}) c JOIN {layer_rows(layer)} ON {city})) GROUP BY id)"
    )


STREET_COST = "CASE WHEN st.s.dist < 30 THEN 35e0 WHEN st.s.dist < 75 THEN 25e0 WHEN st.s.dist < 150 THEN 15e0 WHEN st.s.dist < 300 THEN 8e0 ELSE 0e0 END * st.s.severity"
FREEWAY_COST = "CASE WHEN fw.s.dist < 100 THEN 40 WHEN fw.s.dist < 200 THEN 30 WHEN fw.s.dist < 300 THEN 20 WHEN fw.s.dist < 500 THEN 10 ELSE 0 END"
FIRE_COST = "CASE WHEN fi.s.dist < 150 THEN 10 WHEN fi.s.dist < 300 THEN 5 ELSE 0 END"
QUIET = (
    "CASE WHEN st.id IS NOT NULL THEN CAST(greatest(0, least(100, round_even("
    f"100e0 - {STREET_COST} - {FREEWAY_COST} - {FIRE_COST}, 0))) AS INTEGER) END"
)
GEO = ", ".join(near_cte(layer, "fx") for layer in ("street", "freeway", "fire"))
GEO_JOIN = "LEFT JOIN near_street st USING (id) LEFT JOIN near_freeway fw USING (id) LEFT JOIN near_fire fi USING (id)"


def light(t: str = "t") -> str:
    pos, neg = f"len({hits(t, LX.LIGHT_POSITIVE)})", f"len({hits(t, LX.LIGHT_NEGATIVE)})"
    return (
        f"CAST(greatest(0, least(100, 50 + least(25, 5 * {pos}) - least(30, 10 * {neg})"
        " + CASE WHEN has_natural_light_keywords THEN 15 ELSE 0 END - CASE WHEN is_north_facing_only THEN 25 ELSE 0 END"
        f" - CASE WHEN is_basement_unit THEN 30 ELSE 0 END + CASE WHEN {any_of(t, ('top floor', 'penthouse', 'top level'))} THEN 10 ELSE 0 END"
        f" + CASE WHEN {any_of(t, ('corner unit', 'corner apartment'))} THEN 8 ELSE 0 END"
        " + CASE WHEN n_photos >= 15 THEN 5 WHEN n_photos >= 10 THEN 3 ELSE 0 END)) AS INTEGER)"
    )


# --- scoring ------------------------------------------------------------------
def score_ctes(p: Profile) -> str:
    """LISTINGS, layers, then ``sig`` (signals), ``sc`` (scores), ``pts`` (points, percent)."""
    pos, neg = p.groups("positive"), p.groups("negative")

    def mult(polarity: str, group: str) -> str:
        return num(p.multiplier(polarity, group))

    cols = [f"{hits('t', pos.get(g, []))} AS p_{g}" for g in
            ("light", "pet", "gym", "outdoor", "outdoor_private", "outdoor_premium", "character", "kitchen", "amenities", "quality")]
    cols += [f"{hits('t', neg.get(g, []))} AS n_{g}" for g in
             ("gross_highrise", "dark", "condition", "no_pets", "weak_outdoor", "flipper", "location_noise")]
    cols += [f"{hits('t', ws)} AS c_{n}" for n, ws in LX.CRITERION_TERMS.items()]
    mods = p.location_modifiers
    for kind, name in (("boost_streets", "good_st"), ("penalize_streets", "bad_st")):
        cols.append(f"list_filter({lst(mods.get(kind) or [])}, lambda s: contains(lower(address), lower(s))) AS {name}")
    groups = " + ".join(
        f"CASE WHEN len({hits('t', ws)}) > 0 THEN 1 ELSE 0 END" for ws in pos.values()
    ) or "0"
    cols.append(f"(len(regexp_extract_all(t, '\\S+')) < 80 AND ({groups}) < 2) AS generic")
    cols.append(f"{QUIET} AS quiet")
    cols.append(f"{light()} AS light")

    def h(n: str) -> str:
        return f"least(10e0, {n} * 2.5e0)"

    def times(score: str, cond: str, factor: str) -> str:
        return f"(({score}) * CASE WHEN {cond} THEN {factor} ELSE 1e0 END)"

    def cap(score: str, factor: str) -> str:
        return f"least(10e0, ({score}) * {factor})"

    n = {c.split(" AS ")[-1]: f"len({c.split(' AS ')[-1]})" for c in cols}
    parts = f"{h(n['p_light'])} + coalesce(light / 10e0, 0e0) + coalesce(brightness / 10e0, 0e0)"
    count = "(2 + CASE WHEN brightness IS NULL THEN 0 ELSE 1 END)"
    dark = f"({n['n_dark']} > 0 AND {n['p_light']} = 0)"
    flipped = f"({n['n_flipper']} > 0 AND generic)"
    any_out = f"({n['p_outdoor']} > 0 OR {n['p_outdoor_private']} > 0 OR {n['p_outdoor_premium']} > 0 OR has_outdoor_space_keywords)"
    out = f"CASE WHEN {any_out} THEN 5.5e0 + least(2e0, {n['p_outdoor']} * 0.5e0) ELSE 0e0 END"
    out = f"greatest({out}, CASE WHEN has_outdoor_space_keywords THEN 6e0 ELSE 0e0 END)"
    out = f"(CASE WHEN {n['p_outdoor_private']} > 0 THEN greatest({out}, 7e0) + least(1e0, {n['p_outdoor_private']} * 0.4e0) ELSE {out} END)"
    out = f"(CASE WHEN {n['p_outdoor_premium']} > 0 THEN greatest({out}, 8.5e0) + least(1e0, {n['p_outdoor_premium']} * 0.35e0) ELSE {out} END)"
    out = cap(out, mult("positive", "outdoor"))
    out = f"(CASE WHEN {n['n_weak_outdoor']} > 0 THEN least({out} * {mult('negative', 'weak_outdoor')}, 6.5e0) ELSE {out} END)"
    out = f"greatest(0e0, least(10e0, {out}))"
    soul = f"greatest({h('(' + n['p_character'] + ' + ' + n['p_quality'] + ')')}, CASE WHEN has_architectural_details_keywords THEN 7e0 ELSE 0e0 END)"
    soul = f"least(10e0, {soul} + CASE WHEN year_built <= 1940 THEN 2e0 WHEN year_built <= 1960 THEN 1e0 ELSE 0e0 END)"
    soul = cap(soul, mult("positive", "character"))
    soul = f"(CASE WHEN {n['p_quality']} > 0 THEN {cap(soul, mult('positive', 'quality'))} ELSE {soul} END)"
    soul = times(soul, flipped, mult("negative", "flipper"))
    conds = set(mods.get("penalize_conditions") or [])
    exposed = "(has_busy_street_keywords OR len(bad_st) > 0)"
    quiet = "least(10e0, coalesce(quiet / 10e0, 5e0))"
    quiet = f"(CASE WHEN has_busy_street_keywords THEN greatest(0e0, {quiet} - 3e0) ELSE {quiet} END)"
    quiet = times(quiet, f"{n['n_location_noise']} > 0", mult("negative", "location_noise"))
    adj = "len(good_st) * 1.5e0 - len(bad_st) * 1.5e0"
    if "adjacent_to_bar" in conds:
        adj += f" - CASE WHEN {n['n_location_noise']} > 0 OR {any_of('t', ('bar', 'nightlife'))} THEN 1.5e0 ELSE 0e0 END"
    if "on_major_thoroughfare" in conds:
        adj += f" - CASE WHEN {exposed} THEN 1.5e0 ELSE 0e0 END"
    if "first_floor_busy_street" in conds:
        adj += f" - CASE WHEN {exposed} AND {any_of('t', ('first floor', 'ground floor'))} THEN 1e0 ELSE 0e0 END"
    visual = "nullif(visual_quality_score, 0)"
    move = f"greatest({h(n['c_move_in'])}, least(10e0, coalesce({visual} / 10e0, 0e0)))"
    move = times(times(move, flipped, "0.8e0"), f"{n['n_condition']} > 0", mult("negative", "condition"))
    bq = (
        f"CASE WHEN has_building_quality_keywords AND {visual} IS NOT NULL THEN (7e0 + {visual} / 10e0) / 2e0 "
        f"WHEN has_building_quality_keywords THEN 7e0 ELSE coalesce({visual} / 10e0, 0e0) END"
    )
    bq = times(cap(bq, mult("positive", "building_quality")), f"{n['n_gross_highrise']} > 0", mult("negative", "gross_highrise"))
    pet = cap(f"CASE WHEN is_pet_friendly THEN 10e0 ELSE {h(n['p_pet'])} END", mult("positive", "pet"))
    pet = times(pet, f"{n['n_no_pets']} > 0", mult("negative", "no_pets"))
    gym = cap(f"CASE WHEN has_gym_keywords THEN 10e0 ELSE {h(n['p_gym'])} END", mult("positive", "gym"))
    dm_hits = f"len(list_filter(p_amenities, lambda a: {any_of('a', LX.DOORMAN_TERMS)}))"
    dm = f"greatest(CASE WHEN has_doorman_keywords THEN 8e0 ELSE 0e0 END, {h(dm_hits)})"
    dm = (
        f"CASE WHEN {any_of('t', LX.DOORMAN_NEGATIONS)} THEN 0e0 WHEN {any_of('t', LX.DOORMAN_FULL_TIME)} THEN 10e0 "
        f"WHEN {any_of('t', LX.DOORMAN_PART_TIME)} THEN greatest({dm}, 6e0) ELSE {dm} END"
    )
    scores = {
        "natural_light": times(cap(f"({parts}) / {count}", mult("positive", "light")), dark, mult("negative", "dark")),
        "outdoor_space": "outdoor",
        "character_soul": soul,
        "kitchen_quality": cap(h(n["p_kitchen"]), mult("positive", "kitchen")),
        "location_quiet": f"greatest(0e0, least(10e0, {quiet} + ({adj})))",
        "office_space": f"greatest({h(n['c_office'])}, CASE WHEN has_home_office_keywords THEN 7e0 ELSE 0e0 END)",
        "indoor_outdoor_flow": f"CASE WHEN {n['c_flow']} = 0 AND outdoor >= 6 AND {n['c_layout']} > 0 THEN 6.5e0 ELSE {h(n['c_flow'])} END",
        "high_ceilings": f"CASE WHEN {any_of('t', LX.TALL_CEILING_TERMS)} THEN 9e0 WHEN has_high_ceiling_keywords THEN 8e0 ELSE 0e0 END",
        "layout_intelligence": h(n["c_layout"]),
        "move_in_ready": move,
        "views": "CASE WHEN has_view_keywords THEN 8e0 ELSE 0e0 END",
        "in_unit_laundry": f"CASE WHEN {n['c_laundry']} = 0 AND {n['c_laundry_shared']} > 0 THEN 4e0 ELSE {h(n['c_laundry'])} END",
        "parking": f"CASE WHEN lower(parking_type) IN ('garage', 'carport', 'driveway') THEN 9e0 WHEN has_parking_keywords THEN 7e0 WHEN {n['c_street_parking']} > 0 THEN 4e0 ELSE 0e0 END",
        "central_hvac": h(n["c_hvac"]),
        "gas_stove": h(n["c_gas"]),
        "dishwasher": h(n["c_dishwasher"]),
        "storage": "CASE WHEN has_storage_keywords THEN 8e0 ELSE 0e0 END",
        "pet_friendly": pet,
        "gym_fitness": gym,
        "building_quality": bq,
        "doorman_concierge": dm,
    }
    total = "0e0"
    for key in scores:
        w = p.weights.get(key, 0)
        if w:
            total += f" + s_{key} / 10e0 * {num(float(w))}"
    soft, hard = p.soft_caps.get("price_soft"), p.hard_filters.get("price_max")
    pen = "0e0"
    if soft is not None:
        hard = hard or soft
        pen = (
            f"CASE WHEN price IS NULL OR price <= {num(soft)} THEN 0e0 WHEN price >= {num(hard)} THEN 10e0 "
            f"ELSE 10e0 * ((price - {num(soft)}) / {num(hard - soft)}) END"
        )
    hoa = "CASE WHEN hoa_fee IS NULL OR hoa_fee <= 800 THEN 0e0 WHEN hoa_fee <= 1000 THEN 5e0 ELSE 10e0 END"
    minus = f" - ({pen})" + (f" - ({hoa})" if p.mode != "rent" else "")
    return (
        f"WITH {LISTINGS}, {GEO}, sig AS MATERIALIZED (SELECT fx.*, {', '.join(cols)} FROM fx {GEO_JOIN}), "
        f"ou AS MATERIALIZED (SELECT *, {out} AS outdoor FROM sig), "
        f"sc AS MATERIALIZED (SELECT *, {', '.join(f'{rnd(e, 2)} AS s_{k}' for k, e in scores.items())} FROM ou), "
        f"pt AS MATERIALIZED (SELECT *, greatest(0e0, {total}{minus}) AS points, {pen} AS price_pen, {hoa} AS hoa_pen FROM sc), "
        f"pts AS (SELECT *, points / {num(p.total_weight)} * 100 AS percent FROM pt)"
    )


def hard_sql(p: Profile) -> str:
    h = p.hard_filters
    hoods = ", ".join(q(x) for x in p.neighborhoods)
    status = " AND ".join(f"listing_status NOT ILIKE {q('%' + s + '%')}" for s in LX.INACTIVE_STATUSES)
    return (
        f"price <= {h['price_max']} AND beds >= {h['bedrooms_min']} AND baths >= {h['bathrooms_min']} "
        f"AND (sqft IS NULL OR sqft >= {h['sqft_min']}) AND neighborhood IN ({hoods}) "
        f"AND (listing_status IS NULL OR ({status}))"
    )


def signal_sql(p: Profile) -> str:
    last = (
        "NOT (coalesce(is_no_pets, FALSE) OR len(n_no_pets) > 0)" if p.mode == "rent"
        else f"NOT {any_of('t', LX.CRITERION_TERMS['no_parking'])}"
    )
    return (
        "NOT (len(n_dark) > 0 AND len(p_light) = 0) AND NOT has_busy_street_keywords AND coalesce(quiet, 100) >= 40 "
        f"AND NOT {any_of('t', LX.CRITERION_TERMS['layout_bad'])} AND {last}"
    )


def reasons_sql(p: Profile) -> tuple[str, str]:
    h = p.hard_filters
    hoods = ", ".join(q(x) for x in p.neighborhoods)
    hard = [
        (f"price IS NULL OR price > {h['price_max']}", "price above max"),
        (f"beds IS NULL OR beds < {h['bedrooms_min']}", "bedrooms below min"),
        (f"baths IS NULL OR baths < {h['bathrooms_min']}", "bathrooms below min"),
        (f"sqft < {h['sqft_min']}", "sqft below min"),
        (f"neighborhood IS NULL OR neighborhood NOT IN ({hoods})", "neighborhood excluded"),
        (any_of("lower(coalesce(listing_status, ''))", LX.INACTIVE_STATUSES), "inactive status"),
    ]
    last = ("coalesce(is_no_pets, FALSE) OR len(n_no_pets) > 0", "no pets allowed") if p.mode == "rent" else (
        any_of("t", LX.CRITERION_TERMS["no_parking"]), "no parking")
    soft = [
        ("len(n_dark) > 0 AND len(p_light) = 0", "dark interior signals"),
        ("has_busy_street_keywords", "busy street signal"),
        ("quiet < 40", "low tranquility score"),
        (any_of("t", LX.CRITERION_TERMS["layout_bad"]), "layout red flags"),
        last,
    ]

    def listed(pairs) -> str:
        return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(w)} END" for c, w in pairs) + "], lambda r: r IS NOT NULL)"

    return listed(hard), listed(soft)


TIER = "CASE WHEN percent >= 80 THEN 'Exceptional' WHEN percent >= 70 THEN 'Strong' WHEN percent >= 60 THEN 'Interesting' ELSE 'Pass' END"
