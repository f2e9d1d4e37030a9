"""Text and location queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog import sqltext as S
from nestrank.catalog.registry import joined, query
from nestrank.functions import columns as CO
from nestrank.functions import geo
from nestrank.functions import lexicon as LX
from nestrank.functions import scoring as SC
from nestrank.functions import text as TX
from nestrank.operators import search_text as ST
from nestrank.operators import signals as SG
from nestrank.operators import spatial as SP
from nestrank.schema import FLAG_COLUMNS
from nestrank.sources.profiles import rental_profile

RENTAL = rental_profile()
# words that do occur in the driver's documents
DOC_TERMS = ["den", "ring", "the", "license", "th", "tion", "é", "er erthe", "the the", "copyright", "on"]
DOC_TEXT = "lower(coalesce(text, ''))"


@query(
    "flags_listings",
    f"WITH {S.LISTINGS} SELECT id, " + ", ".join(f"{c} AS {c}" for c in FLAG_COLUMNS.values()) + " FROM fx",
)
def flags_listings(spark, sf_dir):
    return FX.listings(spark, sf_dir).select("id", *FLAG_COLUMNS.values())


def _doc_flags_sql() -> str:
    flags = S.flag_exprs("t")
    each = ", ".join(f"CASE WHEN {e} THEN {S.q(n)} END" for n, e in flags.items())
    return (
        f"SELECT doc_id, array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), '|') AS flags "
        f"FROM (SELECT doc_id, text, {DOC_TEXT} AS t FROM documents)"
    )


@query("flags_documents", _doc_flags_sql())
def flags_documents(spark, sf_dir):
    names = [*LX.FLAG_GROUPS, *LX.DEAL_FLAGS, "north_facing_only", "basement_unit"]
    docs = SG.extract_flags(FX.table(spark, sf_dir, "documents"), "text")
    found = F.filter(F.array(*[F.when(F.col(f"flag_{n}"), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return docs.select("doc_id", joined(found).alias("flags"))


@query(
    "hits_documents",
    f"SELECT doc_id, array_to_string({S.hits('t', DOC_TERMS)}, '|') AS hits FROM (SELECT doc_id, {DOC_TEXT} AS t FROM documents)",
)
def hits_documents(spark, sf_dir):
    docs = SG.keyword_hits(FX.table(spark, sf_dir, "documents"), "text", {"words": DOC_TERMS})
    return docs.select("doc_id", joined("hits_words").alias("hits"))


ALL_TERMS = list(dict.fromkeys([*DOC_TERMS, *[t for ts in LX.FLAG_GROUPS.values() for t in ts], *LX.LIGHT_NEGATIVE]))


@query(
    "keyword_rows_documents",
    f"SELECT keyword, count(*) AS documents FROM (SELECT doc_id, unnest({S.hits('t', ALL_TERMS)}) AS keyword "
    f"FROM (SELECT doc_id, {DOC_TEXT} AS t FROM documents)) GROUP BY keyword",
)
def keyword_rows_documents(spark, sf_dir):
    rows = SG.keyword_hit_rows(FX.table(spark, sf_dir, "documents"), "doc_id", "text", ALL_TERMS)
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("documents"))


def _signals_sql() -> str:
    parts = []
    for polarity in ("positive", "negative"):
        entries = []
        for group, terms in RENTAL.groups(polarity).items():
            found = S.hits("t", terms)
            if group == "dark":
                found = f"CASE WHEN len({S.hits('t', RENTAL.groups('positive')['light'])}) > 0 THEN [] ELSE {found} END"
            entries.append(f"CASE WHEN len({found}) > 0 THEN concat({S.q(group + '=')}, array_to_string({found}, ',')) END")
        parts.append(
            f"array_to_string(list_sort(list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL)), ';') AS {polarity}_hits"
        )
    return f"WITH {S.LISTINGS} SELECT id, {', '.join(parts)} FROM fx"


@query("text_signals", _signals_sql())
def text_signals(spark, sf_dir):
    def shown(col: str):
        entries = F.transform(
            F.map_entries(col), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, ","))
        )
        return joined(F.sort_array(entries), ";").alias(col)

    out = SG.text_signals(FX.raw_listings(spark, sf_dir), RENTAL)
    return out.select("id", shown("positive_hits"), shown("negative_hits"))


@query(
    "generic_descriptions",
    f"SELECT doc_id, (text = '' OR (len(regexp_extract_all(text, '\\S+')) < 80 AND (CASE WHEN {S.any_of('t', DOC_TERMS[:3])} THEN 1 ELSE 0 END "
    f"+ CASE WHEN {S.any_of('t', DOC_TERMS[3:6])} THEN 1 ELSE 0 END) < 2)) AS generic, len(regexp_extract_all(text, '\\S+')) AS words "
    "FROM (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS t FROM documents)",
)
def generic_descriptions(spark, sf_dir):
    docs = SG.keyword_hits(FX.table(spark, sf_dir, "documents"), "text", {"a": DOC_TERMS[:3], "b": DOC_TERMS[3:6]})
    groups = (F.size("hits_a") > 0).cast("int") + (F.size("hits_b") > 0).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", SG.is_generic(text, groups).alias("generic"), TX.word_count(text).cast("long").alias("words")
    )


def _quality_sql(source: str, key: str, text: str) -> str:
    score = "0e0"
    for name, terms in LX.FLAG_GROUPS.items():
        score += f" + CASE WHEN {S.any_of('t', terms)} THEN {LX.QUALITY_WEIGHTS.get(name, 1)} ELSE 0 END"
    score += f" + CASE WHEN {S.any_of('t', LX.MOTIVATED_SELLER)} THEN 1 ELSE 0 END"
    for terms in LX.POSITIVE_GROUPS.values():
        score += f" + CASE WHEN {S.any_of('t', terms)} THEN 2 ELSE 0 END"
    for terms in LX.RED_FLAG_GROUPS.values():
        score += f" - CASE WHEN {S.any_of('t', terms)} THEN 5 ELSE 0 END"
    best = sum(LX.QUALITY_WEIGHTS.values()) + 8
    return (
        f"SELECT {key}, round(CASE WHEN t = '' THEN 0e0 ELSE greatest(0e0, least(100e0, ({score}) / {best}e0 * 100e0)) END, 6) AS text_quality "
        f"FROM (SELECT {key}, lower(coalesce({text}, '')) AS t FROM {source})"
    )


@query("text_quality_documents", _quality_sql("documents", "doc_id", "text"))
def text_quality_documents(spark, sf_dir):
    out = SG.text_quality(FX.table(spark, sf_dir, "documents"), "text")
    return out.select("doc_id", F.round("text_quality", 6).alias("text_quality"))


@query("text_quality_listings", f"WITH {S.RAW} " + _quality_sql("raw", "id", "description"))
def text_quality_listings(spark, sf_dir):
    out = SG.text_quality(FX.raw_listings(spark, sf_dir), "description")
    return out.select("id", F.round("text_quality", 6).alias("text_quality"))


def _light_sql() -> str:
    named = (
        f"list_concat(list_transform(list_slice({S.hits('t', LX.LIGHT_POSITIVE)}, 1, 3), lambda k: concat('mentions ''', k, '''')), "
        f"list_transform(list_slice({S.hits('t', LX.LIGHT_NEGATIVE)}, 1, 2), lambda k: concat('mentions ''', k, '''')))"
    )
    rest = (
        "list_filter([CASE WHEN has_natural_light_keywords THEN 'natural_light_flag: true' END, "
        "CASE WHEN is_north_facing_only THEN 'north_facing_only: true' END, CASE WHEN is_basement_unit THEN 'basement_unit: true' END, "
        f"CASE WHEN {S.any_of('t', ('top floor', 'penthouse', 'top level'))} THEN 'top_floor_unit' END, "
        f"CASE WHEN {S.any_of('t', ('corner unit', 'corner apartment'))} THEN 'corner_unit' END, "
        "CASE WHEN n_photos >= 15 THEN 'high_photo_count' END], lambda x: x IS NOT NULL)"
    )
    return (
        f"WITH {S.LISTINGS}, s AS (SELECT *, list_concat({named}, {rest}) AS sig FROM fx) "
        f"SELECT id, {S.light()} AS light_potential_score, array_to_string(sig, '|') AS signals, "
        "CASE WHEN is_basement_unit OR is_north_facing_only THEN 'high' WHEN len(sig) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s"
    )


@query("light_potential", _light_sql())
def light_potential(spark, sf_dir):
    out = SG.light_potential(FX.listings(spark, sf_dir))
    return out.select(
        "id", "light_potential_score", joined("light_potential_signals").alias("signals"),
        F.col("light_potential_confidence").alias("confidence"),
    )


@query(
    "tradeoff_sentences",
    f"SELECT conv_id, turn, {S.any_of('lower(coalesce(text, ' + chr(39) * 2 + '))', LX.TRADEOFF_HINTS)} AS is_tradeoff, "
    f"{S.any_of('lower(coalesce(text, ' + chr(39) * 2 + '))', LX.DOORMAN_NEGATIONS)} AS negated FROM conversations",
)
def tradeoff_sentences(spark, sf_dir):
    chat = FX.table(spark, sf_dir, "conversations")
    return chat.select(
        "conv_id", "turn", TX.is_tradeoff(F.col("text")).alias("is_tradeoff"),
        TX.has_negation(TX.lowered(F.col("text"))).alias("negated"),
    )


SEARCH_TEXT = (
    "concat('Looking for ', CASE id % 3 WHEN 0 THEN '3 bedroom' WHEN 1 THEN 'four bedroom' ELSE 'a 2.5 bath' END, ' home in ', "
    "coalesce(neighborhood, 'NoPa'), CASE id % 5 WHEN 0 THEN ' under $2M, walk score 85, condo' WHEN 1 THEN ' up to 3 million, walkable townhouse' "
    "WHEN 2 THEN ' from $1m with 1,200 sq' ELSE ', no busy street, avoid Geary' END, '. ', description)"
)


def _search_sql() -> str:
    cols = []
    for target, kind in ST.NUMBER_TYPES.items():
        whens = " ".join(
            f"WHEN {S.any_of('d', terms)} THEN {v}" for name, v, terms in reversed(ST.NUMBER_RULES) if name == target
        )
        cols.append(f"CAST(CASE {whens} END AS {'DOUBLE' if kind == 'double' else 'INTEGER'}) AS {target}")
    cols += [f"CASE WHEN {S.any_of('d', terms)} THEN TRUE END AS {t}" for t, terms in ST.SWITCH_RULES]
    types = ", ".join(f"CASE WHEN {S.any_of('d', terms)} THEN {S.q(n)} END" for n, terms in ST.TYPE_RULES)
    cols.append(f"nullif(array_to_string(list_filter([{types}], lambda x: x IS NOT NULL), '|'), '') AS property_types")
    names = {
        "potrero hill": "Potrero Hill", "potrero": "Potrero Hill", "cole valley": "Cole Valley",
        "haight": "Haight-Ashbury", "haight-ashbury": "Haight-Ashbury", "dolores heights": "Dolores Heights",
        "nopa": "NoPa", "no pa": "NoPa", "north of panhandle": "NoPa",
    }
    hoods = ", ".join(f"CASE WHEN contains(d, {S.q(h)}) THEN {S.q(names.get(h, h))} END" for h in ST.HOODS)
    cols.append(f"nullif(array_to_string(list_filter([{hoods}], lambda x: x IS NOT NULL), '|'), '') AS hoods")
    cols.append(f"CASE WHEN {S.any_of('d', ST.STREET_TERMS)} THEN 'Van Ness|Geary|19th Ave' END AS excluded_streets")
    cols.append(
        "concat_ws(',', "
        + ", ".join(f"CASE WHEN contains(d, {S.q(t)}) THEN {a} ELSE {b} END" for t, a, b in ST.WEIGHT_RULES.values())
        + ") AS weights"
    )
    return f"WITH {S.RAW} SELECT id, {', '.join(cols)} FROM (SELECT id, lower({SEARCH_TEXT}) AS d FROM raw)"


@query("search_criteria", _search_sql())
def search_criteria(spark, sf_dir):
    texts = FX.raw_listings(spark, sf_dir).select("id", F.expr(SEARCH_TEXT).alias("wish"))
    out = ST.parse_search_description(texts, "wish")
    weights = F.concat_ws(",", *[F.element_at("feature_weights", F.lit(k)) for k in ST.WEIGHT_RULES])
    return out.select(
        "id", *ST.NUMBER_TYPES, *[t for t, _ in ST.SWITCH_RULES],
        joined("property_types").alias("property_types"), joined("preferred_neighborhoods").alias("hoods"),
        joined("excluded_streets").alias("excluded_streets"), weights.alias("weights"),
    )


# --- location ------------------------------------------------------------------
@query(
    "nearest_fire_station",
    f"WITH {S.RAW}, {S.near_cte('fire', 'raw')} SELECT id, s.name AS station, round(s.dist, 1) AS distance_m FROM near_fire",
)
def nearest_fire_station(spark, sf_dir):
    df = FX.raw_listings(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    near = geo.nearest_in_city(geo.coverage(lat, lon), "lat", "lon", "fire")
    return (
        df.select("id", near.alias("s")).filter(F.col("s").isNotNull())
        .select("id", F.col("s.name").alias("station"), F.round("s.distance_m", 1).alias("distance_m"))
    )


CANAL = [seg for seg in geo.layer_segments("nyc", "street") if seg[1] == "Canal Street"]


def _canal_sql() -> str:
    parts = []
    for _, _, _, a, b, c, d in CANAL:
        k = f"greatest(0e0, least(1e0, ((lon - {S.num(b)}) * {S.num(d - b)} + (lat - {S.num(a)}) * {S.num(c - a)}) / {S.num((c - a) ** 2 + (d - b) ** 2)}))"
        parts.append(S.haversine("lat", "lon", f"{S.num(a)} + {k} * {S.num(c - a)}", f"{S.num(b)} + {k} * {S.num(d - b)}"))
    return f"WITH {S.RAW} SELECT id, round(least({', '.join(parts)}), 1) AS canal_m FROM raw WHERE lat IS NOT NULL"


@query("polyline_distance", _canal_sql())
def polyline_distance(spark, sf_dir):
    names = ("lat1", "lon1", "lat2", "lon2")
    segments = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, seg[3:])]) for seg in CANAL])
    df = FX.raw_listings(spark, sf_dir).filter(F.col("lat").isNotNull())
    return df.select("id", F.round(geo.polyline_m(F.col("lat"), F.col("lon"), segments), 1).alias("canal_m"))


def _tranquility_sql() -> str:
    warn = (
        "list_filter([CASE WHEN st.s.dist < 30 THEN concat('On ', st.s.name, ' (high traffic)') WHEN st.s.dist < 75 THEN concat('Near ', st.s.name) END, "
        "CASE WHEN fw.s.dist < 100 THEN concat('Adjacent to ', fw.s.name) WHEN fw.s.dist < 200 THEN concat('Very close to ', fw.s.name) END, "
        "CASE WHEN fi.s.dist < 150 THEN concat('Near ', fi.s.name) END], lambda x: x IS NOT NULL)"
    )
    return (
        f"WITH {S.LISTINGS}, {S.GEO} SELECT id, CASE WHEN lat IS NULL THEN 50 ELSE {S.QUIET} END AS score, "
        "st.s.name AS street, round(st.s.dist, 1) AS street_m, fw.s.name AS freeway, round(fw.s.dist, 1) AS freeway_m, "
        "fi.s.name AS station, round(fi.s.dist, 1) AS station_m, "
        f"CASE WHEN lat IS NULL THEN 'No location data available' WHEN st.id IS NULL THEN 'Outside coverage area' ELSE array_to_string({warn}, '|') END AS warnings, "
        "CASE WHEN lat IS NULL OR st.id IS NULL THEN 'low' WHEN st.s.dist < 500 THEN 'high' ELSE 'medium' END AS confidence "
        f"FROM fx {S.GEO_JOIN}"
    )


@query("tranquility", _tranquility_sql())
def tranquility(spark, sf_dir):
    out = SG.tranquility(FX.raw_listings(spark, sf_dir))
    f = "tranquility_factors"
    return out.select(
        "id", F.col("tranquility_score").alias("score"),
        F.col(f"{f}.nearest_busy_street.name").alias("street"), F.round(f"{f}.nearest_busy_street.distance_m", 1).alias("street_m"),
        F.col(f"{f}.nearest_freeway.name").alias("freeway"), F.round(f"{f}.nearest_freeway.distance_m", 1).alias("freeway_m"),
        F.col(f"{f}.nearest_fire_station.name").alias("station"), F.round(f"{f}.nearest_fire_station.distance_m", 1).alias("station_m"),
        joined("tranquility_warnings").alias("warnings"), F.col("tranquility_confidence").alias("confidence"),
    )


def hood_name_sql(col: str) -> str:
    whens = " ".join(
        f"WHEN lower(trim({col})) = {S.q(name.lower())} OR {S.any_of(f'lower(trim({col}))', aliases)} THEN {S.q(name)}"
        for name, *_, aliases in geo.HOOD_BOXES
    )
    generic = ", ".join(S.q(g) for g in geo.GENERIC_HOODS)
    return f"CASE WHEN {col} IS NULL OR trim({col}) = '' OR lower(trim({col})) IN ({generic}) THEN NULL {whens} ELSE trim({col}) END"


def hood_point_sql() -> str:
    return "CASE " + " ".join(
        f"WHEN lat BETWEEN {a!r} AND {b!r} AND lon BETWEEN {c!r} AND {d!r} THEN {S.q(name)}" for name, a, b, c, d, _ in geo.HOOD_BOXES
    ) + " END"


@query(
    "hood_resolve",
    f"WITH {S.RAW} SELECT id, {hood_name_sql('neighborhood')} AS named, {hood_point_sql()} AS placed, "
    f"coalesce({hood_name_sql('neighborhood')}, {hood_point_sql()}) AS hood FROM raw",
)
def hood_resolve(spark, sf_dir):
    lat, lon, raw = F.col("lat"), F.col("lon"), F.col("neighborhood")
    return FX.raw_listings(spark, sf_dir).select(
        "id", geo.normalize_hood(raw).alias("named"), geo.hood_from_point(lat, lon).alias("placed"),
        geo.resolve_hood(raw, lat, lon).alias("hood"),
    )


@query("point_in_box", f"WITH {S.RAW} SELECT id, {hood_point_sql()} AS hood FROM raw WHERE {hood_point_sql()} IS NOT NULL")
def point_in_box(spark, sf_dir):
    return SP.boxes_of_points(FX.raw_listings(spark, sf_dir).select("id", "lat", "lon"), SP.hood_box_table(spark))


def _mods_sql() -> str:
    mods = RENTAL.location_modifiers
    good = f"list_filter({S.lst(mods['boost_streets'])}, lambda s: contains(lower(address), lower(s)))"
    bad = f"list_filter({S.lst(mods['penalize_streets'])}, lambda s: contains(lower(address), lower(s)))"
    night = S.any_of("t", ("bar", "nightlife"))
    exposed = f"(has_busy_street_keywords OR len({bad}) > 0)"
    low = f"({S.any_of('t', ('first floor', 'ground floor'))} AND {exposed})"
    return (
        f"WITH {S.LISTINGS} SELECT id, len({good}) * 1.5e0 - len({bad}) * 1.5e0 - CASE WHEN {night} THEN 1.5e0 ELSE 0e0 END "
        f"- CASE WHEN {exposed} THEN 1.5e0 ELSE 0e0 END - CASE WHEN {low} THEN 1e0 ELSE 0e0 END AS adjustment, "
        f"array_to_string(list_concat(list_concat(list_transform({good}, lambda s: concat('boost street ', s)), list_transform({bad}, lambda s: concat('penalize street ', s))), "
        f"list_filter([CASE WHEN {night} THEN 'adjacent to nightlife' END, CASE WHEN {exposed} THEN 'major thoroughfare exposure' END, "
        f"CASE WHEN {low} THEN 'first floor on busy street' END], lambda x: x IS NOT NULL)), '|') AS evidence FROM fx"
    )


@query("location_modifiers", _mods_sql())
def location_modifiers(spark, sf_dir):
    staged = SG.stage(FX.listings(spark, sf_dir), RENTAL)
    return staged.select(
        "id", SC.location_adjustment(RENTAL).alias("adjustment"), joined(SC.location_evidence(RENTAL)).alias("evidence")
    )


def _near_sql() -> str:
    sf_rows = "(c.city = v.city OR (coalesce(c.city, '') <> 'nyc' AND v.city = 'sf'))"
    street = S.near_cte("street", "raw", sf_rows)
    freeway = S.near_cte("freeway", "raw", sf_rows)
    return (
        f"WITH {S.RAW}, {street}, {freeway} SELECT id, coalesce(st.s.dist < 50, FALSE) AS on_street, coalesce(fw.s.dist < 200, FALSE) AS by_freeway "
        "FROM raw LEFT JOIN near_street st USING (id) LEFT JOIN near_freeway fw USING (id) WHERE lat IS NOT NULL"
    )


@query("near_busy", _near_sql())
def near_busy(spark, sf_dir):
    df = FX.raw_listings(spark, sf_dir).filter(F.col("lat").isNotNull())
    lat, lon = F.col("lat"), F.col("lon")
    return df.select(
        "id", geo.near(lat, lon, "street", 50).alias("on_street"), geo.near(lat, lon, "freeway", 200).alias("by_freeway")
    )


@query(
    "tile_counts",
    f"WITH {S.RAW}, t AS (SELECT CAST(floor((lat - 37.707e0) / 0.02e0) AS INTEGER) AS row, CAST(floor((lon - (-122.515e0)) / 0.02e0) AS INTEGER) AS col FROM raw "
    "WHERE lat BETWEEN 37.707e0 AND 37.83e0 AND lon BETWEEN -122.515e0 AND -122.355e0), "
    "g AS (SELECT r.range AS row, c.range AS col FROM range(0, 7) r, range(0, 8) c) "
    "SELECT CAST(g.row AS INTEGER) AS row, CAST(g.col AS INTEGER) AS col, count(t.row) AS listings FROM g LEFT JOIN t ON g.row = t.row AND g.col = t.col GROUP BY ALL",
)
def tile_counts(spark, sf_dir):
    low_lat, high_lat, low_lon, high_lon = geo.COVERAGE["sf"]
    tiles = SP.tiles(spark, (low_lat, low_lon, high_lat, high_lon))
    placed = FX.raw_listings(spark, sf_dir).select(
        geo.tile_of(F.col("lat"), low_lat, high_lat, 0.02).alias("row"),
        geo.tile_of(F.col("lon"), low_lon, high_lon, 0.02).alias("col"),
    ).groupBy("row", "col").agg(F.count(F.lit(1)).alias("listings"))
    return tiles.select("row", "col").join(placed, ["row", "col"], "left").select(
        "row", "col", F.coalesce("listings", F.lit(0)).alias("listings")
    )


@query(
    "grid_nearest_street",
    f"WITH {S.RAW}, {S.near_cte('street', 'raw')} SELECT id, s.name AS street, round(s.dist, 1) AS distance_m FROM near_street WHERE s.dist < 500",
)
def grid_nearest_street(spark, sf_dir):
    points = FX.raw_listings(spark, sf_dir).select("id", "lat", "lon")
    near = SP.nearest_within(points, SP.segment_table(spark, "street"), 500.0)
    return near.select("id", F.col("name").alias("street"), F.round("distance_m", 1).alias("distance_m"))


@query(
    "tier_labels",
    f"WITH {S.RAW} SELECT id, CASE WHEN v >= 80 THEN 'Exceptional' WHEN v >= 70 THEN 'Strong' WHEN v >= 60 THEN 'Interesting' WHEN v IS NOT NULL THEN 'Pass' END AS score_tier, "
    "CASE WHEN v >= 75 THEN 'Excellent' WHEN v >= 55 THEN 'Good' WHEN v >= 35 THEN 'Moderate' WHEN v IS NOT NULL THEN 'Limited' END AS light_tier, "
    "CASE WHEN v >= 80 THEN 'Very Quiet' WHEN v >= 60 THEN 'Quiet' WHEN v >= 40 THEN 'Moderate' WHEN v >= 20 THEN 'Noisy' WHEN v IS NOT NULL THEN 'Very Noisy' END AS quiet_tier, "
    "CASE WHEN v IS NULL THEN 'Unknown' WHEN v >= 85 THEN 'Stunning' WHEN v >= 70 THEN 'Very Appealing' WHEN v >= 55 THEN 'Average' WHEN v >= 40 THEN 'Below Average' ELSE 'Needs Work' END AS visual_tier, "
    "CASE WHEN v >= 80 THEN 'excellent' WHEN v >= 60 THEN 'good' WHEN v >= 40 THEN 'fair' WHEN v IS NOT NULL THEN 'low' END AS ui_tier, "
    "CASE WHEN coalesce(v, 0) = 0 THEN 'Visual analysis not available.' ELSE concat('Visual Appeal: ', CASE WHEN v >= 85 THEN 'Stunning' WHEN v >= 70 THEN 'Very Appealing' WHEN v >= 55 THEN 'Average' WHEN v >= 40 THEN 'Below Average' ELSE 'Needs Work' END, "
    "' (', v, '/100, unknown confidence)', CASE WHEN n_photos > 0 THEN concat(' | Highlights: ', array_to_string(list_slice(photos, 1, 3), ', ')) ELSE '' END) END AS summary "
    "FROM (SELECT *, visual_quality_score AS v FROM raw)",
)
def tier_labels(spark, sf_dir):
    v = F.col("visual_quality_score")
    kinds = {"score_tier": "score", "light_tier": "light", "quiet_tier": "quiet", "visual_tier": "visual", "ui_tier": "ui"}
    summary = CO.visual_summary(
        v, F.lit(None).cast("string"), F.col("photos"), F.array().cast("array<string>"), SC.tier(v, "visual")
    )
    return FX.raw_listings(spark, sf_dir).select(
        "id", *[SC.tier(v, kind).alias(name) for name, kind in kinds.items()], summary.alias("summary")
    )
