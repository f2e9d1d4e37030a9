"""Filter, scoring and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.catalog import sqltext as S
from nestrank.catalog.registry import joined, query
from nestrank.functions import columns as CO
from nestrank.functions import geo
from nestrank.functions import scoring as SC
from nestrank.functions.text import round_half_even
from nestrank.operators import filters as FL
from nestrank.operators import joins as J
from nestrank.operators import learning as LE
from nestrank.operators import ranking as R
from nestrank.operators import reports as RP
from nestrank.sources import profile_data
from nestrank.sources.profiles import purchase_profile, rental_profile

RENTAL = rental_profile()
# the purchase profile with the areas of the derived listings, so that some remain
BUY = purchase_profile().__class__(
    **{
        **purchase_profile().__dict__,
        "hard_filters": {
            "price_max": 6000, "bedrooms_min": 1, "bathrooms_min": 1, "sqft_min": 500,
            "neighborhoods": ["Williamsburg", "SoHo", "Park Slope", "Potrero", "Brooklyn"],
        },
        "soft_caps": {"price_soft": 3000},
    }
)
KEYS = [c.key for c in SC.CRITERIA]


def r6(col: str):
    return F.round(col, 6).alias(col)


@query("hard_filter", f"WITH {S.RAW} SELECT id, price, beds FROM raw WHERE {S.hard_sql(RENTAL)}")
def hard_filter(spark, sf_dir):
    return FL.hard_filter(FX.raw_listings(spark, sf_dir), RENTAL).select("id", "price", "beds")


def _reasons_query(p) -> str:
    hard, soft = S.reasons_sql(p)
    return f"{S.score_ctes(p)} SELECT id, array_to_string({hard}, '|') AS hard, array_to_string({soft}, '|') AS soft FROM sc"


@query("failure_reasons", _reasons_query(RENTAL))
def failure_reasons(spark, sf_dir):
    df = FL.with_signal_failures(FX.listings(spark, sf_dir), RENTAL)
    return df.select("id", joined(FL.hard_failures(RENTAL)).alias("hard"), joined("signal_failures").alias("soft"))


@query("failure_reasons_purchase", _reasons_query(BUY))
def failure_reasons_purchase(spark, sf_dir):
    df = FL.with_signal_failures(FX.listings(spark, sf_dir), BUY)
    return df.select("id", joined(FL.hard_failures(BUY)).alias("hard"), joined("signal_failures").alias("soft"))


def _scores_sql(p) -> str:
    return (
        f"{S.score_ctes(p)} SELECT id, {', '.join(f's_{k}' for k in KEYS)}, round(points, 6) AS points, "
        "round(percent, 6) AS percent FROM pts"
    )


@query("score_components", _scores_sql(RENTAL))
def score_components(spark, sf_dir):
    out = R.with_scores(FX.listings(spark, sf_dir), RENTAL)
    return out.select("id", *[f"s_{k}" for k in KEYS], r6("points"), r6("percent"))


@query("score_components_purchase", _scores_sql(BUY))
def score_components_purchase(spark, sf_dir):
    out = R.with_scores(FX.listings(spark, sf_dir), BUY)
    return out.select("id", *[f"s_{k}" for k in KEYS], r6("points"), r6("percent"))


def _explained_sql(p) -> str:
    """``ex``: candidates with reasons, trade-off, tier and signals."""
    labels = SC.LABELS
    entries = ", ".join(
        f"struct_pack(neg := -(s_{k} / 10e0 * {S.num(float(p.weights[k]))}), o := {i}, label := {S.q(labels[k])}, score := s_{k})"
        for i, k in enumerate(KEYS) if p.weights.get(k)
    )
    lowest = ", ".join(
        f"struct_pack(score := s_{k}, o := {i}, label := {S.q(labels[k])})" for i, k in enumerate(KEYS) if p.weights.get(k)
    )
    return (
        f"{S.score_ctes(p)}, ex AS (SELECT *, "
        f"array_to_string(list_transform(list_slice(list_sort(list_filter([{entries}], lambda e: e.score > 0)), 1, 3), lambda e: e.label), '|') AS top_positives, "
        f"CASE WHEN price_pen > 0 THEN 'Above ideal price' WHEN hoa_pen > 0 THEN 'High HOA' ELSE concat('Low on ', (list_sort([{lowest}])[1]).label) END AS key_tradeoff, "
        f"{S.rnd('percent', 1)} AS match_score, {S.rnd('points', 1)} AS score_points, "
        f"concat(CAST(CAST(round_even(points / {S.num(p.total_weight)} * 100, 0) AS BIGINT) AS VARCHAR), '%') AS score_percent, {S.TIER} AS score_tier, "
        f"{S.rnd('quiet / 10e0', 1)} AS sig_quiet, {S.rnd('light / 10e0', 1)} AS sig_light, {S.rnd('visual_quality_score / 10e0', 1)} AS sig_visual, "
        "CASE WHEN len(p_character) + len(p_quality) > 0 THEN least(10e0, (len(p_character) + len(p_quality)) * 2.5e0) END AS sig_character "
        f"FROM pts WHERE {S.hard_sql(p)} AND {S.signal_sql(p)})"
    )


EX_COLS = [
    "id", "top_positives", "key_tradeoff", "match_score", "score_points", "score_percent", "score_tier",
    "sig_quiet", "sig_light", "sig_visual", "sig_character",
]


def _explained(df, p, events=None):
    out = R.explain_matches(df, p, events)
    return out.withColumns(
        {
            "top_positives": joined("top_positives"),
            "sig_quiet": F.col("signals.tranquility_score"), "sig_light": F.col("signals.light_potential"),
            "sig_visual": F.col("signals.visual_quality"), "sig_character": F.col("signals.nlp_character_score"),
        }
    )


@query("match_explain", f"{_explained_sql(RENTAL)} SELECT {', '.join(EX_COLS)} FROM ex")
def match_explain(spark, sf_dir):
    cand = R.with_points(R.candidates(FX.listings(spark, sf_dir), RENTAL), RENTAL)
    return _explained(cand, RENTAL).select(*EX_COLS)


@query("match_explain_purchase", f"{_explained_sql(BUY)} SELECT {', '.join(EX_COLS)} FROM ex")
def match_explain_purchase(spark, sf_dir):
    cand = R.with_points(R.candidates(FX.listings(spark, sf_dir), BUY), BUY)
    return _explained(cand, BUY).select(*EX_COLS)


WHY_SQL = (
    "CASE WHEN coalesce(is_price_reduced, FALSE) AND price_reduction_amount > 0 THEN "
    "coalesce(concat('Price dropped ', CAST(CAST(round_even(price_reduction_amount / (price + price_reduction_amount) * 100, 0) AS BIGINT) AS VARCHAR), '% recently'), 'Price dropped recently') "
    "WHEN le.event_type = 'price_drop' THEN concat('Price dropped ', CAST(CAST(round_even(le.percent, 0) AS BIGINT) AS VARCHAR), '% recently') "
    "WHEN le.event_type = 'back_on_market' THEN 'Back on market' WHEN days_on_market <= 7 THEN concat('New listing (', days_on_market, ' DOM)') "
    "WHEN days_on_market >= 45 THEN concat('Overlooked at ', days_on_market, ' DOM') END"
)
# concat skips NULLs in the checking engine, so the price branch is guarded
WHY_SQL = WHY_SQL.replace(
    "coalesce(concat('Price dropped ', CAST(CAST(round_even(price_reduction_amount",
    "CASE WHEN price IS NULL THEN 'Price dropped recently' ELSE concat('Price dropped ', CAST(CAST(round_even(price_reduction_amount",
).replace("'% recently'), 'Price dropped recently') WHEN", "'% recently') END WHEN")
LATEST = "le AS (SELECT listing_id, max_by(struct_pack(e := event_type, p := percent), struct_pack(c := created_at, i := event_id)) AS s FROM ev GROUP BY 1), latest AS (SELECT listing_id, s.e AS event_type, s.p AS percent FROM le)"


@query(
    "rank_matches",
    f"{_explained_sql(RENTAL)}, {S.EVENTS}, {LATEST} SELECT {', '.join('ex.' + c for c in EX_COLS)}, round(points, 6) AS points, {WHY_SQL} AS why_now "
    "FROM ex LEFT JOIN latest le ON le.listing_id = ex.id ORDER BY ex.points DESC, ex.id LIMIT 100",
)
def rank_matches(spark, sf_dir):
    out = R.rank(FX.listings(spark, sf_dir), RENTAL, 100, events=FX.events_of(spark, sf_dir))
    return out.withColumns(
        {
            "top_positives": joined("top_positives"),
            "sig_quiet": F.col("signals.tranquility_score"), "sig_light": F.col("signals.light_potential"),
            "sig_visual": F.col("signals.visual_quality"), "sig_character": F.col("signals.nlp_character_score"),
        }
    ).select(*EX_COLS, r6("points"), "why_now")


@query(
    "why_now",
    f"WITH {S.LISTINGS}, {S.EVENTS}, {LATEST} SELECT fx.id, {WHY_SQL} AS why_now FROM fx LEFT JOIN latest le ON le.listing_id = fx.id",
)
def why_now(spark, sf_dir):
    df = J.with_latest(FX.listings(spark, sf_dir), FX.events_of(spark, sf_dir))
    return df.select("id", R.why_now().alias("why_now"))


def _evidence_sql(p) -> str:
    def m(col: str, k: int, word: str = "mentions") -> str:
        return f"list_transform(list_slice({col}, 1, {k}), lambda k: concat('{word} ''', k, ''''))"

    def note(cond: str, text: str) -> str:
        return f"list_filter([CASE WHEN {cond} THEN {text} END], lambda x: x IS NOT NULL)"

    def cat(*parts: str) -> str:
        out = parts[0]
        for part in parts[1:]:
            out = f"list_concat({out}, {part})"
        return out

    dm_hits = f"list_filter(p_amenities, lambda a: {S.any_of('a', ('doorman', 'concierge', 'lobby attendant', 'live-in super'))})"
    ev = {
        "natural_light": cat(m("p_light", 3), note("TRUE", "concat('light potential ', light)"), note("brightness IS NOT NULL", "concat('brightness ', brightness)")),
        "outdoor_space": cat(
            m("p_outdoor", 2), m("p_outdoor_private", 2, "private"), m("p_outdoor_premium", 2, "premium"),
            note("has_outdoor_space_keywords", "'provider outdoor amenity flag'"), m("n_weak_outdoor", 2, "weak"),
        ),
        "character_soul": cat(m("list_concat(p_character, p_quality)", 3), note("year_built <> 0", "concat('year built ', year_built)")),
        "kitchen_quality": m("p_kitchen", 3),
        "pet_friendly": cat(f"CASE WHEN is_pet_friendly THEN ['pet_friendly flag'] ELSE {m('p_pet', 3)} END", note("len(n_no_pets) > 0", "'no pets signal'")),
        "gym_fitness": f"CASE WHEN has_gym_keywords THEN ['gym_fitness flag'] ELSE {m('p_gym', 3)} END",
        "building_quality": cat(
            note("has_building_quality_keywords", "'building_quality flag'"),
            note("nullif(visual_quality_score, 0) IS NOT NULL", "concat('visual quality ', visual_quality_score)"),
            note("len(n_gross_highrise) > 0", "'gross high-rise signal'"),
        ),
        "doorman_concierge": f"CASE WHEN {S.any_of('t', ('no doorman', 'no concierge', 'non-doorman', 'non doorman'))} THEN ['doorman explicitly excluded'] ELSE "
        + cat(note("has_doorman_keywords", "'doorman flag'"), m(dm_hits, 2), note(S.any_of("t", ("24-hour doorman", "full-time doorman")), "'24h/full-time doorman'")) + " END",
        "move_in_ready": cat(m("c_move_in", 2), note("len(n_condition) > 0", "'condition concerns'")),
        "office_space": m("c_office", 3),
        "layout_intelligence": m("c_layout", 2),
        "in_unit_laundry": m("c_laundry", 2),
        "views": note("has_view_keywords", "'view keywords'"),
        "storage": note("has_storage_keywords", "'storage mention'"),
        "high_ceilings": note("s_high_ceilings > 0", "'ceiling keywords'"),
        "parking": note("s_parking > 0", "'parking mention'"),
    }
    cols = ", ".join(f"array_to_string({e}, '|') AS e_{k}" for k, e in ev.items())
    conf = "CASE WHEN len(p_light) >= 2 OR light <> 0 THEN 'high' ELSE 'medium' END"
    quiet_conf = "CASE WHEN quiet IS NULL THEN 'low' ELSE 'high' END"
    return f"{S.score_ctes(p)} SELECT id, {cols}, {conf} AS conf_light, {quiet_conf} AS conf_quiet FROM sc"


EVIDENCE = [
    "natural_light", "outdoor_space", "character_soul", "kitchen_quality", "pet_friendly", "gym_fitness",
    "building_quality", "doorman_concierge", "move_in_ready", "office_space", "layout_intelligence",
    "in_unit_laundry", "views", "storage", "high_ceilings", "parking",
]


@query("score_evidence", _evidence_sql(RENTAL))
def score_evidence(spark, sf_dir):
    from nestrank.operators.signals import stage

    out = stage(FX.listings(spark, sf_dir), RENTAL)
    by_key = {c.key: c for c in SC.CRITERIA}
    return out.select(
        "id", *[joined(by_key[k].evidence(RENTAL)).alias(f"e_{k}") for k in EVIDENCE],
        SC.natural_light_confidence(RENTAL).alias("conf_light"),
        SC.location_quiet_confidence(RENTAL).alias("conf_quiet"),
    )


HARD, SOFT = S.reasons_sql(RENTAL)


@query(
    "score_rows",
    f"{S.score_ctes(RENTAL)} SELECT id, CASE WHEN ok THEN round(points, 6) END AS points, ok AND percent >= 20 AS passes "
    f"FROM (SELECT *, len({HARD}) = 0 AND len({SOFT}) = 0 AS ok FROM pts)",
)
def score_rows(spark, sf_dir):
    out = R.score_rows(FX.listings(spark, sf_dir), RENTAL, 20.0)
    return out.select("id", r6("points"), F.coalesce("passes", F.lit(False)).alias("passes"))


@query(
    "funnel_reasons",
    f"{S.score_ctes(RENTAL)}, f AS (SELECT {HARD} AS h, {SOFT} AS s FROM sc) SELECT step, count(*) AS listings FROM ("
    "SELECT unnest(list_filter(list_concat(list_concat(['stage: all', CASE WHEN len(h) = 0 THEN 'stage: hard filters passed' END, "
    "CASE WHEN len(h) = 0 AND len(s) = 0 THEN 'stage: all filters passed' END], h), s), lambda x: x IS NOT NULL)) AS step FROM f) GROUP BY step",
)
def funnel_reasons(spark, sf_dir):
    return RP.funnel(FX.listings(spark, sf_dir), RENTAL)


CANDIDATES = f"{S.score_ctes(RENTAL)}, cand AS (SELECT * FROM pts WHERE {S.hard_sql(RENTAL)} AND {S.signal_sql(RENTAL)})"


@query(
    "score_distribution",
    f"{CANDIDATES}, v AS (SELECT {S.rnd('percent', 2)} AS v FROM cand) SELECT count(*) AS matches, min(v) AS min_pct, round(quantile_cont(v, 0.25), 6) AS p25_pct, "
    "round(quantile_cont(v, 0.5), 6) AS median_pct, round(quantile_cont(v, 0.75), 6) AS p75_pct, max(v) AS max_pct, "
    "round(sum(CAST(round(v * 100) AS BIGINT)) / count(*) / 100, 6) AS mean_pct FROM v",
)
def score_distribution(spark, sf_dir):
    points = R.with_points(R.candidates(FX.listings(spark, sf_dir), RENTAL), RENTAL)
    out = RP.score_distribution(points.withColumn("percent", SC.score_pct(F.col("points"), RENTAL.total_weight)))
    return out.select("matches", "min_pct", r6("p25_pct"), r6("median_pct"), r6("p75_pct"), "max_pct", r6("mean_pct"))


@query("tier_counts", f"{S.score_ctes(RENTAL)} SELECT {S.TIER} AS tier, count(*) AS listings FROM pts GROUP BY 1")
def tier_counts(spark, sf_dir):
    points = R.with_points(FX.listings(spark, sf_dir), RENTAL)
    return RP.tier_counts(points.withColumn("percent", SC.score_pct(F.col("points"), RENTAL.total_weight)))


@query(
    "criterion_activation",
    f"{CANDIDATES} "
    + " UNION ALL ".join(
        f"SELECT {S.q(k)} AS criterion, {S.num(float(RENTAL.weights.get(k, 0)))} AS weight, count(*) AS listings, count(CASE WHEN s_{k} > 0 THEN 1 END) AS active, "
        f"round(sum(CAST(round(s_{k} * 100) AS BIGINT)) * {S.num(float(RENTAL.weights.get(k, 0)))} / 1000e0 / count(*), 6) AS avg_points, "
        f"round(count(CASE WHEN s_{k} > 0 THEN 1 END) / count(*), 6) AS activation FROM cand"
        for k in KEYS
    ),
)
def criterion_activation(spark, sf_dir):
    out = RP.criterion_activation(R.candidates(FX.listings(spark, sf_dir), RENTAL), RENTAL)
    return out.select("criterion", "weight", "listings", "active", r6("avg_points"), r6("activation"))


@query(
    "top_bottom_criteria",
    f"{S.score_ctes(RENTAL)} SELECT id, array_to_string(list_transform(list_slice(list_sort(["
    + ", ".join(f"struct_pack(neg := -(s_{k} / 10e0 * {S.num(float(RENTAL.weights.get(k, 0)))}), o := {i}, c := {S.q(k)})" for i, k in enumerate(KEYS))
    + "]), 1, 3), lambda e: e.c), '|') AS top3, array_to_string(list_transform(list_slice(list_sort(["
    + ", ".join(f"struct_pack(s := s_{k}, o := {i}, c := {S.q(k)})" for i, k in enumerate(KEYS) if RENTAL.weights.get(k))
    + "]), 1, 3), lambda e: e.c), '|') AS bottom3 FROM sc",
)
def top_bottom_criteria(spark, sf_dir):
    from nestrank.operators.signals import stage

    out = stage(FX.listings(spark, sf_dir), RENTAL).withColumn("fs", R.components(RENTAL, explained=False))
    return out.select(
        "id", joined(R.top_criteria(F.col("fs"))).alias("top3"), joined(R.bottom_criteria(F.col("fs"))).alias("bottom3")
    )


@query(
    "rank_summary",
    f"{CANDIDATES} SELECT (SELECT count(*) FROM pts WHERE {S.hard_sql(RENTAL)}) AS total_analyzed, least(100, (SELECT count(*) FROM cand)) AS matches_shown",
)
def rank_summary(spark, sf_dir):
    return R.rank_summary(FX.listings(spark, sf_dir), RENTAL).select("total_analyzed", "matches_shown")


@query(
    "sorted_workspace",
    f"{CANDIDATES}, m AS (SELECT *, {S.rnd('percent', 1)} AS ms FROM cand), f AS (SELECT * FROM m WHERE ms >= 15 AND coalesce(quiet, 50) >= 60 AND has_outdoor_space_keywords) "
    "SELECT id, row_number() OVER (ORDER BY coalesce(ms, 0) DESC, id) AS by_score, row_number() OVER (ORDER BY coalesce(price, 'Infinity'), id) AS by_price, "
    "row_number() OVER (ORDER BY coalesce(days_on_market, 999), id) AS by_age FROM f",
)
def sorted_workspace(spark, sf_dir):
    p = R.with_points(R.candidates(FX.listings(spark, sf_dir), RENTAL), RENTAL)
    from nestrank.operators.signals import quiet_score

    m = p.select(
        *p.columns, R.sealed({"tranquility_score": quiet_score(p)})
    ).withColumn("match_score", round_half_even(SC.score_pct(F.col("points"), RENTAL.total_weight), 1))
    kept = FL.workspace_filter(m, min_score=15, outdoor_space=True, quiet=True)
    # positions only to compare the orders; the workspace itself sorts and pages
    def place(mode: str, *order):
        return F.row_number().over(Window.orderBy(*order)).alias(mode)

    return kept.select(
        "id", place("by_score", F.coalesce("match_score", F.lit(0.0)).desc(), "id"),
        place("by_price", F.coalesce("price", F.lit(float("inf"))), "id"),
        place("by_age", F.coalesce("days_on_market", F.lit(999)), "id"),
    )


@query(
    "listing_page",
    f"WITH {S.RAW} SELECT id, price FROM raw WHERE price <= 9500 AND beds >= 2 AND baths >= 2 AND sqft >= 550 AND neighborhood IN "
    f"({', '.join(S.q(n) for n in RENTAL.neighborhoods)}) ORDER BY id LIMIT 50 OFFSET 100",
)
def listing_page(spark, sf_dir):
    return FL.listing_page(FX.raw_listings(spark, sf_dir), RENTAL, 100, 50).select("id", "price")


@query(
    "listing_page_large",
    f"WITH {S.RAW} SELECT id, price FROM raw WHERE price <= 9500 AND beds >= 2 AND baths >= 2 AND sqft >= 550 AND neighborhood IN "
    f"({', '.join(S.q(n) for n in RENTAL.neighborhoods)}) ORDER BY id LIMIT 2000",
)
def listing_page_large(spark, sf_dir):
    return FL.listing_page(FX.raw_listings(spark, sf_dir), RENTAL, 0, 2000).select("id", "price")


def _sorted(mode: str, order: str):
    @query(f"sort_{mode}", f"WITH {S.RAW} SELECT id, price, days_on_market FROM raw ORDER BY {order}, id LIMIT 500")
    def run(spark, sf_dir):
        return FL.sort_matches(FX.raw_listings(spark, sf_dir), mode).limit(500).select("id", "price", "days_on_market")

    return run


for _mode, _order in (
    ("price_low", "price ASC NULLS LAST"), ("price_high", "coalesce(price, 0) DESC"), ("newest", "coalesce(days_on_market, 999)"),
):
    _sorted(_mode, _order)

PRESET_FACTS = {
    "walk_score": "CAST(id % 101 AS INT)",
    "property_type": "CASE id % 5 WHEN 0 THEN 'Condo' WHEN 1 THEN 'loft' WHEN 2 THEN 'house' WHEN 3 THEN 'townhouse' END",
}
_PASSES = {
    "light_chaser": "NOT coalesce(is_north_facing_only, FALSE) AND NOT coalesce(is_basement_unit, FALSE)",
    "urban_professional": "walk_score >= 85 AND (property_type IS NULL OR lower(property_type) IN ('condo', 'loft', 'townhouse'))",
    "deal_hunter": "coalesce(days_on_market >= 14, TRUE)",
}


@query(
    "preset_filtered",
    f"WITH {S.LISTINGS}, f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in PRESET_FACTS.items())} FROM fx) "
    + " UNION ALL ".join(f"SELECT '{pid}' AS preset, id FROM f WHERE {cond}" for pid, cond in _PASSES.items()),
)
def preset_filtered(spark, sf_dir):
    facts = FX.listings(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in PRESET_FACTS.items()])
    parts = [
        FL.preset_filtered(facts, FL.preset_filters({}, preset)).select(F.lit(pid).alias("preset"), "id")
        for pid, preset in profile_data.PRESETS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ACTIVE_EXPRS = {
    "id": "c_custkey", "user_id": "c_custkey % 500", "name": "concat('set ', CAST(c_custkey % 7 AS STRING))",
    "is_active": "c_custkey % 5 = 0", "price_max": "CAST(1500 + c_custkey % 2500 AS DOUBLE)",
}


@query(
    "active_criteria",
    "WITH c AS (" + FX.select_sql(ACTIVE_EXPRS, "customer") + "), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_active DESC, id DESC) AS rn FROM c), "
    "u AS (SELECT DISTINCT s_suppkey AS user_id FROM supplier) SELECT u.user_id, id, CASE WHEN id IS NULL THEN 'Default Criteria' ELSE name END AS name, TRUE AS is_active, price_max "
    "FROM u LEFT JOIN (SELECT * FROM r WHERE rn = 1) x ON x.user_id = u.user_id",
)
def active_criteria(spark, sf_dir):
    rows = FX.table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in ACTIVE_EXPRS.items()])
    users = FX.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS user_id")
    return FL.active_criteria(users, rows).select("user_id", "id", "name", "is_active", "price_max")


CRIT_COND = (
    "(c.price_min IS NULL OR l.price >= c.price_min) AND (c.price_max IS NULL OR l.price <= c.price_max) AND (c.beds_min IS NULL OR l.beds >= c.beds_min) "
    "AND l.baths >= c.baths_min AND l.sqft >= c.sqft_min AND (NOT c.require_natural_light OR l.has_natural_light_keywords)"
)


@query(
    "criteria_matches",
    f"WITH {S.LISTINGS}, {S.CRITERIA} SELECT c.id AS criteria_id, count(*) AS listings, min(l.price) AS cheapest, min(l.id) AS first_id "
    f"FROM crit c JOIN fx l ON {CRIT_COND} GROUP BY c.id",
)
def criteria_matches(spark, sf_dir):
    facts = FX.listings(spark, sf_dir).select("id", "price", "beds", "baths", "sqft", "has_natural_light_keywords")
    pairs = J.criteria_matches(facts, FX.criteria(spark, sf_dir))
    return pairs.groupBy("criteria_id").agg(
        F.count(F.lit(1)).alias("listings"), F.min("price").alias("cheapest"), F.min("listing_id").alias("first_id")
    )


# Sale prices: most listings between a half and four million, a ninth at one asking price.
SALE = "CASE WHEN id % 9 = 4 THEN CAST(1250000 AS DOUBLE) ELSE least(CAST(4000000 AS DOUBLE), price * 900) END"
BUYERS = {
    **FX.CRITERIA_EXPRS,
    "price_min": "CASE WHEN c_custkey % 3 = 0 THEN CAST(500000 + 1000 * (c_custkey % 900) AS DOUBLE) END",
    "price_max": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(700000 + 2200 * (c_custkey % 1500) AS DOUBLE) END",
    "beds_min": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(2 + c_custkey % 3 AS INT) END",
}


@query(
    "criteria_matches_buy",
    f"WITH {S.LISTINGS}, sale AS (SELECT id, beds, baths, sqft, has_natural_light_keywords, {SALE} AS price FROM fx), "
    f"crit AS ({FX.select_sql(BUYERS, 'customer')}) SELECT c.id AS criteria_id, count(*) AS listings, min(l.price) AS cheapest, "
    f"max(l.price) AS dearest, min(l.id) AS first_id FROM crit c JOIN sale l ON {CRIT_COND} GROUP BY c.id",
)
def criteria_matches_buy(spark, sf_dir):
    facts = FX.listings(spark, sf_dir).selectExpr("id", "beds", "baths", "sqft", "has_natural_light_keywords", f"{SALE} AS price")
    buyers = FX.table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in BUYERS.items()])
    return J.criteria_matches(facts, buyers).groupBy("criteria_id").agg(
        F.count(F.lit(1)).alias("listings"), F.min("price").alias("cheapest"), F.max("price").alias("dearest"),
        F.min("listing_id").alias("first_id"),
    )


@query(
    "criteria_filter",
    f"WITH {S.LISTINGS} SELECT id, price FROM fx WHERE price >= 2000 AND price <= 9000 AND beds >= 3 AND baths >= 1.5 AND has_natural_light_keywords",
)
def criteria_filter(spark, sf_dir):
    limits = {"price_min": 2000.0, "price_max": 9000.0, "beds_min": 3, "baths_min": 1.5, "sqft_min": None, "require_natural_light": True}
    return FL.criteria_filter(FX.listings(spark, sf_dir), limits).select("id", "price")


@query(
    "validated_criteria",
    "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Potrero Hill' WHEN 1 THEN 'Cole Valley|SoHo' WHEN 2 THEN '' ELSE NULL END AS preferred, "
    "CASE WHEN c_custkey % 5 = 0 THEN CAST(1000 + c_custkey AS DOUBLE) ELSE least(CAST(3000 AS DOUBLE), CAST(1000 + c_custkey AS DOUBLE)) END AS soft, "
    "CASE c_custkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'boost' END AS mode FROM customer",
)
def validated_criteria(spark, sf_dir):
    raw = FX.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE c_custkey % 4 WHEN 0 THEN array('potrero', 'brooklyn', 'Potrero Hill') WHEN 1 THEN array('Cole', ' SoHo ') WHEN 2 THEN array('nyc') END AS preferred_neighborhoods",
        "CAST(NULL AS array<string>) AS avoid_neighborhoods",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(3000 AS DOUBLE) END AS price_max",
        "CAST(1000 + c_custkey AS DOUBLE) AS price_soft_max",
        "CASE c_custkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'boost' ELSE 'odd' END AS neighborhood_mode",
        "'fresh' AS recency_mode",
    )
    out = FL.validate_criteria(raw)
    return out.select(
        "id", joined("preferred_neighborhoods").alias("preferred"), F.col("price_soft_max").alias("soft"),
        F.col("neighborhood_mode").alias("mode"),
    )


# --- per-user ranking ----------------------------------------------------------
USER_FACTOR = "(1 + ((c_custkey * {m}) % 7) / 10e0)"
MIX = {k: 3 + 2 * i for i, k in enumerate(RENTAL.weights)}


def _user_weight_sql(key: str) -> str:
    return f"({S.num(float(RENTAL.weights[key]))} * (1 + ((c_custkey % 12) * {MIX[key]}) % 7))"


@query(
    "rank_per_user",
    f"{CANDIDATES}, u AS (SELECT c_custkey AS user_id, c_custkey % 12 AS g, {' + '.join(_user_weight_sql(k) for k in RENTAL.weights)} AS total, "
    + ", ".join(f"{_user_weight_sql(k)} AS w_{k}" for k in RENTAL.weights)
    + " FROM customer), kinds AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY g ORDER BY user_id) = 1), "
    + "raw_pts AS (SELECT g, id, round_even(greatest(0e0, "
    + " + ".join(f"s_{k} / 10e0 * w_{k}" for k in KEYS if k in RENTAL.weights)
    + " - price_pen) * 1e6, 0) / 1e6 AS points FROM kinds CROSS JOIN cand), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY points DESC, id) AS rank FROM raw_pts) "
    "SELECT user_id, CAST(rank AS INTEGER) AS rank, id, round(points, 4) AS points, round(points / total * 100, 4) AS percent FROM ranked JOIN u USING (g) WHERE rank <= 10",
)
def rank_per_user(spark, sf_dir):
    users = FX.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("criterion"),
                (F.lit(float(w)) * (F.lit(1) + (F.col("user_id") % 12) * MIX[k] % 7)).alias("weight"),
            )
            for k, w in RENTAL.weights.items()
        ]
    )
    weights = users.select("user_id", F.inline(entries))
    out = R.rank_per_user(FX.listings(spark, sf_dir), RENTAL, weights, 10, digits=6)  # as the SQL rounds
    return out.select(
        "user_id", "rank", "id", F.round("points", 4).alias("points"), F.round("percent", 4).alias("percent")
    )


def _vector_sql(key: str) -> str:
    i = list(RENTAL.weights).index(key)
    return f"CAST({float(RENTAL.weights[key])!r} AS DOUBLE) * (1 + (o_orderkey * {MIX[key]} + o_orderkey / {i + 2}) % 97)"


def _vectors_duck(key: str) -> str:
    return _vector_sql(key).replace(" / ", " // ")


@query(
    "rank_many_users",
    f"{CANDIDATES}, u AS (SELECT o_orderkey AS user_id, {' + '.join(_vectors_duck(k) for k in RENTAL.weights)} AS total, "
    + ", ".join(f"{_vectors_duck(k)} AS w_{k}" for k in RENTAL.weights)
    + " FROM orders), s AS (SELECT user_id, total, id, greatest(0e0, "
    + " + ".join(f"s_{k} / 10e0 * w_{k}" for k in KEYS if k in RENTAL.weights)
    + " - price_pen) AS points FROM u CROSS JOIN cand), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, id) AS rank FROM s QUALIFY rank <= 5) "
    "SELECT user_id, CAST(rank AS INTEGER) AS rank, id, round(points, 6) AS points, round(points / total * 100, 6) AS percent FROM ranked",
)
def rank_many_users(spark, sf_dir):
    """Every order is a user with weights of its own: as many vectors as listings."""
    entries = F.array(*[
        F.struct(F.lit(k).alias("criterion"), F.expr(_vector_sql(k).replace(" / ", " div ")).alias("weight")) for k in RENTAL.weights
    ])
    weights = FX.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("user_id"), F.inline(entries))
    out = R.rank_per_user(FX.listings(spark, sf_dir), RENTAL, weights, 5)
    return out.select("user_id", "rank", "id", F.round("points", 6).alias("points"), F.round("percent", 6).alias("percent"))


def _preset_sql() -> str:
    def rows(table):
        return ", ".join(f"({S.q(p)}, {S.q(c)}, {S.num(float(w))})" for p, c, w in table)

    presets = [(pid, c, w) for pid, d in profile_data.PRESETS.items() for c, w in d["weights"].items()]
    base = ", ".join(f"({S.q(c)}, {S.num(float(w))})" for c, w in profile_data.DEFAULT_FEATURE_WEIGHTS.items())
    return (
        f"WITH p(preset_id, criterion, weight) AS (VALUES {rows(presets)}), b(criterion, weight) AS (VALUES {base}), "
        "seg AS (SELECT DISTINCT c_mktsegment AS profile_id FROM customer), ids AS (SELECT DISTINCT preset_id FROM p), "
        "keys AS (SELECT preset_id, criterion FROM ids CROSS JOIN b UNION SELECT preset_id, criterion FROM p) "
        "SELECT profile_id, k.preset_id, k.criterion, coalesce(p.weight, b.weight) AS weight FROM seg CROSS JOIN keys k "
        "LEFT JOIN p ON p.preset_id = k.preset_id AND p.criterion = k.criterion LEFT JOIN b ON b.criterion = k.criterion"
    )


@query("preset_weights", _preset_sql())
def preset_weights(spark, sf_dir):
    segments = FX.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("profile_id")).distinct()
    entries = F.array(
        *[F.struct(F.lit(c).alias("criterion"), F.lit(float(w)).alias("weight")) for c, w in profile_data.DEFAULT_FEATURE_WEIGHTS.items()]
    )
    presets = spark.createDataFrame(
        [(pid, c, float(w)) for pid, d in profile_data.PRESETS.items() for c, w in d["weights"].items()],
        "preset_id string, criterion string, weight double",
    )
    return LE.apply_presets(segments.select("profile_id", F.inline(entries)), presets)


def _preset_hits_sql() -> str:
    cols = []
    for pid, d in profile_data.PRESETS.items():
        for side in ("boost", "penalize"):
            cols.append(f"len({S.hits('t', d[side])}) AS {pid}_{side}")
    return f"SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"


@query("preset_hits", _preset_hits_sql())
def preset_hits(spark, sf_dir):
    from nestrank.functions.text import TermIndex, lowered

    groups = {f"{pid}_{side}": d[side] for pid, d in profile_data.PRESETS.items() for side in ("boost", "penalize")}
    index = TermIndex(groups)
    docs = index.with_words(FX.table(spark, sf_dir, "documents"), lowered(F.col("text")))
    return docs.select("doc_id", *[index.count(g).cast("long").alias(g) for g in groups])


@query(
    "display_columns",
    f"WITH {S.LISTINGS} SELECT id, CASE WHEN price IS NULL THEN 'Price n/a' WHEN price >= 1000000 THEN 'x' ELSE concat('$', "
    "CASE WHEN price >= 1000 THEN concat(CAST(CAST(price AS BIGINT) // 1000 AS VARCHAR), ',', lpad(CAST(CAST(price AS BIGINT) % 1000 AS VARCHAR), 3, '0')) ELSE CAST(CAST(price AS BIGINT) AS VARCHAR) END) END AS price_text, "
    "array_to_string(list_filter([CASE WHEN has_natural_light_keywords THEN 'Natural Light' END, CASE WHEN has_high_ceiling_keywords THEN 'High Ceilings' END, "
    "CASE WHEN has_outdoor_space_keywords THEN 'Outdoor Space' END, CASE WHEN has_parking_keywords THEN 'Parking' END, CASE WHEN has_view_keywords THEN 'Views' END, "
    "CASE WHEN has_updated_systems_keywords THEN 'Updated Systems' END, CASE WHEN has_architectural_details_keywords THEN 'Character' END], lambda x: x IS NOT NULL), '|') AS tags, "
    "concat(source, ':', source_listing_id) AS built_id, CASE WHEN len(photos) = 0 THEN '' ELSE sha256(concat('[\"', array_to_string(list_sort(photos), '\", \"'), '\"]')) END AS photos_hash, "
    "sha256(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS text_hash, "
    "concat(upper(substr('unit', 1, 1)), substr('unit', 2), ' ', id, ' #', id % 40) AS url_address, concat('https://example.com/building/unit-', id, '/', id % 40) AS clean_url FROM fx",
)
def display_columns(spark, sf_dir):
    url = CO.canonical_url(F.col("url"), "example.com", CO.UNIT_PATH)
    return FX.listings(spark, sf_dir).select(
        "id", CO.format_price(F.col("price")).alias("price_text"), joined(CO.feature_tags()).alias("tags"),
        CO.build_listing_id(F.col("source"), F.col("source_listing_id")).alias("built_id"),
        CO.photos_hash(F.col("photos")).alias("photos_hash"), CO.text_hash(F.col("description")).alias("text_hash"),
        CO.address_from_unit_url(url).alias("url_address"), url.alias("clean_url"),
    )


@query(
    "signal_values",
    f"WITH {S.RAW} SELECT id, concat_ws('|', concat('Light=', CAST({S.rnd('light_score / 10e0', 1)} AS VARCHAR)), CASE WHEN visual_quality_score IS NOT NULL THEN concat('Visual=', CAST({S.rnd('visual_quality_score / 10e0', 1)} AS VARCHAR)) END) AS shown "
    "FROM (SELECT *, CAST(id % 101 AS INTEGER) AS light_score FROM raw)",
)
def signal_values(spark, sf_dir):
    none = F.lit(None).cast("double")
    signals = F.struct(*[none.alias(n) for n in ("tranquility_score", "light_potential", "visual_quality", "nlp_character_score")])
    values = CO.signal_values(signals, F.col("id") % 101, F.lit(None).cast("int"), F.col("visual_quality_score"))
    shown = F.transform(values, lambda v: F.concat(v.label, F.lit("="), v.value.cast("string")))
    return FX.raw_listings(spark, sf_dir).select("id", joined(shown).alias("shown"))


@query(
    "needs_visual",
    f"WITH {S.RAW}, h AS (SELECT *, CASE WHEN n_photos = 0 THEN '' ELSE sha256(concat('[\"', array_to_string(list_sort(photos), '\", \"'), '\"]')) END AS ph FROM raw) "
    "SELECT id, least(n_photos, 3) AS images FROM h WHERE n_photos > 0 AND (id % 4 = 0 OR id % 4 = 1 OR (id % 100) > 30)",
)
def needs_visual(spark, sf_dir):
    df = FX.raw_listings(spark, sf_dir)
    known = F.when(F.col("id") % 4 == 0, F.lit(None).cast("string")).when(F.col("id") % 4 == 1, F.lit("old")).otherwise(CO.photos_hash(F.col("photos")))
    now = F.to_timestamp(F.lit(FX.NOW))
    analyzed = F.timestamp_seconds(F.unix_timestamp(now) - (F.col("id") % 100) * 86400)
    queue = RP.visual_queue(df.withColumns({"photos_hash": known, "visual_analyzed_at": analyzed}), now)
    return queue.select("id", F.least(F.size("photos"), F.lit(3)).alias("images"))


@query("hood_counts", f"WITH {S.RAW}, n AS (SELECT coalesce(nullif(neighborhood, ''), 'Unknown') AS hood FROM raw) SELECT hood, count(*) AS matches FROM n GROUP BY 1 UNION ALL SELECT 'All', count(*) FROM n")
def hood_counts(spark, sf_dir):
    return RP.hood_counts(FX.raw_listings(spark, sf_dir))


@query("source_counts", f"WITH {S.RAW} SELECT source, count(*) AS listings FROM raw GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM raw")
def source_counts(spark, sf_dir):
    return RP.source_counts(FX.raw_listings(spark, sf_dir))
