"""One explicit DDL schema per table; sources are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _ddl(spec: str) -> str:
    return " ".join(spec.split())


def struct_of(table: str) -> T.StructType:
    """Parsed schema of a table; parsing needs a running session."""
    return T.StructType.fromDDL(TABLES[table])


# Flag name -> listing column it fills.  Fixed values.
FLAG_COLUMNS = {
    "natural_light": "has_natural_light_keywords",
    "high_ceilings": "has_high_ceiling_keywords",
    "outdoor_space": "has_outdoor_space_keywords",
    "parking": "has_parking_keywords",
    "view": "has_view_keywords",
    "updated_systems": "has_updated_systems_keywords",
    "home_office": "has_home_office_keywords",
    "storage": "has_storage_keywords",
    "open_floor_plan": "has_open_floor_plan_keywords",
    "architectural_details": "has_architectural_details_keywords",
    "luxury": "has_luxury_keywords",
    "designer": "has_designer_keywords",
    "tech_ready": "has_tech_ready_keywords",
    "pet_friendly": "is_pet_friendly",
    "no_pets": "is_no_pets",
    "gym_fitness": "has_gym_keywords",
    "doorman_concierge": "has_doorman_keywords",
    "building_quality": "has_building_quality_keywords",
    "busy_street": "has_busy_street_keywords",
    "foundation_issues": "has_foundation_issues_keywords",
    "hoa_issues": "has_hoa_issues_keywords",
    "price_reduced": "is_price_reduced",
    "back_on_market": "is_back_on_market",
    "north_facing_only": "is_north_facing_only",
    "basement_unit": "is_basement_unit",
}

# Flags that a text can only set, never clear.
SET_ONLY_FLAGS = ("price_reduced", "back_on_market")

_FLAG_DDL = ", ".join(f"{c} boolean" for c in FLAG_COLUMNS.values())
_PLACE = "struct<name: string, distance_m: double>"

LISTINGS = _ddl(
    f"""
    id bigint, listing_id string, source string, source_listing_id string,
    sources_seen array<string>, last_seen_at timestamp, address string, price double,
    beds int, baths double, sqft int, property_type string, url string, lat double,
    lon double, year_built int, listing_status string, description string,
    status string, days_on_market int, {_FLAG_DDL},
    price_reduction_amount double, price_reduction_date timestamp,
    neighborhood string, walk_score int, transit_score int, bike_score int,
    parking_type string, parking_spaces int, has_ev_charging boolean, hoa_fee double,
    hoa_includes array<string>, lot_size int, stories int, architectural_style string,
    listing_agent string, listing_brokerage string, match_score double,
    feature_scores array<struct<ord: int, criterion: string, score: double,
      weight: double, evidence: array<string>, confidence: string>>,
    tranquility_score int,
    tranquility_factors struct<nearest_busy_street: {_PLACE},
      nearest_freeway: {_PLACE}, nearest_fire_station: {_PLACE}>,
    light_potential_score int, light_potential_signals array<string>,
    visual_quality_score int,
    visual_assessment struct<dimensions: map<string, int>, red_flags: array<string>,
      highlights: array<string>, photos_analyzed: int, confidence: string>,
    photos_hash string, visual_analyzed_at timestamp, photos array<string>,
    last_updated timestamp
    """
)

SNAPSHOTS = _ddl(
    """
    id bigint, listing_id bigint, snapshot_hash string, snapshot_data struct<price: double,
      listing_status: string, days_on_market: int, photos_hash: string,
      description_hash: string>, created_at timestamp
    """
)
LISTING_EVENTS = _ddl(
    """
    id bigint, listing_id bigint, event_type string, old_price double, new_price double,
    old_text string, new_text string, amount double, percent double, created_at timestamp
    """
)
FEEDBACK = _ddl(
    "user_id bigint, listing_id bigint, feedback_type string, ts timestamp"
)
LEARNED_WEIGHTS = _ddl(
    "user_id bigint, criterion string, multiplier double, signal_count bigint, "
    "last_updated timestamp"
)
CRITERIA = _ddl(
    """
    id bigint, user_id bigint, name string, is_active boolean, price_min double,
    price_max double, price_soft_max double, beds_min int, beds_max int,
    baths_min double, sqft_min int, sqft_max int, require_natural_light boolean,
    require_high_ceilings boolean, require_outdoor_space boolean,
    require_parking boolean, require_view boolean, require_updated_systems boolean,
    require_home_office boolean, min_walk_score int, property_types array<string>,
    preferred_neighborhoods array<string>, avoid_neighborhoods array<string>,
    neighborhood_mode string, recency_mode string, excluded_streets array<string>,
    avoid_busy_streets boolean, avoid_north_facing_only boolean,
    avoid_basement_units boolean, feature_weights map<string, int>
    """
)
SCOUTS = _ddl(
    """
    scout_id bigint, user_id bigint, name string, is_active boolean,
    alert_frequency string, min_match_score double, max_results_per_alert int,
    last_run timestamp
    """
)
SCOUT_RUNS = _ddl(
    """
    id bigint, scout_id bigint, started_at timestamp, completed_at timestamp,
    status string, listings_evaluated bigint, matches_found bigint, new_matches bigint,
    top_score double, average_score double
    """
)
INGESTION_RUNS = _ddl(
    """
    run_id string, started_at timestamp, ended_at timestamp, summary_count bigint,
    detail_calls bigint, upsert_count bigint, error string
    """
)

TABLES = {
    "property_listings": LISTINGS,
    "snapshots": SNAPSHOTS,
    "listing_events": LISTING_EVENTS,
    "feedback": FEEDBACK,
    "learned_weights": LEARNED_WEIGHTS,
    "criteria": CRITERIA,
    "scouts": SCOUTS,
    "scout_runs": SCOUT_RUNS,
    "ingestion_runs": INGESTION_RUNS,
}
