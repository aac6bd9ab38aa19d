"""Small fixed catalogs: statuses, baselines, plans, layer field names, keywords.

Everything in this module is configuration of constant size, so the DataFrames made from it
are literal tables that Catalyst can fold and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_literal(v: object) -> str:
    """One Python constant as SQL text understood by Spark and by ANSI engines."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(sql_literal(x) for x in v) + ")"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows: Sequence[Sequence[object]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)


def literal_table(spark: SparkSession, rows: Sequence[Sequence[object]], ddl: str) -> DataFrame:
    """A constant table with the given ``name type, ...`` schema."""
    cols = [c.strip().split(" ", 1) for c in _split_ddl(ddl)]
    names = ", ".join(n for n, _ in cols)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in cols)
    return spark.sql(f"SELECT {casts} FROM ({values_sql(rows)}) AS t({names})")


def _split_ddl(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


# --- Fixed values: engine versions and the disclaimer, emitted verbatim ------------------
ANALYSIS_VERSION = "1.0.0"
RULES_VERSION = "1.0.0"
STATE_BASELINE_VERSION = "2024.01"
DISCLAIMER = (
    "This is preliminary informational zoning and GIS analysis, not legal, "
    "architectural, surveying, engineering, title, environmental, or permit "
    "advice. Verify all results with the applicable jurisdiction and qualified "
    "professionals before making decisions or spending money."
)

# --- Fixed values: enumerations ----------------------------------------------------------
PROJECT_TYPES = ["detached_adu", "attached_adu", "garage_conversion", "jadu", "sb9_duplex", "sb9_urban_lot_split"]
SB9_PROJECT_TYPES = ["sb9_duplex", "sb9_urban_lot_split"]
COVERAGE = ["planned", "ingesting", "production", "deprecated"]
FEASIBILITY = ["likely_feasible", "likely_constrained", "needs_professional_review", "insufficient_data"]
BILLABLE = ["likely_feasible", "likely_constrained", "needs_professional_review"]
FLAGS = ["matches_state_baseline", "possibly_more_restrictive_than_state_baseline", "needs_review", "not_applicable"]
MATCHES, RESTRICTIVE, REVIEW, NOT_APPLICABLE = FLAGS
CONFIDENCE = ["high", "medium", "low"]
DATA_STATUS = ["current", "stale", "needs_review", "unavailable"]
OPERATORS = ["gte", "lte", "eq", "must_equal", "floor", "ceiling"]
OVERLAY_TYPES = ["flood", "fire", "historic", "coastal", "hillside", "environmental", "hpoz", "other"]
HAZARD_TYPES = ["flood", "fire", "coastal", "hillside"]
EXPECTED_OVERLAYS = ["flood", "fire"]
SFHA_ZONES = ["A", "AE", "AH", "AO", "AR", "A99", "V", "VE"]
SINGLE_FAMILY_PREFIXES = ["R1", "RS", "RE", "RA", "RW1", "RD"]
MULTI_FAMILY_PREFIXES = ["R2", "R3", "R4", "R5", "RAS"]

# --- Fixed values: address token abbreviations -------------------------------------------
DIRECTIONALS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
SUFFIXES = {
    "STREET": "ST", "ST": "ST", "AVENUE": "AVE", "AVE": "AVE", "BOULEVARD": "BLVD", "BLVD": "BLVD",
    "ROAD": "RD", "RD": "RD", "DRIVE": "DR", "DR": "DR", "LANE": "LN", "LN": "LN", "COURT": "CT",
    "CT": "CT", "PLACE": "PL", "PL": "PL", "TERRACE": "TER", "WAY": "WAY", "CIRCLE": "CIR",
    "CIR": "CIR", "HIGHWAY": "HWY", "PARKWAY": "PKWY",
}
ADDRESS_TOKENS = {**DIRECTIONALS, **SUFFIXES}

# --- Fixed values: error codes and their HTTP status -------------------------------------
ERROR_STATUS = {
    "validation_error": 400, "unauthorized": 401, "forbidden": 403, "not_found": 404,
    "idempotency_key_conflict": 409, "unsupported_coverage": 422, "quota_exceeded": 429,
    "rate_limited": 429, "internal_error": 500,
}

# --- Fixed values: changelog entry types shown to readers --------------------------------
CHANGELOG_TYPES = {
    "coverage": "coverage_change", "rule_update": "rule_update", "source_update": "source_refreshed",
    "correction": "correction", "release": "source_ingested", "other": "correction",
}

# --- Fixed values: metering plans --------------------------------------------------------
# plan, slug, monthly quota of billed analyses, requests per minute, share tokens
PLANS = [
    ("BASIC", "basic", 3, 10, False),
    ("PRO", "pro", 50, 30, True),
    ("ULTRA", "ultra", 250, 60, True),
    ("MEGA", "mega", 750, 120, True),
]
PLANS_DDL = "plan string, slug string, monthly_quota int, rate_limit int, share_token boolean"
DEFAULT_PLAN = "BASIC"
DEFAULT_RATE_LIMIT = 60
LEGACY_TIERS = {"free": 50, "starter": 1000, "pro": 10000, "enterprise": 2147483647}
DEDUPE_HOURS = 24

# --- Fixed values: authority of a source kind, 1 is strongest ----------------------------
AUTHORITY_RANK = {
    "state_law": 1, "municipal_code": 2, "gis_parcel": 2, "gis_zoning": 2, "gis_overlay": 3,
    "state_guidance": 4, "gis_zoning_bootstrap": 5,
}

# --- Fixed values: state-law baselines used when answering requests ----------------------
# field, project types, operator, number, boolean, conditional, unit, citation, effective from
STATE_BASELINES = [
    ("max_height_detached_standard_ft", ["detached_adu"], "floor", 16.0, None, None, "ft", "AB 2221 (Gov Code 66323)", "2023-01-01"),
    ("max_height_near_transit_ft", ["detached_adu", "attached_adu"], "floor", 18.0, None, None, "ft", "AB 2221 / SB 897 (Gov Code 66323)", "2023-01-01"),
    ("max_height_multifamily_lot_ft", ["detached_adu"], "floor", 18.0, None, None, "ft", "AB 2221 (Gov Code 66323)", "2023-01-01"),
    ("max_height_attached_ft", ["attached_adu"], "ceiling", 25.0, None, None, "ft", "AB 2221 (Gov Code 66323)", "2023-01-01"),
    ("side_rear_setback_min_ft", ["detached_adu", "attached_adu", "garage_conversion"], "ceiling", 4.0, None, None, "ft", "AB 2221 (Gov Code 66323)", "2023-01-01"),
    ("front_setback_restriction", ["detached_adu", "attached_adu"], "must_equal", None, False, None, None, "AB 2221 (Gov Code 66323)", "2023-01-01"),
    ("owner_occupancy_required_adu", ["detached_adu", "attached_adu", "garage_conversion"], "must_equal", None, False, None, None, "Gov Code 66315 / 66323", "2020-01-01"),
    ("owner_occupancy_required_jadu", ["jadu"], "eq", None, None, '{"conditional": true, "condition": "owner occupancy required unless shared sanitation exemption applies"}', None, "Gov Code 66333(b)", "2020-01-01"),
    ("jadu_allowed", ["jadu"], "must_equal", None, True, None, None, "Gov Code 66333", "2020-01-01"),
    ("jadu_separate_sale_allowed", ["jadu"], "must_equal", None, False, None, None, "Gov Code 66333(c)(1)", "2020-01-01"),
    ("parking_required", ["detached_adu", "attached_adu", "garage_conversion", "jadu"], "must_equal", None, False, None, None, "SB 897 (Gov Code 66314/66323)", "2023-01-01"),
    ("demolition_permit_concurrent", ["garage_conversion", "detached_adu", "attached_adu"], "must_equal", None, True, None, None, "SB 897 (Gov Code 66323)", "2023-01-01"),
    ("permit_review_days", ["detached_adu", "attached_adu", "garage_conversion", "jadu"], "lte", 60.0, None, None, "days", "SB 897 / AB 2221 (Gov Code 66317)", "2023-01-01"),
    ("fire_sprinkler_trigger", ["detached_adu", "attached_adu", "garage_conversion", "jadu"], "must_equal", None, False, None, None, "SB 897 (Gov Code 66323)", "2023-01-01"),
    ("impact_fee_exempt_sqft_threshold", ["detached_adu", "attached_adu", "garage_conversion", "jadu"], "eq", 750.0, None, None, "sqft", "AB 68 / SB 13 (Gov Code 66324)", "2020-01-01"),
    ("max_size_sqft_1br", ["detached_adu", "attached_adu"], "gte", 850.0, None, None, "sqft", "Gov Code 66323", "2020-01-01"),
    ("max_size_sqft_2br", ["detached_adu", "attached_adu"], "gte", 1000.0, None, None, "sqft", "Gov Code 66323", "2020-01-01"),
    ("max_size_sqft_general_cap", ["detached_adu", "attached_adu"], "gte", 1200.0, None, None, "sqft", "Gov Code 66323", "2020-01-01"),
    ("nonconforming_zoning_denial_allowed", ["detached_adu", "attached_adu", "garage_conversion", "jadu"], "must_equal", None, False, None, None, "SB 897 (Gov Code 66314)", "2023-01-01"),
    ("pre_2018_unpermitted_adu_amnesty", ["detached_adu", "attached_adu", "garage_conversion", "jadu"], "must_equal", None, True, None, None, "SB 897 (Gov Code 66332)", "2023-01-01"),
    ("sb9_duplex_ministerial", ["sb9_duplex"], "must_equal", None, True, None, None, "SB 9 (Gov Code 65852.21)", "2022-01-01"),
    ("sb9_lot_split_min_lot_sqft", ["sb9_urban_lot_split"], "gte", 1200.0, None, None, "sqft", "SB 9 (Gov Code 66411.7)", "2022-01-01"),
    ("sb9_lot_split_ratio", ["sb9_urban_lot_split"], "gte", 0.4, None, None, "ratio", "SB 9 (Gov Code 66411.7)", "2022-01-01"),
    ("sb9_one_split_per_owner", ["sb9_urban_lot_split"], "must_equal", None, True, None, None, "SB 9 (Gov Code 66411.7)", "2022-01-01"),
]
BASELINES_DDL = (
    "field_name string, applies_to array<string>, operator string, num double, bool boolean, "
    "json string, unit string, legal_citation string, effective_from date"
)
BASELINE_URL = "https://www.hcd.ca.gov/building-standards/adu/handbook"
BASELINE_TITLE = "HCD ADU Handbook"

# --- Fixed values: field catalog used by the offline validation job ----------------------
# field, data type, kind, number, boolean, restrictive value, unit, law, project types
_BUILD = ["detached_adu", "attached_adu", "garage_conversion"]
_ADU = ["detached_adu", "attached_adu", "garage_conversion", "jadu"]
FIELD_CATALOG = [
    ("max_height_detached_standard_ft", "numeric", "floor", 16.0, None, None, "ft", "AB 2221 (2023)", ["detached_adu", "garage_conversion"]),
    ("max_height_near_transit_ft", "numeric", "floor", 18.0, None, None, "ft", "AB 2221 / SB 897", ["detached_adu", "attached_adu"]),
    ("max_height_multifamily_lot_ft", "numeric", "floor", 18.0, None, None, "ft", "AB 2221 (2023)", ["detached_adu", "attached_adu"]),
    ("max_height_attached_ft", "numeric", "floor", 25.0, None, None, "ft", "AB 2221 (2023)", ["attached_adu"]),
    ("side_rear_setback_min_ft", "numeric", "ceiling", 4.0, None, None, "ft", "AB 2221 / 2020 ADU law", _BUILD),
    ("front_setback_restriction", "boolean", "must_equal", None, False, True, None, "AB 2221", _BUILD),
    ("owner_occupancy_required_adu", "boolean", "must_equal", None, False, True, None, "Gov. Code 66315 / 66323", _BUILD),
    ("owner_occupancy_required_jadu", "boolean", "conditional", None, False, None, None, "Gov. Code 66333(b)", ["jadu"]),
    ("jadu_allowed", "boolean", "must_equal", None, True, False, None, "Gov. Code 66333(a),(d),(f)", ["jadu"]),
    ("jadu_separate_sale_allowed", "boolean", "must_equal", None, False, None, None, "Gov. Code 66333(c)(1)", ["jadu"]),
    ("adu_condo_sale_allowed", "boolean", "informational", None, None, None, None, "AB 1033 (2023)", _BUILD),
    ("parking_required", "boolean", "conditional", None, False, None, None, "SB 897", _ADU),
    ("demolition_permit_concurrent", "boolean", "must_equal", None, True, False, None, "SB 897", _BUILD),
    ("permit_review_days", "numeric", "ceiling", 60.0, None, None, "days", "SB 897 / AB 2221", _ADU),
    ("fire_sprinkler_trigger", "boolean", "must_equal", None, False, True, None, "SB 897", _ADU),
    ("impact_fee_exempt_sqft_threshold", "numeric", "floor", 750.0, None, None, "sqft", "AB 68 / SB 13", _BUILD),
    ("max_size_sqft_1br", "numeric", "floor", 850.0, None, None, "sqft", "Gov. Code ADU statute", ["detached_adu", "attached_adu"]),
    ("max_size_sqft_2br", "numeric", "floor", 1000.0, None, None, "sqft", "Gov. Code ADU statute", ["detached_adu", "attached_adu"]),
    ("max_size_sqft_general_cap", "numeric", "floor", 800.0, None, None, "sqft", "Gov. Code ADU statute", _BUILD),
    ("nonconforming_zoning_denial_allowed", "boolean", "must_equal", None, False, True, None, "SB 897", _ADU),
    ("pre_2018_unpermitted_adu_amnesty", "boolean", "must_equal", None, True, False, None, "SB 897", _ADU),
    ("sb9_duplex_ministerial", "boolean", "must_equal", None, True, False, None, "SB 9 / Gov. Code 65852.21", ["sb9_duplex"]),
    ("sb9_lot_split_min_lot_sqft", "numeric", "ceiling", 1200.0, None, None, "sqft", "SB 9 / Gov. Code 66411.7", ["sb9_urban_lot_split"]),
    ("sb9_lot_split_ratio", "numeric", "ceiling", 0.4, None, None, "ratio", "SB 9 / Gov. Code 66411.7", ["sb9_urban_lot_split"]),
    ("sb9_one_split_per_owner", "boolean", "must_equal", None, True, None, None, "SB 9 / Gov. Code 66411.7", ["sb9_urban_lot_split"]),
]
CATALOG_DDL = (
    "field_name string, dtype string, kind string, num double, bool boolean, "
    "restrictive boolean, unit string, law string, project_types array<string>"
)
FIELD_NAMES = [f[0] for f in FIELD_CATALOG]
KIND_OPERATOR = {"floor": "floor", "ceiling": "ceiling", "must_equal": "must_equal", "conditional": "eq"}

# --- Fixed values: keywords that mark a section as relevant ------------------------------
SECTION_KEYWORDS = [
    "accessory dwelling unit", "junior accessory dwelling", "accessory dwelling", " adu", "adu ", "(adu)",
    "jadu", "in-law unit", "second unit", "residential zoning district", "residential zone",
    "urban lot split", "two-unit",
]
SEARCH_PHRASES = ["accessory dwelling unit", "junior accessory dwelling unit", "ADU", "JADU"]
# slug, search terms, chapter fragments
JURISDICTION_HINTS = [
    ("los_angeles", ["12.22", "accessory dwelling unit", "SB 9", "urban lot split"], ["12.22", "12.24", "12.03"]),
    ("san_diego", ["accessory dwelling unit", "junior accessory dwelling unit", "Chapter 14 Article 1 Division 3"], ["14", "141", "142"]),
    ("san_francisco", ["accessory dwelling unit", "in-law unit", "207"], ["207", "102"]),
    ("sacramento", ["accessory dwelling unit", "Title 17", "17.228"], ["17.108", "17.228", "17.812"]),
    ("san_jose", ["Part 4.5 Accessory Dwelling Units", "accessory dwelling unit", "20.30.46"], ["20.30.460", "20.30.470", "20.30.480", "20.30.490", "20.30.495", "20.30"]),
    ("irvine", ["accessory dwelling unit", "Title 5 zoning"], ["5"]),
    ("long_beach", ["accessory dwelling unit", "Title 21", "21.41"], ["21.41", "21.45", "21.52"]),
    ("oakland", ["accessory dwelling unit", "Chapter 17.103", "residential zoning regulations"], ["17.103", "17.09", "17.10"]),
]
HINTS_DDL = "slug string, search_terms array<string>, chapters array<string>"
SECTION_CAP = 25
MIN_SECTION_CHARS = 50

# --- Fixed values: attribute names tried per city layer, first present wins --------------
# slug, layer kind, layer, output field, candidate attribute names
_LA_PARCEL = [("apn", ["APN", "AIN", "ain"]), ("situs", ["SitusFullAddress", "SitusAddress", "situs_address"])]
LAYER_FIELDS = [
    (slug, kind, layer, field, names)
    for slug, kind, layer, fields in [
        ("los_angeles", "parcel", "LACounty_Parcel/0", _LA_PARCEL),
        ("los_angeles", "zoning", "zma/zimas/1102", [("zone_code", ["ZONE_CLASS", "ZONE_CMPLT", "zone_cmplt", "zone"]), ("zone_name", ["ZONE_CMPLT", "ZONE_CLASS"])]),
        ("san_diego", "parcel", "GeocoderMerged/1", [("apn", ["APN", "APN_8"]), ("situs", ["SITUS_STREET", "SITUS_ADDRESS"])]),
        ("san_diego", "zoning", "DSD/Zoning_Base/0", [("zone_code", ["ZONE_NAME"]), ("zone_name", ["ZONE_NAME"])]),
        ("san_jose", "parcel", "PLN/49", [("apn", ["APN"]), ("situs", [])]),
        ("san_jose", "zoning", "PLN/128", [("zone_code", ["ZONING", "ZONINGABBREV"]), ("zone_name", ["ZONING"])]),
        ("san_francisco", "parcel", "PlanningData/23", [("apn", ["blklot", "mapblklot"]), ("situs", ["street"])]),
        ("san_francisco", "zoning", "PlanningData/3", [("zone_code", ["zoning", "zoning_sim"]), ("zone_name", ["districtname", "zoning"])]),
        ("sacramento", "parcel", "PARCELS/8", [("apn", ["APN_DASH", "APN10", "APN"]), ("situs", ["STREET_NAME", "STREET_NBR"])]),
        ("sacramento", "zoning", "CITY_of_SACRAMENTO/3", [("zone_code", ["BASE_ZONE", "ZONE"]), ("zone_name", ["DESCRIPTIO", "ZONE"])]),
        ("long_beach", "parcel", "LACounty_Parcel/0", _LA_PARCEL),
        ("long_beach", "zoning", "LB Zoning/0", [("zone_code", ["ZONING_SYMBOL"]), ("zone_name", ["ZONING_SYMBOL"])]),
        ("irvine", "parcel", "OnlineParcel/4", [("apn", ["APN"]), ("situs", [])]),
        ("irvine", "zoning", "OnlineParcel/7", [("zone_code", ["ZONING"]), ("zone_name", ["DESCRIPTION", "ZONING"])]),
        ("oakland", "parcel", "AC_Parcels2020/0", [("apn", ["APN_AIR", "PRINTPARCEL", "APN_GROUND"]), ("situs", [])]),
        ("oakland", "zoning", "Zoning_Group_Layers_/0", [("zone_code", ["BASEZONE"]), ("zone_name", ["BASEZONE"])]),
    ]
    for field, names in fields
] + [
    ("*", "flood", "NFHL/28", "designation", ["FLD_ZONE"]),
    ("*", "fire", "FHSZ_in_SRA_for_FHSZ_in_LRA/0", "designation", ["FHSZ_Description"]),
]
LAYER_FIELDS_DDL = "slug string, kind string, layer string, field string, candidates array<string>"

# --- Fixed values: attribute names tried by the bulk layer loads -------------------------
BULK_FIELDS = {
    "zone_code": ["ZONE_CMPLT", "ZONE_CLASS", "ZONE_CODE", "ZONE", "ZONING"],
    "zone_name": ["ZONELEGEND", "ZONE_DESC", "DESCRIPTION", "ZONE_NAME"],
    "zone_category": ["ZONE_CLASS", "ZONE_CMPLT", "CATEGORY"],
    "apn": ["APN", "AIN", "PIN", "PIN_NUM", "ASSESSOR_ID", "AsmtParcelNbr"],
    "situs": ["SitusAddress", "SITUS_ADDR", "SITUS_ADDRESS", "ADDRESS", "SITE_ADDR", "FullAddress"],
    "flood_zone": ["FLD_ZONE"],
    "flood_subtype": ["ZONE_SUBTY"],
    "flood_id": ["FLD_AR_ID", "GFID", "DFIRM_ID", "OBJECTID"],
    "fire_class": ["HAZ_CLASS", "FHSZ", "FHSZ_lyr", "SEVERITY"],
    "fire_area": ["SRA"],
    "fire_id": ["OBJECTID", "OBJECTID_1"],
    "bootstrap_code": ["ZONE_CODE", "ZONING", "ZONE", "ZONE_CMPLT", "GEN_CLASS", "zoning"],
    "bootstrap_name": ["ZONE_NAME", "DESCRIPTION", "ZONE_DESC", "GEN_DESC", "zdescr"],
}
CALIFORNIA_BBOX = (-124.5, 32.5, -114.1, 42.1)

# --- Fixed values: tables readable by anyone; all others are private ----------------------
PUBLIC_TABLES = ["jurisdictions", "zoning_rules", "rule_attributes", "changelog_entries", "state_rule_baselines"]


def state_baselines(spark: SparkSession) -> DataFrame:
    """Request-time baselines; ``effective_to`` is open and provenance is the handbook."""
    return literal_table(spark, STATE_BASELINES, BASELINES_DDL).selectExpr(
        "*", "CAST(NULL AS date) AS effective_to", f"'{BASELINE_URL}' AS source_url",
        f"'{BASELINE_TITLE}' AS source_title", "CAST(NULL AS timestamp) AS last_verified_at",
        "'high' AS confidence", "'current' AS data_status",
    )


def field_catalog(spark: SparkSession) -> DataFrame:
    return literal_table(spark, FIELD_CATALOG, CATALOG_DDL)


def plans(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PLANS, PLANS_DDL)


def layer_fields(spark: SparkSession) -> DataFrame:
    return literal_table(spark, LAYER_FIELDS, LAYER_FIELDS_DDL)


def jurisdiction_hints(spark: SparkSession) -> DataFrame:
    return literal_table(spark, JURISDICTION_HINTS, HINTS_DDL)
