"""Local rules against state-law baselines, and the statuses derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import values as V
from parcelspark.operators.skew import latest_by
from parcelspark.session import cut

SOURCE_FIELDS = [
    "source_url", "source_title", "source_section", "source_layer", "retrieved_at",
    "last_verified_at", "confidence", "data_status", "snapshot_hash",
]
UNKNOWN_SOURCE = "urn:unknown-source"

# Notes attached to findings.
NOTE_NO_BASELINE = "No matching California state baseline for this field."
NOTE_BASELINE_SHOWN = (
    "California state baseline shown; the local ordinance value has not "
    "yet been ingested for this jurisdiction and zone."
)
NOTE_RESTRICTIVE = (
    "Local value appears more restrictive than the current California "
    "state baseline (%s). Local source is "
    "preserved; verify against state law with a professional."
)
NOTE_FRONT = (
    "State law provides that a front setback may not preclude an ADU "
    "of at least 800 sqft; no numeric front setback is asserted here."
)
NOTE_JADU = (
    "JADU owner-occupancy is conditional on the shared-sanitation "
    "arrangement; verify with the jurisdiction."
)


def source(default_title: str | Column, prefix: str = "", have: set[str] | None = None) -> Column:
    """Provenance struct from a row's source columns, with the usual defaults."""
    title = F.lit(default_title) if isinstance(default_title, str) else default_title

    def col(name: str, dtype: str = "string") -> Column:
        return F.col(prefix + name) if have is None or prefix + name in have else F.lit(None).cast(dtype)

    return F.struct(
        F.coalesce(F.nullif(col("source_url"), F.lit("")), F.lit(UNKNOWN_SOURCE)).alias("source_url"),
        F.coalesce(F.nullif(col("source_title"), F.lit("")), title).alias("source_title"),
        col("source_section").alias("source_section"),
        col("source_layer").alias("source_layer"),
        col("retrieved_at", "timestamp").alias("retrieved_at"),
        col("last_verified_at", "timestamp").alias("last_verified_at"),
        F.coalesce(F.nullif(col("confidence"), F.lit("")), F.lit("medium")).alias("confidence"),
        F.coalesce(F.nullif(col("data_status"), F.lit("")), F.lit("current")).alias("data_status"),
        col("snapshot_hash").alias("snapshot_hash"),
    )


def evaluate_compliance(operator: Column, local: Column, baseline: Column) -> Column:
    """Compliance flag of a local value under an operator; anything unclear needs review."""
    is_object = lambda v: F.coalesce(F.startswith(F.ltrim(v["json"]), F.lit("{")), F.lit(False))
    # a number equals a boolean of the same 0/1 value
    n = lambda v: F.coalesce(v["num"], v["bool"].cast("double"))
    same = F.coalesce(n(local) == n(baseline), local["json"] == baseline["json"], F.lit(False))
    numbers = local["num"].isNotNull() & baseline["num"].isNotNull()
    verdict = lambda ok, bad: F.when(ok, C.MATCHES).otherwise(bad)
    return (
        F.when(V.value_is_null(local) | V.value_is_null(baseline) | is_object(local) | is_object(baseline), C.REVIEW)
        .when(operator.isin("floor", "gte") & numbers, verdict(local["num"] >= baseline["num"], C.RESTRICTIVE))
        .when(operator.isin("ceiling", "lte") & numbers, verdict(local["num"] <= baseline["num"], C.RESTRICTIVE))
        .when(operator == "must_equal", verdict(same, C.RESTRICTIVE))
        .when(operator == "eq", verdict(same, C.REVIEW))
        .otherwise(C.REVIEW)
    )


def current_rules(rules: DataFrame) -> DataFrame:
    """Current rule with the highest version per jurisdiction, zone (any case) and project."""
    keyed = rules.where("is_current").withColumn("zone_key", F.upper("zone_code"))
    return latest_by(keyed, ["jurisdiction_id", "zone_key", "project_type"], ["version", "rule_id"])


def resolved_attributes(attrs: DataFrame) -> DataFrame:
    """Attributes with their effective ``value`` (the numeric mirror wins over the JSON) and
    provenance ``source``."""
    have = set(attrs.columns)
    v = F.when(F.col("value_numeric").isNotNull(), V.value(F.col("value_numeric"))).otherwise(V.parse_value(F.col("value_json")))
    return attrs.select("rule_id", "field_name", v.alias("value"), "unit", "operator", source("Local zoning ordinance", have=have).alias("source"))


def baselines_in_force(baselines: DataFrame, as_of: Column) -> DataFrame:
    """Baselines open at an instant."""
    return baselines.where(F.col("effective_to").isNull() | (F.col("effective_to") > as_of))


def baselines_by_project(baselines: DataFrame, as_of: Column) -> DataFrame:
    """One row per project type and field; an empty scope applies to every type."""
    types = F.array(*[F.lit(t) for t in C.PROJECT_TYPES])
    scope = F.when(F.size("applies_to") == 0, types).otherwise(F.col("applies_to"))
    b = baselines_in_force(baselines, as_of).withColumn("project_type", F.explode(scope))
    b = latest_by(b, ["project_type", "field_name"], ["effective_from"])
    state = F.struct(
        F.col("source_url"), F.coalesce("source_title", F.lit("California state law baseline")).alias("source_title"),
        F.col("legal_citation").alias("source_section"), F.lit(None).cast("string").alias("source_layer"),
        F.col("last_verified_at").alias("retrieved_at"), F.col("last_verified_at").alias("last_verified_at"),
        F.coalesce("confidence", F.lit("high")).alias("confidence"), F.coalesce("data_status", F.lit("current")).alias("data_status"),
        F.lit(None).cast("string").alias("snapshot_hash"),
    )
    return b.select(
        "project_type", "field_name", V.value(F.col("num"), F.col("bool"), F.col("json")).alias("b_value"),
        F.col("unit").alias("b_unit"), F.col("operator").alias("b_operator"), "legal_citation", state.alias("b_source"),
    )


def merge_rules(contexts: DataFrame, rules: DataFrame, attrs: DataFrame, baselines: DataFrame, as_of: Column) -> DataFrame:
    """Findings per context (jurisdiction_id, zone_code, project_type): every local attribute
    checked against its baseline, then the baselines no local attribute covers.

    Contexts are distinct combinations, so the work does not grow with the number of requests.
    Rows are ordered by ``sort_order`` within a context.
    """
    keys = ["jurisdiction_id", "zone_code", "project_type"]
    rule = current_rules(rules).select("jurisdiction_id", "zone_key", "project_type", "rule_id")
    ctx = cut(contexts.select(*keys).distinct()).withColumn("zone_key", F.upper("zone_code"))
    used = cut(ctx.where("zone_code IS NOT NULL").join(rule, ["jurisdiction_id", "zone_key", "project_type"]).drop("zone_key"))
    # attributes of rules that no context uses go before they are worked on
    own = attrs.join(used.select("rule_id").distinct(), "rule_id", "left_semi")
    local = used.join(resolved_attributes(own), "rule_id")
    base = ctx.drop("zone_key").join(baselines_by_project(baselines, as_of), "project_type")
    # the zone may be unknown, hence null-safe keys on the baseline side
    l, b = local.alias("l"), base.alias("b")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "field_name"]]
    both = l.join(b, on, "full_outer")
    is_local, has_base = F.col("l.rule_id").isNotNull(), F.col("b.b_operator").isNotNull()
    op = F.coalesce("l.operator", "b.b_operator")
    flag = F.when(is_local & has_base, evaluate_compliance(op, F.col("l.value"), F.col("b.b_value"))).otherwise(C.NOT_APPLICABLE)
    note = (
        F.when(~is_local, NOTE_BASELINE_SHOWN)
        .when(~has_base, NOTE_NO_BASELINE)
        .when(flag == C.RESTRICTIVE, F.format_string(NOTE_RESTRICTIVE, F.col("b.legal_citation")))
    )
    return both.select(
        *[F.coalesce(f"l.{k}", f"b.{k}").alias(k) for k in keys],
        F.coalesce("l.field_name", "b.field_name").alias("field_name"),
        F.when(is_local, F.col("l.value")).otherwise(F.col("b.b_value")).alias("value"),
        F.when(is_local, F.coalesce("l.unit", "b.b_unit")).otherwise(F.col("b.b_unit")).alias("unit"),
        F.when(is_local, F.col("l.source")).otherwise(F.col("b.b_source")).alias("source"),
        F.col("b.b_value").alias("state_baseline"), flag.alias("compliance_flag"),
        F.when(is_local, "local").otherwise("state_baseline").alias("origin"),
        F.when(is_local & ~has_base, F.col("l.operator")).otherwise(op).alias("operator"), note.alias("note"),
    )


def finding_sets(findings: DataFrame) -> DataFrame:
    """Findings folded to one row per context: an ordered array, at most one entry per field."""
    keys = ["jurisdiction_id", "zone_code", "project_type"]
    body = [c for c in findings.columns if c not in keys]
    row = F.struct((F.col("origin") != "local").alias("later"), F.col("field_name").alias("name"), F.struct(*body).alias("f"))
    ordered = F.array_sort(F.collect_list(row), lambda a, b: F.when(a["later"] != b["later"], F.when(a["later"], 1).otherwise(-1)).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return findings.groupBy(*keys).agg(F.transform(ordered, lambda r: r["f"]).alias("findings"))


def find(findings: Column, field: Column) -> Column:
    """The finding of a field, null where there is none."""
    return F.get(F.filter(findings, lambda f: f["field_name"] == field), F.lit(0))


def _sourced(f: Column, value: Column, base: Column, unit: Column, flag: Column | None = None, note: Column | None = None) -> Column:
    return F.when(
        f.isNotNull(),
        F.struct(
            value.alias("value"), unit.alias("unit"), base.alias("state_baseline"),
            (V.public_flag(f["compliance_flag"]) if flag is None else flag).alias("compliance_flag"),
            (f["note"] if note is None else note).alias("note"), f["source"].alias("provenance"),
        ),
    )


def constraints(findings: Column, project_type: Column, near_transit: Column, bedrooms: Column) -> Column:
    """Development limits of a request, each with provenance; absent fields stay null."""

    def number(field: Column | str, unit: bool = True) -> Column:
        f = find(findings, F.lit(field) if isinstance(field, str) else field)
        return _sourced(f, V.strict_number(f["value"]), V.strict_number(f["state_baseline"]), f["unit"])

    def boolean(field: str) -> Column:
        f = find(findings, F.lit(field))
        return _sourced(f, V.strict_bool(f["value"]), V.strict_bool(f["state_baseline"]), F.lit(None).cast("string"))

    front, jadu = find(findings, F.lit("front_setback_restriction")), find(findings, F.lit("owner_occupancy_required_jadu"))
    none_num, none_bool = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    occupancy = F.when(
        project_type == "jadu", _sourced(jadu, none_bool, none_bool, F.lit(None).cast("string"), F.lit(C.REVIEW), F.lit(NOTE_JADU))
    ).otherwise(boolean("owner_occupancy_required_adu"))
    setback = number("side_rear_setback_min_ft")
    return F.struct(
        number(V.height_field(project_type, near_transit)).alias("max_height_ft"),
        number(V.size_field(bedrooms)).alias("max_size_sqft"),
        setback.alias("side_setback_ft"), setback.alias("rear_setback_ft"),
        _sourced(front, none_num, none_num, F.lit("ft"), None, F.lit(NOTE_FRONT)).alias("front_setback_ft"),
        boolean("parking_required").alias("parking_required"),
        occupancy.alias("owner_occupancy_required"),
        number("permit_review_days").alias("permit_review_days"),
        number("impact_fee_exempt_sqft_threshold").alias("impact_fee_exempt_sqft_threshold"),
        boolean("fire_sprinkler_trigger").alias("fire_sprinkler_required"),
    )


def path_status(project_type: Column, zone_code: Column, has_local_rules: Column, zoning_resolved: Column) -> Column:
    """``struct<status, reason>`` of the requested path; never a plain yes or no."""
    single = V.is_single_family(zone_code)
    sb9 = project_type.isin(C.SB9_PROJECT_TYPES)
    # Reason texts.
    ineligible = F.format_string(
        "SB 9 applies in single-family residential zones; this parcel's "
        "zone (%s) does not appear to be single-family. Verify.", zone_code)
    unsure = F.lit(
        "SB 9 eligibility depends on single-family zoning and several "
        "site conditions that could not be confirmed automatically.")
    sb9_ok = F.lit(
        "Parcel appears to be single-family zoned. SB 9 has additional "
        "ministerial conditions (lot history, tenancy, environmental) that "
        "require verification.")
    verified = F.lit(
        "State ADU law and the local ordinance both permit this project type "
        "in this zone, subject to the constraints listed.")
    fallback = F.format_string(
        "California state ADU law permits this project type statewide; the local "
        "ordinance detail for %s has not yet been "
        "ingested, so specific limits are shown from the state baseline.",
        F.coalesce(F.nullif(zone_code, F.lit("")), F.lit("this zone")))
    out = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    return (
        F.when(~zoning_resolved, out("insufficient_data", F.lit("Zoning could not be resolved for this parcel.")))
        .when(sb9 & (single == F.lit(False)), out("likely_ineligible", ineligible))
        .when(sb9 & single.isNull(), out("needs_professional_review", unsure))
        .when(sb9, out("conditional", sb9_ok))
        .when(has_local_rules, out("likely_eligible", verified))
        .otherwise(out("conditional", fallback))
    )


def feasibility_status(
    resolved_jurisdiction: Column, parcel_matched: Column, zoning_resolved: Column, low_confidence: Column,
    cross_zone_ambiguity: Column, flags: Column, hazard_hit: Column, path: Column, orientation_unknown: Column,
) -> Column:
    """One of four statuses; the first level that applies wins."""
    missing = ~resolved_jurisdiction | ~parcel_matched | ~zoning_resolved | low_confidence
    conflict = F.coalesce(F.exists(flags, lambda f: f.isin(C.REVIEW, C.RESTRICTIVE)), F.lit(False))
    review = cross_zone_ambiguity | orientation_unknown | conflict | (path == "needs_professional_review")
    limited = hazard_hit | path.isin("conditional", "likely_ineligible")
    return (
        F.when(missing, "insufficient_data").when(review, "needs_professional_review")
        .when(limited, "likely_constrained").otherwise("likely_feasible")
    )
