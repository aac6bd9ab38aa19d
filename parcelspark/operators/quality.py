"""Declarative table constraints: value checks, uniqueness, references, request validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C

# Allowed values per table and column; a leading "?" also allows null.
CHECKS: dict[str, dict[str, list[str]]] = {
    "jurisdictions": {"jurisdiction_type": ["city", "county", "state"], "coverage_status": C.COVERAGE},
    "source_registry": {
        "source_type": ["municipal_code", "gis_parcel", "gis_zoning", "gis_overlay", "state_handbook", "state_statute", "geocoder", "other"],
        "provider": ["american_legal", "municode", "arcgis", "fema", "cal_fire", "hcd", "ca_open_data", "census", "other"],
    },
    "zoning_sections": {"confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS},
    "state_rule_baselines": {"operator": C.OPERATORS, "confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS},
    "zoning_rules": {
        "project_type": C.PROJECT_TYPES, "review_status": ["pending", "in_review", "verified", "rejected", "superseded"],
        "compliance_flag": C.FLAGS, "confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS,
    },
    "rule_attributes": {"?operator": C.OPERATORS, "compliance_flag": C.FLAGS, "confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS},
    "parcels": {"confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS},
    "zoning_districts": {"confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS},
    "overlay_features": {"overlay_type": C.OVERLAY_TYPES, "confidence": C.CONFIDENCE, "data_status": C.DATA_STATUS},
    "property_analyses": {
        "provider": ["rapidapi", "direct", "portal"], "project_type": C.PROJECT_TYPES, "?coverage_status": C.COVERAGE, "?feasibility_status": C.FEASIBILITY,
    },
    "analysis_findings": {
        "finding_type": ["parcel", "zoning", "constraint", "eligibility", "overlay", "envelope", "assumption", "limitation"],
        "?project_path": C.PROJECT_TYPES, "?feasibility_status": C.FEASIBILITY, "?compliance_flag": C.FLAGS, "?confidence": C.CONFIDENCE, "?data_status": C.DATA_STATUS,
    },
    "ingest_runs": {
        "run_type": ["parcels", "zoning", "overlays", "code", "baselines", "qa", "full"],
        "status": ["pending", "running", "success", "failed", "partial", "cancelled"],
    },
    "qa_issues": {
        "severity": ["info", "warning", "critical"], "status": ["open", "in_review", "resolved", "wont_fix", "dismissed"],
        "?detected_by": ["state_baseline_check", "llm_qa", "source_diff", "human", "automated"],
    },
    "api_usage_events": {"provider": ["rapidapi", "direct", "portal"], "?project_type": C.PROJECT_TYPES},
    "changelog_entries": {"entry_type": ["coverage", "rule_update", "source_update", "correction", "release", "other"]},
}
UNIQUE: dict[str, list[list[str]]] = {
    "jurisdictions": [["slug"]], "source_registry": [["jurisdiction_id", "source_type", "url"]],
    "source_snapshots": [["registry_id", "version"], ["registry_id", "content_hash"]], "zoning_sections": [["jurisdiction_id", "section_url"]],
    "state_rule_baselines": [["field_name", "effective_from"]], "zoning_rules": [["jurisdiction_id", "zone_code", "project_type", "version"]],
    "rule_attributes": [["rule_id", "field_name"]], "parcels": [["jurisdiction_id", "apn"]],
}


def violations(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """``key..., constraint, value``: every broken value check of a table, in one pass."""
    rows = []
    for name, allowed in CHECKS[table].items():
        col = name.lstrip("?")
        if col not in df.columns:
            continue
        ok = F.col(col).isin(allowed)
        broken = ~F.coalesce(ok, F.lit(name.startswith("?")))
        rows.append(F.when(broken, F.struct(F.lit(col).alias("constraint"), F.col(col).cast("string").alias("value"))))
    found = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return df.select(*key, F.explode(found).alias("_v")).select(*key, "_v.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; null parts never clash."""
    full = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("rows"))
    return full.where(F.col("rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows pointing at no parent."""
    ids = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(ids, fk, "left_anti")


REQUEST_FIELDS = ["address", "project_type", "target_sqft", "bedrooms", "proposed_height_ft", "existing_structure", "options"]


def validate_requests(requests: DataFrame, extra: str | None = None) -> DataFrame:
    """Add ``reasons``: why a request is rejected, empty when it is accepted. ``extra`` names a
    column holding the array of field names that were sent."""
    low = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    checks = [
        (F.length(F.coalesce("address", F.lit(""))) < 5, "address_too_short"),
        (~F.coalesce(F.col("project_type").isin(C.PROJECT_TYPES), F.lit(False)), "unknown_project_type"),
        (low("target_sqft"), "negative_target_sqft"), (low("bedrooms"), "negative_bedrooms"), (low("proposed_height_ft"), "negative_height"),
    ]
    if extra:
        known = F.array(*[F.lit(f) for f in REQUEST_FIELDS])
        checks.append((F.size(F.array_except(extra, known)) > 0, "unknown_field"))
    return requests.withColumn("reasons", F.filter(F.array(*[F.when(c, r) for c, r in checks]), lambda r: r.isNotNull()))
