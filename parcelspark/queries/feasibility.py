"""The whole feasibility job and the parts that need its joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators import layers, rules
from parcelspark.operators.skew import dealt
from parcelspark.plans import feasibility as P
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query

_FLAG = f"""CASE WHEN l_field IS NULL OR b_field IS NULL THEN 'not_applicable'
  WHEN (l_num IS NULL AND l_bool IS NULL) OR b_json IS NOT NULL THEN 'needs_review'
  WHEN op IN ('floor', 'gte') THEN CASE WHEN l_num IS NULL OR b_num IS NULL THEN 'needs_review' WHEN l_num >= b_num THEN '{C.MATCHES}' ELSE '{C.RESTRICTIVE}' END
  WHEN op IN ('ceiling', 'lte') THEN CASE WHEN l_num IS NULL OR b_num IS NULL THEN 'needs_review' WHEN l_num <= b_num THEN '{C.MATCHES}' ELSE '{C.RESTRICTIVE}' END
  WHEN op IN ('must_equal', 'eq') THEN CASE WHEN coalesce(l_num, CAST(l_bool AS INT)) = coalesce(b_num, CAST(b_bool AS INT)) THEN '{C.MATCHES}' WHEN op = 'eq' THEN 'needs_review' ELSE '{C.RESTRICTIVE}' END
  ELSE 'needs_review' END"""
_FOUND = f"""SELECT *, {_FLAG} AS flag FROM (SELECT coalesce(l.jurisdiction_id, b.jurisdiction_id) AS jurisdiction_id, coalesce(l.zone_code, b.zone_code) AS zone_code,
    coalesce(l.project_type, b.project_type) AS project_type, coalesce(l.field_name, b.field_name) AS field_name, l.field_name AS l_field, b.field_name AS b_field,
    l.num AS l_num, l.bool AS l_bool, b.num AS b_num, b.bool AS b_bool, b.json AS b_json, coalesce(l.operator, b.operator) AS op, b.unit, b.citation,
    l.l_linenumber, l.last_verified_at, l.rule_id
  FROM (SELECT ctx.*, atr.* FROM ctx JOIN cr ON cr.jurisdiction_id = ctx.jurisdiction_id AND upper(cr.zone_code) = upper(ctx.zone_code) AND cr.project_type = ctx.project_type JOIN atr USING (rule_id)) l
  FULL JOIN (SELECT ctx.*, bl.* FROM ctx JOIN bl ON list_contains(bl.applies_to, ctx.project_type)) b
  ON l.jurisdiction_id = b.jurisdiction_id AND coalesce(l.zone_code, '~') = coalesce(b.zone_code, '~') AND l.project_type = b.project_type AND l.field_name = b.field_name)"""
# every request with its place, zone and hazards
_PLACE = """SELECT rj.*, c_acctbal >= -800 AS geo, c_acctbal >= -800 AND rj.jurisdiction_id IS NOT NULL AS placed,
    c_acctbal >= -800 AND coalesce(coverage_status = 'production', false) AS live, pm.parcel_id AS pid, pm.inside FROM rj LEFT JOIN pm USING (request_id)"""
_PZ1 = """SELECT parcel_id, first(zone_code ORDER BY units DESC, zone_code, zone_id) AS zone_code, count(DISTINCT zone_code) > 1 AS amb,
    string_agg(DISTINCT zone_code, ', ' ORDER BY zone_code) AS codes FROM pz GROUP BY 1"""
_PO1 = "SELECT parcel_id, count(*) AS hits, bool_or(overlay_type IN ('flood','fire','coastal','hillside') AND severity <> 'info') AS hazard, bool_or(overlay_type = 'flood') AS fl, bool_or(overlay_type = 'fire') AS fi FROM po GROUP BY 1"
_XO1 = """SELECT request_id, count(*) AS hits, bool_or(overlay_type IN ('flood','fire','coastal','hillside') AND severity <> 'info') AS hazard, bool_or(overlay_type = 'flood') AS fl, bool_or(overlay_type = 'fire') AS fi
  FROM place JOIN ovs ON u >= x1 AND u <= x2 AND v >= y1 AND v <= y2 WHERE live AND pid IS NULL GROUP BY 1"""
_XZ1 = """SELECT request_id, first(zn.zone_code ORDER BY zn.zone_code, zone_id) AS zone_code, count(DISTINCT zn.zone_code) > 1 AS amb, string_agg(DISTINCT zn.zone_code, ', ' ORDER BY zn.zone_code) AS codes
  FROM place JOIN zn ON place.jurisdiction_id = zn.jurisdiction_id AND u > x1 AND u < x2 AND v > y1 AND v < y2 WHERE live AND pid IS NULL GROUP BY 1"""
_AT = """SELECT place.request_id, project_type, bedrooms, near_transit, include_envelope, geo, placed, live, slug, coverage_status, pid, inside, place.jurisdiction_id, u, v, c_nationkey, consumer_id,
    CASE WHEN live THEN coalesce(pz1.zone_code, xz1.zone_code) END AS zone_code, live AND coalesce(pz1.amb, xz1.amb, false) AS amb, coalesce(pz1.codes, xz1.codes) AS codes,
    live AND coalesce(po1.hazard, xo1.hazard, false) AS hazard, coalesce(po1.hits, xo1.hits, 0) AS hits, coalesce(po1.fl, xo1.fl, false) AS fl, coalesce(po1.fi, xo1.fi, false) AS fi,
    coalesce(pc.confidence = 'low', false) AS low
  FROM place LEFT JOIN pc ON pc.parcel_id = pid AND live LEFT JOIN pz1 ON pz1.parcel_id = pid AND live LEFT JOIN po1 ON po1.parcel_id = pid AND live
  LEFT JOIN xz1 ON xz1.request_id = place.request_id LEFT JOIN xo1 ON xo1.request_id = place.request_id"""
_CTX = "SELECT DISTINCT jurisdiction_id, zone_code, project_type FROM site WHERE live"
_SUM = """SELECT jurisdiction_id, zone_code, project_type, count(*) AS n, count(l_field) AS n_local,
    bool_or(flag IN ('needs_review', 'possibly_more_restrictive_than_state_baseline')) AS conflict FROM found GROUP BY 1, 2, 3"""
_FLAT = """SELECT site.*, coalesce(cr.review_status = 'verified', false) AS has_local, coalesce(n, 0) AS n, coalesce(n_local, 0) AS n_local, coalesce(conflict, false) AS conflict,
    CASE WHEN site.zone_code IS NULL THEN NULL WHEN regexp_matches(site.zone_code, '^(R1|RS|RE|RA|RW1|RD)') THEN true WHEN regexp_matches(site.zone_code, '^(C|M|R2|R3|R4|R5|RAS)') THEN false END AS single
  FROM site LEFT JOIN sums ON site.live AND site.jurisdiction_id = sums.jurisdiction_id AND coalesce(site.zone_code, '~') = coalesce(sums.zone_code, '~') AND site.project_type = sums.project_type
  LEFT JOIN cr ON site.live AND cr.jurisdiction_id = site.jurisdiction_id AND upper(cr.zone_code) = upper(site.zone_code) AND cr.project_type = site.project_type"""
_PATHED = """SELECT *, CASE WHEN zone_code IS NULL THEN 'insufficient_data' WHEN project_type LIKE 'sb9%' THEN
      CASE WHEN single IS NULL THEN 'needs_professional_review' WHEN single THEN 'conditional' ELSE 'likely_ineligible' END
    WHEN has_local THEN 'likely_eligible' ELSE 'conditional' END AS path FROM flat"""
# every parcel of the grid keeps some area after any setback of at most 50 ft
_DONE = """SELECT *, CASE WHEN NOT placed THEN 'insufficient_data' WHEN NOT live THEN NULL WHEN pid IS NULL OR zone_code IS NULL OR low THEN 'insufficient_data'
    WHEN amb OR conflict OR include_envelope OR path = 'needs_professional_review' THEN 'needs_professional_review'
    WHEN hazard OR path IN ('conditional', 'likely_ineligible') THEN 'likely_constrained' ELSE 'likely_feasible' END AS status FROM pathed"""
TABLES = {
    "place": _PLACE, "pz1": _PZ1, "po1": _PO1, "xo1": _XO1, "xz1": _XZ1, "site": _AT, "ctx": _CTX, "found": _FOUND, "sums": _SUM,
    "flat": _FLAT, "pathed": _PATHED, "done": _DONE,
}


def run(spark: SparkSession, sf: str) -> DataFrame:
    """The job itself, over every request."""
    return P.feasibility(D.ask(spark, sf), D.refs(spark, sf), D.AS_OF, path_sources=6)


_INPUTS = ["customer", "part", "nation", "supplier", "lineitem"]


def results(spark: SparkSession, sf: str) -> DataFrame:
    """The job's results as a stored table, written once for given input files; reports read it."""
    key = layers.fingerprint(spark, *[f"{sf}/{t}.parquet" for t in _INPUTS])
    return spark.read.parquet(layers.current(spark, f"results-{key}", lambda folder: run(spark, sf).write.parquet(folder)))


@query("r17_feasibility", with_tables("""SELECT request_id, CASE WHEN placed AND NOT live THEN 'unsupported_coverage' ELSE 'completed' END AS kind, status AS feasibility_status,
    coalesce(status <> 'insufficient_data', false) AS billable, CASE WHEN placed THEN slug ELSE 'unknown' END AS jurisdiction_slug, CASE WHEN live THEN pid END AS parcel_id,
    CASE WHEN live AND pid IS NOT NULL THEN CASE WHEN inside THEN 'st_contains' ELSE 'st_intersects' END END AS match_method, zone_code, amb AS cross_zone_ambiguity,
    hazard AS hazard_hit, live AND has_local AS has_local_rules, path AS path_status, CASE WHEN live THEN n END AS findings,
    CASE WHEN live THEN hits + CASE WHEN fl THEN 0 ELSE 1 END + CASE WHEN fi THEN 0 ELSE 1 END END AS overlays FROM done""", **TABLES))
def feasibility(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).select(
        "request_id", "kind", "feasibility_status", "billable", "jurisdiction_slug", "parcel_id", "match_method", "zone_code", "cross_zone_ambiguity",
        "hazard_hit", "has_local_rules", "path_status", F.size("findings").alias("findings"), F.size("overlays").alias("overlays"),
    )


@query("r17_status_counts", with_tables("""SELECT coalesce(status, 'unsupported_coverage') AS outcome, project_type, count(*) AS requests,
    count(*) FILTER (WHERE status <> 'insufficient_data') AS billable FROM done GROUP BY 1, 2""", **TABLES))
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = run(spark, sf)
    return r.groupBy(F.coalesce("feasibility_status", "kind").alias("outcome"), "project_type").agg(
        F.count("*").alias("requests"), F.count_if("billable").alias("billable")
    )


@query("r05_status_precedence", with_tables("SELECT request_id, status FROM done WHERE live", **TABLES))
def status_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).where("kind = 'completed' AND jurisdiction_slug <> 'unknown'").select("request_id", F.col("feasibility_status").alias("status"))


@query("r04_path_reason", with_tables("""SELECT request_id, path AS status, CASE WHEN zone_code IS NULL THEN 'Zoning could not be resolved for this parcel.'
    WHEN path = 'likely_ineligible' THEN 'SB 9 applies in single-family residential zones; this parcel''s zone (' || zone_code || ') does not appear to be single-family. Verify.'
    WHEN path = 'needs_professional_review' THEN 'SB 9 eligibility depends on single-family zoning and several site conditions that could not be confirmed automatically.'
    WHEN project_type LIKE 'sb9%' THEN 'Parcel appears to be single-family zoned. SB 9 has additional ministerial conditions (lot history, tenancy, environmental) that require verification.'
    WHEN has_local THEN 'State ADU law and the local ordinance both permit this project type in this zone, subject to the constraints listed.'
    ELSE 'California state ADU law permits this project type statewide; the local ordinance detail for ' || zone_code || ' has not yet been ingested, so specific limits are shown from the state baseline.' END AS reason
    FROM pathed WHERE live""", **TABLES))
def path_reason(spark: SparkSession, sf: str) -> DataFrame:
    path = F.get(F.col("result.eligible_paths"), F.lit(0))
    return results(spark, sf).where("kind = 'completed' AND jurisdiction_slug <> 'unknown'").select("request_id", path["status"].alias("status"), path["reason"].alias("reason"))


@query("r07_low_confidence", with_tables("SELECT request_id, low OR NOT geo AS low_confidence FROM site", **TABLES))
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    low = (F.col("geocode_confidence") == "low") | F.coalesce(F.col("result.parcel.apn.provenance.confidence") == "low", F.lit(False))
    return results(spark, sf).select("request_id", low.alias("low_confidence"))


@query("r12_limitations", with_tables("""SELECT request_id, concat_ws(',', CASE WHEN NOT geo THEN 'geocode_failed' END, CASE WHEN geo AND NOT placed THEN 'jurisdiction_unresolved' END,
    CASE WHEN live AND pid IS NULL THEN 'parcel_unmatched' END, CASE WHEN amb THEN 'cross_zone_ambiguity' END, CASE WHEN live AND zone_code IS NULL THEN 'zoning_unresolved' END,
    CASE WHEN live AND include_envelope AND pid IS NOT NULL THEN 'envelope_orientation_unknown' END, CASE WHEN live AND include_envelope AND pid IS NULL THEN 'envelope_unavailable_no_parcel' END) AS codes,
    coalesce(CASE WHEN amb THEN 'The parcel intersects more than one zoning district (' || codes || '); the primary zone was used. Verify.' END, '') AS zone_text,
    CASE WHEN live THEN CAST(near_transit AS INT) + CAST(NOT has_local AS INT) ELSE 0 END AS assumptions FROM done WHERE NOT placed OR live""", **TABLES))
def limitations(spark: SparkSession, sf: str) -> DataFrame:
    amb = F.get(F.filter("limitations", lambda x: x["code"] == "cross_zone_ambiguity"), F.lit(0))["text"]
    return results(spark, sf).where("kind = 'completed'").select(
        "request_id", F.array_join(F.transform("limitations", lambda x: x["code"]), ",").alias("codes"), F.coalesce(amb, F.lit("")).alias("zone_text"),
        F.size("result.assumptions").alias("assumptions"),
    )


@query("r06_constraints", with_tables(f"""SELECT request_id,
    max(CASE WHEN field_name = hf THEN coalesce(l_num, CASE WHEN l_field IS NULL THEN b_num END) END) AS max_height_ft, max(CASE WHEN field_name = hf THEN b_num END) AS height_baseline,
    max(CASE WHEN field_name = hf THEN CASE flag WHEN '{C.MATCHES}' THEN 'compliant' WHEN 'not_applicable' THEN NULL ELSE flag END END) AS height_flag,
    max(CASE WHEN field_name = sf THEN coalesce(l_num, CASE WHEN l_field IS NULL THEN b_num END) END) AS max_size_sqft,
    max(CASE WHEN field_name = 'side_rear_setback_min_ft' THEN coalesce(l_num, CASE WHEN l_field IS NULL THEN b_num END) END) AS setback_ft,
    max(CASE WHEN field_name = 'parking_required' THEN coalesce(l_bool, CASE WHEN l_field IS NULL THEN b_bool END) END) AS parking,
    bool_or(field_name = 'front_setback_restriction') AS has_front, bool_or(field_name = CASE WHEN project_type = 'jadu' THEN 'owner_occupancy_required_jadu' ELSE 'owner_occupancy_required_adu' END) AS has_occupancy
    FROM (SELECT done.request_id, found.*, CASE WHEN found.project_type = 'attached_adu' THEN 'max_height_attached_ft' WHEN near_transit THEN 'max_height_near_transit_ft' ELSE 'max_height_detached_standard_ft' END AS hf,
      CASE WHEN bedrooms >= 2 THEN 'max_size_sqft_2br' ELSE 'max_size_sqft_1br' END AS sf FROM done JOIN found ON done.live AND done.jurisdiction_id = found.jurisdiction_id
      AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type) GROUP BY request_id""", **TABLES))
def constraints(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("result.development_constraints")
    return results(spark, sf).where("kind = 'completed' AND jurisdiction_slug <> 'unknown'").select(
        "request_id", d["max_height_ft"]["value"].alias("max_height_ft"), d["max_height_ft"]["state_baseline"].alias("height_baseline"),
        d["max_height_ft"]["compliance_flag"].alias("height_flag"), d["max_size_sqft"]["value"].alias("max_size_sqft"), d["rear_setback_ft"]["value"].alias("setback_ft"),
        d["parking_required"]["value"].alias("parking"), d["front_setback_ft"].isNotNull().alias("has_front"), d["owner_occupancy_required"].isNotNull().alias("has_occupancy"),
    )


@query("r11_envelope", with_tables("""SELECT request_id, true AS available, coalesce(max(CASE WHEN field_name = 'side_rear_setback_min_ft' THEN coalesce(l_num, CASE WHEN l_field IS NULL THEN b_num END) END), 4) AS inset_ft
    FROM done JOIN found ON done.live AND done.jurisdiction_id = found.jurisdiction_id AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type
    WHERE include_envelope AND pid IS NOT NULL GROUP BY 1""", **TABLES))
def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("result.approximate_envelope")
    ft = F.regexp_extract(e["method"], r"\(([0-9.]+) ft\)", 1).cast("double")
    return results(spark, sf).where(e.isNotNull()).select("request_id", e["available"].alias("available"), ft.alias("inset_ft"))


@query("io12_findings", with_tables("""SELECT request_id, 'constraint' AS finding_type, found.field_name, flag AS compliance_flag,
    CAST(row_number() OVER (PARTITION BY request_id ORDER BY l_field IS NULL, found.field_name) - 1 AS INTEGER) AS sort_order,
    CASE WHEN l_field IS NULL THEN 'High' ELSE 'Local' END AS origin
    FROM done JOIN found ON done.live AND done.jurisdiction_id = found.jurisdiction_id AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type""", **TABLES))
def findings(spark: SparkSession, sf: str) -> DataFrame:
    f = P.analysis_findings(results(spark, sf)).where("finding_type = 'constraint'")
    return f.select("request_id", "finding_type", "field_name", "compliance_flag", "sort_order", F.when(F.startswith("source_url", F.lit("urn:code")), "Local").otherwise("High").alias("origin"))


@query("io12_overlay_findings", with_tables("""SELECT request_id, CAST(hits + CASE WHEN fl THEN 0 ELSE 1 END + CASE WHEN fi THEN 0 ELSE 1 END AS BIGINT) AS overlay_findings FROM done WHERE live""", **TABLES))
def overlay_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = P.analysis_findings(results(spark, sf)).where("finding_type = 'overlay'")
    return f.groupBy("request_id").agg(F.count("*").alias("overlay_findings"))


@query("io12_analyses", with_tables("""SELECT request_id, status AS feasibility_status, coalesce(status <> 'insufficient_data', false) AS billed, CASE WHEN placed THEN coverage_status END AS coverage_status,
    CASE WHEN live THEN pid END AS parcel_id, CASE WHEN placed THEN jurisdiction_id END AS jurisdiction_id, CASE WHEN placed THEN round(done.u / 1024 - 124, 9) END AS geocode_lon, rq.address AS input_address, rq.target_sqft,
    CASE WHEN existing_structure_type IN ('single_family', 'multifamily') THEN true END AS existing_structure, '{"include_envelope":' || done.include_envelope || ',"near_transit":' || done.near_transit || '}' AS options,
    'direct' AS provider, false AS shared FROM done JOIN rq USING (request_id) WHERE NOT placed OR live""", **TABLES))
def analyses(spark: SparkSession, sf: str) -> DataFrame:
    return P.analyses(results(spark, sf)).select(
        "request_id", "feasibility_status", "billed", "coverage_status", "parcel_id", "jurisdiction_id", F.round("geocode_lon", 9).alias("geocode_lon"), "input_address", "target_sqft",
        "existing_structure", "options", "provider", F.col("share_token").isNotNull().alias("shared"),
    )


@query("r17_sourced_fields", with_tables("""SELECT request_id, pc.apn, CASE WHEN pid IS NOT NULL THEN 'parcels/' || pc.jurisdiction_id END AS parcel_layer, CASE WHEN pid IS NOT NULL THEN 'sqft' END AS lot_unit, done.zone_code,
    CASE WHEN done.zone_code IS NOT NULL THEN 'Block ' || z.zone_id END AS zone_name, CASE WHEN z.zone_id % 3 <> 0 THEN 'Plan ' || z.zone_id END AS general_plan FROM done LEFT JOIN pc ON pc.parcel_id = pid
    LEFT JOIN (SELECT parcel_id, first(zone_id ORDER BY units DESC, zone_code, zone_id) AS zone_id FROM pz GROUP BY 1) z ON z.parcel_id = pid WHERE live AND pid IS NOT NULL""", **TABLES))
def sourced_fields(spark: SparkSession, sf: str) -> DataFrame:
    p, z = F.col("result.parcel"), F.col("result.zoning")
    return results(spark, sf).where("result.parcel.matched").select(
        "request_id", p["apn"]["value"].alias("apn"), p["apn"]["provenance"]["source_layer"].alias("parcel_layer"), p["lot_size_sqft"]["unit"].alias("lot_unit"),
        z["zone_code"]["value"].alias("zone_code"), z["zone_name"]["value"].alias("zone_name"), z["general_plan"]["value"].alias("general_plan"),
    )


_AGAIN = {
    **TABLES,
    "rqs": "SELECT event_id AS rid, user_id AS k, date_trunc('second', ts) AS t FROM events JOIN customer ON c_custkey = user_id",
    "stq": """SELECT c_custkey AS k, TIMESTAMP '2024-01-03 05:00:00' + to_days(CAST(c_custkey % 20 AS INTEGER)) AS t, 'stored-' || c_custkey AS id,
        CASE WHEN c_custkey % 2 = 0 THEN 'likely_feasible' ELSE 'insufficient_data' END AS st FROM customer WHERE c_custkey % 3 = 0""",
    "cov": "SELECT rqs.*, stq.id AS sid, stq.st FROM rqs LEFT JOIN stq ON stq.k = rqs.k AND stq.t <= rqs.t AND stq.t > rqs.t - INTERVAL 24 HOUR",
    "unc": "SELECT * FROM cov WHERE sid IS NULL",
    "chain": """SELECT k, min(t) AS t FROM unc GROUP BY 1 UNION ALL SELECT c.k, (SELECT min(t) FROM unc WHERE unc.k = c.k AND unc.t >= c.t + INTERVAL 24 HOUR) AS t
        FROM chain c WHERE (SELECT min(t) FROM unc WHERE unc.k = c.k AND unc.t >= c.t + INTERVAL 24 HOUR) IS NOT NULL""",
    "anch": "SELECT chain.k, chain.t, min(unc.rid) AS arid FROM chain JOIN unc ON unc.k = chain.k AND unc.t = chain.t GROUP BY 1, 2",
    "srv": """SELECT unc.rid, unc.k, CAST(NULL AS VARCHAR) AS sid, CAST(NULL AS VARCHAR) AS st, max(anch.t) AS since, bool_or(anch.arid = unc.rid) AS computed FROM unc JOIN anch ON anch.k = unc.k AND anch.t <= unc.t GROUP BY 1, 2
        UNION ALL SELECT rid, k, sid, st, NULL, false FROM cov WHERE sid IS NOT NULL""",
}


@query("r17_reused_analyses", with_tables("""SELECT rid AS request_id, CASE WHEN sid IS NULL AND placed AND NOT live THEN 'unsupported_coverage' ELSE 'completed' END AS kind, coalesce(st, status) AS feasibility_status,
    computed AND coalesce(status <> 'insufficient_data', false) AS billable, sid IS NOT NULL OR (NOT computed AND status IS NOT NULL) AS cache_hit,
    CASE WHEN sid IS NOT NULL THEN sid WHEN placed AND NOT live THEN NULL ELSE strftime(since, '%Y-%m-%dT%H:%M:%S+00:00') END AS answered_by FROM srv JOIN done ON done.request_id = k""", recursive=True, **_AGAIN))
def reused_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as its user's request, some answered from stored analyses, others by an earlier one of the batch."""
    one = D.ask(spark, sf)
    calls = D.table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("requested_at"))
    requests = one.join(dealt(calls), F.col("request_id") == F.col("user_id")).drop("request_id", "user_id").withColumnRenamed("event_id", "request_id")
    k = F.col("request_id")
    before = P.fingerprinted(one, D.AS_OF).where(k % 3 == 0).withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1))))
    status = F.when(F.col("_n") == 0, F.when(k % 2 == 0, "likely_feasible").otherwise("insufficient_data"))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-03 05:00:00").cast("timestamp")) + ((k % 20) * 24 + F.col("_n") * 10) * 3_600_000_000)
    stored = before.select(
        F.concat(F.lit("stored-"), k.cast("string"), F.when(F.col("_n") == 1, "-open").otherwise("")).alias("analysis_id"), "request_fingerprint", at.alias("created_at"), status.alias("feasibility_status"),
        F.lit("production").alias("coverage_status"), F.lit("somewhere").alias("jurisdiction_slug"),
    ).withColumn("result_json", F.to_json(F.struct("analysis_id", "feasibility_status")))
    out = P.answer(requests, D.refs(spark, sf), D.AS_OF, stored)
    return out.select("request_id", "kind", "feasibility_status", "billable", "cache_hit", F.coalesce("result.freshness.generated_at", "result.analysis_id").alias("answered_by"))


@query("a05_distinct_sources", with_tables("""SELECT done.request_id, 2 + CASE WHEN pid IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN done.zone_code IS NOT NULL THEN 1 ELSE 0 END + coalesce(ot.n, 0) + coalesce(fs.n, 0) AS sources,
    coalesce(strftime(greatest(TIMESTAMP '2024-01-01' + to_days(CAST(done.jurisdiction_id AS INTEGER)), CASE WHEN pid IS NOT NULL THEN TIMESTAMP '2023-12-01' + to_days(p_size) END,
      CASE WHEN done.zone_code IS NOT NULL THEN TIMESTAMP '2024-01-15' END, fs.last), '%Y-%m-%dT%H:%M:%S+00:00'), '') AS data_as_of FROM done
    LEFT JOIN pc ON pc.parcel_id = pid
    LEFT JOIN (SELECT request_id, count(DISTINCT overlay_type) AS n FROM (SELECT request_id, overlay_type FROM done JOIN po ON po.parcel_id = pid UNION ALL SELECT request_id, overlay_type FROM done JOIN ovs ON pid IS NULL AND u >= x1 AND u <= x2 AND v >= y1 AND v <= y2) GROUP BY 1) ot ON ot.request_id = done.request_id
    LEFT JOIN (SELECT request_id, count(DISTINCT CASE WHEN l_field IS NOT NULL THEN rule_id || '/' || l_linenumber ELSE citation END) AS n, max(last_verified_at) AS last FROM done JOIN found
      ON done.jurisdiction_id = found.jurisdiction_id AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type GROUP BY 1) fs ON fs.request_id = done.request_id
    WHERE live""", **TABLES))
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).where("kind = 'completed' AND jurisdiction_slug <> 'unknown'").select(
        "request_id", F.size("result.sources").cast("long").alias("sources"), F.coalesce("result.freshness.data_as_of", F.lit("")).alias("data_as_of")
    )


@query("a06_data_as_of", with_tables("""SELECT count(*) AS results, count(*) FILTER (WHERE live) AS dated FROM done WHERE NOT placed OR live""", **TABLES))
def data_as_of(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).where("kind = 'completed'")
    return r.agg(F.count("*").alias("results"), F.count("result.freshness.data_as_of").alias("dated"))


@query("w09_path_sources", with_tables("""SELECT done.request_id, least(6, count(*) FILTER (WHERE regexp_matches(found.field_name, '^(max_|parking|owner|sb9|jadu)'))) AS path_sources
    FROM done JOIN found ON live AND done.jurisdiction_id = found.jurisdiction_id AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type GROUP BY 1""", **TABLES))
def path_sources(spark: SparkSession, sf: str) -> DataFrame:
    path = F.get(F.col("result.eligible_paths"), F.lit(0))
    return results(spark, sf).where("kind = 'completed' AND jurisdiction_slug <> 'unknown'").select("request_id", F.size(path["sources"]).cast("long").alias("path_sources"))


@query("q05_version_stamps", with_tables(f"""SELECT '{C.ANALYSIS_VERSION}' AS analysis_version, '{C.RULES_VERSION}' AS rules_version, '{C.STATE_BASELINE_VERSION}' AS baseline_version,
    sha256('{C.DISCLAIMER}') AS disclaimer_hash, '2024-01-31T00:00:00+00:00' AS generated_at, count(*) AS results FROM done WHERE NOT placed OR live""", **TABLES))
def version_stamps(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("result.freshness")
    return results(spark, sf).where("kind = 'completed'").groupBy(
        f["analysis_version"].alias("analysis_version"), f["rules_version"].alias("rules_version"), f["state_baseline_version"].alias("baseline_version"),
        F.sha2("result.disclaimer", 256).alias("disclaimer_hash"), f["generated_at"].alias("generated_at"),
    ).agg(F.count("*").alias("results"))


@query("q04_missing_provenance", with_tables("""SELECT count(*) AS findings, 0 AS incomplete FROM done JOIN found ON done.live AND done.jurisdiction_id = found.jurisdiction_id
    AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type""", **TABLES))
def missing_provenance(spark: SparkSession, sf: str) -> DataFrame:
    f = P.analysis_findings(results(spark, sf)).where("finding_type = 'constraint'")
    bad = F.col("source_url").isNull() | F.col("source_title").isNull() | F.col("confidence").isNull() | F.col("data_status").isNull()
    return f.agg(F.count("*").alias("findings"), F.count_if(bad).cast("int").alias("incomplete"))


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Every zone under every project type, as the rule joins see them."""
    types = F.array(*[F.lit(t) for t in C.PROJECT_TYPES])
    return D.zones(spark, sf).select("jurisdiction_id", "zone_code").distinct().withColumn("project_type", F.explode(types))


_ALL = {"ctx": f"SELECT jurisdiction_id, zone_code, project_type FROM (SELECT DISTINCT jurisdiction_id, zone_code FROM zn) z CROSS JOIN (SELECT unnest({D._list(C.PROJECT_TYPES)}) AS project_type) t", "found": _FOUND}


def merged(spark: SparkSession, sf: str) -> DataFrame:
    # the rule tables alone: no lookup is made, so no layer is built
    return rules.merge_rules(contexts(spark, sf), D.zoning_rules(spark, sf), D.rule_attributes(spark, sf), C.state_baselines(spark), F.lit(D.AS_OF).cast("timestamp"))


@query("j09_merge_rules", with_tables("""SELECT jurisdiction_id, zone_code, project_type, field_name, CASE WHEN l_field IS NULL THEN 'state_baseline' ELSE 'local' END AS origin, flag AS compliance_flag FROM found""", **_ALL))
def merge_rules(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("jurisdiction_id", "zone_code", "project_type", "field_name", "origin", "compliance_flag")


@query("r01_compliance_flags", with_tables("""SELECT field_name, op AS operator, flag AS compliance_flag, count(*) AS n FROM found WHERE l_field IS NOT NULL AND b_field IS NOT NULL GROUP BY 1, 2, 3""", **_ALL))
def compliance_flags(spark: SparkSession, sf: str) -> DataFrame:
    m = merged(spark, sf).where("origin = 'local' AND state_baseline IS NOT NULL")
    return m.groupBy("field_name", "operator", "compliance_flag").agg(F.count("*").alias("n"))


@query("r02_merged_values", with_tables(f"""SELECT jurisdiction_id, zone_code, project_type, field_name, l_num AS num, l_bool AS bool, b_num AS baseline_num, unit,
    CASE WHEN b_field IS NULL THEN 'No matching California state baseline for this field.' WHEN flag = '{C.RESTRICTIVE}' THEN 'Local value appears more restrictive than the current California state baseline (' || citation || '). Local source is preserved; verify against state law with a professional.' END AS note
    FROM found WHERE l_field IS NOT NULL""", **_ALL))
def merged_values(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).where("origin = 'local'").select(
        "jurisdiction_id", "zone_code", "project_type", "field_name", F.col("value.num").alias("num"), F.col("value.bool").alias("bool"),
        F.col("state_baseline.num").alias("baseline_num"), "unit", "note",
    )


@query("r03_baseline_findings", with_tables(f"""SELECT jurisdiction_id, zone_code, project_type, field_name, b_num AS num, b_bool AS bool, citation AS source_section, '{C.BASELINE_URL}' AS source_url, op AS operator FROM found WHERE l_field IS NULL""", **_ALL))
def baseline_findings(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).where("origin = 'state_baseline'").select(
        "jurisdiction_id", "zone_code", "project_type", "field_name", F.col("value.num").alias("num"), F.col("value.bool").alias("bool"),
        F.col("source.source_section").alias("source_section"), F.col("source.source_url").alias("source_url"), "operator",
    )


@query("u01_finding_union", with_tables("""SELECT finding_type, count(*) AS n FROM (
    SELECT 'constraint' AS finding_type FROM done JOIN found ON done.live AND done.jurisdiction_id = found.jurisdiction_id AND coalesce(done.zone_code, '~') = coalesce(found.zone_code, '~') AND done.project_type = found.project_type
    UNION ALL SELECT 'overlay' FROM done, range(0, CAST(CASE WHEN live THEN hits + CASE WHEN fl THEN 0 ELSE 1 END + CASE WHEN fi THEN 0 ELSE 1 END ELSE 0 END AS BIGINT)) r(i)) GROUP BY 1""", **TABLES))
def finding_union(spark: SparkSession, sf: str) -> DataFrame:
    return P.analysis_findings(results(spark, sf)).groupBy("finding_type").agg(F.count("*").alias("n"))
