"""The feasibility job: requests joined to every reference table, one result per request."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import geometry as G
from parcelspark.functions import text as T
from parcelspark.functions import values as V
from parcelspark.operators import envelope as E
from parcelspark.operators import asof, geocode, metering, rules, spatial
from parcelspark.operators.layers import Layer
from parcelspark.operators.skew import dealt
from parcelspark.session import cut

SOURCE_T = (
    "struct<source_url:string,source_title:string,source_section:string,source_layer:string,"
    "retrieved_at:timestamp,last_verified_at:timestamp,confidence:string,data_status:string,snapshot_hash:string>"
)


@dataclass
class Refs:
    """Reference tables of the job."""

    jurisdictions: DataFrame  # jurisdiction_id, slug, name, jurisdiction_type, coverage_status, last_source_refresh_at, geom
    parcels: DataFrame  # jurisdiction_id, parcel_id, apn, area_sqft, geom, source columns
    zones: DataFrame  # jurisdiction_id, zone_id, zone_code, zone_name, general_plan (if known), geom, source columns
    overlays: DataFrame  # overlay_id, overlay_type, name, designation, raw_feature_id, raw_value, geom, source columns
    rules: DataFrame
    attributes: DataFrame
    baselines: DataFrame
    geocodes: DataFrame  # normalized_address, lon, lat, confidence
    layers: dict[str, Layer] = field(default_factory=dict)  # stored layers by the names above; a table without one is filed for the call

    def layer(self, name: str) -> DataFrame | Layer:
        return self.layers.get(name, getattr(self, name))


def sites(points: DataFrame, refs: Refs) -> DataFrame:
    """Everything known about each distinct point: jurisdiction, parcel, zones, overlays.

    Zones and overlays are looked up once per distinct matched parcel. A key of
    (parcel or point) called ``place`` lets both lookups share one join back.
    """
    place = F.coalesce(F.concat(F.lit("p:"), F.col("parcel_id").cast("string")), F.concat_ws(",", F.lit("x:"), F.col("lon").cast("string"), F.col("lat").cast("string")))
    jur = refs.jurisdictions.select(
        "jurisdiction_id", "slug", "name", "coverage_status",
        F.struct(
            F.concat(F.lit("urn:jurisdiction:"), F.col("slug")).alias("source_url"),
            F.concat(F.lit("Jurisdiction boundary ("), F.col("name"), F.lit(")")).alias("source_title"),
            F.lit(None).cast("string").alias("source_section"), F.lit("jurisdictions.boundary").alias("source_layer"),
            F.col("last_source_refresh_at").alias("retrieved_at"), F.col("last_source_refresh_at").alias("last_verified_at"),
            F.lit("high").alias("confidence"), F.lit("current").alias("data_status"), F.lit(None).cast("string").alias("snapshot_hash"),
        ).cast(SOURCE_T).alias("jurisdiction_source"),
    )
    # stages that several joins read are written: a plan holds them once, and the driver plans, sends and compiles them once
    located = cut(spatial.match_jurisdiction(points, refs.layer("jurisdictions")).join(jur, "jurisdiction_id"))
    matched = spatial.match_parcel(located.where("coverage_status = 'production'"), refs.layer("parcels"))
    placed = located.join(dealt(matched), ["jurisdiction_id", "lon", "lat"], "left").withColumn("place", place)
    placed = cut(placed)
    live = placed.where("coverage_status = 'production'")

    used = live.where("parcel_id IS NOT NULL").select("parcel_id", "place").distinct()
    lots = refs.parcels.select(
        "jurisdiction_id", "parcel_id", "apn", "area_sqft", "geom", rules.source("Parcel GIS layer", have=set(refs.parcels.columns)).cast(SOURCE_T).alias("parcel_source")
    ).join(dealt(used), "parcel_id")
    lots = cut(lots)
    bare = live.where("parcel_id IS NULL").select("jurisdiction_id", "lon", "lat", "place")

    named = lambda pairs: pairs.withColumn("place", F.concat(F.lit("p:"), F.col("parcel_id").cast("string")))
    zone_pairs = named(spatial.match_zones(lots, refs.layer("zones"))).select("place", "zone_id", "zone_code", "overlap_area").unionByName(
        spatial.zones_at_points(bare, refs.layer("zones")).select("place", "zone_id", "zone_code", "overlap_area")
    )
    plan = F.col("general_plan") if "general_plan" in refs.zones.columns else F.lit(None).cast("string")
    zone_info = refs.zones.select("zone_id", "zone_name", plan.alias("general_plan"), rules.source("Zoning districts GIS layer", have=set(refs.zones.columns)).cast(SOURCE_T).alias("zone_source"))
    zoned = cut(spatial.zone_choice(zone_pairs, ["place"])).join(dealt(zone_info), "zone_id")

    hits = named(spatial.match_overlays(lots, refs.layer("overlays"))).select("place", "overlay_id", "overlay_type").unionByName(
        spatial.overlays_at_points(bare.select("lon", "lat", "place"), refs.layer("overlays")).select("place", "overlay_id", "overlay_type")
    )
    over = cut(overlay_lists(live.select("place").distinct(), cut(hits), refs.overlays))
    lot_info = lots.select("place", "apn", "area_sqft", F.expr(G.centroid("geom")).alias("centroid"), "parcel_source")
    return cut(placed.join(dealt(lot_info), "place", "left").join(dealt(zoned), "place", "left").join(dealt(over), "place", "left").drop("place"))


def overlay_lists(keys: DataFrame, hits: DataFrame, overlays: DataFrame) -> DataFrame:
    """``place, overlays, hazard_hit``: ordered overlay findings of each place."""
    empty = F.create_map().cast("map<string,string>")
    base = F.map_from_arrays(
        F.array(F.lit("raw_feature_id"), F.lit("designation"), F.lit("name")), F.array("raw_feature_id", "designation", "name")
    )
    # the feature's own attributes win over the three standard ones
    extra = F.coalesce("raw_value", empty)
    raw = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra)
    info = overlays.select(
        "overlay_id", raw.alias("raw"), F.coalesce(F.nullif("designation", F.lit("")), F.col("name")).alias("description"),
        rules.source(F.concat(F.col("overlay_type"), F.lit(" overlay GIS layer")), have=set(overlays.columns)).cast(SOURCE_T).alias("source"),
    )
    rich = hits.join(dealt(info), "overlay_id")
    full = spatial.complete_overlays(keys, rich, overlays, ["place"])
    # Fixed value: description of a layer that was never loaded.
    gone = "Overlay layer has not been ingested; presence could not be determined."
    sev = V.hit_severity(F.col("overlay_type"), F.col("status"), F.col("raw"), F.col("description"))
    row = F.struct(
        (F.col("status") != "hit").alias("later"), F.when(F.col("status") == "hit", F.col("overlay_type")).otherwise(F.when(F.col("overlay_type") == "flood", "0").otherwise("1")).alias("k"),
        F.col("overlay_id").alias("id"), F.col("overlay_type"), F.col("status"), sev.alias("severity"),
        F.map_entries(V.with_severity(F.col("raw"), sev)).alias("raw"),
        F.when(F.col("status") == "source_unavailable", gone).otherwise(F.col("description")).alias("description"), F.col("source"),
    )
    lists = full.groupBy("place").agg(F.sort_array(F.collect_list(row)).alias("o"), F.max(V.is_hazard(F.col("overlay_type"), sev)).alias("hazard_hit"))
    pretty = F.transform("o", lambda o: F.struct(o["overlay_type"].alias("overlay_type"), o["status"].alias("status"), o["severity"].alias("severity"), F.map_from_entries(o["raw"]).alias("raw_values"), o["description"].alias("description"), o["source"].alias("provenance")))
    return lists.select("place", pretty.alias("overlays"), "hazard_hit")


def first_sources(sources: Column) -> Column:
    """Sources without repeats of (url, section, layer); the first occurrence stays."""
    same = lambda a, b: a["source_url"].eqNullSafe(b["source_url"]) & a["source_section"].eqNullSafe(b["source_section"]) & a["source_layer"].eqNullSafe(b["source_layer"])
    known = F.filter(sources, lambda s: s.isNotNull())
    return F.filter(known, lambda s, i: ~F.exists(F.slice(known, F.lit(1), i), lambda t: same(t, s)))


def _notes(*items: tuple[Column, str, Column]) -> Column:
    rows = [F.when(c, F.struct(F.lit(code).alias("code"), text.alias("text"))) for c, code, text in items]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


OPTIONAL = {"requested_at": "timestamp", "idempotency_key": "string", "provider": "string", "plan": "string", "may_share": "boolean"}


def fingerprinted(requests: DataFrame, as_of: str) -> DataFrame:
    """Requests with ``normalized_address``, ``request_fingerprint`` and the columns of ``OPTIONAL`` that they lack.

    A request without a time is made at ``as_of``, one without a provider directly.
    """
    for name, kind in OPTIONAL.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    requests = requests.withColumns({
        "requested_at": F.coalesce("requested_at", F.lit(as_of).cast("timestamp")), "provider": F.coalesce("provider", F.lit("direct")),
        "normalized_address": T.normalize_address(F.col("address")),
    })
    opts = F.struct("include_envelope", "near_transit")
    print_ = T.request_fingerprint(
        F.col("consumer_id"), F.col("normalized_address"), F.col("project_type"), F.col("target_sqft"),
        F.col("bedrooms"), F.col("proposed_height_ft"), F.col("existing_structure_type"), opts,
    )
    return requests.withColumn("request_fingerprint", print_)


def feasibility(requests: DataFrame, refs: Refs, as_of: str, path_sources: int | None = None) -> DataFrame:
    """One row per request with status, billing and the nested ``result`` document.

    ``requests``: request_id, consumer_id, address, project_type, target_sqft, bedrooms,
    proposed_height_ft, existing_structure_type, near_transit, include_envelope, and any of
    ``OPTIONAL``. ``as_of`` is the instant of the run (``yyyy-MM-dd HH:mm:ss``, UTC): baselines in
    force then apply, and it is the time of requests that have none of their own.
    ``path_sources`` limits how many sources a path lists; by default it lists all.
    """
    now = F.lit(as_of).cast("timestamp")
    req = geocode.geocode(fingerprinted(requests, as_of), refs.geocodes)
    good = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("geocode_confidence").isin("high", "medium")
    # read by the points and by both halves of the next join
    req = cut(req.withColumn("_geo", F.coalesce(good, F.lit(False))))
    pts = spatial.distinct_points(req.where("_geo"))
    at = sites(pts, refs).withColumnsRenamed({"lon": "_lon", "lat": "_lat"})
    # a failed geocode has no site: such rows pass beside the join, or all would meet at its null key
    sited = req.where("_geo").join(dealt(at), (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")), "left").drop("_lon", "_lat")
    both = sited.unionByName(req.where("NOT _geo"), allowMissingColumns=True)
    # read by the rule contexts, the insets asked for and both halves of the last join, each of which planned and made it anew
    both = cut(both.withColumn("_live", F.coalesce(F.col("coverage_status") == "production", F.lit(False))))

    ctx_keys = ["jurisdiction_id", "zone_code", "project_type"]
    contexts = both.where("_live").select(*ctx_keys).distinct()
    found = rules.finding_sets(rules.merge_rules(contexts, refs.rules, refs.attributes, refs.baselines, now))
    verified = rules.current_rules(refs.rules).select(
        F.col("jurisdiction_id").alias("_j"), "zone_key", F.col("project_type").alias("_p"), (F.col("review_status") == "verified").alias("has_local_rules")
    )
    ctx = found.join(
        verified, (F.col("jurisdiction_id") == F.col("_j")) & (F.upper("zone_code") == F.col("zone_key")) & (F.col("project_type") == F.col("_p")), "left"
    ).drop("_j", "_p", "zone_key")
    ctx = cut(ctx).alias("c")
    r = both.alias("r")
    cond = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ctx_keys]
    full = r.join(ctx, [F.col("r._live"), *cond], "left").select("r.*", "c.findings", F.coalesce("c.has_local_rules", F.lit(False)).alias("has_local_rules"))

    setback = rules.find(F.col("findings"), F.lit("side_rear_setback_min_ft"))["value"]["num"]
    want = F.coalesce(F.col("include_envelope"), F.lit(False))
    full = full.withColumn("inset_ft", F.when(want & F.col("parcel_id").isNotNull(), V.uniform_inset_ft(setback, setback, F.lit(None).cast("double"))))
    asked = full.where("inset_ft IS NOT NULL").select("parcel_id", "inset_ft").distinct()
    areas = E.inset_areas(
        refs.parcels.select("parcel_id", "geom").join(dealt(asked), "parcel_id"), V.feet_to_meters(F.col("inset_ft"))
    ).select("parcel_id", "inset_ft", "inset_area_m2")
    # likewise requests without an envelope
    full = full.where("inset_ft IS NOT NULL").join(dealt(cut(areas)), ["parcel_id", "inset_ft"], "left").unionByName(full.where("inset_ft IS NULL"), allowMissingColumns=True)
    return _assemble(full, path_sources)


def sourced(value: Column, source: Column, unit: str | None = None) -> Column:
    """A value of the answer with its provenance; null without a value."""
    fields = [value.alias("value"), *([F.lit(unit).alias("unit")] if unit else []), source.alias("provenance")]
    return F.when(value.isNotNull() & source.isNotNull(), F.struct(*fields))


def share_token(analysis_id: Column) -> Column:
    """Public token of 22 URL-safe characters; a hash of the analysis, so a replayed job gives the same one."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("share:"), analysis_id), 256))), "+/", "-_"), 1, 22)


def _assemble(df: DataFrame, path_sources: int | None) -> DataFrame:
    """Row-local part: statuses, notes and the result document."""
    c = F.col
    now = c("requested_at")
    matched, resolved = c("parcel_id").isNotNull(), c("zone_code").isNotNull()
    placed, live, geo = c("jurisdiction_id").isNotNull(), c("_live"), c("_geo")
    early = ~geo | ~placed  # no analysis beyond the address
    unsupported = placed & ~live
    want, ambiguous = F.coalesce(c("include_envelope"), F.lit(False)), F.coalesce(c("cross_zone_ambiguity"), F.lit(False))
    has_env = want & matched
    oriented = has_env & c("inset_area_m2").isNotNull()
    path = rules.path_status(c("project_type"), c("zone_code"), c("has_local_rules"), resolved)
    flags = F.transform("findings", lambda f: f["compliance_flag"])
    low = (c("geocode_confidence") == "low") | F.coalesce(c("parcel_source.confidence") == "low", F.lit(False))
    df = df.withColumn("_path", path).withColumn("_flags", flags)
    status = F.when(early, "insufficient_data").when(
        live,
        rules.feasibility_status(
            F.lit(True), matched, resolved, low, ambiguous, c("_flags"), F.coalesce(c("hazard_hit"), F.lit(False)), c("_path.status"), oriented
        ),
    )
    df = df.withColumn("feasibility_status", status).withColumn("kind", F.when(unsupported, "unsupported_coverage").otherwise("completed"))
    # Limitation and assumption texts.
    limits = _notes(
        (~geo, "geocode_failed", F.lit("The address could not be geocoded with sufficient confidence, so no parcel-level analysis was performed.")),
        (geo & ~placed, "jurisdiction_unresolved", F.lit("The point did not fall within any registered jurisdiction boundary.")),
        (live & ~matched, "parcel_unmatched", F.lit("No parcel polygon contained or intersected the geocoded point within the documented tolerance.")),
        (live & ambiguous, "cross_zone_ambiguity", F.format_string("The parcel intersects more than one zoning district (%s); the primary zone was used. Verify.", F.array_join("zone_codes", ", "))),
        (live & ~resolved, "zoning_unresolved", F.lit("No zoning district could be joined to this parcel.")),
        (live & oriented, "envelope_orientation_unknown", F.lit("Parcel edge orientation (front / side / rear) is unknown; the envelope is a uniform-setback approximation pending professional review.")),
        (live & want & ~matched, "envelope_unavailable_no_parcel", F.lit("An approximate envelope requires a matched parcel geometry, which was not resolved for this address.")),
    )
    assume = F.filter(
        F.array(
            F.when(live & F.coalesce(c("near_transit"), F.lit(False)), "Caller asserted the parcel is near transit; transit-based state provisions (height, parking) were applied."),
            F.when(live & ~c("has_local_rules"), "Local ordinance rules for this zone are not yet ingested; constraints are shown from California state baselines and are labeled accordingly."),
        ),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast(f"array<{SOURCE_T}>")
    geo_source = F.struct(
        F.lit("urn:geocoder:reference").alias("source_url"), F.lit("Geocode reference table").alias("source_title"),
        F.lit(None).cast("string").alias("source_section"), F.lit(None).cast("string").alias("source_layer"),
        now.alias("retrieved_at"), F.lit(None).cast("timestamp").alias("last_verified_at"), c("geocode_confidence").alias("confidence"),
        F.lit("current").alias("data_status"), F.lit(None).cast("string").alias("snapshot_hash"),
    ).cast(SOURCE_T)
    parts = F.concat(
        F.array(geo_source, c("jurisdiction_source"), c("parcel_source"), c("zone_source")),
        F.coalesce(F.transform("overlays", lambda o: o["provenance"]), none),
        F.coalesce(F.transform("findings", lambda f: f["source"].cast(SOURCE_T)), none),
        F.array(F.when(oriented, c("parcel_source"))),
    )
    df = df.withColumn("limitations", limits).withColumn("assumptions", assume).withColumn("_sources", first_sources(parts))
    keep = F.filter("findings", lambda f: f["field_name"].rlike("^(max_|parking|owner|sb9|jadu)"))
    stamped = lambda s: s.withField("retrieved_at", F.coalesce(s["retrieved_at"], now))
    as_of_data = F.array_max(F.transform("_sources", lambda s: s["last_verified_at"]))
    analysis = F.sha2(F.concat_ws("|", c("request_fingerprint"), c("request_id").cast("string"), now.cast("string")), 256)
    on = lambda cond, col: F.when(cond, col)
    dated = lambda src: F.when(src.isNotNull(), stamped(src))
    billable = F.coalesce(c("feasibility_status").isin(C.BILLABLE), F.lit(False))
    shared = billable & F.coalesce(c("may_share"), F.lit(False))
    result = F.struct(
        analysis.alias("analysis_id"),
        F.struct("address", "normalized_address", "project_type", "target_sqft", "bedrooms", "proposed_height_ft").alias("request"),
        F.struct(
            F.coalesce("slug", F.lit("unknown")).alias("jurisdiction_slug"), F.coalesce("name", F.lit("Unknown")).alias("jurisdiction_name"),
            F.coalesce("coverage_status", F.lit("planned")).alias("coverage_status"), on(placed, F.lit("high")).alias("matched_confidence"),
            c("jurisdiction_source").alias("provenance"),
        ).alias("coverage"),
        F.struct(
            matched.alias("matched"), "match_method", on(matched, c("match_tolerance_m")).alias("match_tolerance_m"),
            sourced(c("apn"), dated(c("parcel_source"))).alias("apn"),
            sourced(F.bround("area_sqft", 1), dated(c("parcel_source")), "sqft").alias("lot_size_sqft"), "centroid",
        ).alias("parcel"),
        F.struct(
            ambiguous.alias("cross_zone_ambiguity"), *[sourced(c(k), dated(c("zone_source"))).alias(k) for k in ("zone_code", "zone_name", "general_plan")]
        ).alias("zoning"),
        c("feasibility_status"),
        F.when(early, F.array().cast("array<struct<path_type:string,status:string,reason:string,sources:array<" + SOURCE_T + ">>>")).otherwise(
            F.array(F.struct(
                c("project_type").alias("path_type"), c("_path.status").alias("status"), c("_path.reason").alias("reason"),
                F.transform(keep if path_sources is None else F.slice(keep, 1, path_sources), lambda f: f["source"].cast(SOURCE_T)).alias("sources"),
            ))
        ).alias("eligible_paths"),
        on(~early, rules.constraints(c("findings"), c("project_type"), c("near_transit"), c("bedrooms"))).alias("development_constraints"),
        c("overlays").alias("overlay_findings"), c("assumptions"), c("limitations"),
        F.transform("_sources", stamped).alias("sources"),
        F.struct(
            F.lit(C.ANALYSIS_VERSION).alias("analysis_version"), F.lit(C.RULES_VERSION).alias("rules_version"),
            F.lit(C.STATE_BASELINE_VERSION).alias("state_baseline_version"), T.iso_utc(now).alias("generated_at"),
            on(~early, T.iso_utc(as_of_data)).alias("data_as_of"),
        ).alias("freshness"),
        on(shared, share_token(analysis)).alias("share_token"), F.lit(C.DISCLAIMER).alias("disclaimer"),
        on(has_env, E.envelope_block(c("inset_area_m2"), c("inset_ft"))).alias("approximate_envelope"),
    )
    return df.select(
        "request_id", "consumer_id", "request_fingerprint", "normalized_address", "lon", "lat", "kind", "feasibility_status",
        billable.alias("billable"), "project_type", "bedrooms", "near_transit", "geocode_confidence",
        F.coalesce("slug", on(early, F.lit("unknown"))).alias("jurisdiction_slug"), F.coalesce("coverage_status", F.lit("planned")).alias("coverage_status"),
        "parcel_id", "match_method", "zone_code", ambiguous.alias("cross_zone_ambiguity"), F.coalesce("hazard_hit", F.lit(False)).alias("hazard_hit"),
        "has_local_rules", c("_path.status").alias("path_status"), "findings", "overlays", "limitations", on(~unsupported, result).alias("result"),
        F.lit(False).alias("cache_hit"), "jurisdiction_id", "existing_structure_type", "include_envelope", *[k for k in OPTIONAL if k != "may_share"],
    )


def served(requests: DataFrame, stored: DataFrame, hours: float = C.DEDUPE_HOURS) -> DataFrame:
    """``request_id, computed, analysis_id, anchor_id``: how each request is answered.

    A request repeats the newest analysis of its fingerprint that was computed less than ``hours`` before it: a stored one
    (``analysis_id``), or that of an earlier request (``anchor_id``). Without one it is computed. Repeats compute nothing,
    so they do not extend the time; stored rows without a status count for nothing. A request found in the stored rows
    cannot have a newer one among the computed, since a request is computed only where no stored row reaches.
    """
    span = int(hours * 3_600_000_000)
    asking = cut(requests.select("request_id", F.col("request_fingerprint").alias("fingerprint"), F.unix_micros("requested_at").alias("us"), F.col("requested_at").alias("ts")))
    kept = stored.where("feasibility_status IS NOT NULL").select(F.col("request_fingerprint").alias("fingerprint"), F.unix_micros("created_at").alias("us"), "analysis_id")
    old = asof.latest_within(asking.drop("ts"), kept, ["fingerprint"], span, id="request_id").select("request_id", F.col("found.analysis_id").alias("analysis_id"))
    past = cut(asking.join(dealt(old), "request_id", "left"))
    rest = past.where("analysis_id IS NULL").withColumnRenamed("request_id", "event_id").drop("analysis_id")
    fresh = cut(metering.dedupe_replay(rest, hours)).withColumnRenamed("event_id", "request_id")
    anchors = fresh.where("NOT hit").select("fingerprint", "us", F.col("request_id").alias("anchor_id"))
    new = asof.latest_within(fresh.where("hit").select("request_id", "fingerprint", "us"), anchors, ["fingerprint"], span, id="request_id")
    linked = fresh.join(dealt(new), "request_id", "left").select("request_id", F.col("found.anchor_id").alias("anchor_id"), (~F.col("hit")).alias("computed"))
    text = linked.schema["request_id"].dataType
    again = past.where("analysis_id IS NOT NULL").select("request_id", "analysis_id", F.lit(None).cast(text).alias("anchor_id"), F.lit(False).alias("computed"))
    return again.unionByName(linked, allowMissingColumns=True)


def answer(requests: DataFrame, refs: Refs, as_of: str, stored: DataFrame, hours: float = C.DEDUPE_HOURS, path_sources: int | None = None) -> DataFrame:
    """``feasibility`` that computes an analysis once and repeats it for ``hours``, from ``stored`` rows (the analyses
    table, with jurisdiction_slug) and within the batch. Repeats have ``cache_hit`` and are not billed.

    An answer of unsupported coverage is kept nowhere, so requests after it are answered anew, which gives the same.
    Request ids must be unique.
    """
    requests = fingerprinted(requests, as_of)
    how = cut(served(requests, stored, hours))
    fresh = cut(feasibility(requests.join(dealt(how.where("computed").select("request_id")), "request_id", "left_semi"), refs, as_of, path_sources))
    own = ["request_id", "requested_at", "idempotency_key", "provider", "plan"]
    # repeats within the batch: the earlier request's row under the later one's id
    pairs = how.where("NOT computed AND analysis_id IS NULL").select("request_id", "anchor_id").join(dealt(requests.select(*own)), "request_id")
    told = fresh.drop("requested_at", "idempotency_key", "provider", "plan").withColumnRenamed("request_id", "anchor_id")
    hit = F.col("feasibility_status").isNotNull()
    within = pairs.join(dealt(told), "anchor_id").withColumn("cache_hit", hit).withColumn("billable", F.lit(False)).select(*fresh.columns)
    # repeats of stored analyses: what was stored, as it was
    kept = stored.select("analysis_id", "feasibility_status", "coverage_status", "jurisdiction_slug", F.from_json("result_json", fresh.schema["result"].dataType).alias("result"))
    found = how.where("analysis_id IS NOT NULL").select("request_id", "analysis_id").join(dealt(kept), "analysis_id")
    asked = requests.select(*own, "consumer_id", "request_fingerprint", "normalized_address", "project_type", "bedrooms", "near_transit", "existing_structure_type", "include_envelope")
    before = found.drop("analysis_id").join(dealt(asked), "request_id").withColumns({"kind": F.lit("completed"), "billable": F.lit(False), "cache_hit": F.lit(True)})
    return fresh.unionByName(within).unionByName(before, allowMissingColumns=True)


def analyses(results: DataFrame) -> DataFrame:
    """Rows of the analyses table: completed requests that were computed, one each."""
    request = lambda k: F.col(f"result.request.{k}").alias(k)
    structure = V.existing_structure_flag(F.col("existing_structure_type"))
    found = F.col("jurisdiction_slug") != "unknown"
    return results.where("kind = 'completed' AND NOT cache_hit").select(
        F.col("result.analysis_id").alias("analysis_id"), "request_id", "request_fingerprint", "idempotency_key", F.col("result.share_token").alias("share_token"),
        "consumer_id", "provider", "plan", F.col("result.request.address").alias("input_address"), "normalized_address",
        F.when(found, F.col("lon")).alias("geocode_lon"), F.when(found, F.col("lat")).alias("geocode_lat"), "project_type", *[request(k) for k in ("target_sqft", "bedrooms", "proposed_height_ft")],
        structure.alias("existing_structure"), F.to_json(F.struct("include_envelope", "near_transit")).alias("options"),
        "jurisdiction_id", "jurisdiction_slug", "parcel_id", F.when(found, F.col("coverage_status")).alias("coverage_status"),
        "feasibility_status", F.lit(None).cast("double").alias("score"), F.lit(C.ANALYSIS_VERSION).alias("analysis_version"),
        F.to_json("result").alias("result_json"), F.lit(C.DISCLAIMER).alias("disclaimer"), "billable", F.col("billable").alias("billed"),
        F.lit(False).alias("cache_hit"), F.col("requested_at").alias("created_at"),
    )


def analysis_findings(results: DataFrame) -> DataFrame:
    """Rows of the findings table: rule findings in order, then overlay findings."""
    done = results.where("kind = 'completed' AND feasibility_status IS NOT NULL AND NOT cache_hit")
    key = F.col("result.analysis_id").alias("analysis_id")
    rule = done.select(key, "request_id", "project_type", F.posexplode("findings").alias("sort_order", "f")).select(
        "analysis_id", "request_id", F.lit("constraint").alias("finding_type"), F.col("project_type").alias("project_path"),
        F.col("f.field_name").alias("field_name"), F.col("f.note").alias("detail"), V.value_text(F.col("f.value")).alias("value_json"),
        F.col("f.compliance_flag").alias("compliance_flag"), F.col("f.source.source_url").alias("source_url"),
        F.col("f.source.source_title").alias("source_title"), F.col("f.source.confidence").alias("confidence"),
        F.col("f.source.data_status").alias("data_status"), "sort_order",
    )
    over = done.select(key, "request_id", F.coalesce(F.size("findings"), F.lit(0)).alias("n"), F.posexplode("overlays").alias("p", "o")).select(
        "analysis_id", "request_id", F.lit("overlay").alias("finding_type"), F.col("o.overlay_type").alias("field_name"),
        F.col("o.description").alias("detail"), F.to_json("o.raw_values").alias("value_json"), (F.col("n") + F.col("p")).alias("sort_order"),
    )
    return rule.unionByName(over, allowMissingColumns=True)
