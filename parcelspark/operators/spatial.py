"""Spatial lookups: point to jurisdiction and parcel, parcel to zones and overlays.

All of them take plain tables with a ``geom`` column and return one row per match, keyed by the
columns named. None carries a geometry out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import geometry as G
from parcelspark.operators import quadtree as Q
from parcelspark.operators.layers import Layer, in_envelope, with_edges
from parcelspark.operators.skew import dealt, spread

TOLERANCE_M = 25.0  # fixed value: nearest-parcel radius

PARCEL_KEEP = ["jurisdiction_id", "first"]
ZONE_KEEP = ["jurisdiction_id", "zone_id", "zone_code"]
OVERLAY_KEEP = ["overlay_id", "overlay_type"]
JURISDICTION_KEEP = ["jurisdiction_id", "jurisdiction_type", "slug"]

__all__ = ["in_envelope", "with_edges"]


def distinct_points(requests: DataFrame) -> DataFrame:
    """Distinct coordinates: many requests for one address cost one lookup."""
    return requests.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct()


def points_in_polygons(points: DataFrame, polygons: DataFrame | Layer, keep: list[str]) -> DataFrame:
    """Pairs of a point (``lon``, ``lat`` and its other columns) and a polygon strictly around
    it; ``keep`` names the polygon columns wanted."""
    layer = polygons if isinstance(polygons, Layer) else Layer.of(polygons, keep)
    return layer.points(points).where(Q.contains_point()).select(*points.columns, *keep)


def match_jurisdiction(points: DataFrame, jurisdictions: DataFrame | Layer) -> DataFrame:
    """``lon, lat, jurisdiction_id``: the containing boundary, cities before others, then slug."""
    pairs = points_in_polygons(points, jurisdictions, JURISDICTION_KEEP)
    rank = F.struct((F.col("jurisdiction_type") != "city").alias("r"), F.col("slug").alias("s"))
    return pairs.groupBy("lon", "lat").agg(F.min_by("jurisdiction_id", rank).alias("jurisdiction_id"))


def parcel_shapes(parcels: DataFrame) -> DataFrame:
    """One row for each distinct shape of a jurisdiction, with its lowest APN in ``first``.

    Parcels of identical shape (condominiums) are told apart by a digest of the geometry, so only digests are shuffled
    for shapes that occur once in a task.
    """
    digest = F.sha2(F.to_json("geom"), 256)
    named = parcels.where(F.size("geom") > 0).select("jurisdiction_id", digest.alias("_d"), F.struct("apn", "parcel_id").alias("first"), "geom")
    return named.groupBy("jurisdiction_id", "_d").agg(F.min("first").alias("first"), F.any_value("geom").alias("geom")).drop("_d")


def parcel_layer(parcels: DataFrame, tolerance_m: float = TOLERANCE_M) -> Layer:
    return Layer.of(parcel_shapes(parcels), PARCEL_KEEP, tolerance_m=tolerance_m)


def match_parcel(points: DataFrame, parcels: DataFrame | Layer, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """``jurisdiction_id, lon, lat, parcel_id, match_method, match_tolerance_m, distance_m``.

    The containing parcel of the same jurisdiction, else the nearest one within the tolerance;
    ties go to the lowest APN, also among parcels of one shape. A layer must have been filed
    with this tolerance at least.
    """
    layer = parcels if isinstance(parcels, Layer) else parcel_layer(parcels, tolerance_m)
    if layer.tolerance_m < tolerance_m:
        raise ValueError(f"the layer is filed for {layer.tolerance_m} m")
    pairs = layer.points(points.select("jurisdiction_id", "lon", "lat"), ["jurisdiction_id"])
    gap = f"CASE WHEN {Q.contains_point()} THEN -1D ELSE {G.boundary_distance_m('edges', 'lon', 'lat')} END"
    measured = pairs.withColumn("_d", F.expr(gap))
    # the tolerance is applied inside the aggregate: as a filter it would be pushed below the
    # measurement and evaluate it twice
    row = F.struct((F.col("_d") >= 0).alias("out"), F.greatest("_d", F.lit(0.0)).alias("d"), F.col("first").alias("p"))
    best = (
        measured.groupBy("jurisdiction_id", "lon", "lat").agg(F.min(F.when(F.col("_d") <= tolerance_m, row)).alias("m")).where("m IS NOT NULL")
    )
    out = F.col("m.out")
    return best.select(
        "jurisdiction_id", "lon", "lat", F.col("m.p.parcel_id").alias("parcel_id"),
        F.when(out, "st_intersects").otherwise("st_contains").alias("match_method"),
        F.when(out, F.lit(float(tolerance_m))).otherwise(0.0).alias("match_tolerance_m"),
        F.col("m.d").alias("distance_m"),
    )


def polygon_pairs(probes: DataFrame, layer: Layer, on: list[str], probe_key: str, keep: list[str], area: bool) -> DataFrame:
    """Intersecting (probe, feature) pairs, one row each, with ``overlap_area`` when asked.

    ``keep`` must identify a feature. Areas of the probe's parts in each piece's cell add up.
    """
    p = with_edges(spread(probes.select(probe_key, "geom", *on)))
    if area:
        p = p.withColumns({"parts": F.expr(G.convex_parts("geom")), "area": F.expr(G.planar_area("geom"))})
    p, f = layer.polygons(p.drop("geom"))
    cond = " AND ".join(["p.cell = f.cell", "p.tile = f.tile", *[f"p.{c} = f.{c}" for c in on], Q.near_piece()])
    # most pairs need no cutting: probes that no boundary comes near are in or out as a whole (null: cut them)
    met = p.join(f, F.expr(cond)).selectExpr("p.*", *[f"f.{k} AS f_{k}" for k in keep], "struct(f.*) AS f", f"IF({Q.undivided()}, {Q.holds_start()}, NULL) AS _in").alias("p")
    shared = f"CASE WHEN _in THEN p.area WHEN _in IS NULL THEN {G.overlap_area('p.parts', 'f.rings')} ELSE 0D END" if area else "0D"
    seen = met.selectExpr(probe_key, *[f"f_{k} AS {k}" for k in keep], f"{shared} AS _a", f"coalesce(_in, {Q.meets_piece()}) AS _hit")
    return seen.groupBy(probe_key, *keep).agg(F.sum("_a").alias("overlap_area"), F.max("_hit").alias("_h")).where("_h").drop("_h")


def zone_layer(zones: DataFrame) -> Layer:
    return Layer.of(zones, ZONE_KEEP, areas=True)


def match_zones(parcels: DataFrame, zones: DataFrame | Layer) -> DataFrame:
    """``parcel_id, zone_id, zone_code, overlap_area``: districts of the parcel's jurisdiction
    that share a point with it. ``parcels`` needs jurisdiction_id, parcel_id, geom."""
    layer = zones if isinstance(zones, Layer) else zone_layer(zones)
    return polygon_pairs(parcels, layer, ["jurisdiction_id"], "parcel_id", ["zone_id", "zone_code"], area=True)


def zone_choice(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Primary zone (largest overlap, then code, then id) and whether codes disagree."""
    order = F.struct((-F.col("overlap_area")).alias("a"), F.col("zone_code").alias("c"), F.col("zone_id").alias("i"))
    return pairs.groupBy(*key).agg(
        F.min(order).alias("_z"), F.sort_array(F.collect_set("zone_code")).alias("zone_codes")
    ).select(
        *key, F.col("_z.i").alias("zone_id"), F.col("_z.c").alias("zone_code"), "zone_codes",
        (F.size("zone_codes") > 1).alias("cross_zone_ambiguity"),
    )


def zones_at_points(points: DataFrame, zones: DataFrame | Layer) -> DataFrame:
    """Zones strictly containing a point of the same jurisdiction, where no parcel matched."""
    layer = zones if isinstance(zones, Layer) else Layer.of(zones, ZONE_KEEP)
    pairs = layer.points(points, ["jurisdiction_id"]).where(Q.contains_point())
    return pairs.select(*points.columns, "zone_id", "zone_code", F.lit(0.0).alias("overlap_area"))


def match_overlays(parcels: DataFrame, overlays: DataFrame | Layer) -> DataFrame:
    """``parcel_id, overlay_id, overlay_type``: features of any jurisdiction touching a parcel."""
    layer = overlays if isinstance(overlays, Layer) else Layer.of(overlays, OVERLAY_KEEP)
    return polygon_pairs(parcels, layer, [], "parcel_id", OVERLAY_KEEP, area=False).drop("overlap_area")


def overlays_at_points(points: DataFrame, overlays: DataFrame | Layer) -> DataFrame:
    """Features covering a point, boundary included."""
    layer = overlays if isinstance(overlays, Layer) else Layer.of(overlays, OVERLAY_KEEP)
    return layer.points(points).where(Q.covers_point()).select(*points.columns, *OVERLAY_KEEP)


def complete_overlays(keys: DataFrame, hits: DataFrame, overlays: DataFrame, key: list[str], expected: list[str] = C.EXPECTED_OVERLAYS) -> DataFrame:
    """Add the expected types without a hit: ``no_hit`` where the layer holds any feature at
    all, ``source_unavailable`` where it was never loaded."""
    loaded = overlays.select("overlay_type").distinct().withColumn("loaded", F.lit(True))
    wanted = keys.select(*key).withColumn("overlay_type", F.explode(F.array(*[F.lit(t) for t in expected])))
    missing = wanted.join(dealt(hits.select(*key, "overlay_type")), [*key, "overlay_type"], "left_anti")
    status = F.when(F.col("loaded"), "no_hit").otherwise("source_unavailable")
    absent = missing.join(loaded, "overlay_type", "left").withColumn("status", status).drop("loaded")
    return hits.withColumn("status", F.lit("hit")).unionByName(absent, allowMissingColumns=True)
