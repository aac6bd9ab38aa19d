"""Geometry functions and spatial joins over parcels, districts and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.operators import envelope, layers, quadtree, spatial, validity
from parcelspark.operators.skew import dealt
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query

# Albers forward in SQL, constants written out from the projection's parameters.
_Q = f"({1 - G._E2!r} * (s / (1 - {G._E2!r} * s * s) - ln((1 - {G._E!r} * s) / (1 + {G._E!r} * s)) / {2 * G._E!r}))"
_ALBERS = f"""SELECT *, {G._A / G.ALBERS_N!r} * sqrt({G.ALBERS_C!r} - {G.ALBERS_N!r} * {_Q}) AS rho, (x + 120) * {G.ALBERS_N * G._RAD!r} AS th
  FROM (SELECT *, sin(y * {G._RAD!r}) AS s FROM vx)"""
_VX = """SELECT parcel_id, i, gx0, ux / 1024e0 - 124e0 AS x, uy / 1024e0 + 32.5e0 AS y FROM (SELECT parcel_id, gx AS gx0, unnest([1, 2, 3, 4]) AS i,
  unnest([gx, gx + 0.875, gx + wt, gx]) AS ux, unnest([gy, gy, gy + 0.875, gy + 0.875]) AS uy FROM pc)"""
_XY = f"SELECT parcel_id, i, rho * sin(th) AS px, {G.ALBERS_RHO0!r} - rho * cos(th) AS py FROM alb"
_EXTRA = {"vx": _VX, "alb": _ALBERS, "xy": _XY}


@query("g01_geojson_roundtrip", with_tables("""SELECT parcel_id, 1 AS polygons, 5 AS points, true AS valid,
  gx / 1024e0 - 124e0 AS xmin, gy / 1024e0 + 32.5e0 AS ymin FROM pc"""))
def geojson_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    # an unclosed ring with a repeated point is repaired on the way in
    p = D.parcels(spark, sf)
    open_ring = "transform(geom, p -> transform(p, r -> concat(slice(r, 1, 1), slice(r, 1, 4))))"
    g = p.selectExpr("parcel_id", f"{G.to_geojson(open_ring)} AS j").selectExpr("parcel_id", f"{G.from_geojson('j')} AS g")
    return g.selectExpr(
        "parcel_id", "size(g) AS polygons", "size(g[0][0]) AS points", f"{G.is_valid('g')} AS valid", f"{G.bbox(G.edges('g'))} AS b"
    ).selectExpr("parcel_id", "polygons", "points", "valid", "b.xmin", "b.ymin")


@query("g02_centroid", with_tables("""SELECT parcel_id, round((gx + CASE WHEN wt = 0.875 THEN 0.4375e0
    ELSE (0.875 * 0.875 + 0.875 * wt + wt * wt) / (3 * (0.875 + wt)) END) / 1024 - 124, 9) AS cx,
  round((gy + CASE WHEN wt = 0.875 THEN 0.4375e0 ELSE 0.875 / 3 * (0.875 + 2 * wt) / (0.875 + wt) END) / 1024 + 32.5, 9) AS cy FROM pc"""))
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return D.parcels(spark, sf).selectExpr("parcel_id", f"{G.centroid('geom')} AS c").selectExpr("parcel_id", "round(c.x, 9) AS cx", "round(c.y, 9) AS cy")


@query("g03_area_equal_area", with_tables("""SELECT a.parcel_id, round(abs(sum((a.px - o.px) * (b.py - o.py) - (b.px - o.px) * (a.py - o.py))) / 2, 2) AS area_m2
  FROM xy a JOIN xy b ON a.parcel_id = b.parcel_id AND b.i = a.i % 4 + 1 JOIN xy o ON o.parcel_id = a.parcel_id AND o.i = 1 GROUP BY 1""", **_EXTRA))
def area_equal_area(spark: SparkSession, sf: str) -> DataFrame:
    return D.parcels(spark, sf).selectExpr("parcel_id", f"round({G.area_m2('geom')}, 2) AS area_m2")


@query("g04_bbox", with_tables("""SELECT zone_id, x1 / 1024 - 124 AS xmin, y1 / 1024 + 32.5 AS ymin, x2 / 1024 - 124 AS xmax, y2 / 1024 + 32.5 AS ymax FROM zn"""))
def bbox(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.with_edges(D.zones(spark, sf)).select("zone_id", "bbox.*")


@query("g05_point_in_polygon", with_tables("""SELECT request_id, parcel_id FROM (
    SELECT request_id, parcel_id, sum(CASE WHEN (e.b > v) <> (e.d > v) AND u < (e.c - e.a) * (v - e.b) / (e.d - e.b) + e.a THEN 1 ELSE 0 END) % 2 = 1 AS odd,
      bool_or((e.c - e.a) * (v - e.b) = (u - e.a) * (e.d - e.b) AND u BETWEEN least(e.a, e.c) AND greatest(e.a, e.c) AND v BETWEEN least(e.b, e.d) AND greatest(e.b, e.d)) AS edge
    FROM pt JOIN pe ON u BETWEEN gx AND gx + 1 AND v BETWEEN gy AND gy + 1 GROUP BY 1, 2) WHERE odd AND NOT edge"""))
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    pts = D.located(spark, sf).select("request_id", "lon", "lat")
    return spatial.points_in_polygons(pts, D.parcels(spark, sf), ["parcel_id"]).select("request_id", "parcel_id")


@query("g06_distance_m", with_tables("SELECT request_id, parcel_id, round(CASE WHEN odd OR d = 0 THEN 0 ELSE d END, 4) AS distance_m FROM gap WHERE odd OR d <= 60"))
def distance_m(spark: SparkSession, sf: str) -> DataFrame:
    pts = spatial.match_jurisdiction(D.located(spark, sf).select("lon", "lat").distinct(), D.jurisdictions(spark, sf))
    req = D.located(spark, sf).join(dealt(pts), ["lon", "lat"])
    filed = layers.Layer.of(D.parcels(spark, sf), ["jurisdiction_id", "parcel_id"], tolerance_m=60.0)
    pairs = filed.points(req, ["jurisdiction_id"])
    d = f"CASE WHEN {quadtree.covers_point()} THEN 0D ELSE {G.boundary_distance_m('edges', 'lon', 'lat')} END"
    # the task's number keeps the condition from being pushed below the measurement, which then was made twice
    measured = pairs.selectExpr("request_id", "parcel_id", f"{d} AS d", "spark_partition_id() AS _task")
    return measured.where("d <= 60 AND _task >= 0").select("request_id", "parcel_id", F.round("d", 4).alias("distance_m"))


@query("g07_polygon_intersects", with_tables("SELECT parcel_id, overlay_id FROM po"))
def polygon_intersects(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.match_overlays(D.parcels(spark, sf), D.overlays(spark, sf)).select("parcel_id", "overlay_id")


@query("g08_intersection_area", with_tables("SELECT parcel_id, zone_id, round(units, 6) AS overlap_units FROM pz"))
def intersection_area(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.match_zones(D.parcels(spark, sf), D.zones(spark, sf))
    return pairs.select("parcel_id", "zone_id", F.round(F.col("overlap_area") * (1024.0 * 1024.0), 6).alias("overlap_units"))


_INSET = """SELECT p.parcel_id, round(greatest(0, area - d * per + d * d * k), 1) AS inset_m2 FROM (
    SELECT parcel_id, abs(sum(cr)) / 2 AS area, sum(len) AS per, sum(1 / tan(ang / 2)) AS k FROM (
      SELECT a.parcel_id, (a.px - o.px) * (b.py - o.py) - (b.px - o.px) * (a.py - o.py) AS cr, sqrt(power(b.px - a.px, 2) + power(b.py - a.py, 2)) AS len,
        acos(((b.px - a.px) * (z.px - a.px) + (b.py - a.py) * (z.py - a.py)) / sqrt(power(b.px - a.px, 2) + power(b.py - a.py, 2)) / sqrt(power(z.px - a.px, 2) + power(z.py - a.py, 2))) AS ang
      FROM xy a JOIN xy b ON a.parcel_id = b.parcel_id AND b.i = a.i % 4 + 1 JOIN xy z ON z.parcel_id = a.parcel_id AND z.i = (a.i + 2) % 4 + 1 JOIN xy o ON o.parcel_id = a.parcel_id AND o.i = 1)
    GROUP BY 1) p JOIN (SELECT parcel_id, 1.2192e0 * (1 + parcel_id % 3) AS d FROM pc) q USING (parcel_id)"""


@query("g09_inward_buffer_area", with_tables(_INSET, **_EXTRA))
def inward_buffer_area(spark: SparkSession, sf: str) -> DataFrame:
    p = D.parcels(spark, sf).select("parcel_id", "geom")
    out = envelope.inset_areas(p, (F.col("parcel_id") % 3 + 1) * 1.2192)
    return out.select("parcel_id", F.round(F.coalesce("inset_area_m2", F.lit(0.0)), 1).alias("inset_m2"))


# boxes by key: as they are, crossed over, with a doubled part, with a part inside, with a hole touching its ring
@query("g01_validity", """SELECT p_partkey AS parcel_id, p_partkey % 5 IN (1, 2, 4) AS crossing, p_partkey % 5 IN (2, 3) AS nested FROM part WHERE p_partkey % 5 <> 0""")
def validity_of_lots(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i, j: D.grid_point(f"p_partkey % 64 + {i / 8}D", f"p_partkey div 64 + {j / 8}D")
    ring = lambda *c: f"array({', '.join(at(*p) for p in (*c, c[0]))})"
    box, small = ring((0, 0), (7, 0), (7, 7), (0, 7)), ring((2, 2), (4, 2), (4, 4), (2, 4))
    shapes = [f"array(array({box}))", f"array(array({ring((0, 0), (7, 7), (7, 0), (0, 7))}))", f"array(array({box}), array({ring((3, 3), (9, 3), (9, 9), (3, 9))}))", f"array(array({box}), array({small}))", f"array(array({box}, {ring((4, 4), (0, 2), (4, 2))}))"]
    geom = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {g}" for k, g in enumerate(shapes)) + " END"
    lots = D.table(spark, sf, "part").selectExpr("p_partkey AS parcel_id", f"CAST({geom} AS {G.GEOM_T}) AS geom").withColumn("digest", validity.digest("geom"))
    return lots.join(validity.invalid(lots.select("digest", "geom")), "digest").select("parcel_id", "crossing", "nested")


@query("g05_points_in_odd_lots", with_tables("""SELECT request_id, parcel_id FROM pt JOIN ob ON u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2 GROUP BY 1, 2
  HAVING bool_or(sign = 1 AND u > x1 AND u < x2 AND v > y1 AND v < y2) AND NOT bool_or(sign = -1)"""))
def points_in_odd_lots(spark: SparkSession, sf: str) -> DataFrame:
    pts = D.located(spark, sf).select("request_id", "lon", "lat")
    return spatial.points_in_polygons(pts, D.odd_lots(spark, sf), ["parcel_id"]).select("request_id", "parcel_id")


@query("g08_overlap_of_odd_lots", with_tables("""SELECT parcel_id, zone_id, round(sum(sign * greatest(0e0, least(ob.x2, zn.x2) - greatest(ob.x1, zn.x1)) * greatest(0e0, least(ob.y2, zn.y2) - greatest(ob.y1, zn.y1))), 6) AS overlap_units
  FROM ob JOIN zn ON ob.jurisdiction_id = zn.jurisdiction_id AND ob.x1 <= zn.x2 AND ob.x2 >= zn.x1 AND ob.y1 <= zn.y2 AND ob.y2 >= zn.y1 GROUP BY 1, 2"""))
def overlap_of_odd_lots(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.match_zones(D.odd_lots(spark, sf).select("jurisdiction_id", "parcel_id", "geom"), D.layer(spark, sf, "zones"))
    return pairs.select("parcel_id", "zone_id", F.round(F.col("overlap_area") * (1024.0 * 1024.0), 6).alias("overlap_units"))


# what is left of an L rounds its reflex corner, what is left around a hole has four round corners
_ODD = """SELECT parcel_id, round(CASE parcel_id % 3
    WHEN 0 THEN power(0.875 * m - 2 * d, 2) - power(0.375 * m, 2) + d * d * (1 - pi() / 4)
    WHEN 1 THEN power(0.875 * m - 2 * d, 2) - power(0.25 * m, 2) - m * d - pi() * d * d
    ELSE (0.25 * m - 2 * d) * (0.875 * m - 2 * d) + (0.375 * m - 2 * d) * (0.875 * m - 2 * d) END, 6) AS inset_m2
  FROM (SELECT p_partkey AS parcel_id, 40e0 + p_size AS m, 0.5e0 + p_partkey % 5 * 0.75e0 AS d FROM part)"""


@query("g09_inset_of_odd_lots", _ODD)
def inset_of_odd_lots(spark: SparkSession, sf: str) -> DataFrame:
    out = envelope.eroded_areas(D.odd_lots(spark, sf), "planar", F.col("parcel_id") % 5 * 0.75 + 0.5)
    return out.select("parcel_id", F.round("eroded", 6).alias("inset_m2"))


@query("g10_cell_join_counts", with_tables("""SELECT zone_id, count(*) AS requests FROM pt JOIN zn ON u > x1 AND u < x2 AND v > y1 AND v < y2 GROUP BY 1"""))
def cell_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    pts = D.located(spark, sf).select("request_id", "lon", "lat")
    return spatial.points_in_polygons(pts, D.layer(spark, sf, "zones"), ["zone_id"]).groupBy("zone_id").agg(F.count("*").alias("requests"))


@query("j01_jurisdiction_of_point", with_tables("SELECT request_id, jurisdiction_id FROM rj"))
def jurisdiction_of_point(spark: SparkSession, sf: str) -> DataFrame:
    req = D.located(spark, sf)
    hit = spatial.match_jurisdiction(spatial.distinct_points(req), D.layer(spark, sf, "jurisdictions"))
    return req.join(dealt(hit), ["lon", "lat"], "left").select("request_id", "jurisdiction_id")


@query("j02_parcel_of_point", with_tables("""SELECT request_id, parcel_id, CASE WHEN inside THEN 'st_contains' WHEN NOT inside THEN 'st_intersects' END AS match_method,
  CASE WHEN inside THEN 0e0 WHEN NOT inside THEN 25e0 END AS match_tolerance_m, round(dist, 4) AS distance_m FROM rj LEFT JOIN pm USING (request_id)"""))
def parcel_of_point(spark: SparkSession, sf: str) -> DataFrame:
    req = D.located(spark, sf)
    pts = spatial.match_jurisdiction(spatial.distinct_points(req), D.layer(spark, sf, "jurisdictions"))
    hit = spatial.match_parcel(pts, D.layer(spark, sf, "parcels"))
    return req.join(dealt(hit), ["lon", "lat"], "left").select("request_id", "parcel_id", "match_method", "match_tolerance_m", F.round("distance_m", 4).alias("distance_m"))


@query("j03_zones_of_parcel", with_tables("""SELECT parcel_id, first(zone_id ORDER BY units DESC, zone_code, zone_id) AS zone_id,
  string_agg(DISTINCT zone_code, ',' ORDER BY zone_code) AS codes, count(DISTINCT zone_code) > 1 AS ambiguous FROM pz GROUP BY 1"""))
def zones_of_parcel(spark: SparkSession, sf: str) -> DataFrame:
    z = spatial.zone_choice(spatial.match_zones(D.parcels(spark, sf), D.layer(spark, sf, "zones")), ["parcel_id"])
    return z.select("parcel_id", "zone_id", F.array_join("zone_codes", ",").alias("codes"), F.col("cross_zone_ambiguity").alias("ambiguous"))


@query("j03_zone_of_point", with_tables("SELECT request_id, zone_id FROM rj JOIN zn ON rj.jurisdiction_id = zn.jurisdiction_id AND u > x1 AND u < x2 AND v > y1 AND v < y2"))
def zone_of_point(spark: SparkSession, sf: str) -> DataFrame:
    req = D.located(spark, sf).select("request_id", "lon", "lat")
    pts = spatial.match_jurisdiction(spatial.distinct_points(req), D.layer(spark, sf, "jurisdictions"))
    z = spatial.zones_at_points(pts, D.layer(spark, sf, "zones"))
    return req.join(dealt(z), ["lon", "lat"]).select("request_id", "zone_id")


@query("j04_overlays_of_parcel", with_tables("SELECT parcel_id, overlay_type, count(*) AS features, min(overlay_id) AS first_id FROM po GROUP BY 1, 2"))
def overlays_of_parcel(spark: SparkSession, sf: str) -> DataFrame:
    o = spatial.match_overlays(D.parcels(spark, sf), D.layer(spark, sf, "overlays"))
    return o.groupBy("parcel_id", "overlay_type").agg(F.count("*").alias("features"), F.min("overlay_id").alias("first_id"))


@query("j04_overlays_of_point", with_tables("SELECT request_id, overlay_id FROM pt JOIN ov ON u >= x1 AND u <= x2 AND v >= y1 AND v <= y2"))
def overlays_of_point(spark: SparkSession, sf: str) -> DataFrame:
    pts = D.located(spark, sf).select("request_id", "lon", "lat")
    return spatial.overlays_at_points(pts, D.layer(spark, sf, "overlays")).select("request_id", "overlay_id")




@query("j05_overlay_tristate", with_tables(
    """SELECT pc.parcel_id, t.overlay_type, CASE WHEN t.overlay_type = 'fire' THEN 'source_unavailable' WHEN h.n > 0 THEN 'hit' ELSE 'no_hit' END AS status, coalesce(h.n, 0) AS features
    FROM pc CROSS JOIN (VALUES ('flood'), ('fire')) t(overlay_type) LEFT JOIN (SELECT parcel_id, overlay_type, count(*) AS n FROM po WHERE overlay_type = 'flood' GROUP BY 1, 2) h
    ON h.parcel_id = pc.parcel_id AND h.overlay_type = t.overlay_type"""))
def overlay_tristate(spark: SparkSession, sf: str) -> DataFrame:
    # the fire layer is left out, as if never loaded
    ov, p = D.overlays(spark, sf).where("overlay_type <> 'fire'"), D.parcels(spark, sf)
    hits = spatial.match_overlays(p, ov)
    full = spatial.complete_overlays(p, hits, ov, ["parcel_id"]).where(F.col("overlay_type").isin("flood", "fire"))
    return full.groupBy("parcel_id", "overlay_type").agg(F.max("status").alias("status"), F.count("overlay_id").alias("features"))
