"""Validity of polygons: edges that meet where they should not, and rings that lie where they should not.

Edges that meet share a cell, so only pairs inside one quadtree piece are tested, never all edges of a feature against each
other. That rings lie inside one another without touching is a point lookup: one corner of each ring among the pieces of
the other rings of its feature. Features are told apart by a digest of their geometry, so repeated ones are tested once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.operators import quadtree as Q
from parcelspark.operators.layers import with_edges
from parcelspark.session import cut

TILE_LEVEL = 2


def digest(geom: str) -> Column:
    return F.sha2(F.to_json(geom), 256)


def contacts(edges: str) -> str:
    """Two edges of a list meet other than as neighbours of a ring do: in the end of the one and the start of the other."""
    on = lambda s, x, y: G.on_boundary(f"array({s})", x, y)
    follows = lambda s, t: f"({s}.x2 = {t}.x1 AND {s}.y2 = {t}.y1 AND NOT {on(s, f'{t}.x2', f'{t}.y2')} AND NOT {on(t, f'{s}.x1', f'{s}.y1')})"
    bad = lambda s, t: f"{G.edges_touch(f'array({s})', f'array({t})')} AND NOT {follows(s, t)} AND NOT {follows(t, s)}"
    later = lambda s, i: f"exists(slice({edges}, {i} + 2, size({edges})), {G.fn(lambda t: bad(s, t))})"
    return f"exists(transform({edges}, {G.fn(later)}), {G.fn(lambda v: v)})"


def invalid(geometries: DataFrame) -> DataFrame:
    """``digest, crossing, nested`` of the geometries (``digest``, ``geom``) that are not valid.

    ``crossing``: edges cross, overlap or touch. ``nested``: a part's ring lies in another part, or a hole not in exactly one
    ring. Geometries that are malformed (open, short or empty rings, bad coordinates) are both false here: ``geometry.is_valid``
    tells.
    """
    shapes = cut(geometries.where(F.size("geom") > 0).groupBy("digest").agg(F.any_value("geom").alias("geom")))
    whole = Q.pieces(with_edges(shapes).select("digest", "edges", "bbox"), tile_level=TILE_LEVEL)
    crossing = whole.where(contacts("edges")).select("digest").distinct().withColumn("crossing", F.lit(True))
    several = shapes.where(f"size({G.rings('geom')}) > 1").selectExpr("digest", f"posexplode({G.rings('geom')}) AS (ring, r)")
    rings = cut(several.selectExpr("digest", "ring", "r.sign AS sign", "array(array(r.pts)) AS geom", "r.pts[0].x AS lon", "r.pts[0].y AS lat").where("size(geom[0][0]) > 3"))
    parts = Q.pieces(with_edges(rings.select("digest", "ring", "geom")), tile_level=TILE_LEVEL).withColumnRenamed("ring", "_around")
    corners = Q.point_cells(rings.select("digest", "ring", "sign", "lon", "lat"), Q.EVERY_LEVEL, TILE_LEVEL)
    held = corners.join(parts, ["digest", "tile", "cell"]).where(f"ring <> _around AND {Q.contains_point()}").groupBy("digest", "ring").agg(F.count("*").alias("n"))
    wrong = rings.select("digest", "ring", "sign").join(held, ["digest", "ring"], "left").where("coalesce(n, 0) <> IF(sign = 1, 0, 1)")
    nested = wrong.select("digest").distinct().withColumn("nested", F.lit(True))
    both = crossing.join(nested, "digest", "full_outer")
    return both.select("digest", F.coalesce("crossing", F.lit(False)).alias("crossing"), F.coalesce("nested", F.lit(False)).alias("nested"))


def review(rows: DataFrame, status: str = "data_status") -> DataFrame:
    """Loaded rows with ``status`` ``needs_review`` where ``geom`` is missing, malformed or not valid; others keep theirs."""
    known = rows.withColumn("_digest", digest("geom"))
    bad = invalid(known.select(F.col("_digest").alias("digest"), "geom")).select(F.col("digest").alias("_digest"), F.lit(True).alias("_bad"))
    own = F.col(status) if status in rows.columns else F.lit("current")
    flag = F.coalesce(F.col("_bad"), F.lit(False)) | ~F.expr(G.is_valid("geom"))
    return known.join(bad, "_digest", "left").withColumn(status, F.when(flag, "needs_review").otherwise(own)).drop("_digest", "_bad")
