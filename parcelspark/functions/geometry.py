"""Planar and geodetic expressions over polygons, all evaluated inside the JVM.

Every function takes and returns Spark SQL text (column names or larger expressions), to be used
through ``F.expr`` or ``selectExpr``: one text reaches the JVM in one call, where the same tree
built from ``Column`` objects takes thousands.

A geometry is ``array<array<array<struct<x,y>>>>``: polygons, rings (the first is the outer
one), closed point lists in degrees. Tests work on its *edges*, a flat
``array<struct<x1,y1,x2,y2>>``, because crossing parity and distances need no ring structure.
"""

from __future__ import annotations

import inspect
import itertools
import math
from collections.abc import Callable

Sql = str

RING_T = "array<struct<x:double,y:double>>"
GEOM_T = f"array<array<{RING_T}>>"
EDGES_T = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
NO_POINTS = f"CAST(array() AS {RING_T})"

# GRS80 ellipsoid and the California Albers projection (EPSG:3310).
_A = 6378137.0
_E2 = 0.00669438002290
_E = math.sqrt(_E2)
_RAD = math.pi / 180.0
_LAT1, _LAT2, _LAT0, _LON0 = 34.0, 40.5, 0.0, -120.0
# Fixed value: WGS84 first eccentricity squared, for metres around a point.
_WGS_E2 = 0.00669437999014

_names = itertools.count()


def num(v: float) -> Sql:
    """Double literal."""
    return f"{v!r}D"


def fn(body: Callable[..., Sql]) -> Sql:
    """SQL lambda of a Python function over variable names; names are never reused."""
    args = [f"v{next(_names)}" for _ in inspect.signature(body).parameters]
    head = args[0] if len(args) == 1 else "(" + ", ".join(args) + ")"
    return f"{head} -> {body(*args)}"


def let(expr: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``body(expr)`` with the expression evaluated once, however often the body reads it."""
    return f"get(transform(array({expr}), {fn(body)}), 0)"


def struct(**fields: Sql) -> Sql:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def point(x: Sql, y: Sql) -> Sql:
    return struct(x=f"CAST({x} AS double)", y=f"CAST({y} AS double)")


def polygon(*pts: Sql) -> Sql:
    """One outer ring from points (the caller repeats the first one)."""
    return f"CAST(array(array(array({', '.join(pts)}))) AS {GEOM_T})"


def box(x1: Sql, y1: Sql, x2: Sql, y2: Sql) -> Sql:
    """Rectangle as a geometry."""
    return polygon(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))


# --- GeoJSON -----------------------------------------------------------------------------
def _clean_ring(ring: Sql) -> Sql:
    """Points of a coordinate list, without repeats, closed."""
    pts = f"filter(transform({ring}, {fn(lambda p: point(f'get({p}, 0)', f'get({p}, 1)'))}), {fn(lambda p: f'{p}.x IS NOT NULL AND {p}.y IS NOT NULL')})"
    no_repeat = lambda v: f"filter({v}, {fn(lambda p, i: f'{i} = 0 OR NOT ({p} <=> get({v}, {i} - 1))')})"
    close = lambda k: f"CASE WHEN size({k}) > 0 AND NOT (get({k}, 0) <=> get({k}, size({k}) - 1)) THEN concat({k}, slice({k}, 1, 1)) ELSE {k} END"
    return let(let(pts, no_repeat), close)


def from_geojson(json: Sql) -> Sql:
    """Polygon or MultiPolygon text as a geometry; null for anything else."""
    coords = f"get_json_object({json}, '$.coordinates')"
    one = f"array(from_json({coords}, 'array<array<array<double>>>'))"
    many = f"from_json({coords}, 'array<array<array<array<double>>>>')"
    polys = f"CASE get_json_object({json}, '$.type') WHEN 'Polygon' THEN {one} WHEN 'MultiPolygon' THEN {many} END"
    return f"CAST(transform({polys}, {fn(lambda g: f'transform({g}, {fn(_clean_ring)})')}) AS {GEOM_T})"


def to_geojson(geom: Sql) -> Sql:
    """MultiPolygon text."""
    ring = lambda r: f"transform({r}, {fn(lambda p: f'array({p}.x, {p}.y)')})"
    coords = f"transform({geom}, {fn(lambda g: f'transform({g}, {fn(ring)})')})"
    return f"to_json(named_struct('type', 'MultiPolygon', 'coordinates', {coords}))"


def rings(geom: Sql) -> Sql:
    """Flat ``array<struct<sign,pts>>``; holes carry sign -1."""
    one = lambda r, i: struct(sign=f"IF({i} = 0, 1, -1)", pts=r)
    return f"flatten(transform({geom}, {fn(lambda g: f'transform({g}, {fn(one)})')}))"


def is_valid(geom: Sql) -> Sql:
    """Every ring closed, with at least four finite points and some area. Self-intersection is
    not examined."""
    off = lambda p: f"isnan({p}.x) OR isnan({p}.y) OR abs({p}.x) > 180 OR abs({p}.y) > 90"
    bad = lambda r: (
        f"size({r}.pts) < 4 OR NOT (get({r}.pts, 0) <=> get({r}.pts, size({r}.pts) - 1)) "
        f"OR exists({r}.pts, {fn(off)}) OR {ring_area(f'{r}.pts')} = 0"
    )
    return f"coalesce(size({geom}) > 0 AND NOT exists({rings(geom)}, {fn(bad)}), false)"


# --- edges, boxes, rings -----------------------------------------------------------------
def _ring_edges(r: Sql) -> Sql:
    edge = lambda p, q: struct(x1=f"{p}.x", y1=f"{p}.y", x2=f"{q}.x", y2=f"{q}.y")
    n = f"greatest(size({r}) - 1, 0)"
    return f"zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), {fn(edge)})"


def ring_edges(ring: Sql) -> Sql:
    return let(ring, _ring_edges)


def edges(geom: Sql) -> Sql:
    """All boundary edges of a geometry."""
    return f"CAST(flatten(flatten(transform({geom}, {fn(lambda g: f'transform({g}, {fn(_ring_edges)})')}))) AS {EDGES_T})"


def bbox(e: Sql) -> Sql:
    """Bounding box of an edge list."""
    end = lambda f, k: f"{f}(transform({e}, {fn(lambda s: f'{s}.{k}')}))"
    return struct(xmin=end("array_min", "x1"), ymin=end("array_min", "y1"), xmax=end("array_max", "x1"), ymax=end("array_max", "y1"))


def bbox_overlaps(a: Sql, b: Sql) -> Sql:
    return f"({a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax)"


def bbox_envelope(lon: Sql, lat: Sql, radius_m: Sql) -> Sql:
    """Degrees box of about ``radius_m`` around a point."""
    dlat = f"({radius_m} / 111320D)"
    dlon = f"({radius_m} / (greatest(0.01D, abs(cos(radians({lat})))) * 111320D))"
    return struct(xmin=f"{lon} - {dlon}", ymin=f"{lat} - {dlat}", xmax=f"{lon} + {dlon}", ymax=f"{lat} + {dlat}")


def _sum(arr: Sql, term: Callable[[Sql], Sql]) -> Sql:
    return f"aggregate({arr}, 0D, {fn(lambda acc, e: f'{acc} + {term(e)}')})"


def ring_area(ring: Sql) -> Sql:
    """Signed planar area of a closed ring, counter-clockwise positive."""

    def area(r: Sql) -> Sql:
        o = f"get({r}, 0)"
        cross = lambda e: f"(({e}.x1 - {o}.x) * ({e}.y2 - {o}.y) - ({e}.x2 - {o}.x) * ({e}.y1 - {o}.y))"
        return f"({_sum(_ring_edges(r), cross)} / 2D)"

    return let(ring, area)


def planar_area(geom: Sql) -> Sql:
    """Area in square units of the coordinates; holes subtract."""
    return _sum(rings(geom), lambda r: f"(abs({ring_area(f'{r}.pts')}) * {r}.sign)")


def centroid(geom: Sql) -> Sql:
    """Area-weighted centroid."""
    o = f"get(get(get({geom}, 0), 0), 0)"
    zero = struct(a="0D", x="0D", y="0D")

    def moments(r: Sql) -> Sql:
        def add(acc: Sql, e: Sql) -> Sql:
            x1, y1, x2, y2 = f"({e}.x1 - {o}.x)", f"({e}.y1 - {o}.y)", f"({e}.x2 - {o}.x)", f"({e}.y2 - {o}.y)"
            c = f"({x1} * {y2} - {x2} * {y1})"
            return struct(a=f"{acc}.a + {c}", x=f"{acc}.x + ({x1} + {x2}) * {c}", y=f"{acc}.y + ({y1} + {y2}) * {c}")

        return struct(sign=f"{r}.sign", m=f"aggregate({_ring_edges(f'{r}.pts')}, {zero}, {fn(add)})")

    def total(acc: Sql, r: Sql) -> Sql:
        # orient every ring by its role, whatever its direction
        s = f"(IF({r}.m.a < 0, -1D, 1D) * {r}.sign)"
        return struct(**{k: f"{acc}.{k} + {r}.m.{k} * {s}" for k in "axy"})

    def place(t: Sql) -> Sql:
        return point(*[f"{o}.{k} + {t}.{k} / nullif({t}.a * 3D, 0D)" for k in "xy"])

    return let(f"aggregate(transform({rings(geom)}, {fn(moments)}), {zero}, {fn(total)})", place)


# --- points ------------------------------------------------------------------------------
def _side(e: Sql, x: Sql, y: Sql) -> Sql:
    """Positive left of the edge, zero on its line."""
    return f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({x} - {e}.x1) * ({e}.y2 - {e}.y1))"


def on_boundary(e: Sql, x: Sql, y: Sql) -> Sql:
    hit = lambda s: (
        f"{_side(s, x, y)} = 0 AND {x} BETWEEN least({s}.x1, {s}.x2) AND greatest({s}.x1, {s}.x2) "
        f"AND {y} BETWEEN least({s}.y1, {s}.y2) AND greatest({s}.y1, {s}.y2)"
    )
    return f"exists({e}, {fn(hit)})"


def ray_parity(e: Sql, x: Sql, y: Sql) -> Sql:
    """True where a ray towards +x crosses an odd number of edges. Division-free, so exact on
    dyadic coordinates."""
    crosses = lambda s: f"((({s}.y1 > {y}) != ({s}.y2 > {y})) AND (({_side(s, x, y)} > 0) = ({s}.y2 > {s}.y1)))"
    return f"aggregate({e}, false, {fn(lambda acc, s: f'{acc} != {crosses(s)}')})"


def contains(e: Sql, x: Sql, y: Sql) -> Sql:
    """Point strictly inside; the boundary does not count."""
    return f"({ray_parity(e, x, y)} AND NOT {on_boundary(e, x, y)})"


def covers(e: Sql, x: Sql, y: Sql) -> Sql:
    """Point inside or on the boundary."""
    return f"({on_boundary(e, x, y)} OR {ray_parity(e, x, y)})"


def metres_per_degree(lat: Sql) -> Sql:
    """``struct<kx,ky>``: ground length of one degree of longitude and latitude (WGS84)."""
    w = f"(1D - sin({lat} * {num(_RAD)}) * sin({lat} * {num(_RAD)}) * {num(_WGS_E2)})"
    return struct(
        kx=f"cos({lat} * {num(_RAD)}) * {num(_A * _RAD)} / sqrt({w})", ky=f"{num(_A * (1 - _WGS_E2) * _RAD)} / ({w} * sqrt({w}))"
    )


def boundary_distance_m(e: Sql, x: Sql, y: Sql) -> Sql:
    """Metres from a point to the nearest edge, in the local tangent scale at the point."""

    def gap2(s: Sql) -> Sql:
        t = f"coalesce(-({s}.ax * {s}.dx + {s}.ay * {s}.dy) / nullif({s}.dx * {s}.dx + {s}.dy * {s}.dy, 0D), 0D)"
        sq = lambda v: f"({v}) * ({v})"
        foot = lambda t: f"{sq(f'{s}.ax + {t} * {s}.dx')} + {sq(f'{s}.ay + {t} * {s}.dy')}"
        return let(f"least(1D, greatest(0D, {t}))", foot)

    def nearest(k: Sql) -> Sql:
        local = lambda s: struct(
            ax=f"({s}.x1 - {x}) * {k}.kx", ay=f"({s}.y1 - {y}) * {k}.ky", dx=f"({s}.x2 - {s}.x1) * {k}.kx", dy=f"({s}.y2 - {s}.y1) * {k}.ky"
        )
        return f"sqrt(array_min(transform(transform({e}, {fn(local)}), {fn(gap2)})))"

    return let(metres_per_degree(y), nearest)


def distance_m(e: Sql, x: Sql, y: Sql) -> Sql:
    """Metres from a point to a polygon, zero inside."""
    return f"CASE WHEN {covers(e, x, y)} THEN 0D ELSE {boundary_distance_m(e, x, y)} END"


# --- polygon pairs -----------------------------------------------------------------------
def _segments_touch(a: Sql, b: Sql) -> Sql:
    near = " AND ".join(
        f"greatest({p}.{k}1, {p}.{k}2) >= least({q}.{k}1, {q}.{k}2)" for k in "xy" for p, q in ((a, b), (b, a))
    )
    straddles = lambda s, t: f"signum({_side(s, f'{t}.x1', f'{t}.y1')}) * signum({_side(s, f'{t}.x2', f'{t}.y2')}) <= 0"
    return f"({near} AND {straddles(a, b)} AND {straddles(b, a)})"


def edges_touch(a: Sql, b: Sql) -> Sql:
    """Any edge of one list meets any edge of the other, end points and overlaps included."""
    return f"exists({a}, {fn(lambda s: f'exists({b}, {fn(lambda t: _segments_touch(s, t))})')})"


def intersects(a: Sql, b: Sql) -> Sql:
    """Two polygons share a point; touching counts. Both edge lists must be complete."""
    inside = lambda p, q: f"exists({p}, {fn(lambda s: covers(q, f'{s}.x1', f'{s}.y1'))})"
    return f"({edges_touch(a, b)} OR {inside(a, b)} OR {inside(b, a)})"


def _cut(ring: Sql, signed: Callable[[Sql], Sql]) -> Sql:
    """Part of a closed ring where ``signed`` is not negative. Pieces may stay joined along the
    cutting line, which adds no area."""

    def step(p: Sql, q: Sql) -> Sql:
        keep = f"IF({p}.d >= 0, array({point(f'{p}.x', f'{p}.y')}), {NO_POINTS})"
        cross = lambda t: f"array({point(f'{p}.x + ({q}.x - {p}.x) * {t}', f'{p}.y + ({q}.y - {p}.y) * {t}')})"
        return f"concat({keep}, IF({p}.d * {q}.d < 0, {let(f'{p}.d / ({p}.d - {q}.d)', cross)}, {NO_POINTS}))"

    def walk(tagged: Sql) -> Sql:
        n = f"greatest(size({tagged}) - 1, 0)"
        out = f"flatten(zip_with(slice({tagged}, 1, {n}), slice({tagged}, 2, {n}), {fn(step)}))"
        return let(out, lambda o: f"concat({o}, slice({o}, 1, 1))")

    tag = fn(lambda p: struct(x=f"{p}.x", y=f"{p}.y", d=signed(p)))
    return f"CAST({let(f'transform({ring}, {tag})', walk)} AS {RING_T})"


def clip_to_box(ring: Sql, x1: Sql, y1: Sql, x2: Sql, y2: Sql) -> Sql:
    """Ring cut to a rectangle."""
    for signed in (lambda p: f"{p}.x - {x1}", lambda p: f"{x2} - {p}.x", lambda p: f"{p}.y - {y1}", lambda p: f"{y2} - {p}.y"):
        ring = _cut(ring, signed)
    return ring


def clip_to_convex(ring: Sql, window: Sql) -> Sql:
    """Ring cut to a convex, counter-clockwise window given by its edges."""
    step = lambda acc, e: _cut(acc, lambda p: _side(e, f"{p}.x", f"{p}.y"))
    return f"aggregate({window}, CAST({ring} AS {RING_T}), {fn(step)})"


def is_convex(ring: Sql) -> Sql:
    """Closed ring that never turns both ways."""

    def one_way(e: Sql) -> Sql:
        turn = lambda a, b: f"signum(({a}.x2 - {a}.x1) * ({b}.y2 - {b}.y1) - ({a}.y2 - {a}.y1) * ({b}.x2 - {b}.x1))"
        turns = f"zip_with({e}, concat(slice({e}, 2, greatest(size({e}) - 1, 0)), slice({e}, 1, 1)), {fn(turn)})"
        both = lambda t: f"NOT (exists({t}, {fn(lambda v: f'{v} > 0')}) AND exists({t}, {fn(lambda v: f'{v} < 0')}))"
        return f"size({e}) >= 3 AND {let(turns, both)}"

    real = f"filter({ring_edges(ring)}, {fn(lambda e: f'{e}.x1 != {e}.x2 OR {e}.y1 != {e}.y2')})"
    return let(real, one_way)


def is_convex_polygon(geom: Sql) -> Sql:
    """One polygon, no holes, convex."""
    return f"(size({geom}) = 1 AND size(get({geom}, 0)) = 1 AND {is_convex(f'get(get({geom}, 0), 0)')})"


def _ccw(ring: Sql) -> Sql:
    return let(ring, lambda r: f"IF({ring_area(r)} < 0, reverse({r}), {r})")


def convex_parts(geom: Sql) -> Sql:
    """Signed convex pieces ``array<struct<sign,window>>`` whose signed sum is the geometry.

    A convex polygon is its own piece. Otherwise each ring is a fan of triangles around its
    first point, counted by orientation, so dents and holes cancel.
    """

    def fan(r: Sql) -> Sql:
        def signed(tri: Sql) -> Sql:
            return struct(
                sign=f"{r}.sign * CAST(signum({ring_area(tri)}) AS int)", window=f"CAST({ring_edges(_ccw(tri))} AS {EDGES_T})"
            )

        def triangles(pts: Sql) -> Sql:
            n = f"greatest(size({pts}) - 2, 0)"
            tri = lambda p, q: let(f"array(get({pts}, 0), {p}, {q}, get({pts}, 0))", signed)
            all_ = f"zip_with(slice({pts}, 2, {n}), slice({pts}, 3, {n}), {fn(tri)})"
            return f"filter({all_}, {fn(lambda t: f'{t}.sign != 0')})"

        return let(_ccw(f"{r}.pts"), triangles)

    whole = lambda r: struct(sign=f"{r}.sign", window=f"CAST({ring_edges(_ccw(f'{r}.pts'))} AS {EDGES_T})")
    return (
        f"CASE WHEN {is_convex_polygon(geom)} THEN transform({rings(geom)}, {fn(whole)}) "
        f"ELSE flatten(transform({rings(geom)}, {fn(fan)})) END"
    )


def overlap_area(parts: Sql, signed_rings: Sql) -> Sql:
    """Planar area shared by convex parts and signed rings; exact for any simple polygons."""
    shared = lambda r, p: f"coalesce(abs({ring_area(clip_to_convex(f'{r}.pts', f'{p}.window'))}) * {r}.sign * {p}.sign, 0D)"
    return _sum(parts, lambda p: _sum(signed_rings, lambda r: shared(r, p)))


def intersection_area(a: Sql, b: Sql) -> Sql:
    """Planar area of the intersection of two geometries."""
    return overlap_area(convex_parts(a), rings(b))


# --- metric area -------------------------------------------------------------------------
def _q_const(lat: float) -> float:
    s = math.sin(lat * _RAD)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m_const(lat: float) -> float:
    s = math.sin(lat * _RAD)
    return math.cos(lat * _RAD) / math.sqrt(1 - _E2 * s * s)


ALBERS_N = (_m_const(_LAT1) ** 2 - _m_const(_LAT2) ** 2) / (_q_const(_LAT2) - _q_const(_LAT1))
ALBERS_C = _m_const(_LAT1) ** 2 + ALBERS_N * _q_const(_LAT1)
ALBERS_RHO0 = _A * math.sqrt(ALBERS_C - ALBERS_N * _q_const(_LAT0)) / ALBERS_N


def albers(p: Sql) -> Sql:
    """Point in degrees to equal-area metres (EPSG:3310 without the false northing)."""

    def forward(s: Sql) -> Sql:
        log_part = f"ln((1D - {s} * {num(_E)}) / (1D + {s} * {num(_E)})) / {num(2 * _E)}"
        q = f"({s} / (1D - {s} * {s} * {num(_E2)}) - {log_part}) * {num(1 - _E2)}"
        polar = struct(
            rho=f"sqrt({num(ALBERS_C)} - {q} * {num(ALBERS_N)}) * {num(_A / ALBERS_N)}", theta=f"({p}.x - {num(_LON0)}) * {num(ALBERS_N * _RAD)}"
        )
        return let(polar, lambda t: point(f"{t}.rho * sin({t}.theta)", f"{num(ALBERS_RHO0)} - {t}.rho * cos({t}.theta)"))

    return let(f"sin({p}.y * {num(_RAD)})", forward)


def project(geom: Sql) -> Sql:
    ring = lambda r: f"transform({r}, {fn(albers)})"
    return f"CAST(transform({geom}, {fn(lambda g: f'transform({g}, {fn(ring)})')}) AS {GEOM_T})"


def area_m2(geom: Sql) -> Sql:
    """Square metres in the equal-area projection."""
    return planar_area(project(geom))


def convex_inset_area(ring: Sql, d: Sql) -> Sql:
    """Area left of a convex ring after moving every edge inwards by ``d``; exact, since an
    inward buffer of a convex polygon has no arcs."""
    measured = lambda e: struct(
        x1=f"{e}.x1", y1=f"{e}.y1", x2=f"{e}.x2", y2=f"{e}.y2",
        len=f"sqrt(({e}.x2 - {e}.x1) * ({e}.x2 - {e}.x1) + ({e}.y2 - {e}.y1) * ({e}.y2 - {e}.y1))",
    )

    def shrink(ccw: Sql) -> Sql:
        window = f"filter(transform({_ring_edges(ccw)}, {fn(measured)}), {fn(lambda e: f'{e}.len > 0')})"
        step = lambda acc, e: _cut(acc, lambda p: f"{_side(e, f'{p}.x', f'{p}.y')} - {d} * {e}.len")
        left = f"aggregate({window}, CAST({ccw} AS {RING_T}), {fn(step)})"
        return f"coalesce(abs({ring_area(left)}), 0D)"

    return let(_ccw(ring), shrink)
