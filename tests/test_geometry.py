"""Geometry against brute force on random polygons."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.operators import envelope, spatial

RNG = random.Random(7)


def star(cx, cy, r, n):
    """A simple polygon around a point: rising angles, random radii, often not convex."""
    polar = [((i + 0.8 * RNG.random()) * 2 * math.pi / n, r * RNG.uniform(0.3, 1)) for i in range(n)]
    pts = [(cx + d * math.cos(a), cy + d * math.sin(a)) for a, d in polar]
    return [*pts, pts[0]]


def parity(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:]))) / 2


def frame(spark, rings, key="id"):
    rows = [(i, json.dumps({"type": "Polygon", "coordinates": [r]})) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"{key} long, g string").selectExpr(key, f"{G.from_geojson('g')} AS geom")


@pytest.fixture(scope="module")
def shapes():
    big = [star(-122 + RNG.uniform(-0.4, 0.4), 38 + RNG.uniform(-0.4, 0.4), RNG.choice([0.002, 0.02, 0.4]), RNG.choice([5, 12, 90])) for _ in range(25)]
    small = [star(-122 + RNG.uniform(-0.3, 0.3), 38 + RNG.uniform(-0.3, 0.3), RNG.choice([0.001, 0.01]), 6) for _ in range(40)]
    return big, small


def test_points_in_polygons(spark, shapes):
    big, _ = shapes
    pts = [(i, -122 + RNG.uniform(-0.6, 0.6), 38 + RNG.uniform(-0.6, 0.6)) for i in range(400)]
    pts += [(1000 + i, r[0][0] + 1e-4, r[0][1]) for i, r in enumerate(big)]
    got = spatial.points_in_polygons(spark.createDataFrame(pts, "pid long, lon double, lat double"), frame(spark, big), ["id"])
    want = {(p, i) for p, x, y in pts for i, r in enumerate(big) if parity(r, x, y)}
    assert {(r["pid"], r["id"]) for r in got.collect()} == want and want


def test_polygon_pairs_and_area(spark, shapes):
    big, small = shapes
    z = frame(spark, big, "zone_id").withColumns({"zone_code": F.lit("R1"), "jurisdiction_id": F.lit(1)})
    p = frame(spark, small, "parcel_id").withColumn("jurisdiction_id", F.lit(1))
    got = {(r["parcel_id"], r["zone_id"]): r["overlap_area"] for r in spatial.match_zones(p, z).collect()}
    # the same test on every pair, with complete edge lists and no cells
    a = spatial.with_edges(p).selectExpr("parcel_id", "geom AS g1", "edges AS e1")
    b = spatial.with_edges(z).selectExpr("zone_id", "geom AS g2", "edges AS e2")
    every = a.join(b, F.expr(G.intersects("e1", "e2"))).selectExpr("parcel_id", "zone_id", f"{G.intersection_area('g1', 'g2')} AS s").collect()
    assert got.keys() == {(r["parcel_id"], r["zone_id"]) for r in every} and got
    for r in every:
        assert got[r["parcel_id"], r["zone_id"]] == pytest.approx(r["s"], rel=1e-6, abs=1e-13)


def test_intersection_area_by_scan_lines(spark):
    a, b = star(0, 0, 1, 9), star(0.3, 0.1, 1, 11)
    df = frame(spark, [a]).crossJoin(frame(spark, [b]).withColumnsRenamed({"id": "id2", "geom": "geom2"}))
    got = df.selectExpr(f"{G.intersection_area('geom', 'geom2')} AS s").first()["s"]
    n, total = 4000, 0.0
    xs = np.linspace(-1.5, 1.8, 4001)
    for y in np.linspace(-1.5, 1.5, n, endpoint=False) + 1.5 / n:
        ins = []
        for ring in (a, b):
            m = np.zeros(len(xs), bool)
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > y) != (y2 > y):
                    m ^= xs < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            ins.append(m)
        total += (ins[0] & ins[1]).mean() * 3.3 * 3 / n
    assert got == pytest.approx(total, rel=5e-3)


def test_ring_rotation_and_direction_do_not_matter(spark, shapes):
    ring = shapes[0][3]
    turned = [*ring[4:-1], *ring[:5]]
    df = frame(spark, [ring, turned, ring[::-1]])
    rows = df.selectExpr(f"{G.planar_area('geom')} AS s", f"{G.centroid('geom')} AS c", f"{G.contains(G.edges('geom'), '-122.1D', '38.05D')} AS i").collect()
    assert {r["i"] for r in rows} == {parity(ring, -122.1, 38.05)}
    for r in rows:
        assert r["s"] == pytest.approx(area(ring), rel=1e-9)
        assert r["c"]["x"] == pytest.approx(rows[0]["c"]["x"], abs=1e-9)


def test_hole_and_boundary(spark):
    g = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}
    df = spark.createDataFrame([(json.dumps(g),)], "g string").selectExpr(f"{G.from_geojson('g')} AS geom").selectExpr("geom", f"{G.edges('geom')} AS e")
    at = lambda f, x, y: df.selectExpr(f"{f('e', f'{x}D', f'{y}D')} AS v").first()["v"]
    assert [at(G.contains, *p) for p in ((1, 5), (5, 5), (0, 5), (4, 5), (11, 5))] == [True, False, False, False, False]
    assert [at(G.covers, *p) for p in ((1, 5), (5, 5), (0, 5), (4, 5))] == [True, False, True, True]
    r = df.selectExpr(f"{G.planar_area('geom')} AS s", f"{G.is_valid('geom')} AS ok", f"{G.is_convex_polygon('geom')} AS c").first()
    assert (r["s"], r["ok"], r["c"]) == (96.0, True, False)


def test_bad_geometry(spark):
    rows = [("null",), ('{"type":"Point","coordinates":[1,2]}',), ('{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}',), (None,)]
    df = spark.createDataFrame(rows, "g string").selectExpr(f"{G.from_geojson('g')} AS geom")
    assert [r["ok"] for r in df.selectExpr(f"{G.is_valid('geom')} AS ok").collect()] == [False] * 4
    assert spatial.with_edges(df.where("geom IS NULL")).count() == 0


def test_distance_against_haversine(spark):
    box = [(-122.0, 38.0), (-121.999, 38.0), (-121.999, 38.001), (-122.0, 38.001), (-122.0, 38.0)]
    df = frame(spark, [box]).selectExpr(f"{G.distance_m(G.edges('geom'), '-122.0002D', '38.0012D')} AS d")
    p1, p2 = math.radians(38.0012), math.radians(38.001)
    h = math.sin((p1 - p2) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(0.0002) / 2) ** 2
    assert df.first()["d"] == pytest.approx(2 * 6371008.8 * math.asin(math.sqrt(h)), rel=5e-3)


def test_inset(spark):
    ell = [(0, 0), (0.001, 0), (0.001, 0.0002), (0.0002, 0.0002), (0.0002, 0.001), (0, 0.001), (0, 0)]
    sq = [(-120.0, 35.0), (-119.999, 35.0), (-119.999, 35.001), (-120.0, 35.001), (-120.0, 35.0)]
    shapes = [[(x - 120, y + 35) for x, y in ell], sq]
    base = frame(spark, shapes)
    got = [{r["id"]: r["inset_area_m2"] or 0.0 for r in envelope.inset_areas(base, F.lit(d)).collect()} for d in (0.0, 1.0, 3.0, 200.0)]
    full = {r["id"]: r["a"] for r in base.selectExpr("id", f"{G.area_m2('geom')} AS a").collect()}
    for i in (0, 1):
        assert got[0][i] == pytest.approx(full[i], rel=1e-3)
        assert got[0][i] > got[1][i] > got[2][i] > got[3][i] == 0
    w = math.sqrt(full[1])
    assert got[1][1] == pytest.approx(full[1] - 4 * w + 4, rel=1e-2)


def test_eroded_area_of_an_ell():
    # arms 10 x 2 and 2 x 10: insets of 0.5 leave 9 x 1 and 1 x 9 minus the shared corner, and a
    # reflex corner rounds by (1 - pi/4) d^2
    pts = np.array([(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10), (0, 0)], float)
    e = np.hstack([pts[:-1], pts[1:]])
    want = 9 * 1 + 9 * 1 - 1 + (1 - math.pi / 4) * 0.25
    assert envelope.eroded_area(e, 0.5) == pytest.approx(want, rel=1e-9)
    assert envelope.eroded_area(e, 5.0) == 0.0


def ring_edges(*rings):
    return np.array([[*a, *b] for r in rings for a, b in zip(r, r[1:] + r[:1])], dtype=float)


def test_eroded_areas_in_closed_form():
    w, h, a, b = 10, 8, 4, 3
    ell, hole = [(0, 0), (w, 0), (w, b), (a, b), (a, h), (0, h)], [(3, 3), (6, 3), (6, 5), (3, 5)]
    for d in (0.1, 0.5, 1.0, 1.4):
        assert envelope.eroded_area(ring_edges(ell), d) == pytest.approx((w - 2 * d) * (h - 2 * d) - (w - a) * (h - b) + d * d * (1 - math.pi / 4), abs=1e-7)
    for d in (0.1, 0.7, 1.2):
        assert envelope.eroded_area(ring_edges([(0, 0), (w, 0), (w, h), (0, h)], hole), d) == pytest.approx((w - 2 * d) * (h - 2 * d) - (6 + 10 * d + math.pi * d * d), abs=1e-7)
    two = [[(0, 0), (3, 0), (3, 8), (0, 8)], [(5, 0), (9, 0), (9, 8), (5, 8)]]
    assert envelope.eroded_area(ring_edges(*two), 1.0) == pytest.approx(18, abs=1e-9)
    assert envelope.eroded_area(ring_edges(ell), 5.0) == 0.0 and envelope.eroded_area(np.zeros((0, 4)), 1.0) == 0.0
    assert envelope.eroded_area(ring_edges([(0, 0), (0, 0), (1, 1)]), 0.1) == 0.0


@pytest.mark.parametrize("n", [7, 20, 60])
def test_eroded_area_does_not_turn(n, monkeypatch):
    """Turning or mirroring a lot, or looking at fewer pairs at a time, leaves its area; sampling agrees."""
    ring, d = star(0, 0, 10, n)[:-1], 0.4
    turned = lambda t, m: [(m * (x * math.cos(t) - y * math.sin(t)), x * math.sin(t) + y * math.cos(t)) for x, y in ring]
    areas = [envelope.eroded_area(ring_edges(turned(t, m)), d) for t in (0.0, 0.3, math.pi / 2, 2.0) for m in (1, -1)]
    assert max(areas) - min(areas) < 1e-7
    monkeypatch.setattr(envelope, "PAIRS", 500)
    assert envelope.eroded_area(ring_edges(ring), d) == pytest.approx(areas[0], abs=1e-9)
    e, x = ring_edges(ring), (np.indices((400, 400)).reshape(2, -1).T + 0.5) / 20 - 10
    inside, near = np.zeros(len(x), dtype=bool), np.full(len(x), np.inf)
    for x1, y1, x2, y2 in e:
        cross = (y1 > x[:, 1]) != (y2 > x[:, 1])
        if y1 != y2:
            inside ^= cross & (x[:, 0] < (x2 - x1) * (x[:, 1] - y1) / (y2 - y1) + x1)
        t = np.clip(((x[:, 0] - x1) * (x2 - x1) + (x[:, 1] - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        near = np.minimum(near, np.hypot(x[:, 0] - x1 - t * (x2 - x1), x[:, 1] - y1 - t * (y2 - y1)))
    assert areas[0] == pytest.approx((inside & (near >= d)).sum() / 400, rel=0.02, abs=0.2)



def test_condominium_stack_and_ties(spark):
    box = [(-122.0, 38.0), (-121.9999, 38.0), (-121.9999, 38.0001), (-122.0, 38.0001), (-122.0, 38.0)]
    p = frame(spark, [box] * 50, "parcel_id").selectExpr("parcel_id", "geom", "1L AS jurisdiction_id", "CAST(1000 - parcel_id AS string) AS apn")
    pts = spark.createDataFrame([(1, -121.99995, 38.00005), (1, -122.00005, 38.00005), (1, -122.1, 38.0)], "jurisdiction_id long, lon double, lat double")
    got = {r["lon"]: (r["parcel_id"], r["match_method"]) for r in spatial.match_parcel(pts, p).collect()}
    assert got == {-121.99995: (0, "st_contains"), -122.00005: (0, "st_intersects")}


def test_equal_lots_are_measured_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from parcelspark.operators import envelope as E

    calls, real = [], E.eroded_area
    monkeypatch.setattr(E, "eroded_area", lambda e, d: calls.append(d) or real(e, d))
    monkeypatch.setattr(E, "REMEMBERED", 2)
    shape = [0.0, 0.0, 8.0, 0.0, 8.0, 0.0, 8.0, 8.0, 8.0, 8.0, 4.0, 4.0, 4.0, 4.0, 0.0, 0.0]
    dist = [1.0, 1.0, 0.5, None, 1.0, 2.0, 1.0]
    batch = pa.record_batch([pa.array(range(8)), pa.array([shape] * 7 + [None]), pa.array([*dist, 1.0])], names=["k", "_e", "_d"])
    got = next(E._with_areas(iter([batch]))).column("eroded").to_pylist()
    assert got == [None if d is None else real(np.array(shape).reshape(-1, 4), d) for d in dist] + [None]
    assert calls == [1.0, 0.5, 2.0, 1.0]  # the third shape makes room


def test_distance_is_measured_once(spark):
    """The limit on the distance is no second measurement below the first."""
    from parcelspark.queries import spatial as queries

    text = queries.distance_m(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    limited = [line for line in text.split("\n") if "<= 60.0" in line]
    assert len(limited) == 1 and "exists(" not in limited[0]
