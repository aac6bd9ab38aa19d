"""Quadtree pieces and stored layers, against whole polygons."""

import glob
import json
import random
import re

import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_geometry import frame, parity, star

from parcelspark.functions import geometry as G
from parcelspark.operators import layers, spatial, validity
from parcelspark.operators import quadtree as Q
from parcelspark.queries import domain as D

RNG = random.Random(11)


@pytest.fixture(scope="module")
def shapes():
    """Many-edged and few-edged polygons whose corners often lie on cell borders."""
    grid = lambda r: [(round(x * 4096) / 4096, round(y * 4096) / 4096) for x, y in r]
    out = [star(-122 + RNG.uniform(-0.3, 0.3), 38 + RNG.uniform(-0.3, 0.3), r, n) for r in (0.3, 0.05, 0.004) for n in (5, 40, 400)]
    return [grid(r) if i % 2 else r for i, r in enumerate(out)]


def test_pieces_decide_points(spark, shapes):
    pts = [(i, -122 + RNG.uniform(-0.6, 0.6), 38 + RNG.uniform(-0.6, 0.6)) for i in range(500)]
    pts += [(1000 + i, x + dx, y) for r in shapes for i, (x, y) in enumerate(r[::7]) for dx in (0.0, 1 / 8192)]
    layer = layers.Layer.of(frame(spark, shapes), ["id"])
    got = layer.points(spark.createDataFrame(pts, "pid long, lon double, lat double")).selectExpr("pid", "lon", "lat", "id", f"{Q.contains_point()} AS inside", f"{Q.covers_point()} AS covered").collect()
    on = lambda r, x, y: any(
        (x2 - x1) * (y - y1) == (x - x1) * (y2 - y1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for (x1, y1), (x2, y2) in zip(r, r[1:])
    )
    inside = {(p, x, y, i) for p, x, y in pts for i, r in enumerate(shapes) if parity(r, x, y) and not on(r, x, y)}
    covered = inside | {(p, x, y, i) for p, x, y in pts for i, r in enumerate(shapes) if on(r, x, y)}
    key = lambda r: (r.pid, r.lon, r.lat, r.id)
    assert len({key(r) for r in got}) == len(set(map(key, got)))
    assert {key(r) for r in got if r.inside} == inside and {key(r) for r in got if r.covered} == covered and len(covered) > len(inside) > 50


def test_pieces_are_small_and_cover_once(spark, shapes):
    layer = layers.Layer.of(frame(spark, shapes), ["id"], areas=True)
    rows = layer.pieces.selectExpr("id", "level", "cell", "full", "size(edges) AS n", "size(steps) AS s", "side", f"{G.planar_area('transform(rings, r -> array(r.pts))')} AS a").collect()
    assert max(r.n for r in rows if r.level < Q.DEEPEST) <= Q.PIECE_EDGES and any(r.full for r in rows)
    assert all(r.n == 0 and r.s == 0 and r.a == pytest.approx(r.side**2) for r in rows if r.full)
    total = {}
    for r in rows:
        total[r.id] = total.get(r.id, 0) + r.a
    for r in frame(spark, shapes).selectExpr("id", f"{G.planar_area('geom')} AS a").collect():
        assert total[r.id] == pytest.approx(r.a, rel=1e-9)


HOLED = {"type": "Polygon", "coordinates": [[[0, 0], [8, 0], [8, 8], [0, 8], [0, 0]], [[2, 2], [6, 2], [6, 6], [2, 6], [2, 2]]]}
TWO = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 8], [0, 8], [0, 0]]], [[[7, 0], [8, 0], [8, 8], [7, 8], [7, 0]]]]}


def test_holes_parts_and_large_probes(spark):
    zones = spark.createDataFrame([(1, json.dumps(HOLED)), (2, json.dumps(TWO))], "zone_id long, g string").selectExpr("zone_id", f"{G.from_geojson('g')} AS geom", "'R1' AS zone_code", "1 AS jurisdiction_id")
    boxes = {1: (3, 3, 5, 5), 2: (1, 1, 2, 2), 3: (-5, -5, 20, 20), 4: (0.25, 0.25, 0.5, 0.5), 5: (1.5, 3, 7.5, 5), 6: (8, 8, 9, 9), 7: (6, 2, 6.5, 6)}
    lots = spark.createDataFrame([(k, *map(float, b)) for k, b in boxes.items()], "parcel_id long, a double, b double, c double, d double").selectExpr("parcel_id", "1 AS jurisdiction_id", f"{G.box('a', 'b', 'c', 'd')} AS geom")
    got = {(r.parcel_id, r.zone_id): round(r.overlap_area, 9) for r in spatial.match_zones(lots, zones).collect()}
    assert got == {(2, 1): 1, (2, 2): 0, (3, 1): 48, (3, 2): 16, (4, 1): 0.0625, (4, 2): 0.0625, (5, 1): 4, (5, 2): 1, (6, 1): 0, (6, 2): 0, (7, 1): 2}


@pytest.fixture(scope="module")
def stored(spark, shapes, tmp_path_factory):
    fine = [star(-122 + RNG.uniform(-0.3, 0.3), 38 + RNG.uniform(-0.3, 0.3), 0.002, 6) for _ in range(300)]
    df = frame(spark, shapes + fine, "zone_id").withColumns({"zone_code": F.lit("R1"), "jurisdiction_id": (F.col("zone_id") % 2)})
    return df, layers.store(f"{tmp_path_factory.mktemp('l')}/zones", df, spatial.ZONE_KEEP, areas=True, tile_level=4)


def test_stored_as_filed_on_the_fly(spark, stored):
    df, layer = stored
    lots = frame(spark, [star(-122 + RNG.uniform(-0.3, 0.3), 38 + RNG.uniform(-0.3, 0.3), RNG.choice([0.001, 0.03]), 6) for _ in range(60)], "parcel_id").withColumn("jurisdiction_id", F.lit(1))
    one, two = ({(r.parcel_id, r.zone_id, round(r.overlap_area, 12)) for r in spatial.match_zones(lots, z).collect()} for z in (df, layer))
    assert one == two and len(one) > 40
    again = layers._open(spark, layer.features.inputFiles()[0].rsplit("/features", 1)[0])
    assert again.levels == layer.levels and again.pieces.count() == layer.pieces.count()


def test_geometry_is_not_shuffled(spark, stored):
    _, layer = stored
    pts = spark.range(40).selectExpr("-122 + id / 400 AS lon", "38 + id / 500 AS lat", "id % 2 AS jurisdiction_id")
    few = spatial.zones_at_points(pts, layer)
    text = few._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", text), text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spatial.zones_at_points(pts, layer)
        text = many._jdf.queryExecution().executedPlan().toString()
        scan = text[text.index("SortMergeJoin"):]
        pieces = scan[scan.rindex("Sort ["):]
        assert "SortMergeJoin" in text and "FileScan" in pieces and "Exchange" not in pieces, text
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_envelope_reaches_the_scan(spark, tmp_path):
    """Rows lie along a curve, so a small envelope meets few row groups, and the range is pushed down."""
    path = str(tmp_path / "f")
    layers.clustered(D.parcels(spark, SF), 8).write.parquet(path)
    window = (-123.99, 32.5, -123.985, 32.501)
    found = layers.in_envelope(spark.read.parquet(path), *window)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"{k}" in plan[plan.index("PushedFilters"):] for k in ("GreaterThanOrEqual(xmax", "LessThanOrEqual(xmin", "GreaterThanOrEqual(ymax", "LessThanOrEqual(ymin"))
    kept, total = 0, 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            low, high = (lambda k: meta.row_group(g).column(at[k]).statistics.min), (lambda k: meta.row_group(g).column(at[k]).statistics.max)
            total += 1
            kept += high("xmax") >= window[0] and low("xmin") <= window[2] and high("ymax") >= window[1] and low("ymin") <= window[3]
    assert 0 < kept < total / 2 and found.count() > 0


def test_builds_are_found_when_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = layers.fingerprint(spark, path)
    assert first == layers.fingerprint(spark, path)
    spark.range(7).write.mode("overwrite").parquet(path)
    assert first != layers.fingerprint(spark, path)
    calls = []

    def build(folder):
        calls.append(folder)
        if len(calls) == 1:
            raise RuntimeError("lost")
        spark.range(3).write.parquet(folder)

    with pytest.raises(RuntimeError):
        layers.current(spark, f"test-{first}", build)
    assert layers.current(spark, f"test-{first}", build) == layers.current(spark, f"test-{first}", build) == calls[1]


def test_validity(spark):
    sq = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    cases = {
        "fine": [[sq]], "bow": [[[[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]]], "spike": [[[[0, 0], [4, 0], [4, 4], [4, 6], [4, 4], [0, 4], [0, 0]]]],
        "pinch": [[[[0, 0], [2, 2], [4, 0], [4, 4], [2, 2], [0, 4], [0, 0]]]], "hole": [[sq, [[1, 1], [1, 2], [2, 2], [1, 1]]]], "out": [[sq, [[5, 5], [5, 6], [6, 6], [5, 5]]]],
        "touch": [[sq, [[1, 1], [0, 2], [2, 2], [1, 1]]]], "two": [[sq], [[[6, 0], [8, 0], [8, 2], [6, 0]]]], "inside": [[sq], [[[1, 1], [2, 1], [2, 2], [1, 1]]]],
        "over": [[sq], [[[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]]], "same": [[sq], [sq]], "island": [[sq, [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]], [[[1.5, 1.5], [2, 1.5], [2, 2], [1.5, 1.5]]]],
        "many": [[[[x, y] for x, y in star(100, 20, 3, 60)]]],
    }
    rows = [(k, json.dumps({"type": "MultiPolygon", "coordinates": v})) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "id string, g string").selectExpr("id", f"{G.from_geojson('g')} AS geom").withColumn("digest", validity.digest("geom"))
    found = {r.id: (r.crossing, r.nested) for r in df.join(validity.invalid(df), "digest").collect()}
    assert set(found) == {"bow", "spike", "pinch", "out", "touch", "inside", "over", "same", "island"}
    assert {k for k, v in found.items() if v[0]} == {"bow", "spike", "pinch", "touch", "over", "same"} and found["inside"] == (False, True) and found["out"] == (False, True)
    status = {r.id: r.data_status for r in validity.review(df.select("id", "geom").union(spark.createDataFrame([("none", None)], "id string, g string").selectExpr("id", f"{G.from_geojson('g')}"))).collect()}
    assert {k for k, v in status.items() if v == "needs_review"} == {*found, "none"}


def test_sides_that_grow_are_not_broadcast(spark, monkeypatch):
    from parcelspark.operators import geocode, layers
    from parcelspark.queries import domain as D

    monkeypatch.setattr(layers, "FEW", 10)
    sf = "/root/testdata/sf0.001"
    pairs = spatial.points_in_polygons(D.located(spark, sf).select("request_id", "lon", "lat"), D.odd_lots(spark, sf), ["parcel_id"])
    asked = geocode.geocode(D.ask(spark, sf), D.geocodes(spark, sf))
    for df in (pairs, asked):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_filed_layers_use_only_their_levels(spark):
    from parcelspark.operators import layers
    from parcelspark.queries import domain as D

    filed = layers.Layer.of(D.odd_lots(spark, "/root/testdata/sf0.001"), ["parcel_id"])
    assert len(filed.levels) < 5 and filed.few
    none = layers.Layer.of(D.odd_lots(spark, "/root/testdata/sf0.001").where("parcel_id < 0"), ["parcel_id"])
    assert none.points(D.located(spark, "/root/testdata/sf0.001")).count() == 0


def test_undivided_probes_are_not_cut(spark, shapes):
    """Probes that no boundary comes near get what cutting them gives."""
    zones = frame(spark, shapes, "zone_id").withColumns({"zone_code": F.lit("R1"), "jurisdiction_id": F.lit(1)})
    layer = spatial.zone_layer(zones)
    lots = frame(spark, [star(-122 + RNG.uniform(-0.3, 0.3), 38 + RNG.uniform(-0.3, 0.3), 0.002, 6) for _ in range(80)], "parcel_id").withColumn("jurisdiction_id", F.lit(1))
    p = spatial.with_edges(lots).withColumns({"parts": F.expr(G.convex_parts("geom")), "area": F.expr(G.planar_area("geom"))}).drop("geom")
    p, f = layer.polygons(p)
    pairs = p.join(f, F.expr(f"p.cell = f.cell AND p.tile = f.tile AND {Q.undivided()}")).selectExpr(
        f"{Q.holds_start()} AS whole", f"{Q.meets_piece()} AS hit", f"{G.overlap_area('p.parts', 'f.rings')} AS cut", "p.area AS area"
    ).collect()
    assert {r.whole for r in pairs} == {True, False}
    assert all(r.whole == r.hit and abs(r.cut - (r.area if r.whole else 0)) < 1e-15 for r in pairs)


def test_stored_pieces_are_counted_once(spark, shapes, tmp_path, monkeypatch):
    seen, measure = [], layers._measure
    monkeypatch.setattr(layers, "_measure", lambda pieces: seen.append(1) or measure(pieces))
    layer = layers.store(f"{tmp_path}/one", frame(spark, shapes, "zone_id").withColumns({"zone_code": F.lit("R1"), "jurisdiction_id": F.lit(1)}), spatial.ZONE_KEEP)
    assert len(seen) == 1 and layer.levels == measure(layer.pieces)[0]
