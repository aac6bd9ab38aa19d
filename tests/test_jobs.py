"""Sources, sinks, streams and the feasibility job on small made scenes."""

import json
import re

import pytest
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import geometry as G
from parcelspark.functions import text as T
from parcelspark.plans import feasibility as P
from parcelspark.plans.feasibility import Refs, feasibility
from parcelspark.session import cut, shared_dir
from parcelspark.sources import features, sinks
from parcelspark.streaming import jobs as J

NOW = "2024-06-01 00:00:00"


def box(x1, y1, x2, y2):
    return json.dumps({"type": "Polygon", "coordinates": [[[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]]})


def geo(spark, rows, ddl):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumn("geom", F.expr(G.from_geojson("g"))).drop("g")


def scene(spark, coverage="production", value=5.0, fire=True):
    prov = ["*", "'urn:x' AS source_url", "'layer' AS source_layer", "'high' AS confidence"]
    jur = geo(
        spark, [(1, "los_angeles", "Los Angeles", "city", coverage, box(-118.70, 33.90, -118.10, 34.40)), (2, "oakland", "Oakland", "city", "planned", box(-122.4, 37.6, -122.1, 37.9))],
        "jurisdiction_id long, slug string, name string, jurisdiction_type string, coverage_status string, g string",
    ).withColumn("last_source_refresh_at", F.lit(None).cast("timestamp"))
    parcels = geo(spark, [(1, 10, "5123", 6500.04, box(-118.2510, 34.0490, -118.2490, 34.0510))], "jurisdiction_id long, parcel_id long, apn string, area_sqft double, g string").selectExpr(*prov)
    zones = geo(spark, [(1, 7, "R1", "One-Family", box(-118.3, 34.0, -118.2, 34.1))], "jurisdiction_id long, zone_id long, zone_code string, zone_name string, g string").selectExpr(*prov)
    over = [(1, "historic", "H", None, box(-118.26, 34.04, -118.24, 34.06))] + ([(2, "fire", "F", "High", box(-118.0, 34.3, -117.9, 34.4))] if fire else [])
    overlays = geo(spark, over, "overlay_id long, overlay_type string, name string, designation string, g string").withColumns(
        {"raw_feature_id": F.lit(None).cast("string"), "raw_value": F.lit(None).cast("map<string,string>")}
    )
    rules = spark.createDataFrame([(1, 1, "r1", "detached_adu", 1, True, "verified")], "rule_id long, jurisdiction_id long, zone_code string, project_type string, version int, is_current boolean, review_status string")
    attrs = spark.createDataFrame(
        [(1, "side_rear_setback_min_ft", str(value), value, "ft", "ceiling", "urn:code", "Code", "12.22")],
        "rule_id long, field_name string, value_json string, value_numeric double, unit string, operator string, source_url string, source_title string, source_section string",
    )
    where = [("1 N MAIN ST", -118.25, 34.05, "high"), ("2 OAK RD", -122.27, 37.8, "high"), ("3 SEA DR", -100.0, 40.0, "high"), ("4 FAR LN", -118.25, 34.05, "low"), ("5 GAP CT", -118.25, 34.3, "medium")]
    codes = spark.createDataFrame(where, "normalized_address string, lon double, lat double, confidence string")
    return Refs(jur, parcels, zones, overlays, rules, attrs, C.state_baselines(spark), codes)


def ask(spark, rows):
    full = [(i, "c", a, p, None, None, None, None, t, e) for i, a, p, t, e in rows]
    return spark.createDataFrame(full, "request_id long, consumer_id string, address string, project_type string, target_sqft double, bedrooms int, proposed_height_ft double, existing_structure_type string, near_transit boolean, include_envelope boolean")


def test_scene(spark):
    q = ask(spark, [
        (1, "1 North Main Street", "detached_adu", None, None), (2, "2 Oak Road", "jadu", None, None), (3, "3 sea dr", "jadu", None, None), (4, "4 far ln", "jadu", None, None),
        (5, "5 Gap Court", "jadu", None, True), (6, "nowhere at all", "jadu", None, None), (7, "1 N Main St.", "sb9_duplex", None, None), (8, "1 n main st", "detached_adu", True, True),
    ])
    r = {x["request_id"]: x for x in feasibility(q, scene(spark), NOW).collect()}
    # the local 5 ft setback exceeds the 4 ft ceiling
    assert r[1]["feasibility_status"] == "needs_professional_review" and r[1]["billable"]
    res = r[1]["result"]
    side = res["development_constraints"]["side_setback_ft"]
    assert (side["value"], side["state_baseline"], side["compliance_flag"]) == (5.0, 4.0, C.RESTRICTIVE)
    assert side["provenance"]["source_section"] == "12.22"
    assert res["development_constraints"]["max_height_ft"]["value"] == 16.0
    # the answer's values carry their source
    lot = res["parcel"]["lot_size_sqft"]
    assert (lot["value"], lot["unit"], lot["provenance"]["source_title"]) == (6500.0, "sqft", "Parcel GIS layer") and res["disclaimer"] == C.DISCLAIMER
    assert res["zoning"]["zone_code"]["value"] == "R1" and res["zoning"]["general_plan"] is None and res["share_token"] is None
    assert [(o["overlay_type"], o["status"]) for o in res["overlay_findings"]] == [("historic", "hit"), ("flood", "source_unavailable"), ("fire", "no_hit")]
    assert res["overlay_findings"][0]["raw_values"]["severity"] == "info"
    assert r[2]["kind"] == "unsupported_coverage" and r[2]["result"] is None and not r[2]["billable"] and r[2]["jurisdiction_slug"] == "oakland"
    for i, code in ((3, "jurisdiction_unresolved"), (4, "geocode_failed"), (6, "geocode_failed")):
        assert r[i]["feasibility_status"] == "insufficient_data" and not r[i]["billable"] and r[i]["kind"] == "completed"
        assert [x["code"] for x in r[i]["limitations"]] == [code] and r[i]["result"]["coverage"]["jurisdiction_slug"] == "unknown" and r[i]["coverage_status"] == "planned"
    assert [x["code"] for x in r[5]["limitations"]] == ["parcel_unmatched", "zoning_unresolved", "envelope_unavailable_no_parcel"]
    assert r[7]["path_status"] == "conditional" and r[7]["feasibility_status"] == "likely_constrained"
    env = r[8]["result"]["approximate_envelope"]
    assert env["available"] and env["buildable_area_sqft"] > 0 and "5 ft" in env["assumptions"][0]
    assert r[1]["request_fingerprint"] != r[8]["request_fingerprint"]


def test_clean_local_rules_are_feasible(spark):
    r = feasibility(ask(spark, [(1, "1 N Main St", "detached_adu", None, None)]), scene(spark, value=4.0), NOW).first()
    assert r["feasibility_status"] == "likely_feasible" and r["path_status"] == "likely_eligible"


def test_no_requests(spark):
    assert feasibility(ask(spark, [(1, "x", "jadu", None, None)]).where("request_id > 1"), scene(spark), NOW).count() == 0


def test_request_plan_has_no_cartesian_product(spark):
    df = feasibility(ask(spark, [(1, "1 N Main St", "jadu", None, None)]), scene(spark), NOW)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_feature_reading(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no landed"):
        features.read_features(spark, str(tmp_path / "none"))
    page = {"features": [{"geometry": json.loads(box(0, 0, 1, 1)), "properties": {"OBJECTID": i, "Zone": f"R{i}"}} for i in (10, 9, 2)]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    f = features.read_features(spark, str(tmp_path), max_features=2)
    assert sorted(r["z"] for r in f.select(features.pick(F.col("props"), ["zone"]).alias("z")).collect()) == ["R2", "R9"]


def test_scope_is_never_cleared_by_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_scope(spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string"), path, "s")
    sinks.replace_scope(spark.createDataFrame([(3, "a")], "i int, s string"), path, "s")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]
    with pytest.raises(ValueError):
        sinks.replace_scope(spark.createDataFrame([], "i int, s string"), path, "s")


def test_private_tables_are_refused(spark):
    with pytest.raises(PermissionError):
        sinks.public_view(spark.range(1), "parcels")


def test_land_new_adds_nothing_twice(spark):
    path = f"{shared_dir(spark)}/land-{id(spark)}"
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        J.land_new(batch, path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_late_rows_are_counted(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, ts in enumerate(["2024-01-01T12:00:00", "2024-01-01T13:00:00", "2024-01-01T10:00:00"]):
        (src / f"{i}.json").write_text(json.dumps({"ts": ts + "Z", "consumer_id": 1}))
    s = spark.readStream.schema("ts timestamp, consumer_id long").option("maxFilesPerTrigger", 1).json(str(src))
    q = J.minute_counts(s).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    late = J.late_rows(q)
    q.stop()
    assert late >= 1


def test_keyword_and_url_parts(spark):
    r = spark.range(1).select(T.code_url_parts(F.lit("https://x.y/codes/la/latest/lapz/0-0-0-1?q=1")).alias("u"), T.matches_keywords(F.lit("New Accessory Dwelling Units")).alias("k"), T.matches_keywords(F.lit("Parking")).alias("n")).first()
    assert tuple(r["u"]) == ("la", "lapz", "0-0-0-1") and r["k"] and not r["n"]


def test_sites_are_joined_once(spark):
    """What is read several times is stored, so the last plan holds neither the requests' nor the geocodes' table."""
    q = ask(spark, [(1, "1 North Main Street", "detached_adu", None, True), (6, "nowhere at all", "jadu", None, None)])
    plan = feasibility(q, scene(spark), NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_no_stage_is_planned_twice(spark, monkeypatch):
    """Stages read by several joins are stored: no plan of the job holds the geocodes twice, or as many joins as with its inputs in it."""
    plans = []
    monkeypatch.setattr(P, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    refs = scene(spark)
    refs.geocodes = refs.geocodes.withColumn("lon", F.col("lon") + F.expr("length(uuid()) - 36"))
    q = ask(spark, [(1, "1 North Main Street", "detached_adu", None, True), (6, "nowhere at all", "jadu", None, None)])
    last = feasibility(q, refs, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert [p.count("uuid(") for p in [*plans, last] if "uuid(" in p] == [1]
    assert max(len(re.findall(r"\bJoin ", p)) for p in plans) <= 5
