"""Field choice by layer, and values as they are stored."""

import json

from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators import candidates, validation
from parcelspark.sources import features as S


def rows(spark, data):
    return spark.createDataFrame(data, "layer string, id int, props map<string,string>").withColumn("geom", F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>"))


LAYERS = [("a", 1, {"Zone_Cmplt": "R1", "ZONE": "X"}), ("a", 2, {"ZONE": "Y"}), ("a", 3, {"zone_cmplt": "  ", "ZONE": "Z"}), ("b", 4, {"ZONE": "W"}), ("b", 5, {"ZONING": "V", "Zone": None}), ("c", 6, {"OTHER": "U"}), ("c", 7, {})]


def test_first_field_of_the_layer(spark):
    df = rows(spark, LAYERS)
    profile = {(r.layer, r.field): r.present for r in S.schema_profile(df, ["layer"]).collect()}
    assert profile == {("a", "zone_cmplt"): 2, ("a", "zone"): 3, ("b", "zone"): 2, ("b", "zoning"): 1, ("c", "other"): 1}
    wanted = {"code": C.BULK_FIELDS["zone_code"]}
    got = {r.id: r.code for r in S.resolve_fields(df, wanted, ["layer"]).collect()}
    assert got == {1: "R1", 2: None, 3: None, 4: "W", 5: None, 6: None, 7: None}
    one = {r.id: r.code for r in S.resolve_fields(df, wanted).collect()}
    assert one == {1: "R1", 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    told = spark.createDataFrame([("a", ["ZONE"]), ("b", ["zoning", "OBJECTID"])], "layer string, fields array<string>")
    named = {r.id: r.code for r in S.resolve_fields(df, wanted, ["layer"], told).collect()}
    assert named == {1: "X", 2: "Y", 3: "Z", 4: None, 5: "V", 6: None, 7: None}
    assert {r.zone_code: r.outcome for r in S.load_zoning(df, ["layer"]).collect()} == {"R1": "inserted", "W": "inserted", None: "failed"}
    assert S.resolve_fields(df.where("false"), wanted).count() == 0 == S.resolve_fields(df.where("false"), wanted, ["layer"]).count()


def test_validation_reads_the_stored_json(spark):
    base = C.state_baselines(spark)
    attrs = spark.createDataFrame(
        [(1, "height_limit_detached_ft", "16", 99.0), (1, "no_such_field", "1", None), (2, "height_limit_detached_ft", '"12 ft"', 16.0), (2, "owner_occupancy_required", "true", None)],
        "rule_id int, field_name string, value_json string, value_numeric double",
    ).withColumn("source_url", F.lit("u"))
    fields = {r.field_name: r.kind for r in C.field_catalog(spark).collect()}
    attrs = attrs.where(F.col("field_name").isin([*fields, "no_such_field"]))
    v = validation.validate_rules(validation.stored_values(attrs), C.field_catalog(spark), base)
    flags = {(r.rule_id, r.field_name): r.observed for r in v.collect()}
    assert all(k[1] in fields for k in flags)
    assert all(o == "16.0" for (i, f), o in flags.items() if i == 1) and all(o == "12.0" for (i, f), o in flags.items() if i == 2 and fields[f] in ("floor", "ceiling"))
    rules = spark.createDataFrame([(1, 7, "pending"), (2, 7, "verified"), (3, 7, "pending"), (4, 8, "pending")], "rule_id int, jurisdiction_id int, review_status string")
    got = {r.jurisdiction_id: (r.rules, r.attributes) for r in validation.counters(rules, attrs, v).collect()}
    assert got == {7: (2, attrs.where("rule_id = 1").count()), 8: (1, 0)}


def test_numbers_in_quotes_are_text(spark):
    name = next(f[0] for f in C.FIELD_CATALOG if f[1] == "numeric")

    def document(value):
        fields = {f: {"value": None, "confidence": "high", "evidence": ""} for f in C.FIELD_NAMES}
        fields[name] = {"value": value, "confidence": "high", "evidence": " e "}
        return json.dumps({"zones": [{"zone_district": "R1", "fields": fields}]})

    docs = spark.createDataFrame([(1, i, C.PROJECT_TYPES, document(v)) for i, v in enumerate([16, 16.5, "16", None, True])], "jurisdiction_id int, section_id int, supported array<string>, payload string")
    got = {(r.section_id, r.value, r.value_numeric) for r in candidates.map_candidates(docs, C.field_catalog(spark)).collect()}
    assert got == {(0, "16", 16.0), (1, "16.5", 16.5), (2, "16", None), (4, "true", None)}
    assert {r.section_id: r.problem for r in candidates.check_payloads(docs).collect()} == {0: None, 1: None, 2: "bad_field_value", 3: None, 4: "bad_field_value"}


def test_flood_beyond_california(spark, tmp_path):
    # lots far down the grid stretch it north of 42.1 degrees; their flood overlays are loaded like any others
    from parcelspark.queries import domain as D
    from parcelspark.queries.sources import load_flood

    sf = str(tmp_path)
    spark.createDataFrame([(0, 1), (64 * 12000, 1)], "p_partkey long, p_size int").write.parquet(f"{sf}/part.parquet")
    spark.range(400).selectExpr("id AS s_suppkey").write.parquet(f"{sf}/supplier.parquet")
    north = D.overlays(spark, sf).where("overlay_type = 'flood' AND geom[0][0][0].y > 42.1").count()
    assert north > 0
    assert {int(r.raw_feature_id) for r in load_flood(spark, sf).collect()} == set(range(0, 400, 5))
