"""Golden values of single functions."""

import json

import pytest
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import text as T
from parcelspark.functions import values as V
from parcelspark.operators import rules
from parcelspark.operators import validation as W

MATCH, MORE, REVIEW, NA = C.FLAGS


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def val(x):
    if isinstance(x, bool):
        return V.value(bool_=F.lit(x))
    if isinstance(x, (int, float)):
        return V.value(F.lit(float(x)))
    return V.value(json=F.lit(None if x is None else json.dumps(x)))


@pytest.mark.parametrize(
    "op,local,base,want",
    [
        ("floor", 16, 16, MATCH), ("floor", 20, 16, MATCH), ("floor", 14, 16, MORE),
        ("ceiling", 4, 4, MATCH), ("ceiling", 3, 4, MATCH), ("ceiling", 6, 4, MORE),
        ("gte", 850, 850, MATCH), ("gte", 800, 850, MORE), ("lte", 60, 60, MATCH), ("lte", 90, 60, MORE),
        ("must_equal", False, False, MATCH), ("must_equal", True, False, MORE), ("eq", 750, 750, MATCH), ("eq", 700, 750, REVIEW),
        ("floor", None, 16, REVIEW), ("floor", 16, None, REVIEW), ("eq", {"conditional": True}, 16, REVIEW),
        ("must_equal", 1.0, True, MATCH), ("floor", True, 16, REVIEW), ("other", 1, 1, REVIEW),
    ],
)
def test_compliance(spark, op, local, base, want):
    assert one(spark, rules.evaluate_compliance(F.lit(op), val(local), val(base))) == want


@pytest.mark.parametrize(
    "change,want",
    [
        ({"parcel": False}, "insufficient_data"), ({"zoning": False}, "insufficient_data"), ({"low": True}, "insufficient_data"),
        ({"ambiguous": True}, "needs_professional_review"), ({"flags": [MORE]}, "needs_professional_review"), ({"flags": [REVIEW]}, "needs_professional_review"),
        ({"orientation": True}, "needs_professional_review"), ({"path": "needs_professional_review"}, "needs_professional_review"),
        ({"hazard": True}, "likely_constrained"), ({"path": "conditional"}, "likely_constrained"), ({"path": "likely_ineligible"}, "likely_constrained"),
        ({}, "likely_feasible"),
    ],
)
def test_status_precedence(spark, change, want):
    s = {"parcel": True, "zoning": True, "low": False, "ambiguous": False, "flags": [], "hazard": False, "path": "likely_eligible", "orientation": False, **change}
    flags = F.array(*[F.lit(f) for f in s["flags"]]).cast("array<string>")
    col = rules.feasibility_status(
        F.lit(True), F.lit(s["parcel"]), F.lit(s["zoning"]), F.lit(s["low"]), F.lit(s["ambiguous"]), flags, F.lit(s["hazard"]), F.lit(s["path"]), F.lit(s["orientation"])
    )
    assert one(spark, col) == want


@pytest.mark.parametrize("zone,want", [(z, "info") for z in ("X", "D", "AREA OF MINIMAL FLOOD HAZARD", "X (unshaded)", "")] + [(z, "warning") for z in C.SFHA_ZONES])
def test_flood(spark, zone, want):
    assert one(spark, V.flood_severity(F.create_map(F.lit("FLD_ZONE"), F.lit(zone)), F.lit(None).cast("string"))) == want


@pytest.mark.parametrize("cls,want", [("Very High", "critical"), ("High", "warning"), ("Moderate", "info"), (None, "warning"), ("odd", "warning")])
def test_fire(spark, cls, want):
    assert one(spark, V.fire_severity(F.create_map(F.lit("HAZ_CLASS"), F.lit(cls).cast("string")), F.lit(None).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("1234 South  Main street, ", "1234 S MAIN ST"), ("9 NE. Oak Boulevard", "9 NE OAK BLVD"), (None, ""), (" ., ", "")])
def test_address(spark, raw, want):
    assert one(spark, T.normalize_address(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "raw,num,boolean",
    [("12", 12.0, None), ('"1,200 sq ft"', 1200.0, None), ('"5-10"', None, None), ("true", None, True), ('"Not required"', None, False), ("1", 1.0, True), ("2", 2.0, None), ("null", None, None), ('{"a": 1}', None, None)],
)
def test_lenient(spark, raw, num, boolean):
    v = V.parse_value(F.lit(raw))
    assert (one(spark, V.lenient_number(v)), one(spark, V.lenient_bool(v))) == (num, boolean)


def test_single_family_prefix_order(spark):
    # RAS.. starts with RA, so it is single-family before the multi-family prefix is tried
    got = {z: one(spark, V.is_single_family(F.lit(z))) for z in ("R1-1", "ras4", "R3", "C2", "PF", "", "M1", "RW1")}
    assert got == {"R1-1": True, "ras4": True, "R3": False, "C2": False, "PF": None, "": None, "M1": False, "RW1": True}


def test_numbering(spark):
    n = one(spark, T.numbering(F.lit("Sec. 12.22 A.33 Accessory Dwelling Units"), F.lit("")))
    assert tuple(n) == ("12", "12.22", "12.22")
    assert one(spark, T.section_label(T.numbering(F.lit("Sec. 12.22 A.33 Accessory Dwelling Units"), F.lit("")), F.lit("x"))) == "12 / 12.22 / 12.22"
    assert tuple(one(spark, T.numbering(F.lit(None).cast("string"), F.lit(None).cast("string")))) == (None, None, None)


def test_numbering_beyond_an_empty_heading_and_a_long_start(spark):
    n = one(spark, T.numbering(F.lit(""), F.lit("Sec. 12.22 A")))
    assert tuple(n) == ("12", "12.22", "12.22")
    far = F.lit("x " * 300 + "Sec. 9.5 B")
    assert one(spark, T.numbering(F.lit(None).cast("string"), far))["section_number"] == "9.5"
    assert one(spark, T.numbering(F.lit(None).cast("string"), far, 400))["section_number"] is None


def test_feature_key_does_not_depend_on_member_order(spark):
    from parcelspark.sources import features as S

    a, b = '{"type": "Point", "coordinates": [1.5, 2]}', '{"coordinates":[1.5,2],"type":"Point"}'
    key = lambda g: one(spark, S.feature_key(S.canonical_geometry(F.lit(g)), F.lit("x")))
    assert key(a) == key(b) != key(a.replace("1.5", "1.6"))


def test_search_phrases():
    from parcelspark import catalogs as C

    assert C.SEARCH_PHRASES == ["accessory dwelling unit", "junior accessory dwelling unit", "ADU", "JADU"]


def test_hash_ignores_white_space(spark):
    assert one(spark, T.content_hash(F.lit("a b"))) == one(spark, T.content_hash(F.lit(" a  \n b\n")))


def test_main_content(spark):
    page = "<body><nav>n</nav><main><p>" + "x" * 60 + "</p></main></body>"
    assert one(spark, T.main_content(F.lit(page))) == "x" * 60
    assert one(spark, T.main_content(F.lit("<body>short</body>"))) is None


CASES = [
    ("max_height_detached_standard_ft", 16, 12, MORE, "more_restrictive_than_state_baseline", "warning"), ("max_height_detached_standard_ft", 16, 18, MATCH, None, "info"),
    ("side_rear_setback_min_ft", 4, 5, MORE, "more_restrictive_than_state_baseline", "warning"), ("side_rear_setback_min_ft", 4, 4, MATCH, None, "info"),
    ("owner_occupancy_required_adu", False, True, MORE, "more_restrictive_than_state_baseline", "warning"), ("jadu_separate_sale_allowed", False, True, REVIEW, "over_permissive_anomaly", "critical"),
    ("parking_required", False, True, REVIEW, "conditional_needs_facts", "warning"), ("adu_condo_sale_allowed", None, True, NA, None, "info"),
    ("permit_review_days", None, 30, REVIEW, "no_state_baseline", "info"), ("permit_review_days", 60, None, REVIEW, "value_missing", "info"), ("permit_review_days", 60, "soon", REVIEW, "value_not_numeric", "info"),
]


def test_verdicts(spark):
    for field, base, seen, flag, issue, severity in CASES:
        a = spark.range(1).select(F.lit(1).alias("rule_id"), F.lit(field).alias("field_name"), val(seen).alias("value"))
        b = C.state_baselines(spark).where(F.col("field_name") == field).withColumn("num", F.lit(float(base) if isinstance(base, int) and not isinstance(base, bool) else None).cast("double")).withColumn(
            "bool", F.lit(base if isinstance(base, bool) else None).cast("boolean")
        ).withColumn("json", F.lit(None).cast("string"))
        b = b.where(F.lit(base is not None))
        r = W.validate_rules(a, C.field_catalog(spark), b).first()
        assert (r["flag"], r["issue_type"], r["severity"]) == (flag, issue, severity), field


def test_roll_up(spark):
    rows = [(1, MATCH), (1, MORE), (2, MATCH), (2, REVIEW), (3, MATCH), (3, NA)]
    got = dict(W.roll_up(spark.createDataFrame(rows, "rule_id int, flag string")).collect())
    assert got == {1: MORE, 2: REVIEW, 3: MATCH}
