"""Extracted zone documents to versioned rule candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import values as V
from parcelspark.operators.skew import latest_by

FIELD_T = "struct<value:string,confidence:string,evidence:string>"
ZONES_T = "struct<zones:array<struct<zone_district:string,fields:map<string,string>>>>"
RAW_ZONES_T = "struct<zones:array<map<string,string>>>"


def value_kind(field: Column) -> Column:
    """JSON type of the ``value`` member of a field's text; a number in quotes is a STRING."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(field), "$.value", "variant"))


def is_number(kind: Column) -> Column:
    return kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("DECIMAL")


def check_payloads(payloads: DataFrame) -> DataFrame:
    """Add ``problem``: why a document (``payload``) does not have the agreed shape, null if it
    does. Documents with a problem are rejected whole."""
    raw = F.from_json("payload", RAW_ZONES_T)
    keys = lambda m: F.array_sort(F.map_keys(m))
    zones = raw["zones"]
    top = F.json_object_keys("payload")
    names = F.array_sort(F.array(*[F.lit(n) for n in C.FIELD_NAMES]))
    numeric = F.array(*[F.lit(f[0]) for f in C.FIELD_CATALOG if f[1] == "numeric"])
    fields = F.transform(zones, lambda z: F.from_json(z["fields"], "map<string,string>"))
    bad_zone = F.exists(zones, lambda z: ~F.coalesce(keys(z) == F.array(F.lit("fields"), F.lit("zone_district")), F.lit(False)) | z["zone_district"].isNull())
    bad_fields = F.exists(fields, lambda f: ~F.coalesce(keys(f) == names, F.lit(False)))
    def bad_entry(k, v):
        m = F.from_json(v, "map<string,string>")
        value = F.coalesce(value_kind(v), F.lit("VOID"))
        right = F.when(F.array_contains(numeric, k), is_number(value)).otherwise(value == "BOOLEAN") | (value == "VOID")
        shape = F.coalesce(keys(m) == F.array(F.lit("confidence"), F.lit("evidence"), F.lit("value")), F.lit(False))
        return ~shape | ~F.coalesce(m["confidence"].isin(C.CONFIDENCE), F.lit(False)) | m["evidence"].isNull() | ~right

    bad_values = F.exists(fields, lambda f: F.size(F.map_filter(f, bad_entry)) > 0)
    problem = (
        F.when(top.isNull() | ~(top == F.array(F.lit("zones"))) | zones.isNull(), "bad_document")
        .when(bad_zone, "bad_zone").when(bad_fields, "bad_field_names").when(bad_values, "bad_field_value")
    )
    return payloads.withColumn("problem", problem)


def map_candidates(documents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidate attributes ``jurisdiction_id, section_id, zone_code, project_type, field_name,
    value, value_numeric, unit, operator, confidence, evidence, rule_confidence``.

    ``documents``: jurisdiction_id, section_id, supported (project types), payload. A project type
    appears only when the zone has at least one non-null field governing it.
    """
    d = documents.withColumn("z", F.explode(F.from_json("payload", ZONES_T)["zones"]))
    d = d.withColumn("zone_code", F.trim("z.zone_district")).where("zone_code <> ''")
    f = d.select("jurisdiction_id", "section_id", "supported", "zone_code", F.explode("z.fields").alias("field_name", "_f"))
    f = f.withColumns({"f": F.from_json("_f", FIELD_T), "_number": F.coalesce(is_number(value_kind(F.col("_f"))), F.lit(False))}).drop("_f").where("f.value IS NOT NULL")
    ops = F.coalesce(*[F.when(F.col("kind") == k, o) for k, o in C.KIND_OPERATOR.items()])
    cat = catalog.select("field_name", "dtype", "unit", ops.alias("operator"), F.explode("project_types").alias("project_type"))
    j = f.join(cat, "field_name").where(F.array_contains("supported", F.col("project_type")))
    known = F.col("f.confidence").isin(C.CONFIDENCE)
    rows = j.select(
        "jurisdiction_id", "section_id", "zone_code", "project_type", "field_name", F.col("f.value").alias("value"),
        F.when((F.col("dtype") == "numeric") & F.col("_number"), F.col("f.value").try_cast("double")).alias("value_numeric"), "unit", "operator",
        F.when(known, F.col("f.confidence")).otherwise("low").alias("confidence"), F.nullif(F.trim("f.evidence"), F.lit("")).alias("evidence"),
    )
    keys = ["jurisdiction_id", "section_id", "zone_code", "project_type"]
    # the lowest rank is an aggregate, not an array of all fields
    lowest = rows.groupBy(*keys).agg(V.confidence_name(F.least(F.min(V.confidence_rank(F.col("confidence"))), F.lit(1))).alias("rule_confidence"))
    return rows.join(lowest, keys)


def version_candidates(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """What happens to each candidate rule: ``insert`` as version 1, ``refresh`` a pending one in
    place, or ``new_version`` after a reviewed one. A candidate is never current."""
    keys = ["jurisdiction_id", "zone_code", "project_type"]
    last = latest_by(rules.select(*keys, "version", "review_status", F.col("rule_id").alias("latest_rule_id")), keys, ["version", "latest_rule_id"])
    j = candidates.join(last, keys, "left")
    pending = F.col("review_status") == "pending"
    return j.withColumn(
        "action", F.when(F.col("version").isNull(), "insert").when(pending, "refresh").otherwise("new_version")
    ).withColumn("new_version", F.when(F.col("version").isNull(), 1).when(pending, F.col("version")).otherwise(F.col("version") + 1)).withColumn(
        "is_current", F.lit(False)
    )
