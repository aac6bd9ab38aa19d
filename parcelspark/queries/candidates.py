"""Rule joins, offline validation and rule candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators import candidates as K
from parcelspark.operators import reports, rules
from parcelspark.operators import validation as W
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query


@query("j06_current_rule", with_tables("SELECT zone_id, rule_id FROM zn JOIN cr ON zn.jurisdiction_id = cr.jurisdiction_id AND upper(zn.zone_code) = upper(cr.zone_code)"))
def current_rule(spark: SparkSession, sf: str) -> DataFrame:
    r = rules.current_rules(D.zoning_rules(spark, sf)).select("jurisdiction_id", "zone_key", "rule_id")
    z = D.zones(spark, sf).select("zone_id", "jurisdiction_id", F.upper("zone_code").alias("zone_key"))
    return z.join(r, ["jurisdiction_id", "zone_key"]).select("zone_id", "rule_id")


@query("j07_rule_attributes", with_tables("SELECT rule_id, field_name, num, bool, atr.operator FROM atr JOIN rl USING (rule_id)"))
def rule_attributes(spark: SparkSession, sf: str) -> DataFrame:
    a = rules.resolved_attributes(D.rule_attributes(spark, sf))
    return D.zoning_rules(spark, sf).select("rule_id").join(a, "rule_id").select("rule_id", "field_name", F.col("value.num").alias("num"), F.col("value.bool").alias("bool"), "operator")


@query("j08_baselines_in_force", with_tables("SELECT request_id, count(*) AS baselines, string_agg(field_name, ',' ORDER BY field_name) AS fields FROM rq JOIN bl ON len(applies_to) = 0 OR list_contains(applies_to, project_type) GROUP BY 1"))
def baselines_in_force(spark: SparkSession, sf: str) -> DataFrame:
    b = rules.baselines_by_project(C.state_baselines(spark), F.lit(D.AS_OF).cast("timestamp"))
    # at most one baseline per field: folded per project type before meeting the requests
    per = b.groupBy("project_type").agg(F.count("*").alias("baselines"), F.array_join(F.array_sort(F.collect_set("field_name")), ",").alias("fields"))
    return D.requests(spark, sf).select("request_id", "project_type").join(per, "project_type").drop("project_type")


_N = "CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(n AS VARCHAR) END"
_VER = f"""SELECT atr.rule_id, atr.field_name, ct.kind, ct.law, ct.restrictive, atr.num, atr.bool, bl.num AS bn, bl.bool AS bb, bl.json, bl.citation, bl.field_name IS NOT NULL AS has, atr.l_linenumber,
    CASE WHEN ct.kind = 'informational' THEN 'not_applicable' WHEN bl.field_name IS NULL THEN 'needs_review'
      WHEN ct.kind = 'floor' THEN CASE WHEN atr.num >= bl.num THEN '{C.MATCHES}' ELSE '{C.RESTRICTIVE}' END WHEN ct.kind = 'ceiling' THEN CASE WHEN atr.num <= bl.num THEN '{C.MATCHES}' ELSE '{C.RESTRICTIVE}' END
      WHEN ct.kind = 'must_equal' THEN CASE WHEN atr.bool = bl.bool THEN '{C.MATCHES}' WHEN atr.bool = ct.restrictive THEN '{C.RESTRICTIVE}' ELSE 'needs_review' END
      ELSE CASE WHEN coalesce(atr.bool = bl.bool, false) THEN '{C.MATCHES}' ELSE 'needs_review' END END AS flag
    FROM atr JOIN ct USING (field_name) LEFT JOIN bl ON bl.field_name = atr.field_name"""
_VER2 = """SELECT *, CASE WHEN flag = 'matches_state_baseline' OR kind = 'informational' THEN NULL WHEN NOT has THEN 'no_state_baseline' WHEN flag = 'possibly_more_restrictive_than_state_baseline' THEN 'more_restrictive_than_state_baseline'
    WHEN kind = 'must_equal' THEN 'over_permissive_anomaly' ELSE 'conditional_needs_facts' END AS issue_type,
    CASE WHEN flag = 'matches_state_baseline' OR kind = 'informational' OR NOT has THEN 'info' WHEN kind = 'must_equal' AND flag = 'needs_review' THEN 'critical' ELSE 'warning' END AS severity FROM ver0"""
_VERS = {"ver0": _VER, "ver": _VER2}


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return W.validate_rules(W.stored_values(D.rule_attributes(spark, sf)), C.field_catalog(spark), C.state_baselines(spark))


@query("r08_stored_json", with_tables("SELECT rule_id, field_name, flag, issue_type, severity FROM ver", ver0=_VER.replace("FROM atr JOIN", "FROM (SELECT * REPLACE (CASE WHEN rule_id % 2 = 0 THEN 2 * num ELSE num END AS num) FROM atr) atr JOIN"), ver=_VER2))
def stored_json(spark: SparkSession, sf: str) -> DataFrame:
    """Stored text such as "24.0 sq ft" decides, whatever number stands in the mirror beside it."""
    twice = F.concat(F.lit('"'), (F.col("value_numeric") * 2).cast("string"), F.lit(' sq ft"'))
    a = D.rule_attributes(spark, sf).withColumn("value_json", F.when((F.col("rule_id") % 2 == 0) & F.col("value_numeric").isNotNull(), twice).otherwise(F.col("value_json")))
    return W.validate_rules(W.stored_values(a), C.field_catalog(spark), C.state_baselines(spark)).select("rule_id", "field_name", "flag", "issue_type", "severity")


@query("r08_verdicts", with_tables("SELECT rule_id, field_name, flag, issue_type, severity FROM ver", **_VERS))
def verdict_rows(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("rule_id", "field_name", "flag", "issue_type", "severity")


@query("r09_rule_flag", with_tables("""SELECT rule_id, CASE min(CASE flag WHEN 'possibly_more_restrictive_than_state_baseline' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'matches_state_baseline' THEN 2 ELSE 3 END)
    WHEN 0 THEN 'possibly_more_restrictive_than_state_baseline' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'matches_state_baseline' ELSE 'not_applicable' END AS compliance_flag FROM ver GROUP BY 1""", **_VERS))
def rule_flag(spark: SparkSession, sf: str) -> DataFrame:
    return W.roll_up(verdicts(spark, sf))


@query("r10_open_issues", with_tables(f"""SELECT rule_id, field_name, issue_type, severity, CASE WHEN kind IN ('floor', 'ceiling') THEN CAST(num AS VARCHAR) || CASE WHEN kind = 'floor' THEN ' is below the state floor of ' ELSE ' exceeds the state ceiling of ' END || CAST(bn AS VARCHAR)
      || ' (' || citation || '); local rule is more restrictive than the state baseline'
    WHEN issue_type = 'more_restrictive_than_state_baseline' THEN 'state requires ' || upper(left(CAST(bb AS VARCHAR), 1)) || substr(CAST(bb AS VARCHAR), 2) || ' (' || citation || '); local value ' || upper(left(CAST(bool AS VARCHAR), 1)) || substr(CAST(bool AS VARCHAR), 2) || ' is more restrictive than state law allows'
    WHEN issue_type = 'over_permissive_anomaly' THEN 'state contemplates ' || upper(left(CAST(bb AS VARCHAR), 1)) || substr(CAST(bb AS VARCHAR), 2) || ' (' || citation || '); local value ' || upper(left(CAST(bool AS VARCHAR), 1)) || substr(CAST(bool AS VARCHAR), 2) || ' is more permissive than state law and needs review'
    ELSE 'value ' || upper(left(CAST(bool AS VARCHAR), 1)) || substr(CAST(bool AS VARCHAR), 2) || ' is lawful only under specific conditions (' || citation || '); needs review to confirm those conditions apply' END
    || ' | State law: ' || citation || ' | Baseline source: {C.BASELINE_URL} | Local source: urn:code:' || rule_id AS description
    FROM ver WHERE issue_type IS NOT NULL AND NOT (rule_id % 5 = 0 AND kind = 'floor')""", **_VERS))
def open_issues(spark: SparkSession, sf: str) -> DataFrame:
    v = verdicts(spark, sf)
    existing = v.where("rule_id % 5 = 0 AND kind = 'floor' AND issue_type IS NOT NULL").select("rule_id", "field_name", "issue_type", F.lit("open").alias("status"))
    return W.open_issues(v, existing).select("rule_id", "field_name", "issue_type", "severity", "description")


@query("r13_baseline_drift", with_tables("""SELECT d.field_name, operator_drift, value_drift, scope_drift, count(atr.rule_id) AS attributes FROM (
    SELECT coalesce(ct.field_name, bl.field_name) AS field_name,
      CASE ct.kind WHEN 'floor' THEN 'min' WHEN 'ceiling' THEN 'max' WHEN 'conditional' THEN 'eq' WHEN 'must_equal' THEN 'must_equal' END IS DISTINCT FROM CASE WHEN bl.operator IN ('floor', 'gte') THEN 'min' WHEN bl.operator IN ('ceiling', 'lte') THEN 'max' ELSE bl.operator END AS operator_drift,
      ct.num IS DISTINCT FROM bl.num OR ct.bool IS DISTINCT FROM bl.bool AS value_drift, list_sort(ct.project_types) IS DISTINCT FROM list_sort(bl.applies_to) AS scope_drift FROM ct FULL JOIN bl USING (field_name)) d
    LEFT JOIN atr ON atr.field_name = d.field_name WHERE operator_drift OR value_drift OR scope_drift GROUP BY 1, 2, 3, 4"""))
def baseline_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Drift between the two catalogs, with the number of stored attributes it touches."""
    d = W.baseline_drift(C.field_catalog(spark), C.state_baselines(spark)).select("field_name", "operator_drift", "value_drift", "scope_drift")
    n = D.rule_attributes(spark, sf).groupBy("field_name").agg(F.count("*").alias("attributes"))
    return d.join(n, "field_name", "left").withColumn("attributes", F.coalesce("attributes", F.lit(0).cast("long")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction documents: one zone per rule, with every catalog field and its value or null."""
    a = D.rule_attributes(spark, sf).select("rule_id", "field_name", "value_json", "source_section")
    every = D.zoning_rules(spark, sf).select("rule_id", "jurisdiction_id", "zone_code", F.explode(F.array(*[F.lit(f) for f in C.FIELD_NAMES])).alias("field_name"))
    conf = F.when(F.col("source_section") == "Sec. 1", "low").when(F.col("source_section") == "Sec. 2", "high").otherwise("medium")
    obj = F.concat(F.lit('"'), "field_name", F.lit('":{"value":'), F.coalesce("value_json", F.lit("null")), F.lit(',"confidence":"'), F.coalesce(conf, F.lit("low")), F.lit('","evidence":"'), F.coalesce("source_section", F.lit("")), F.lit('"}'))
    j = every.join(a, ["rule_id", "field_name"], "left")
    # exactly one entry per catalog field, so the folded text is bounded
    z = j.groupBy("rule_id", "jurisdiction_id", "zone_code").agg(F.array_join(F.array_sort(F.collect_list(obj)), ",").alias("fields"))
    doc = F.concat(F.lit('{"zones":[{"zone_district":" '), "zone_code", F.lit(' ","fields":{'), "fields", F.lit("}}]}"))
    return z.select(F.col("rule_id").alias("section_id"), "jurisdiction_id", F.array(*[F.lit(p) for p in C.PROJECT_TYPES[:5]]).alias("supported"), doc.alias("payload"))


_CAND = f"""SELECT rl.jurisdiction_id, rule_id AS section_id, rl.zone_code, pt AS project_type, field_name, num, CASE WHEN l_linenumber = 1 THEN 'low' WHEN l_linenumber = 2 THEN 'high' ELSE 'medium' END AS confidence
    FROM atr JOIN rl USING (rule_id) JOIN (SELECT field_name, unnest(project_types) AS pt FROM ct) c USING (field_name) WHERE pt <> 'sb9_urban_lot_split'"""


@query("r14_map_candidates", with_tables("""SELECT section_id, zone_code, project_type, field_name, CASE WHEN section_id % 4 <> 2 THEN num END AS value_numeric, confidence, CASE WHEN bool_or(confidence = 'low') OVER (PARTITION BY section_id, project_type) THEN 'low' ELSE 'medium' END AS rule_confidence FROM cand""", cand=_CAND))
def map_candidates(spark: SparkSession, sf: str) -> DataFrame:
    # a number in quotes is text, so it has no numeric mirror
    quoted = F.when(F.col("section_id") % 4 == 2, F.regexp_replace("payload", '"value":([0-9.]+)', '"value":"$1"')).otherwise(F.col("payload"))
    return K.map_candidates(documents(spark, sf).withColumn("payload", quoted), C.field_catalog(spark)).select("section_id", "zone_code", "project_type", "field_name", "value_numeric", "confidence", "rule_confidence")


@query("r15_payload_check", with_tables("""SELECT rule_id AS section_id, CASE rule_id % 6 WHEN 1 THEN 'bad_document' WHEN 2 THEN 'bad_zone' WHEN 3 THEN 'bad_field_names' WHEN 4 THEN 'bad_field_value' WHEN 5 THEN 'bad_field_value' END AS problem FROM rl"""))
def payload_check(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    s, p = F.col("section_id") % 6, F.col("payload")
    broken = (
        F.when(s == 1, F.replace(p, F.lit('{"zones"'), F.lit('{"areas"'))).when(s == 2, F.replace(p, F.lit("zone_district"), F.lit("district")))
        .when(s == 3, F.replace(p, F.lit('"jadu_allowed"'), F.lit('"jadu_permitted"'))).when(s == 4, F.regexp_replace(p, '"jadu_allowed":\\{"value":[a-z]+', '"jadu_allowed":{"value":7'))
        .when(s == 5, F.regexp_replace(p, '("permit_review_days":\\{"value":[^,]+,"confidence":)"[a-z]+"', '$1"sure"')).otherwise(p)
    )
    return K.check_payloads(d.withColumn("payload", broken)).select("section_id", "problem")


@query("r16_version_candidates", with_tables("""SELECT c.section_id, c.zone_code, c.project_type, CASE WHEN r.version IS NULL THEN 'insert' WHEN r.review_status = 'pending' THEN 'refresh' ELSE 'new_version' END AS action,
    CAST(CASE WHEN r.version IS NULL THEN 1 WHEN r.review_status = 'pending' THEN r.version ELSE r.version + 1 END AS BIGINT) AS new_version, false AS is_current
    FROM (SELECT DISTINCT jurisdiction_id, section_id, zone_code, project_type FROM cand) c LEFT JOIN (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY jurisdiction_id, zone_code, project_type ORDER BY version DESC, rule_id DESC) = 1) r
    ON r.jurisdiction_id = c.jurisdiction_id AND r.zone_code = c.zone_code AND r.project_type = c.project_type""", cand=_CAND))
def version_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = K.map_candidates(documents(spark, sf), C.field_catalog(spark)).select("jurisdiction_id", "section_id", "zone_code", "project_type").distinct()
    return K.version_candidates(c, D.zoning_rules(spark, sf)).select("section_id", "zone_code", "project_type", "action", F.col("new_version").cast("long").alias("new_version"), "is_current")


@query("a10_validation_counters", with_tables("""SELECT jurisdiction_id, count(*) AS rules, coalesce(sum(a), 0) + count(*) FILTER (WHERE rule_id % 3 = 0) AS attributes, coalesce(sum(i), 0) AS issues, coalesce(sum(m), 0) AS more_restrictive
    FROM rl LEFT JOIN (SELECT rule_id, count(*) AS a, count(issue_type) AS i, count(*) FILTER (WHERE flag = 'possibly_more_restrictive_than_state_baseline') AS m FROM ver WHERE rule_id % 4 <> 1 GROUP BY 1) c USING (rule_id) WHERE review_status = 'pending' GROUP BY 1""", **_VERS))
def validation_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Some rules have no attributes, some have one of a field that the catalog lacks."""
    rules_ = D.zoning_rules(spark, sf)
    a = W.stored_values(D.rule_attributes(spark, sf)).where("rule_id % 4 <> 1")
    unknown = rules_.where("rule_id % 3 = 0").select("rule_id", F.lit("unlisted").alias("field_name"))
    every = a.unionByName(unknown, allowMissingColumns=True)
    return W.counters(rules_, every, W.validate_rules(every, C.field_catalog(spark), C.state_baselines(spark)))


@query("a07_wide_rules", with_tables("SELECT rule_id, " + ", ".join(
    f"max(CASE WHEN field_name = '{n}' THEN coalesce(CAST(num AS VARCHAR), CAST(bool AS VARCHAR)) END) AS {n}" for n in C.FIELD_NAMES) + " FROM atr GROUP BY 1"))
def wide_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reports.wide_rules(D.rule_attributes(spark, sf))
