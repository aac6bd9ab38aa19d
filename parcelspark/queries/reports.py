"""Reports, run bookkeeping and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators import reports as R
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query


@query("a03_flag_summary", with_tables("SELECT f.flag AS compliance_flag, count(rl.rule_id) AS n FROM (SELECT unnest(['matches_state_baseline', 'possibly_more_restrictive_than_state_baseline', 'needs_review', 'not_applicable', 'retired']) AS flag) f LEFT JOIN rl ON rl.compliance_flag = f.flag GROUP BY 1"))
def flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.flag_summary(D.zoning_rules(spark, sf), [*C.FLAGS, "retired"])


@query("a04_loaded_overlay_types", with_tables("SELECT DISTINCT overlay_type FROM ov"))
def loaded_overlay_types(spark: SparkSession, sf: str) -> DataFrame:
    return D.overlays(spark, sf).select("overlay_type").distinct()


_RUN = """SELECT o_custkey % 10 AS run_id, CASE o_orderstatus WHEN 'F' THEN 'inserted' WHEN 'O' THEN 'updated' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'unchanged' END END AS outcome FROM orders"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = F.when(s == "F", "inserted").when(s == "O", "updated").when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("unchanged")
    return D.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("run_id"), o.alias("outcome"))


@query("a08_run_counters", with_tables("SELECT run_id, count(*) AS processed, count(*) FILTER (WHERE outcome = 'inserted') AS inserted, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM run GROUP BY 1", run=_RUN))
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_counters(outcomes(spark, sf), ["run_id"])


@query("a09_run_status", """SELECT s_nationkey AS run_id, CASE WHEN bool_or(s_acctbal < -500) THEN 'failed' WHEN bool_or(s_acctbal < 500) THEN 'partial' WHEN bool_and(s_acctbal > 5000) THEN 'cancelled' ELSE 'success' END AS status FROM supplier GROUP BY 1""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("s_acctbal")
    s = F.when(b < -500, "failed").when(b < 500, "partial").when(b > 5000, "skipped").otherwise("success")
    return R.run_status(D.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run_id"), s.alias("status")), ["run_id"])


@query("a09_section_run_status", with_tables("""SELECT run_id, CASE WHEN count(*) FILTER (WHERE outcome <> 'failed') > 0 THEN 'success' WHEN count(*) = 0 THEN 'failed' ELSE 'partial' END AS status FROM run GROUP BY 1""", run=_RUN))
def section_run_status(spark: SparkSession, sf: str) -> DataFrame:
    return R.section_run_status(R.run_counters(outcomes(spark, sf), ["run_id"])).select("run_id", "status")


@query("a11_source_freshness", with_tables(f"""SELECT coalesce(layer_name, name) AS key, CASE WHEN last_retrieved_at IS NULL THEN 'unavailable' WHEN last_retrieved_at < TIMESTAMP '{D.AS_OF}' - INTERVAL 90 DAY THEN 'stale' ELSE 'current' END AS data_status FROM sr WHERE active"""))
def source_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return R.source_freshness(D.source_registry(spark, sf), F.lit(D.AS_OF).cast("timestamp")).select("key", "data_status")


@query("a11_overall_health", with_tables("SELECT CASE WHEN bool_or(last_retrieved_at IS NULL) THEN 'degraded' ELSE 'ok' END AS status, count(*) AS sources FROM sr WHERE active"))
def overall_health(spark: SparkSession, sf: str) -> DataFrame:
    return R.overall_health(R.source_freshness(D.source_registry(spark, sf), F.lit(D.AS_OF).cast("timestamp")))


@query("a12_jurisdiction_rules", with_tables("""SELECT rl.rule_id, jr.slug, count(atr.field_name) AS attributes, coalesce(string_agg(atr.field_name, ',' ORDER BY atr.field_name), '') AS fields, count(atr.field_name) AS citations
    FROM rl JOIN jr USING (jurisdiction_id) LEFT JOIN atr USING (rule_id) WHERE is_current GROUP BY 1, 2"""))
def jurisdiction_rules(spark: SparkSession, sf: str) -> DataFrame:
    r = R.jurisdiction_rules(D.zoning_rules(spark, sf), D.rule_attributes(spark, sf), D.jurisdictions(spark, sf))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    fields = F.array_join(F.transform("attributes", lambda a: a["field_name"]), ",")
    return r.select("rule_id", "slug", n("attributes").alias("attributes"), F.coalesce(fields, F.lit("")).alias("fields"), n("citations").alias("citations"))


@query("w04_jurisdiction_list", with_tables("SELECT slug, CAST(row_number() OVER (ORDER BY coverage_status = 'production' DESC, coverage_status = 'ingesting' DESC, name) AS BIGINT) AS place FROM jr"))
def jurisdiction_list(spark: SparkSession, sf: str) -> DataFrame:
    # jurisdictions are few; the sorted report is numbered to show its order
    from pyspark.sql import Window

    order = Window.orderBy((F.col("coverage_status") == "production").desc(), (F.col("coverage_status") == "ingesting").desc(), "name")
    return R.jurisdictions_report(D.jurisdictions(spark, sf).drop("geom")).select("slug", F.row_number().over(order).cast("long").alias("place"))


@query("j13_changelog", with_tables("""SELECT entry_id, coalesce(slug, 'unknown') AS jurisdiction_slug, CASE entry_type WHEN 'release' THEN 'source_ingested' WHEN 'coverage' THEN 'coverage_change' WHEN 'source_update' THEN 'source_refreshed' ELSE entry_type END AS change_type, coalesce(summary, title) AS summary
    FROM cl LEFT JOIN jr USING (jurisdiction_id) ORDER BY published_at DESC, entry_id LIMIT 200"""))
def changelog(spark: SparkSession, sf: str) -> DataFrame:
    return R.changelog(D.changelog_entries(spark, sf), D.jurisdictions(spark, sf), limit=200).drop("occurred_at")


@query("w05_newest_changelog", with_tables("""SELECT entry_id, slug AS jurisdiction_slug FROM cl JOIN jr USING (jurisdiction_id) WHERE slug = 'nation_3' ORDER BY published_at DESC, entry_id LIMIT 50"""))
def newest_changelog(spark: SparkSession, sf: str) -> DataFrame:
    return R.changelog(D.changelog_entries(spark, sf), D.jurisdictions(spark, sf), "nation_3").select("entry_id", "jurisdiction_slug")


@query("j14_rules_with_city", with_tables("SELECT rule_id, name, zone_code FROM rl JOIN jr USING (jurisdiction_id) WHERE slug = 'nation_3' AND zone_code ILIKE 'r%'"))
def rules_with_city(spark: SparkSession, sf: str) -> DataFrame:
    return R.rules_with_city(D.zoning_rules(spark, sf), D.jurisdictions(spark, sf), "nation_3", "r%").select("rule_id", "name", "zone_code")


_ANA = """SELECT o_orderkey AS analysis_id, CASE WHEN o_orderstatus = 'F' THEN 'tok' || o_orderkey END AS share_token, 'c' || o_custkey AS consumer_id, o_custkey, o_orderpriority FROM orders"""


def stored(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    return D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("tok"), k)).alias("share_token"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("consumer_id"), "o_custkey", F.col("o_orderpriority").alias("result_json"),
    )


@query("w06_lookup_analyses", with_tables("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a.analysis_id IS NULL THEN 'not_found' WHEN l_linenumber = 1 THEN CASE WHEN share_token = 'tok' || l_orderkey THEN 'ok' ELSE 'not_found' END
    WHEN l_linenumber % 2 = 0 THEN 'ok' ELSE 'forbidden' END AS access FROM lineitem LEFT JOIN ana a ON a.analysis_id = l_orderkey""", ana=_ANA))
def lookup_analyses(spark: SparkSession, sf: str) -> DataFrame:
    a = stored(spark, sf)
    li = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), "l_linenumber", "l_partkey")
    owner = a.select("analysis_id", F.col("consumer_id").alias("owner"))
    keys = li.join(owner, "analysis_id", "left").select(
        "analysis_id", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 1, F.concat(F.lit("tok"), F.col("analysis_id").cast("string"))).alias("token"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("owner")).otherwise("someone").alias("consumer_id"),
    )
    return R.lookup_analyses(a, keys).select(F.col("analysis_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "access")


@query("j12_analyses_with_slug", with_tables("SELECT o_orderkey AS analysis_id, slug FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN jr ON jr.jurisdiction_id = c_nationkey AND jr.coverage_status = 'production'"))
def analyses_with_slug(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("jurisdiction_id"))
    j = D.jurisdictions(spark, sf).where("coverage_status = 'production'").select("jurisdiction_id", "slug")
    return stored(spark, sf).join(c, "o_custkey").join(j, "jurisdiction_id", "left").select("analysis_id", "slug")
