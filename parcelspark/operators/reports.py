"""Reader-facing reports and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import values as V
from parcelspark.operators.rules import resolved_attributes

STALE_DAYS = 90
MAX_ENTRIES = 200


def jurisdictions_report(j: DataFrame) -> DataFrame:
    """Jurisdictions with production first, then ingesting, then by name."""
    return j.orderBy((F.col("coverage_status") == "production").desc(), (F.col("coverage_status") == "ingesting").desc(), "name")


def changelog(entries: DataFrame, jurisdictions: DataFrame, slug: str | None = None, limit: int = 50) -> DataFrame:
    """Newest entries, at most ``limit`` (1 to 200); entries without a jurisdiction are kept
    unless one is asked for."""
    if not 1 <= limit <= MAX_ENTRIES:
        raise ValueError(f"limit must be 1 to {MAX_ENTRIES}")
    j = jurisdictions.select("jurisdiction_id", "slug")
    rows = entries.join(j, "jurisdiction_id", "left")
    if slug is not None:
        rows = rows.where(F.col("slug") == slug)
    top = rows.orderBy(F.col("published_at").desc(), "entry_id").limit(limit)
    return top.select(
        "entry_id", F.coalesce("slug", F.lit("unknown")).alias("jurisdiction_slug"), V.changelog_type(F.col("entry_type")).alias("change_type"),
        F.coalesce("summary", "title", F.lit("")).alias("summary"), F.col("published_at").alias("occurred_at"),
    )


def jurisdiction_rules(rules: DataFrame, attrs: DataFrame, jurisdictions: DataFrame, zone: str | None = None, project_type: str | None = None) -> DataFrame:
    """Current rules with their attributes (ordered by field, unique per rule) in one join."""
    r = rules.where("is_current")
    if zone is not None:
        r = r.where(F.upper("zone_code") == zone.upper())
    if project_type is not None:
        r = r.where(F.col("project_type") == project_type)
    a = resolved_attributes(attrs)
    item = F.struct("field_name", "value", "unit", "source")
    lists = a.groupBy("rule_id").agg(F.array_sort(F.collect_list(item), lambda x, y: F.when(x["field_name"] < y["field_name"], -1).when(x["field_name"] > y["field_name"], 1).otherwise(0)).alias("attributes"))
    j = jurisdictions.select("jurisdiction_id", "slug", "name", "coverage_status")
    return r.join(lists, "rule_id", "left").join(j, "jurisdiction_id").withColumn("citations", F.transform("attributes", lambda x: x["source"]))


def source_freshness(sources: DataFrame, as_of: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """Status of every active source."""
    age = F.when(F.col("last_retrieved_at").isNull(), "unavailable").when(
        F.col("last_retrieved_at") < as_of - F.make_dt_interval(F.lit(stale_days)), "stale"
    ).otherwise("current")
    return sources.where("active").select(F.coalesce("layer_name", "name").alias("key"), "name", age.alias("data_status"), F.col("last_retrieved_at").alias("last_refreshed_at"))


def overall_health(freshness: DataFrame) -> DataFrame:
    """``degraded`` when any source is unavailable."""
    bad = F.coalesce(F.bool_or(F.col("data_status") == "unavailable"), F.lit(False))
    return freshness.agg(F.when(bad, "degraded").otherwise("ok").alias("status"), F.count("*").alias("sources"))


def flag_summary(rules: DataFrame, known: list[str] = C.FLAGS, flag: str = "compliance_flag") -> DataFrame:
    """Rules per flag; known flags without rules count zero."""
    seen = rules.groupBy(flag).agg(F.count("*").alias("n"))
    spark = rules.sparkSession
    zero = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias(flag), F.lit(0).cast("long").alias("n"))
    return seen.unionByName(zero).groupBy(flag).agg(F.sum("n").alias("n"))


def rules_with_city(rules: DataFrame, jurisdictions: DataFrame, slug: str | None = None, zone: str | None = None) -> DataFrame:
    """Rules joined to their city, filtered by slug and by zone in any case, ordered by zone."""
    j = rules.join(jurisdictions.select("jurisdiction_id", "slug", "name"), "jurisdiction_id")
    if slug is not None:
        j = j.where(F.col("slug") == slug)
    if zone is not None:
        j = j.where(F.col("zone_code").ilike(zone))
    return j.orderBy("zone_code")


def wide_rules(attrs: DataFrame, fields: list[str] = C.FIELD_NAMES) -> DataFrame:
    """One row per rule with a column per known field, values as JSON text."""
    a = resolved_attributes(attrs).select("rule_id", "field_name", V.value_text(F.col("value")).alias("v"))
    return a.groupBy("rule_id").pivot("field_name", fields).agg(F.first("v"))


def lookup_analyses(analyses: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored analyses by (analysis_id, token or consumer_id), with ``access``: ``ok`` for a
    matching share token or the owner, ``forbidden`` for another consumer, else ``not_found``."""
    a = analyses.select("analysis_id", F.col("share_token").alias("_t"), F.coalesce("consumer_id", F.lit("")).alias("_c"), "result_json")
    j = keys.join(a, "analysis_id", "left")
    access = (
        F.when(F.col("_c").isNull(), "not_found")
        .when(F.col("token").isNotNull(), F.when(F.coalesce(F.col("_t") == F.col("token"), F.lit(False)), "ok").otherwise("not_found"))
        .when(F.col("_c") != F.coalesce("consumer_id", F.lit("")), "forbidden").otherwise("ok")
    )
    access = F.when((access == "ok") & F.col("result_json").isNull(), "not_found").otherwise(access)
    return j.withColumn("access", access).withColumn("result_json", F.when(F.col("access") == "ok", F.col("result_json"))).drop("_t", "_c")


def run_counters(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Processed, inserted, updated, unchanged and failed rows per run from an ``outcome`` column."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.groupBy(*keys).agg(F.count("*").alias("processed"), n("inserted"), n("updated"), n("unchanged"), n("failed"))


def run_status(results: DataFrame, keys: list[str]) -> DataFrame:
    """Status of a run from its parts: failed, then partial, then cancelled if all were skipped."""
    s = F.col("status")
    return results.groupBy(*keys).agg(
        F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "partial"), "partial").when(F.bool_and(s == "skipped"), "cancelled").otherwise("success").alias("status")
    )


def section_run_status(counters: DataFrame) -> DataFrame:
    """Status of a section run: success once any section was stored or found unchanged, failed
    when none was discovered, partial when all that were discovered failed."""
    stored = F.col("inserted") + F.col("updated") + F.col("unchanged") > 0
    status = F.when(stored, "success").when(F.col("processed") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("success")
    return counters.withColumn("status", status)


def layer_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("layer").agg(F.count("*").alias("inserted"))
