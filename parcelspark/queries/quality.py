"""Constraint checks over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators import quality as Q
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query


@query("q01_violations", with_tables("""SELECT * FROM (SELECT rule_id, unnest(['review_status', 'compliance_flag', 'confidence']) AS "constraint", unnest([CASE WHEN rule_id % 3 = 0 THEN 'odd' END, CASE WHEN rule_id % 4 = 0 THEN 'unknown' END, CASE WHEN rule_id % 5 = 0 THEN 'sure' END]) AS value FROM rl) WHERE value IS NOT NULL"""))
def violations(spark: SparkSession, sf: str) -> DataFrame:
    r = D.zoning_rules(spark, sf)
    i = F.col("rule_id")
    r = r.withColumn("review_status", F.when(i % 3 == 0, "odd").otherwise(F.col("review_status"))).withColumn(
        "compliance_flag", F.when(i % 4 == 0, "unknown").otherwise(F.col("compliance_flag"))
    ).withColumn("confidence", F.when(i % 5 == 0, "sure").otherwise("high")).withColumn("data_status", F.lit("current"))
    return Q.violations(r, "zoning_rules", ["rule_id"])


@query("q02_duplicates", "SELECT source, text_hash, count(*) AS rows FROM (SELECT source, sha256(text) AS text_hash FROM documents) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("text_hash"))
    return Q.duplicates(d, ["source", "text_hash"])


@query("q03_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    parent = D.table(spark, sf, "customer").where("c_acctbal >= 0")
    return Q.orphans(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey", "c_custkey")


@query("s27_request_validation", with_tables("""SELECT request_id, concat_ws(',', CASE WHEN c_acctbal < -500 THEN 'address_too_short' END, CASE WHEN request_id % 7 = 0 THEN 'unknown_project_type' END,
    CASE WHEN c_acctbal < 0 THEN 'negative_target_sqft' END, CASE WHEN request_id % 11 = 0 THEN 'negative_bedrooms' END, CASE WHEN request_id % 4 = 0 THEN 'unknown_field' END) AS reasons FROM rq"""))
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("request_id")
    r = D.requests(spark, sf).withColumn("address", F.when(F.col("c_acctbal") < -500, "1 A").otherwise(F.col("address"))).withColumn(
        "project_type", F.when(i % 7 == 0, "tower").otherwise(F.col("project_type"))
    ).withColumn("target_sqft", F.col("c_acctbal")).withColumn("bedrooms", F.when(i % 11 == 0, -1).otherwise(F.col("bedrooms"))).withColumn(
        "sent", F.when(i % 4 == 0, F.array(F.lit("address"), F.lit("zip"))).otherwise(F.array(F.lit("address"), F.lit("options")))
    )
    return Q.validate_requests(r, "sent").select("request_id", F.array_join("reasons", ",").alias("reasons"))
