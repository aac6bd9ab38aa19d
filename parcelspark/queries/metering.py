"""Metering over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators import metering as M
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query


def planned(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return M.resolve_plan(D.usage_events(spark, sf, events), C.plans(spark))


_DEC = """SELECT *, CASE WHEN status_code <> 200 THEN 'non_200_status:' || status_code WHEN cache_hit THEN 'cache_hit_within_dedupe_window'
    WHEN feasibility_status = 'insufficient_data' THEN 'non_billable_status:insufficient_data' ELSE 'completed_feasibility_analysis' END AS reason FROM evp"""
_BILL = {"dec": _DEC, "bill": "SELECT *, reason = 'completed_feasibility_analysis' AS billable FROM dec"}


def billed(spark: SparkSession, sf: str) -> DataFrame:
    d = M.decide_metering(F.col("status_code"), F.col("feasibility_status"), F.col("cache_hit"))
    return planned(spark, sf).withColumn("_d", d).select("*", "_d.*").drop("_d")


@query("m01_billing_decision", with_tables("SELECT event_id, billable, reason FROM bill", **_BILL))
def billing_decision(spark: SparkSession, sf: str) -> DataFrame:
    return billed(spark, sf).select("event_id", "billable", "reason")


@query("m02_monthly_quota", with_tables("""SELECT event_id, n <= quota AS allowed, CAST(least(n - 1, quota) AS BIGINT) AS used FROM (SELECT event_id, quota,
    row_number() OVER (PARTITION BY consumer_id, date_trunc('month', ts) ORDER BY ts, event_id) AS n FROM bill WHERE billable)""", **_BILL))
def monthly_quota(spark: SparkSession, sf: str) -> DataFrame:
    e = billed(spark, sf).withColumnRenamed("billable", "candidate")
    return M.monthly_quota(e).where("candidate").select("event_id", "allowed", F.col("used").cast("long").alias("used"))


# one day of traffic is compressed into one minute so that the limit is reached
_FAST = "SELECT * REPLACE (make_timestamp(CAST(floor(epoch_us(ts) / 1440.0) AS BIGINT)) AS ts) FROM evp"


def fast(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / 1440).cast("long")))


@query("m03_burst_limit", with_tables("""SELECT event_id, row_number() OVER (PARTITION BY consumer_id, epoch_us(ts) // 60000000 ORDER BY ts, event_id) <= least(rate, 3) AS allowed FROM fst""", fst=_FAST))
def burst_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = fast(planned(spark, sf)).withColumn("rate_limit", F.least("rate_limit", F.lit(3)))
    return M.burst_limit(e).select("event_id", "allowed")


@query("m04_dedupe_replay", with_tables("""SELECT event_id, NOT (event_id IN (SELECT e.event_id FROM chain JOIN ev e ON e.fingerprint = chain.fingerprint AND e.ts = chain.ts QUALIFY row_number() OVER (PARTITION BY e.fingerprint, e.ts ORDER BY e.event_id) = 1)) AS hit FROM ev""",
    recursive=True, chain="""SELECT fingerprint, min(ts) AS ts FROM ev GROUP BY 1 UNION ALL SELECT c.fingerprint, (SELECT min(ts) FROM ev WHERE ev.fingerprint = c.fingerprint AND ev.ts >= c.ts + INTERVAL 24 HOUR) AS ts
    FROM chain c WHERE (SELECT min(ts) FROM ev WHERE ev.fingerprint = c.fingerprint AND ev.ts >= c.ts + INTERVAL 24 HOUR) IS NOT NULL"""))
def dedupe_replay(spark: SparkSession, sf: str) -> DataFrame:
    return M.dedupe_replay(D.usage_events(spark, sf)).select("event_id", "hit")


@query("m05_idempotency", with_tables("""SELECT event_id, CASE WHEN coalesce(idempotency_key, '') = '' THEN 'no_key' WHEN f.f IS NULL OR (ts, event_id) <= (f.f.ts, f.f.event_id) THEN 'fresh'
    WHEN fingerprint = f.f.fingerprint THEN 'replay' ELSE 'conflict' END AS outcome FROM ev LEFT JOIN (SELECT consumer_id AS c, idempotency_key AS k,
      min({'ts': ts, 'event_id': event_id, 'fingerprint': fingerprint}) AS f FROM ev WHERE idempotency_key <> '' AND outcome IN ('ok', 'insufficient') GROUP BY 1, 2) f
    ON consumer_id = f.c AND idempotency_key = f.k"""))
def idempotency(spark: SparkSession, sf: str) -> DataFrame:
    e = D.usage_events(spark, sf).withColumn("stored", F.col("outcome").isin("ok", "insufficient"))
    return M.idempotency(e).select("event_id", F.col("idempotency_outcome").alias("outcome"))


# one row of state per consumer, advanced event by event
_NUM = """SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS us, year(ts) * 12 + month(ts) AS mon FROM
    (SELECT * FROM evp QUALIFY row_number() OVER (PARTITION BY consumer_id, epoch_us(ts) // 60000000 ORDER BY ts, event_id) <= rate)"""
_STEP = """SELECT consumer_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS decision, MAP {'~': CAST(-1 AS BIGINT)} AS keys,
    MAP {CAST(-1 AS BIGINT): CAST(0 AS BIGINT)} AS anchors, CAST(0 AS BIGINT) AS mon, CAST(0 AS BIGINT) AS billed FROM (SELECT DISTINCT consumer_id FROM nums)
  UNION ALL SELECT consumer_id, i, event_id, decision,
    CASE WHEN decision IN ('computed', 'billed') AND idempotency_key IS NOT NULL THEN map_concat(keys, MAP {idempotency_key: fingerprint}) ELSE keys END,
    CASE WHEN decision IN ('computed', 'billed') THEN map_concat(anchors, MAP {fingerprint: us}) ELSE anchors END,
    mon, used + CASE WHEN decision = 'billed' THEN 1 ELSE 0 END FROM (
    SELECT s.consumer_id, n.i, n.event_id, n.idempotency_key, n.fingerprint, n.us, s.keys, s.anchors, CAST(n.mon AS BIGINT) AS mon, CASE WHEN s.mon = n.mon THEN s.billed ELSE 0 END AS used,
      CASE WHEN n.idempotency_key IS NOT NULL AND map_contains(s.keys, n.idempotency_key) THEN CASE WHEN s.keys[n.idempotency_key] = n.fingerprint THEN 'replay' ELSE 'conflict' END
      WHEN map_contains(s.anchors, n.fingerprint) AND n.us - s.anchors[n.fingerprint] < 86400000000 THEN 'dedupe_hit'
      WHEN (CASE WHEN s.mon = n.mon THEN s.billed ELSE 0 END) >= n.quota THEN 'quota_exceeded' WHEN n.outcome = 'error' THEN 'internal_error' WHEN n.outcome = 'unsupported' THEN 'unsupported_coverage'
      WHEN n.outcome = 'insufficient' THEN 'computed' ELSE 'billed' END AS decision
    FROM step s JOIN nums n ON n.consumer_id = s.consumer_id AND n.i = s.i + 1)"""


@query("m06_request_gate", with_tables("""SELECT event_id, decision, decision = 'billed' AS billed FROM step WHERE event_id IS NOT NULL
    UNION ALL SELECT event_id, 'rate_limited', false FROM evp WHERE event_id NOT IN (SELECT event_id FROM nums)""", recursive=True, nums=_NUM, step=_STEP))
def request_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.gate(planned(spark, sf))


@query("m07_plan_resolution", with_tables("SELECT event_id, plan, quota AS monthly_quota, rate AS rate_limit FROM evp"))
def plan_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).select("event_id", "plan", "monthly_quota", "rate_limit")


@query("m08_legacy_quota", with_tables("""SELECT event_id, n <= lim AS allowed, CAST(least(n, lim) AS BIGINT) AS requests_this_month FROM (SELECT event_id,
    CASE consumer_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 1000 WHEN 2 THEN 10000 ELSE 2147483647 END AS lim, row_number() OVER (PARTITION BY consumer_id, date_trunc('month', ts) ORDER BY ts, event_id) AS n FROM ev)"""))
def legacy_quota(spark: SparkSession, sf: str) -> DataFrame:
    e = D.usage_events(spark, sf).withColumn("tier", D.choose(list(C.LEGACY_TIERS), F.col("consumer_id") % 4))
    return M.legacy_usage(e).select("event_id", "allowed", F.col("requests_this_month").cast("long").alias("requests_this_month"))


@query("m09_usage_report", with_tables("""SELECT consumer_id, endpoint, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (WHERE billable) AS billed,
    count(*) FILTER (WHERE cache_hit) AS cache_hits, max(response_time_ms) AS max_ms, quantile_disc(response_time_ms, 0.5) AS median_ms FROM bill GROUP BY 1, 2, 3""", **_BILL))
def usage_report(spark: SparkSession, sf: str) -> DataFrame:
    return M.usage_report(billed(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("m10_error_status", with_tables("""SELECT code, http_status, count(*) AS events FROM (SELECT CASE outcome WHEN 'error' THEN 'internal_error' WHEN 'unsupported' THEN 'unsupported_coverage' WHEN 'insufficient' THEN 'not_found' END AS code,
    CASE outcome WHEN 'error' THEN 500 WHEN 'unsupported' THEN 422 WHEN 'insufficient' THEN 404 END AS http_status FROM ev) GROUP BY 1, 2"""))
def error_status(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("outcome") == "error", "internal_error").when(F.col("outcome") == "unsupported", "unsupported_coverage").when(F.col("outcome") == "insufficient", "not_found")
    e = D.usage_events(spark, sf).select(code.alias("code"))
    return e.groupBy("code", M.error_status(F.col("code")).alias("http_status")).agg(F.count("*").alias("events"))


@query("a01_billable_per_month", with_tables("SELECT consumer_id, strftime(ts, '%Y-%m') AS month, count(*) AS billable FROM bill WHERE billable GROUP BY 1, 2", **_BILL))
def billable_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return M.billable_by_month(billed(spark, sf)).withColumn("month", F.date_format("month", "yyyy-MM"))


@query("a02_requests_last_minute", with_tables("""SELECT consumer_id, count(*) AS requests FROM ev, (SELECT max(ts) AS at FROM events) m WHERE ts > m.at - INTERVAL 1 MINUTE AND ts <= m.at GROUP BY 1"""))
def requests_last_minute(spark: SparkSession, sf: str) -> DataFrame:
    at = D.usage_events(spark, sf).agg(F.max("ts").alias("at")).scalar()
    return M.requests_in_last_minute(D.usage_events(spark, sf), at)


@query("w06_cached_analysis", with_tables("""SELECT fingerprint, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id FROM ev, (SELECT max(ts) AS at FROM events) m
    WHERE outcome IN ('ok', 'insufficient') AND ts > m.at - INTERVAL 24 HOUR GROUP BY 1"""))
def cached_analysis(spark: SparkSession, sf: str) -> DataFrame:
    at = D.usage_events(spark, sf).agg(F.max("ts").alias("at")).scalar()
    done = D.usage_events(spark, sf).where(F.col("outcome").isin("ok", "insufficient") & (F.col("ts") > at - F.expr("INTERVAL 24 HOURS")))
    return done.groupBy("fingerprint").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("w08_stored_by_key", with_tables("""SELECT consumer_id, idempotency_key, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, first(fingerprint ORDER BY ts DESC, event_id DESC) AS fingerprint
    FROM ev WHERE idempotency_key IS NOT NULL GROUP BY 1, 2"""))
def stored_by_key(spark: SparkSession, sf: str) -> DataFrame:
    e = D.usage_events(spark, sf).where("idempotency_key IS NOT NULL")
    best = F.max_by(F.struct("event_id", "fingerprint"), F.struct("ts", "event_id")).alias("b")
    return e.groupBy("consumer_id", "idempotency_key").agg(best).select("consumer_id", "idempotency_key", "b.event_id", "b.fingerprint")
