"""Streaming jobs run over the files to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.feasibility import TABLES
from parcelspark.queries.metering import _NUM, _STEP, planned
from parcelspark.queries.registry import query
from parcelspark.session import shared_dir
from parcelspark.streaming import jobs as J


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).parquet(f"{sf}/{name}*.parquet")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st01_minute_counts", "SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, user_id AS consumer_id, count(*) AS requests FROM events GROUP BY 1, 2")
def minute_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = J.minute_counts(event_stream(spark, sf).withColumnRenamed("user_id", "consumer_id"))
    # update mode re-emits a growing count: the last one is the largest
    out = J.run_to_end(spark, s, "update")
    return out.groupBy(F.unix_micros("minute").alias("minute_us"), "consumer_id").agg(F.max("requests").alias("requests"))


@query("st02_land_once", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def land_once(spark: SparkSession, sf: str) -> DataFrame:
    s = J.land_once(event_stream(spark, sf), ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    return J.run_to_end(spark, s)


@query("st03_live_gate", with_tables("""SELECT event_id, decision, decision = 'billed' AS billed FROM step WHERE event_id IS NOT NULL
    UNION ALL SELECT event_id, 'rate_limited', false FROM evp WHERE event_id NOT IN (SELECT event_id FROM nums)""", recursive=True, nums=_NUM, step=_STEP))
def live_gate(spark: SparkSession, sf: str) -> DataFrame:
    s = planned(spark, sf, event_stream(spark, sf))
    return J.run_to_end(spark, J.live_gate(s))


_MEMO = """SELECT user_id % 10 AS layer, round(value / 100, 0) AS x, epoch_us(ts) AS us, event_id FROM events"""


@query("st04_recent_memo", with_tables("""SELECT m.event_id, c.us IS NOT NULL AND m.event_id = c.event_id AS fetched FROM memo m LEFT JOIN (SELECT layer, x, us, min(event_id) AS event_id FROM (SELECT chain.layer, chain.x, chain.us, memo.event_id FROM chain JOIN memo ON memo.layer = chain.layer AND memo.x = chain.x AND memo.us = chain.us) GROUP BY 1, 2, 3) c
    ON c.layer = m.layer AND c.x = m.x AND c.us = m.us""", recursive=True, memo=_MEMO, chain="""SELECT layer, x, min(us) AS us FROM memo GROUP BY 1, 2 UNION ALL
    SELECT layer, x, us FROM (SELECT c.layer, c.x, (SELECT min(us) FROM memo WHERE memo.layer = c.layer AND memo.x = c.x AND memo.us >= c.us + 3600000000) AS us FROM chain c) WHERE us IS NOT NULL"""))
def recent_memo(spark: SparkSession, sf: str) -> DataFrame:
    # an hour instead of a minute, so that repeats occur in this traffic
    s = event_stream(spark, sf).select("event_id", "ts", (F.col("user_id") % 10).alias("layer"), F.round(F.col("value") / 100).alias("lon"), F.lit(0.0).alias("lat"))
    return J.run_to_end(spark, J.recent_memo(s, 3600, "40 days"))


@query("st05_stream_enrichment", with_tables("SELECT request_id, status AS feasibility_status, CASE WHEN placed AND NOT live THEN 'unsupported_coverage' ELSE 'completed' END AS kind FROM done", **TABLES))
def stream_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    ask, refs = D.ask(spark, sf, stream(spark, sf, "customer")), D.refs(spark, sf)
    base = f"{shared_dir(spark)}/enrich-{uuid.uuid4().hex}"

    def store(result: DataFrame, i: int) -> None:
        result.select("request_id", "feasibility_status", "kind").write.mode("overwrite").parquet(f"{base}/out/batch={i}")

    q = J.enrich(ask, refs, D.AS_OF, store).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("request_id long, feasibility_status string, kind string").parquet(f"{base}/out").drop("batch")
