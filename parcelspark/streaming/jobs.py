"""The same semantics run continuously with Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcelspark import catalogs as C
from parcelspark.operators.metering import GateState
from parcelspark.plans.feasibility import Refs, feasibility
from parcelspark.session import shared_dir

MINUTE_US = 60_000_000


def minute_counts(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests per consumer and clock minute; rows later than ``delay`` are dropped."""
    w = F.window("ts", "1 minute")
    return stream.withWatermark("ts", delay).groupBy(w, "consumer_id").agg(F.count("*").alias("requests")).select(
        F.col("window.start").alias("minute"), "consumer_id", "requests"
    )


def land_once(stream: DataFrame, keys: Sequence[str], delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """First row per key among those arriving within ``delay`` of each other."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def land_new(batch: DataFrame, path: str, keys: Sequence[str]) -> None:
    """``foreachBatch`` body that appends rows whose key was never stored, whatever its age.

    The anti-join makes a repeated batch add nothing.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(list(keys))
    try:
        old = spark.read.parquet(path).select(*keys)
        fresh = fresh.join(old, list(keys), "left_anti")
    except Exception as exc:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    fresh.write.mode("append").parquet(path)


def live_gate(stream: DataFrame, hours: float = C.DEDUPE_HOURS) -> DataFrame:
    """Decision per request from per-consumer state: burst, idempotency, deduplication, quota.

    State is one JSON document per consumer; fingerprints older than the window are dropped from
    it. Rows of one micro-batch are taken in (ts, event_id) order.
    """
    window_us = int(hours * 3_600_000_000)
    month = (F.year("ts") * 12 + F.month("ts")).alias("month")
    rows = stream.select(
        "consumer_id", F.unix_micros("ts").alias("us"), "event_id", month, "idempotency_key", "fingerprint", "monthly_quota", "rate_limit", "outcome"
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, minute, seen = GateState(window_us), -1, 0
        if state.exists:
            old = json.loads(state.get[0])
            gate.keys, gate.month, gate.billed = old["keys"], old["month"], old["billed"]
            gate.anchors = {int(k): v for k, v in old["anchors"].items()}
            minute, seen = old["minute"], old["seen"]
        out, last = [], 0
        for r in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples():
            last = r.us
            if r.us // MINUTE_US != minute:
                minute, seen = r.us // MINUTE_US, 0
            if r.rate_limit > 0 and seen >= r.rate_limit:
                out.append((r.event_id, "rate_limited", False))
                continue
            seen += 1
            opt = lambda v: None if v is None or v != v else v
            out.append((r.event_id, *gate.decide(r.us, r.month, opt(r.idempotency_key), r.fingerprint, opt(r.monthly_quota), r.outcome)))
        anchors = {str(k): int(v) for k, v in gate.anchors.items() if last - v < window_us}
        keys = {k: int(v) for k, v in gate.keys.items()}
        state.update((json.dumps({"keys": keys, "anchors": anchors, "month": None if gate.month is None else int(gate.month), "billed": gate.billed, "minute": int(minute), "seen": seen}),))
        yield pd.DataFrame(out, columns=["event_id", "decision", "billed"])

    return rows.groupBy("consumer_id").applyInPandasWithState(
        step, "event_id long, decision string, billed boolean", "state string", "append", GroupStateTimeout.NoTimeout
    )


def recent_memo(stream: DataFrame, ttl_s: int = 60, delay: str = "10 minutes") -> DataFrame:
    """``event_id, fetched``: whether a (layer, rounded point) must be fetched or was fetched less
    than ``ttl_s`` ago. Hits do not extend the memo; expired entries leave the state.

    ``stream``: event_id, ts, layer, lon, lat.
    """
    ttl_us = ttl_s * 1_000_000
    rows = stream.withWatermark("ts", delay).select(
        "layer", F.bround("lon", 5).alias("x"), F.bround("lat", 5).alias("y"), "ts", F.unix_micros("ts").alias("us"), "event_id"
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples():
            fetch = anchor is None or r.us - anchor >= ttl_us
            anchor = r.us if fetch else anchor
            out.append((r.event_id, fetch))
        state.update((int(anchor),))
        due = (anchor + ttl_us) // 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(due))
        yield pd.DataFrame(out, columns=["event_id", "fetched"])

    return rows.groupBy("layer", "x", "y").applyInPandasWithState(
        step, "event_id long, fetched boolean", "anchor long", "append", GroupStateTimeout.EventTimeTimeout
    )


def enrich(stream: DataFrame, refs: Refs, as_of: str, store: Callable[[DataFrame, int], None]):
    """Run the feasibility job unchanged on every micro-batch and hand each result to ``store``.

    Returns the stream writer; the caller adds trigger, checkpoint location and ``start()``.
    """
    return stream.writeStream.foreachBatch(lambda batch, i: store(feasibility(batch, refs, as_of), i))


def late_rows(query) -> int:
    """Rows a finished query dropped for being past the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def run_to_end(spark: SparkSession, result: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is available, write each micro-batch to its own folder, and read all back.

    A repeated batch overwrites its folder, so a restart stores nothing twice.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")

    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out").drop("batch")
