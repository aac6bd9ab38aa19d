"""Request metering replayed over an event table: billing, quotas, limits, deduplication.

Events carry ``event_id, ts, consumer_id`` and are ordered by (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions.text import lookup
from parcelspark.operators.skew import dealt
from parcelspark.session import cut

DAY_US = 86_400_000_000


def resolve_plan(events: DataFrame, plans: DataFrame, slug: str = "slug", direct: Column | None = None) -> DataFrame:
    """Add ``plan``, ``monthly_quota``, ``rate_limit``: by subscription slug in any case, else the
    default plan; direct callers always get the default. A plan without its own rate gets the
    general one."""
    by_slug = plans.select(F.lower("slug").alias("_s"), F.col("plan").alias("_p"))
    named = events.join(by_slug, F.lower(slug) == F.col("_s"), "left")
    use = F.col("_p") if direct is None else F.when(~direct, F.col("_p"))
    named = named.withColumn("plan", F.coalesce(use, F.lit(C.DEFAULT_PLAN))).drop("_s", "_p")
    rate = F.coalesce(F.nullif("rate_limit", F.lit(0)), F.lit(C.DEFAULT_RATE_LIMIT))
    return named.join(plans.select("plan", "monthly_quota", rate.alias("rate_limit")), "plan", "left")


def decide_metering(status_code: Column, feasibility_status: Column, cache_hit: Column) -> Column:
    """``struct<billable, reason>`` of a finished request."""
    out = lambda b, r: F.struct(F.lit(b).alias("billable"), r.alias("reason"))
    none = F.coalesce(feasibility_status, F.lit("None"))
    return (
        F.when(status_code != 200, out(False, F.concat(F.lit("non_200_status:"), status_code.cast("string"))))
        .when(cache_hit, out(False, F.lit("cache_hit_within_dedupe_window")))
        .when(~none.isin(C.BILLABLE), out(False, F.concat(F.lit("non_billable_status:"), none)))
        .otherwise(out(True, F.lit("completed_feasibility_analysis")))
    )


def error_status(code: Column) -> Column:
    return lookup(code, C.ERROR_STATUS)


def _limit_rank(events: DataFrame, keys: Sequence[str | Column], limit: str, salts: int = 64) -> DataFrame:
    """``event_id, rn`` of the first events per key, as many as the row's own ``limit`` says.

    Sub-groups by a salt are ranked first and cut to the limit, so a hot key's last rank sees at most ``salts`` times
    its limit.
    """
    named = events.select("event_id", "ts", F.col(limit).alias("_most"), F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("_salt"), *[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    first = Window.partitionBy(*names, "_salt").orderBy("ts", "event_id")
    last = Window.partitionBy(*names).orderBy("ts", "event_id")
    cut_down = named.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= F.col("_most"))
    return cut_down.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= F.col("_most")).select("event_id", "rn")


def monthly_quota(events: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``used`` to would-be billed requests (``candidate``).

    A request is allowed while fewer billed ones precede it in the UTC month than the plan's
    quota; denied ones do not count, so exactly the first ``monthly_quota`` candidates pass.
    A null quota is unlimited.
    """
    month = F.date_trunc("month", "ts")
    first = _limit_rank(events.where("candidate AND monthly_quota IS NOT NULL"), ["consumer_id", month], "monthly_quota")
    ranked = events.join(dealt(first), "event_id", "left")
    within = F.col("rn") <= F.col("monthly_quota")
    return ranked.withColumn(
        "allowed", F.when(F.col("candidate"), F.col("monthly_quota").isNull() | F.coalesce(within, F.lit(False)))
    ).withColumn(
        "used", F.when(F.col("candidate") & F.col("monthly_quota").isNotNull(), F.least(F.coalesce(F.col("rn") - 1, F.col("monthly_quota")), F.col("monthly_quota")))
    ).drop("rn")


def burst_limit(events: DataFrame) -> DataFrame:
    """Add ``allowed``: the first ``rate_limit`` requests of a consumer in a clock minute. A limit
    of zero or less means unlimited."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    first = _limit_rank(events.where("rate_limit > 0"), ["consumer_id", minute], "rate_limit")
    ranked = events.join(dealt(first), "event_id", "left")
    return ranked.withColumn("allowed", (F.col("rate_limit") <= 0) | F.coalesce(F.col("rn") <= F.col("rate_limit"), F.lit(False))).drop("rn")


def greedy_anchors(events: DataFrame, keys: Sequence[str], window_us: int) -> DataFrame:
    """``keys, anchor_us``: times at which a key is computed afresh.

    The first event is an anchor; the next anchor is the first event at least ``window_us`` after
    the previous one. Events in between do not extend the window, so this is a recurrence.

    Each distinct time is linked to the first time at least a window later: that lies in the next
    window-long bucket, behind the time's place in it, or else is the first time of a later bucket.
    Following links from the first time is then done by doubling them: the known anchors reach as
    many again in each round, so rounds grow with the logarithm of a key's history in windows.
    A key of any size is spread over its buckets.
    """
    keys = list(keys)
    bucket = F.floor(F.col("us") / window_us)
    times = cut(events.select(*keys, F.unix_micros("ts").alias("us")).distinct().withColumn("_b", bucket))
    lows = times.groupBy(*keys, "_b").agg(F.min("us").alias("_low"))
    later = Window.partitionBy(*keys).orderBy("_b")
    # a time's bucket ahead holds its place (us + window) among the real times there
    places = times.select(*keys, (F.col("_b") + 1).alias("_b"), (F.col("us") + window_us).alias("_at"), F.col("us").alias("_from"))
    real = times.select(*keys, "_b", F.col("us").alias("_at"), F.lit(None).cast("bigint").alias("_from"))
    ahead = Window.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = places.unionByName(real).withColumn("_to", F.min(F.when(F.col("_from").isNull(), F.col("_at"))).over(ahead))
    inside = both.where("_from IS NOT NULL").select(*keys, "_b", F.col("_from").alias("us"), "_to")
    # where the bucket ahead has none, the first time of the bucket after it
    own = lows.withColumn("_next", F.lead("_b").over(later)).withColumn("_next_low", F.lead("_low").over(later))
    over = own.select(*keys, (F.col("_b") + 1).alias("_b"), F.when(F.col("_next") > F.col("_b") + 1, F.col("_next_low")).alias("_gap"))
    after = own.select(*keys, "_b", F.col("_next_low").alias("_after"))
    same = lambda a, c: [F.col(f"a.{k}").eqNullSafe(F.col(f"{c}.{k}")) for k in keys] + [F.col("a._b") == F.col(f"{c}._b")]
    linked = inside.alias("a").join(dealt(over.alias("o")), same("a", "o"), "left").join(dealt(after.alias("f")), same("a", "f"), "left")
    jump = cut(linked.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.us").alias("us"), F.coalesce("_to", "_after", "_gap").alias("to")).where("to IS NOT NULL"))
    reached = cut(times.groupBy(*keys).agg(F.min("us").alias("anchor_us")))
    match = lambda a, c, x, y: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{c}.{k}")) for k in keys] + [F.col(f"{a}.{x}") == F.col(f"{c}.{y}")]
    while True:
        new = cut(reached.alias("r").join(dealt(jump.alias("j")), match("r", "j", "anchor_us", "us")).select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("j.to").alias("anchor_us")))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        jump = cut(jump.alias("x").join(dealt(jump.alias("y")), match("x", "y", "to", "us")).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.us").alias("us"), F.col("y.to").alias("to")))


def dedupe_replay(events: DataFrame, hours: float = C.DEDUPE_HOURS, key: str = "fingerprint") -> DataFrame:
    """Add ``hit``: the request repeats a computed one less than ``hours`` old.

    The anchor of a time is the earliest event at it, so only that event is computed.
    """
    anchors = greedy_anchors(events, [key], int(hours * 3_600_000_000)).select(F.col(key).alias("_k"), "anchor_us")
    at = events.withColumn("_us", F.unix_micros("ts"))
    first = at.join(dealt(anchors), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_us") == F.col("anchor_us")), "left_semi")
    computed = first.groupBy(key, "_us").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(False).alias("_h"))
    return events.join(dealt(computed), "event_id", "left").withColumn("hit", F.coalesce("_h", F.lit(True))).drop("_h")


def idempotency(events: DataFrame, stored: str = "stored") -> DataFrame:
    """Add ``idempotency_outcome``: ``no_key``, ``fresh``, ``replay`` or ``conflict`` against the first request of
    (consumer, key) that stored its answer, which never expires.

    ``stored`` is a boolean column: whether the request, if computed, keeps an answer. Requests before
    the first such one are fresh, as nothing is there to replay. An empty key is no key.
    """
    keyed = events.where("idempotency_key <> ''")
    first = keyed.where(F.col(stored)).groupBy("consumer_id", "idempotency_key").agg(
        F.min(F.struct("ts", "event_id", "fingerprint")).alias("_f")
    )
    earlier = F.struct("ts", "event_id") <= F.struct("_f.ts", "_f.event_id")
    named = keyed.join(dealt(first), ["consumer_id", "idempotency_key"], "left").select(
        "event_id",
        F.when(F.col("_f").isNull() | earlier, "fresh").when(F.col("fingerprint") == F.col("_f.fingerprint"), "replay").otherwise("conflict").alias("_o"),
    )
    return events.join(dealt(named), "event_id", "left").withColumn("idempotency_outcome", F.coalesce("_o", F.lit("no_key"))).drop("_o")


GATE_STATE = "event_id long, decision string, billed boolean"


class GateState:
    """What one consumer's requests depend on; replaying an event updates it."""

    def __init__(self, window_us: int):
        self.window_us = window_us
        self.keys: dict[str, int] = {}  # idempotency key -> fingerprint it was stored with
        self.anchors: dict[int, int] = {}  # fingerprint -> time it was last computed
        self.month: int | None = None
        self.billed = 0

    def decide(self, us: int, month: int, key: str | None, fp: int, quota: int | None, outcome: str) -> tuple[str, bool]:
        if key and key in self.keys:
            return ("replay", False) if self.keys[key] == fp else ("conflict", False)
        anchor = self.anchors.get(fp)
        if anchor is not None and us - anchor < self.window_us:
            return "dedupe_hit", False
        if month != self.month:
            self.month, self.billed = month, 0
        if quota is not None and self.billed >= quota:
            return "quota_exceeded", False
        if outcome == "error":
            return "internal_error", False
        if outcome == "unsupported":
            return "unsupported_coverage", False
        self.anchors[fp] = us
        if key:
            self.keys[key] = fp
        if outcome == "insufficient":
            return "computed", False
        self.billed += 1
        return "billed", True


def _opt(v: object) -> object | None:
    return None if v is None or v != v else v


def gate(events: DataFrame, hours: float = C.DEDUPE_HOURS) -> DataFrame:
    """``event_id, decision, billed``: burst limit, idempotency, deduplication, quota, compute.

    Needs ``rate_limit``, ``monthly_quota``, ``fingerprint``, ``idempotency_key`` and ``outcome``
    (what computing would give: ok, insufficient, unsupported, error). The burst limit is decided
    first by a distributed rank, which leaves each consumer at most ``rate_limit`` requests per
    minute however many were sent. Only those run through the per-consumer state, streamed in
    order batch by batch; the state holds one entry per key and fingerprint.
    """
    limited = burst_limit(events)
    denied = limited.where("NOT allowed").select("event_id", F.lit("rate_limited").alias("decision"), F.lit(False).alias("billed"))
    month = (F.year("ts") * 12 + F.month("ts")).alias("month")
    passed = limited.where("allowed").select(
        "consumer_id", F.unix_micros("ts").alias("us"), "event_id", month, "idempotency_key", "fingerprint", "monthly_quota", "outcome"
    )
    window_us = int(hours * 3_600_000_000)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = GateState(window_us)
        for pdf in batches:
            out = [
                (e, *state.decide(us, m, _opt(k), fp, _opt(q), o))
                for us, e, m, k, fp, q, o in zip(pdf.us, pdf.event_id, pdf.month, pdf.idempotency_key, pdf.fingerprint, pdf.monthly_quota, pdf.outcome)
            ]
            yield pd.DataFrame(out, columns=["event_id", "decision", "billed"])

    # sorted by the grouping key first, so grouping adds no further sort and keeps the order
    ordered = passed.repartition("consumer_id").sortWithinPartitions("consumer_id", "us", "event_id")
    return ordered.groupBy("consumer_id").applyInPandas(replay, GATE_STATE).unionByName(denied)


def legacy_usage(events: DataFrame, tiers: dict[str, int] | None = None) -> DataFrame:
    """Add ``allowed`` and ``requests_this_month`` under the earlier key tiers: every request
    counts until the tier's monthly limit, and the count restarts each calendar month.

    The count is a rank within (key, month, minute) shifted by the minutes before, so no group is
    larger than one key's minute, and the shift works on counts.
    """
    limits = tiers or C.LEGACY_TIERS
    e = events.withColumn("_m", F.date_trunc("month", "ts")).withColumn("_q", F.floor(F.unix_micros("ts") / 60_000_000))
    per = e.groupBy("consumer_id", "_m", "_q").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("consumer_id", "_m").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("consumer_id", "_m", "_q").orderBy("ts", "event_id"))
    seen = e.withColumn("_r", rank).join(per.withColumn("_b", before).drop("_n"), ["consumer_id", "_m", "_q"])
    limit = lookup(F.col("tier"), limits)
    n = F.col("_r") + F.col("_b")
    return seen.withColumn("allowed", n <= limit).withColumn("requests_this_month", F.least(n, limit)).drop("_m", "_q", "_r", "_b")


def billable_by_month(usage: DataFrame) -> DataFrame:
    """Billed requests per consumer and UTC calendar month."""
    return usage.where("billable").groupBy("consumer_id", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("billable"))


def requests_in_last_minute(usage: DataFrame, as_of: Column) -> DataFrame:
    recent = (F.col("ts") > as_of - F.expr("INTERVAL 1 MINUTE")) & (F.col("ts") <= as_of)
    return usage.where(recent).groupBy("consumer_id").agg(F.count("*").alias("requests"))


def usage_report(usage: DataFrame) -> DataFrame:
    """Counts and latency per consumer, endpoint and day; ``median_ms`` is an approximate median (rank error 1 in 10,000)."""
    return usage.groupBy("consumer_id", "endpoint", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if("billable").alias("billed"), F.count_if("cache_hit").alias("cache_hits"),
        F.max("response_time_ms").alias("max_ms"), F.percentile_approx("response_time_ms", 0.5, 10000).alias("median_ms"),
    )
