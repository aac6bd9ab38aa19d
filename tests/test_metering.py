"""Metering recurrences against plain Python, hot keys included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import metering as M
from parcelspark.operators.skew import number_rows, top_per_key

T0 = dt.datetime(2024, 1, 30)
DDL = "event_id long, ts timestamp, consumer_id long, fingerprint long, idempotency_key string, monthly_quota int, rate_limit int, outcome string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(1500):
        c = 0 if rng.random() < 0.5 else rng.randrange(6)  # one consumer holds half of the traffic
        ts = T0 + dt.timedelta(seconds=rng.randrange(4 * 86400) if rng.random() < 0.7 else rng.randrange(600))
        out.append((i, ts, c, c * 3 + rng.randrange(3), str(rng.randrange(4)) if rng.random() < 0.2 else None, [3, 5, None][c % 3], 4, rng.choice(["ok", "ok", "insufficient", "unsupported", "error"])))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, DDL)


def by_time(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def test_dedupe(events, rows):
    anchor, want = {}, {}
    for r in by_time(rows):
        a = anchor.get(r[3])
        want[r[0]] = a is not None and r[1] - a < dt.timedelta(hours=24)
        if not want[r[0]]:
            anchor[r[3]] = r[1]
    got = {r["event_id"]: r["hit"] for r in M.dedupe_replay(events).collect()}
    assert got == want and any(want.values())


def test_short_window_over_a_month_of_one_key(spark):
    rng = random.Random(9)
    times = sorted({rng.randrange(30 * 86400) for _ in range(4000)} | {5, 65, 125, 185, 245})
    df = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=t)) for t in times] + [(None, T0)], "k string, ts timestamp")
    want, last = [], None
    for t in times:
        if last is None or t - last >= 60:
            want.append(t)
            last = t
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = M.greedy_anchors(df, ["k"], 60_000_000).collect()
    assert sorted(r.anchor_us // 1_000_000 - base for r in got if r.k) == want
    assert sum(r.k is None for r in got) == 1


def test_first_stored_request_owns_its_key(spark):
    rows = [(1, 0, "k", 7, False), (2, 1, "k", 7, True), (3, 2, "k", 7, True), (4, 3, "k", 8, False), (5, 4, "", 7, True), (6, 5, None, 7, True)]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), 1, k, f, st) for i, s, k, f, st in rows], "event_id int, ts timestamp, consumer_id int, idempotency_key string, fingerprint int, stored boolean")
    got = {r.event_id: r.idempotency_outcome for r in M.idempotency(df).collect()}
    assert got == {1: "fresh", 2: "fresh", 3: "replay", 4: "conflict", 5: "no_key", 6: "no_key"}


def test_gate(events, rows):
    minute, state, want = {}, {}, {}
    for r in by_time(rows):
        i, ts, c, fp, key, quota, rate, outcome = r
        m = (c, ts.replace(second=0))
        if minute.get(m, 0) >= rate:
            want[i] = "rate_limited"
            continue
        minute[m] = minute.get(m, 0) + 1
        s = state.setdefault(c, {"keys": {}, "anchors": {}, "billed": {}})
        month = (ts.year, ts.month)
        a = s["anchors"].get(fp)
        if key in s["keys"]:
            want[i] = "replay" if s["keys"][key] == fp else "conflict"
        elif a is not None and ts - a < dt.timedelta(hours=24):
            want[i] = "dedupe_hit"
        elif quota is not None and s["billed"].get(month, 0) >= quota:
            want[i] = "quota_exceeded"
        elif outcome in ("error", "unsupported"):
            want[i] = {"error": "internal_error", "unsupported": "unsupported_coverage"}[outcome]
        else:
            s["anchors"][fp] = ts
            if key is not None:
                s["keys"][key] = fp
            want[i] = "computed" if outcome == "insufficient" else "billed"
            if outcome == "ok":
                s["billed"][month] = s["billed"].get(month, 0) + 1
    got = {r["event_id"]: r["decision"] for r in M.gate(events).collect()}
    assert got == want
    assert {"rate_limited", "replay", "conflict", "dedupe_hit", "quota_exceeded", "billed"} <= set(want.values())


def test_quota_of_a_hot_consumer(events, rows):
    used, want = {}, {}
    for r in by_time(rows):
        k = (r[2], r[1].month)
        if r[5] is None:
            want[r[0]] = (True, None)
            continue
        n = used.get(k, 0)
        want[r[0]] = (n < r[5], n)
        used[k] = min(n + 1, r[5])
    out = M.monthly_quota(events.withColumn("candidate", F.lit(True))).collect()
    assert {r["event_id"]: (r["allowed"], r["used"]) for r in out} == want


def test_numbering_of_a_hot_key(spark):
    rows = [(0 if i % 3 else i % 5, (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, i long")
    want, seen = {}, {}
    for k, o, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r["i"]: r["rn"] for r in number_rows(df, ["k"], "o", ["i"], slices=16).collect()} == want
    top = {(r["k"], r["i"]) for r in top_per_key(df, ["k"], ["o", "i"], 5).collect()}
    assert top == {(k, i) for k, o, i in rows if want[i] <= 5}
    assert number_rows(df.where("k > 99"), ["k"], "o", ["i"]).count() == 0


def test_plan_resolution(spark):
    from parcelspark import catalogs as C

    e = spark.createDataFrame([(1, "PRO", False), (2, "gold", False), (3, None, False), (4, "ultra", True)], "event_id long, slug string, direct boolean")
    got = {r["event_id"]: (r["plan"], r["monthly_quota"], r["rate_limit"]) for r in M.resolve_plan(e, C.plans(spark), direct=F.col("direct")).collect()}
    assert got == {1: ("PRO", 50, 30), 2: ("BASIC", 3, 10), 3: ("BASIC", 3, 10), 4: ("BASIC", 3, 10)}
