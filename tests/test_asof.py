"""As-of joins and reuse of analyses, against plain loops."""

import random

from pyspark.sql import functions as F

from parcelspark.operators import asof
from parcelspark.plans import feasibility as P


def test_latest_within(spark):
    rng, span = random.Random(4), 1000
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(8000), f"r{i % 200}") for i in range(300)]
    asking = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([rng.randrange(9000), None])) for i in range(600)]
    asking += [(1000 + i, k, us + d) for i, (k, us, _) in enumerate(rows[:60]) for d in (0,)] + [(2000 + i, k, us + span) for i, (k, us, _) in enumerate(rows[:60])]
    left = spark.createDataFrame(asking, "id long, k string, us long").repartition(5)
    right = spark.createDataFrame(rows, "k string, us long, name string").repartition(3)
    want = {}
    for i, k, us in asking:
        past = [(u, n) for key, u, n in rows if k is not None and us is not None and key == k and us - span < u <= us]
        if past:
            want[i] = max(past)
    for salts in (1, 7):
        got = {r.id: (r.found.us, r.found.name) for r in asof.latest_within(left, right, ["k"], span, id="id", salts=salts).collect()}
        assert got == want and len(want) > 100
    assert asof.latest_within(left.where("false"), right, ["k"], span, id="id").count() == 0
    assert asof.latest_within(left, right.where("false"), ["k"], span, id="id").count() == 0


def test_served(spark):
    """Stored rows count for less than a day, rows without a status never, and repeats do not extend the time."""
    hour = "timestamp_micros({h} * 3600000000)"
    asked = [(1, "f", 0), (2, "f", 23), (3, "f", 24), (4, "f", 47), (5, "f", 49), (6, "g", 10), (7, "g", 30), (8, "g", 34), (9, "h", 5), (10, "h", 5), (11, None, 1)]
    stored = [("s1", "g", 9, "likely_feasible"), ("s0", "g", 8, "likely_feasible"), ("s2", "h", 4, None), ("s3", "f", -24, "likely_feasible")]
    left = spark.createDataFrame(asked, "request_id long, request_fingerprint string, h long").withColumn("requested_at", F.expr(hour.format(h="h")))
    right = spark.createDataFrame(stored, "analysis_id string, request_fingerprint string, h long, feasibility_status string").withColumn("created_at", F.expr(hour.format(h="h")))
    got = {r.request_id: (r.computed, r.analysis_id, r.anchor_id) for r in P.served(left, right).collect()}
    assert got == {
        1: (True, None, None), 2: (False, None, 1), 3: (True, None, None), 4: (False, None, 3), 5: (True, None, None), 6: (False, "s1", None),
        7: (False, "s1", None), 8: (True, None, None), 9: (True, None, None), 10: (False, None, 9), 11: (True, None, None),
    }
