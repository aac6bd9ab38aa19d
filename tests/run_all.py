"""Compare queries by name prefix: ``python tests/run_all.py [sf] [prefix ...]``."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from parcelspark.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    want = tuple(a for a in sys.argv[2:] if not a.startswith("-"))
    skip = tuple(a[1:] for a in sys.argv[2:] if a.startswith("-"))
    spark, con, sql = local_session(cores="8"), duck(sf), entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if (want and not name.startswith(want)) or (skip and name.startswith(skip)):
            continue
        t = time.time()
        try:
            msg = compare(spark, con, sf, fn, sql[name]) if name in sql else f"rows only: {fn(spark, sf).count()}"
        except Exception as exc:  # noqa: BLE001 - report and go on
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        ok = msg is None or msg.startswith("rows only")
        print(f"{'ok ' if ok else 'BAD'} {time.time() - t:6.2f}s {name} {'' if msg is None else msg}", flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)
