"""As-of joins: the latest earlier row of the same key, within a span of time.

Keys and times are cut into buckets as long as the span, and a row is filed in its own bucket and the one after, so every
row that can be the latest is in the asking row's bucket. Within a bucket one pass in order of time carries the last row
on; no key's history is gathered. A key that asks often is dealt over ``salts`` copies of its (few, narrow) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def latest_within(asking: DataFrame, rows: DataFrame, keys: Sequence[str], span_us: int, *, id: str, at: str = "us", salts: int = SALTS) -> DataFrame:
    """``id`` of each asking row that has one, with ``found``: the latest row of its ``keys`` at or before its time.

    A row counts while it is less than ``span_us`` old. ``asking`` has ``id``, the keys and a time in microseconds;
    ``rows`` has the keys and that time, and their other columns come back in the struct ``found``, which also decides
    between rows of one time: the greatest is taken. Null keys find nothing.
    """
    known = " AND ".join(f"{k} IS NOT NULL" for k in [*keys, at])
    mine = [c for c in rows.columns if c not in keys]
    bucket = F.floor(F.col(at) / span_us)
    salt = F.pmod(F.xxhash64(F.col(id)), F.lit(salts)).cast("int")
    nothing = F.lit(None).cast(rows.select(F.struct(*mine)).schema[0].dataType)
    asked = asking.where(known).select(*keys, F.col(at).alias("_at"), bucket.alias("_b"), salt.alias("_s"), F.lit(1).alias("_side"), F.col(id).alias("_id"), nothing.alias("_row"))
    filed = rows.where(known).select(*keys, F.col(at).alias("_at"), bucket.alias("_b"), F.struct(*mine).alias("_row"))
    # of rows at one time only the greatest can be found
    filed = filed.groupBy(*keys, "_at", "_b").agg(F.max("_row").alias("_row"))
    filed = filed.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = asked.unionByName(filed.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy(*keys, "_b", "_s").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("found", F.last("_row", ignorenulls=True).over(past)).where("_side = 1")
    return carried.where(F.col("_at") - F.col(f"found.{at}") < span_us).select(F.col("_id").alias(id), "found")
