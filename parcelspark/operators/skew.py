"""Per-key ordering and top rows that survive a key holding a large share of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, to be dealt by key on both sides.

    The planner knows a file's bytes on disk, not its rows in memory nor what an explode makes of them, and would pass such a
    side through the driver while its file is small.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as a shuffle has, before work that is heavy for their size on disk.

    The planner moves conditions below a shuffle together with the work they rest on, which then is done in the few tasks
    of the file; it moves none below a condition that depends on the task, which always holds.
    """
    even = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return even.where(F.spark_partition_id() >= 0)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key. An aggregate, so each task sends one row per key."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*cols)).alias("_r"))
    return best.select(*keys, "_r.*")


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], k: int, name: str = "rn", salts: int = 64) -> DataFrame:
    """First ``k`` rows per key with their row number.

    Two rounds: salted sub-groups are cut to ``k`` first (Spark also cuts them before the
    shuffle), so the final sort of a hot key sees at most ``salts * k`` rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    cut = salted.withColumn(name, F.row_number().over(first)).where(F.col(name) <= k).drop("_salt", name)
    return cut.withColumn(name, F.row_number().over(last)).where(F.col(name) <= k)


def number_rows(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (), name: str = "rn", slices: int = 64) -> DataFrame:
    """``row_number`` per key over a numeric or time column, for keys of any size.

    The order column is cut into slices of about equal row count; rows are numbered inside
    (key, slice) and shifted by the count of the key's earlier slices. Only the slice bounds
    (at most ``slices - 1`` numbers) visit the driver.
    """
    is_time = dict(df.dtypes)[order] == "timestamp"
    pos = F.unix_micros(order) if is_time else F.col(order)
    cuts = [(i + 1) / slices for i in range(slices - 1)]
    bounds = sorted(set(df.agg(F.percentile_approx(pos, cuts, 1000)).first()[0] or []))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    cut = df.withColumn("_slice", F.size(F.filter(edges, lambda b: b < pos)))
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_slice").orderBy(order, *tie)
    numbered = cut.withColumn("_in", F.row_number().over(inner))
    return numbered.join(shift, [*keys, "_slice"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_slice", "_in", "_before")
