"""Content-addressed snapshots and section change history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.skew import number_rows


def append_snapshots(captures: DataFrame, existing: DataFrame, order: str = "captured_seq") -> DataFrame:
    """New snapshot rows ``registry_id, content_hash, <order>, version``.

    A capture whose (registry, hash) is stored, or repeats an earlier one of the batch, adds
    nothing. Versions continue from the registry's highest in order of first capture. Numbering
    is sliced, so one registry may hold most of the captures.
    """
    first = captures.groupBy("registry_id", "content_hash").agg(F.min(order).alias(order))
    fresh = first.join(existing.select("registry_id", "content_hash"), ["registry_id", "content_hash"], "left_anti")
    top = existing.groupBy("registry_id").agg(F.max("version").alias("_top"))
    numbered = number_rows(fresh, ["registry_id"], order, ["content_hash"])
    return numbered.join(top, "registry_id", "left").select(
        "registry_id", "content_hash", order, (F.coalesce("_top", F.lit(0)) + F.col("rn")).alias("version")
    )


def section_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """New sections with ``outcome`` against the stored ones: inserted, updated, unchanged.
    Snapshot links are refreshed in every case, text only when the hash moved."""
    keys = ["jurisdiction_id", "section_url"]
    j = new.join(old.select(*keys, F.col("content_hash").alias("_old")), keys, "left")
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("content_hash"), "unchanged").otherwise("updated")
    return j.withColumn("outcome", outcome).drop("_old")


def section_history(captures: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """Every capture with ``outcome`` against the capture before it of the same section.

    The previous row is found by joining sliced row numbers, so a section captured very often is
    not sorted in one task.
    """
    n = number_rows(captures, keys, order, tie)
    prev = n.select(*keys, (F.col("rn") + 1).alias("rn"), F.col("content_hash").alias("_prev"))
    j = n.join(prev, [*keys, "rn"], "left")
    outcome = F.when(F.col("rn") == 1, "inserted").when(F.col("_prev").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    return j.withColumn("outcome", outcome).drop("_prev")
