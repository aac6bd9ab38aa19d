"""Keyed writes as DataFrame results, and the writers that store them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.operators.skew import latest_by


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column], mode: str = "update") -> DataFrame:
    """Target after a batch, with ``outcome`` per row: ``inserted``, ``updated`` or ``kept``.

    ``update``: the batch's last row per key replaces the stored one. ``ignore``: stored keys stay
    and the batch's first row per new key is added.
    """
    cols = [c for c in target.columns if c not in keys]
    if mode == "update":
        new = latest_by(batch, keys, order)
    else:
        new = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    t = target.select(*keys, F.struct(*cols).alias("_old"))
    n = new.select(*keys, F.struct(*cols).alias("_new"))
    both = t.join(n, list(keys), "full_outer")
    old, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    use_new = fresh & (~old | F.lit(mode == "update"))
    outcome = F.when(~old, "inserted").when(fresh & F.lit(mode == "update"), "updated").otherwise("kept")
    return both.select(*keys, F.when(use_new, F.col("_new")).otherwise(F.col("_old")).alias("_r"), outcome.alias("outcome")).select(*keys, "_r.*", "outcome")


def append_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Batch rows whose key is not stored yet, one per key."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return first.join(target.select(*keys), list(keys), "left_anti")


def replace_scope(batch: DataFrame, path: str, scope: str) -> None:
    """Replace all stored rows of the scopes present in the batch, leaving other scopes alone.

    Scopes are folders, so the swap is a dynamic partition overwrite. A batch without rows is
    refused: an outage must not clear a layer.
    """
    if batch.isEmpty():
        raise ValueError("refusing to replace a scope with no rows")
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def scope_replacement(target: DataFrame, batch: DataFrame, scope: str) -> DataFrame:
    """The rows a scope replacement leaves."""
    return target.join(batch.select(scope).distinct(), scope, "left_anti").unionByName(batch)


def append_only_violations(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an append-only table that were removed or changed; empty when it was respected."""
    cols = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*cols).alias("_b"))
    a = after.select(*keys, F.struct(*cols).alias("_a"), F.lit(True).alias("_there"))
    j = b.join(a, list(keys), "left")
    change = F.when(F.col("_there").isNull(), "deleted").when(~F.col("_b").eqNullSafe(F.col("_a")), "updated")
    return j.select(*keys, change.alias("change")).where("change IS NOT NULL")


# Columns that identify a person or a request, dropped from public views.
PRIVATE_COLUMNS = ["input_address", "normalized_address", "address", "consumer_id", "idempotency_key", "share_token", "geocode"]


def public_view(df: DataFrame, table: str) -> DataFrame:
    """A table as anyone may read it; private tables are refused."""
    if table not in C.PUBLIC_TABLES:
        raise PermissionError(f"{table} is private")
    return df.drop(*PRIVATE_COLUMNS)
