"""Addresses to points: reference table lookup and the provider fallback chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.text import normalize_address
from parcelspark.operators.skew import dealt


def geocode(requests: DataFrame, reference: DataFrame) -> DataFrame:
    """Add ``lon``, ``lat``, ``geocode_confidence`` by normalised address.

    ``reference`` has one row per ``normalized_address``. Unknown addresses keep a null point at
    low confidence.
    """
    req = requests if "normalized_address" in requests.columns else requests.withColumn(
        "normalized_address", normalize_address(F.col("address"))
    )
    ref = reference.select("normalized_address", "lon", "lat", F.col("confidence").alias("_c"))
    joined = req.join(dealt(ref), "normalized_address", "left")
    return joined.withColumn("geocode_confidence", F.coalesce("_c", F.lit("low"))).drop("_c")


def chain_providers(responses: DataFrame, key: str = "normalized_address") -> DataFrame:
    """One response per address: the first provider (by ``priority``) that gave a point at high
    or medium confidence, else the first provider's answer."""
    row = F.struct("provider", "lon", "lat", "confidence")
    good = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("confidence").isin("high", "medium")
    best = responses.groupBy(key).agg(
        F.min_by(row, F.when(good, F.col("priority"))).alias("hit"), F.min_by(row, "priority").alias("head")
    )
    return best.select(key, F.coalesce("hit", "head").alias("r"), F.col("hit").isNotNull().alias("resolved")).select(
        key, "r.*", "resolved"
    )
