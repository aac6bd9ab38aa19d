"""Stored tables whose changes appear all at once or not at all.

Rows live in folders that are written once and never changed. A version is a small manifest, which says for every scope (a
source, a jurisdiction) which folder holds its rows; it is written under a temporary name and renamed to its number last.
Readers take the highest number there is, so they see the version before a change or after it, never a mix, and a job that
fails leaves nothing but a folder that no manifest names. Two writers cannot publish one number: the later one fails and
may try again on the new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelspark.sources import sinks

_SCOPE = "_scope"


class Conflict(RuntimeError):
    """Another writer has published a version meanwhile."""


class Table:
    """A table at ``path`` whose rows are replaced by ``scope`` (one of its columns; null is a scope of its own)."""

    def __init__(self, spark: SparkSession, path: str, scope: str):
        self.spark, self.path, self.scope = spark, path, scope
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join([path, *parts]))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the latest version, 0 before the first."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"scopes": {}, "schema": None}
        stream = self._fs.open(self._at("manifests", str(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the latest."""
        about = self.manifest(version)
        if about["schema"] is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = StructType.fromJson(about["schema"])
        folders: dict[str, list[str]] = {}
        for value, folder in about["scopes"].items():
            folders.setdefault(folder, []).append(value)
        rows = self.spark.createDataFrame([], schema)
        for folder, values in sorted(folders.items()):
            stored = self.spark.read.schema(StructType(schema.fields).add(_SCOPE, "string")).parquet(f"{self.path}/data/{folder}")
            rows = rows.unionByName(stored.where(F.col(_SCOPE).isin(values)).drop(_SCOPE))
        return rows

    def _key(self) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(self.scope).cast("string")), F.lit("null"))

    def replace(self, batch: DataFrame, on: int | None = None) -> int:
        """Publish a version in which the scopes of ``batch`` have its rows and no others; returns its number.

        A batch without rows is refused: an outage must not clear a scope. ``on`` is the version that the batch was made
        from; the change fails if that is not the latest any more.
        """
        before = self.version() if on is None else on
        folder = uuid.uuid4().hex
        batch.withColumn(_SCOPE, self._key()).write.partitionBy(_SCOPE).parquet(f"{self.path}/data/{folder}")
        scopes = [r[0] for r in self.spark.read.schema(StructType().add(_SCOPE, "string")).parquet(f"{self.path}/data/{folder}").distinct().collect()]
        if not scopes:
            raise ValueError("refusing to replace a scope with no rows")
        about = self.manifest(before)
        self._publish(before + 1, {"scopes": about["scopes"] | dict.fromkeys(scopes, folder), "schema": about["schema"] or batch.schema.jsonValue()})
        return before + 1

    def upsert(self, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column], mode: str = "update") -> int:
        """Publish a version after a keyed upsert (see ``sinks.upsert``); only scopes of the batch are written anew. Rows do not change scope."""
        before = self.version()
        if not before:
            names = batch.columns
            return self.replace(sinks.upsert(batch.limit(0), batch, keys, order, mode).select(*names), 0)
        stored = self.read(before)
        scopes = batch.select(self.scope).distinct().withColumnRenamed(self.scope, "_touched")
        touched = stored.join(scopes, F.col(self.scope).eqNullSafe(F.col("_touched")), "left_semi")
        return self.replace(sinks.upsert(touched, batch, keys, order, mode).select(*stored.columns), before)

    def _publish(self, version: int, about: dict) -> None:
        temporary, final = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", str(version))
        out = self._fs.create(temporary, False)
        try:
            out.write(json.dumps(about).encode())
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but the last ``keep``, and folders that none of these names. Not while others write."""
        last = self.version()
        named = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.manifest(v)["scopes"].values()}
        for v in range(1, last - keep + 1):
            self._fs.delete(self._at("manifests", str(v)), False)
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
