"""Deterministic shards: contiguous ranges of a total order, of about equal size, whatever the cluster's partitions.

Rows are ordered by (key, tie), null keys first. The running size over that order is the same for any partitioning, so
shard bounds depend on the data alone. Only narrow rows (key, tie, size) are sorted; bounds, one for each shard, reach
the driver.
"""

from __future__ import annotations

import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.session import cut, shared_dir


def place(key: object, tie: int) -> tuple:
    """A row's place in the order, for comparison."""
    return (False, 0, tie) if key is None else (True, key, tie)


def bounds(rows: DataFrame, size: Column, target: int) -> list[tuple]:
    """Place of the first row of each shard of ``rows`` (key, tie), when shards are of ``target`` in sum of ``size``.

    A shard ends with the row that reaches its target, so a row larger than the target ends its shard. Places are
    distinct: rows that repeat both key and tie are in one shard, however large they are together.
    """
    narrow = rows.select("key", "tie", size.cast("bigint").alias("size"))
    ranged = cut(narrow.repartitionByRange("key", "tie").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.sum("size").alias("s")).withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).select("part", "offset")
    inside = Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("b", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, "part")
    shard = F.floor((F.col("b") + F.col("offset")) / F.lit(target))
    first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("key", "tie")).alias("first"))
    return sorted({place(r.first.key, r.first.tie) for r in first.select("first").collect()})


def shard_of(starts: list[tuple], key: object, tie: int) -> int:
    return max(0, bisect_right(starts, place(key, tie)) - 1)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a folder that Spark names; `file:` or none is a mounted folder."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def published(folder: str, name: str) -> Iterator:
    """A file to write under a temporary name, which gets its own name when all is written.

    Content is a function of the data, so attempts that race publish the same bytes.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{os.getpid()}-{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(temporary, compression=None) as out:
            yield out
        fs.move(temporary, f"{path}/{name}")
    except BaseException:
        if fs.get_file_info(temporary).type == pafs.FileType.File:
            fs.delete_file(temporary)
        raise
