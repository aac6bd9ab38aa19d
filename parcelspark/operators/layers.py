"""Reference layers: features, and their quadtree pieces filed for lookups, stored once and read by every job.

A stored layer is a folder with three tables and a manifest written last:

* ``features``: attributes, geometry and plain box columns, rows along a Z-order curve, so that row-group statistics skip
  what an envelope does not reach;
* ``pieces``: partitioned by tile, bucketed and sorted by cell. Lookups start from the cells asked for:
  they are dealt to the buckets' places, so stored geometry is not shuffled; only a layer counted to have few pieces is
  broadcast;
* ``above``: the coarser cells over each piece's cell, for lookups by polygons larger than a piece.

``Layer.of`` files a table on the fly instead, for one lookup.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.operators import quadtree as Q
from parcelspark.operators.skew import dealt, spread
from parcelspark.session import shared_dir

TILE_LEVEL = 2  # tiles of a quarter of a degree
BUCKETS = 8
FEW = 10_000  # pieces that may be broadcast
METRES_PER_DEGREE = 110000.0  # at least so many metres are a degree of latitude


def _measure(pieces: DataFrame) -> tuple[list[int], bool]:
    """Levels in use, and whether the pieces are few."""
    counts = {r.level: r["count"] for r in pieces.groupBy("level").count().collect()}
    return sorted(counts) or [Q.COARSEST], sum(counts.values()) <= FEW


def with_edges(df: DataFrame) -> DataFrame:
    """Add the ``edges`` and ``bbox`` every spatial lookup works on; rows without area go."""
    return df.where(F.size("geom") > 0).withColumn("edges", F.expr(G.edges("geom"))).withColumn("bbox", F.expr(G.bbox("edges")))


def pads(tolerance_m: float) -> tuple[str, str]:
    """Degrees that surely span a tolerance, for a feature with a ``bbox``."""
    if not tolerance_m:
        return "0D", "0D"
    pad_y = f"{tolerance_m / METRES_PER_DEGREE!r}D"
    return f"({pad_y} / greatest(0.01D, cos(radians(least(90D, greatest(abs(bbox.ymin), abs(bbox.ymax)) + {pad_y})))))", pad_y


@dataclass
class Layer:
    pieces: DataFrame
    above: DataFrame
    features: DataFrame
    levels: list[int]  # of the pieces; bounded by the quadtree's depth
    tile_level: int = TILE_LEVEL
    tolerance_m: float = 0.0
    few: bool = False  # at most ``FEW`` pieces, counted

    @classmethod
    def of(cls, features: DataFrame, keep: list[str], *, tolerance_m: float = 0.0, areas: bool = False, tile_level: int = TILE_LEVEL) -> Layer:
        """File features with ``geom`` now; ``keep`` names the columns that lookups return."""
        cut = _pieces(features, keep, tolerance_m, areas, tile_level)
        levels, few = _measure(cut)
        return cls(cut, Q.ancestors(cut, tile_level), features, levels, tile_level, tolerance_m, few)

    def points(self, points: DataFrame, on: list[str] | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
        """Each point with each piece whose cell it lies in, and of the same ``on``."""
        cells = Q.point_cells(spread(points), self.levels, self.tile_level, x, y)
        pieces = self.pieces.hint("broadcast") if self.few else dealt(self.pieces)
        return cells.join(pieces, ["tile", "cell", *(on or [])]).drop("tile", "cell")

    def polygons(self, polygons: DataFrame, on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Polygons (``edges``, ``bbox``) by the cells they may meet pieces in as ``p``, and the pieces as ``f``."""
        small = (lambda df: df.hint("broadcast")) if self.few else dealt
        return Q.polygon_cells(polygons, self.levels, small(self.above), self.tile_level).alias("p"), small(self.pieces).alias("f")

    def within(self, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
        """Stored features whose box meets an envelope; the range predicates reach the scan."""
        return in_envelope(self.features, xmin, ymin, xmax, ymax)


def _pieces(features: DataFrame, keep: list[str], tolerance_m: float, areas: bool, tile_level: int) -> DataFrame:
    shaped = with_edges(spread(features.select("geom", *keep)))
    return Q.pieces(shaped, *pads(tolerance_m), areas=areas, tile_level=tile_level)


def in_envelope(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose stored box (plain columns ``xmin`` to ``ymax``) meets an envelope."""
    return df.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))


def clustered(features: DataFrame, files: int | None = None) -> DataFrame:
    """Features with plain box columns, in files along a Z-order curve of their boxes' lower corners.

    Rows without geometry have null boxes and come first.
    """
    box = F.expr(G.bbox(G.edges("geom")))
    boxed = features.withColumn("_b", F.when(F.size("geom") > 0, box)).select("*", *[F.col(f"_b.{k}").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")]).drop("_b")
    coded = boxed.withColumn("_z", F.expr(Q.morton("greatest(-180D, least(180D, xmin))", "greatest(-90D, least(90D, ymin))")))
    dealt = coded.repartitionByRange(*([files] if files else []), "_z")
    return dealt.sortWithinPartitions("_z").drop("_z")


def store(folder: str, features: DataFrame, keep: list[str], *, filed: DataFrame | None = None, tolerance_m: float = 0.0, areas: bool = False, tile_level: int = TILE_LEVEL, buckets: int = BUCKETS) -> Layer:
    """Write a layer to ``folder``, which must be new, and open it.

    ``filed`` are the rows to file where they are not the features themselves (one for each distinct shape, say). Readers
    find a layer by its manifest, so one that was not finished is not read.
    """
    spark = features.sparkSession
    clustered(features, buckets).write.parquet(f"{folder}/features")
    # counted once, as stored
    filing = _pieces(spark.read.parquet(f"{folder}/features") if filed is None else filed, keep, tolerance_m, areas, tile_level)
    name = _table(folder)
    writer = filing.repartition(buckets, "cell").write.partitionBy("tile").bucketBy(buckets, "cell").sortBy("cell").option("path", f"{folder}/pieces")
    writer.mode("overwrite").format("parquet").saveAsTable(name)
    pieces = spark.table(name)
    Q.ancestors(pieces, tile_level).write.parquet(f"{folder}/above")
    levels, few = _measure(pieces)
    about = {"levels": levels, "few": few, "tile_level": tile_level, "tolerance_m": tolerance_m, "buckets": buckets, "pieces": [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]}
    spark.range(1).select(F.lit(json.dumps(about)).alias("value")).write.text(f"{folder}/manifest")
    return open_layer(spark, folder)


def _table(folder: str) -> str:
    return f"layer_{hashlib.sha1(folder.encode()).hexdigest()[:24]}"


_opened: dict[tuple[str, str], Layer] = {}  # a finished layer's folder never changes


def open_layer(spark: SparkSession, folder: str) -> Layer:
    """A stored layer; its pieces are entered in the session's catalog where they are not yet."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _opened:
        _opened[key] = _open(spark, folder)
    return _opened[key]


def _open(spark: SparkSession, folder: str) -> Layer:
    about = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    name, n = _table(folder), about["buckets"]
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c.split(' ', 1)[0]}` {c.split(' ', 1)[1]}" for c in about["pieces"])
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (tile) CLUSTERED BY (cell) SORTED BY (cell) INTO {n} BUCKETS LOCATION '{folder}/pieces'")
        spark.catalog.recoverPartitions(name)
    read = spark.read.parquet
    return Layer(spark.table(name), read(f"{folder}/above"), read(f"{folder}/features"), about["levels"], about["tile_level"], about["tolerance_m"], about.get("few", False))


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Hash of the names, sizes and times of tables' folders or files: changes when an input does. No table is read."""
    sc, found = spark.sparkContext, []
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        size = fs.getContentSummary(path)
        found.append([p, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()])
    return hashlib.sha1(json.dumps(found).encode()).hexdigest()[:24]


_named: dict[str, str] = {}  # pointers read so far; one is never written again


def current(spark: SparkSession, name: str, build: Callable[[str], object]) -> str:
    """Folder of a finished build called ``name`` in the shared folder; ``build`` fills a new one where there is none.

    The name is given to a folder by a pointer written after it, so a build that failed is never read. Where two build at
    once, the first to finish keeps the name.
    """
    pointer = f"{shared_dir(spark)}/current/{name}"
    if pointer not in _named:
        try:
            _named[pointer] = spark.read.text(pointer).first().value
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            build(folder)
            spark.range(1).select(F.lit(folder).alias("value")).write.mode("ignore").text(pointer)
            _named[pointer] = spark.read.text(pointer).first().value
    return _named[pointer]
