"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are scaled to integers once and kept as blocks: for each dimension the distinct integers that occur in the block,
and for each vector the places of its components among them. In a round, a task takes a block and tabulates, for each
dimension, each occurring integer and each centroid, the squared difference; a vector's distances are then sums of
gathered table rows. Only these sums, counts and componentwise sums by centroid leave a task, so the work shuffled in a
round is the number of tasks times centroids times dimensions, however many vectors fall to one centroid. The driver
holds the centroids alone.

Defined cases: vectors with another number of components than ``dims``, or with a null or non-finite one, are left out,
null vectors too. Rows that repeat an id each count and each have a result; of seeds with one hash the smaller vector is
first, and a null id is hashed as the empty text. With fewer vectors than centroids every vector is a seed. Components
beyond 2**62 after scaling count as 2**62. Beyond 2**27 blocks are worked out in Python's integers, and a distance or sum
that no long holds is null. An empty table gives no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.session import cut

BLOCK = 8192  # vectors whose tables are made together: at most BLOCK x dims x k numbers
FAR, LIMIT = 1 << 27, 1 << 62
LONG = 1 << 63


def scaled(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale x) of the vectors that are whole, a row each, and the rows they come from."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    wide = values.reshape(len(rows), dims)
    good = np.isfinite(wide).all(axis=1)
    with np.errstate(over="ignore"):
        numbers = np.floor(wide[good] * float(scale))
    numbers = np.clip(numbers, -float(LIMIT), float(LIMIT))
    return numbers.astype(np.int64), rows[good]


def seed_hash(seed: int, key: object) -> str:
    return hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int, seed: int, k: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, rows = scaled(batch.column("vector"), dims, scale)
        ids = batch.column("id").take(pa.array(rows))
        for a in range(0, len(rows), block):
            part, keys = numbers[a : a + block], ids.slice(a, block)
            values, starts, codes = [], [0], np.empty(part.shape, dtype="<u2")
            for d in range(dims):
                occurring, codes[:, d] = np.unique(part[:, d], return_inverse=True)
                values.append(occurring)
                starts.append(starts[-1] + len(occurring))
            hashes = [seed_hash(seed, key) for key in keys.to_pylist()]
            first = sorted(range(len(part)), key=lambda i: (hashes[i], part[i].tolist()))[:k]
            seeds = [{"hash": hashes[i], "vector": part[i].tolist()} for i in first]
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    "starts": pa.array([starts], pa.list_(pa.int32())),
                    "vals": pa.array([np.concatenate(values)], pa.list_(pa.int64())),
                    "codes": pa.array([codes.T.tobytes()], pa.binary()),
                    "seeds": pa.array([seeds], pa.list_(pa.struct([("hash", pa.string()), ("vector", pa.list_(pa.int64()))]))),
                }
            )


def blocks(vectors: DataFrame, dims: int, scale: int, seed: int, k: int, block: int = BLOCK) -> DataFrame:
    """Vectors (id, vector) as blocks of at most ``block`` (below 65,536), each with its ``k`` first seeds."""
    schema = f"ids array<{dict(vectors.dtypes)['id']}>, starts array<int>, vals array<bigint>, codes binary, seeds array<struct<hash: string, vector: array<bigint>>>"
    return vectors.mapInArrow(lambda it: _blocks(it, dims, scale, seed, k, block), schema)


class Block:
    """One block, opened: which integers occur in each dimension and where each vector has which."""

    def __init__(self, starts: np.ndarray, vals: np.ndarray, codes: bytes, centroids: list[list[int]]):
        self.starts, dims = starts, len(starts) - 1
        self.codes = np.frombuffer(codes, dtype="<u2").reshape(dims, -1)
        far = max((abs(x) for c in centroids for x in c), default=0) >= FAR or bool(len(vals)) and max(-int(vals.min()), int(vals.max())) >= FAR
        self.vals = vals.astype(object) if far else vals

    def distances(self, centroids: list[list[int]]) -> np.ndarray:
        """Squared distances, vectors by centroids: a table for each dimension, gathered and summed."""
        places = np.array(centroids, dtype=object if self.vals.dtype == object else np.int64)
        total = np.zeros((self.codes.shape[1], len(centroids)), dtype=self.vals.dtype)
        for d, codes in enumerate(self.codes):
            occurring = self.vals[self.starts[d] : self.starts[d + 1]]
            table = (occurring[:, None] - places[:, d]) ** 2
            total += table[codes]
        return total

    def sums(self, nearest: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """Count and componentwise sums of each centroid's vectors: occurrences of each integer, times the integer."""
        totals = [[0] * len(self.codes) for _ in range(k)]
        for d, codes in enumerate(self.codes):
            occurring = self.vals[self.starts[d] : self.starts[d + 1]]
            times = np.bincount(nearest * len(occurring) + codes, minlength=k * len(occurring)).reshape(k, -1)
            if self.vals.dtype == object:
                column = [sum(int(n) * int(x) for n, x in zip(row, occurring, strict=True)) for row in times]
            else:
                column = (times @ occurring).tolist()
            for j in range(k):
                totals[j][d] = column[j]
        return np.bincount(nearest, minlength=k), totals


def _opened(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.Array, Block, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(*(batch.column(c)[i].values.to_numpy() for c in ("starts", "vals")), batch.column("codes")[i].as_py(), centroids)
            distance = block.distances(centroids)
            nearest = distance.argmin(axis=1)  # the first of equal ones
            yield batch.column("ids")[i].values, block, nearest, distance[np.arange(len(nearest)), nearest]


def _summed(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """One row for each centroid of a task: its number of vectors, and the sums in two parts that longs can add up."""
    k, dims = len(centroids), len(centroids[0])
    counts, totals = np.zeros(k, dtype=np.int64), [[0] * dims for _ in range(k)]
    for _, block, nearest, _ in _opened(batches, centroids):
        number, sums = block.sums(nearest, k)
        counts += number
        totals = [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(totals, sums, strict=True)]
    part = lambda f: pa.array([[f(x) for x in row] for row in totals], pa.list_(pa.int64()))
    yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "n": pa.array(counts), "high": part(lambda x: x >> 32), "low": part(lambda x: x & 0xFFFFFFFF)})


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's componentwise floor of the mean of its vectors; one without vectors stays."""
    sums = table.select("starts", "vals", "codes", "ids").mapInArrow(lambda it: _summed(it, centroids), "cluster int, n bigint, high array<bigint>, low array<bigint>")
    terms = sums.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "part"))
    rows = terms.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("part.high").alias("high"), F.sum("part.low").alias("low")).where("n > 0").collect()
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster][r.dim] = ((r.high << 32) + r.low) // r.n
    return out


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for ids, _, nearest, distance in _opened(batches, centroids):
        near = pa.array([x if x < LONG else None for x in distance.tolist()], pa.int64()) if distance.dtype == object else pa.array(distance)
        yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), near], names=["id", "cluster", "distance"])


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, cluster_inertia, inertia) of each whole vector of ``vectors`` (id, vector), and the final centroids.

    Seeds are the ``k`` vectors with the smallest hash of their id. A round moves each centroid to the floor of the mean
    of the vectors nearest to it.
    """
    table = cut(blocks(vectors.select("id", "vector"), dims, scale, seed, k, block))
    order = table.select(F.explode("seeds").alias("s")).orderBy("s.hash", "s.vector").limit(k)
    centroids = [r.s.vector for r in order.collect()]
    kind = dict(vectors.dtypes)["id"]
    for _ in range(rounds if centroids else 0):
        centroids = moved(table, centroids)
    out = table.drop("seeds").mapInArrow(lambda it: _assigned(it, centroids), f"id {kind}, cluster int, distance bigint")
    assigned = cut(out)
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = assigned.groupBy("cluster").agg(total.alias("part")).collect()  # a row for each centroid
    parts = {r.cluster: r.part for r in by}
    inertia = None if None in parts.values() else sum(parts.values())
    number = lambda v: F.lit(None if v is None or v >= LONG else int(v)).cast("bigint")
    own = F.array(*[number(parts.get(c)) for c in range(len(centroids))]) if centroids else F.array(number(None))
    return assigned.select("*", F.get(own, F.col("cluster")).alias("cluster_inertia"), number(inertia).alias("inertia")), centroids
