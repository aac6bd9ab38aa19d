"""Buildable area after a uniform inward setback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parcelspark.functions import geometry as G
from parcelspark.functions import values as V

REMEMBERED = 10_000  # shapes of a task whose area is kept
PAIRS = 1 << 20  # pairs of curves, or of slabs and curves, looked at together


def _tiles(n: int, m: int) -> Iterator[slice]:
    """Runs of n rows that meet ``PAIRS`` pairs with m columns."""
    step = max(1, PAIRS // max(m, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _crossings(v: np.ndarray, a: np.ndarray, b: np.ndarray, d: float) -> list[np.ndarray]:
    """Heights at which two of the offset lines a-b and the circles of radius d around v meet."""
    out = []
    ab = b - a
    low, high = np.minimum(a, b), np.maximum(a, b)
    for t in _tiles(len(a), len(a)):  # line and line
        near = (low[t, None] <= high[None]).all(-1) & (low[None] <= high[t, None]).all(-1)
        i, j = np.nonzero(near)
        i += t.start
        det = ab[i, 0] * ab[j, 1] - ab[i, 1] * ab[j, 0]
        ok = det != 0
        i, j, det = i[ok], j[ok], det[ok]
        w = a[j] - a[i]
        s, u = (w[:, 0] * ab[j, 1] - w[:, 1] * ab[j, 0]) / det, (w[:, 0] * ab[i, 1] - w[:, 1] * ab[i, 0]) / det
        met = (s >= 0) & (s <= 1) & (u >= 0) & (u <= 1)
        out.append(a[i[met], 1] + s[met] * ab[i[met], 1])
    for t in _tiles(len(a), len(v)):  # line and circle
        i, j = np.nonzero(((low[t, None] - d <= v[None]) & (v[None] <= high[t, None] + d)).all(-1))
        i += t.start
        w = a[i] - v[j]
        qa, qb, qc = (ab[i] ** 2).sum(-1), (w * ab[i]).sum(-1), (w**2).sum(-1) - d * d
        root = np.sqrt(np.maximum(qb * qb - qa * qc, 0))
        for sign in (-1, 1):
            s = (-qb + sign * root) / qa
            met = (qb * qb >= qa * qc) & (s >= 0) & (s <= 1)
            out.append(a[i[met], 1] + s[met] * ab[i[met], 1])
    for t in _tiles(len(v), len(v)):  # circle and circle
        i, j = np.nonzero((np.abs(v[t, None] - v[None]) <= 2 * d).all(-1))
        i += t.start
        w = v[j] - v[i]
        far = (w**2).sum(-1)
        met = (far > 0) & (far <= 4 * d * d)
        i, w, far = i[met], w[met], far[met]
        side = np.sqrt(np.maximum(d * d / far - 0.25, 0)) * w[:, 0]
        mid = v[i, 1] + w[:, 1] / 2
        out += [mid - side, mid + side]
    return out


def eroded_area(e: np.ndarray, d: float) -> float:
    """Area of the points inside a polygon at least ``d`` > 0 from its boundary, exact but for rounding.

    ``e`` holds edges (x1, y1, x2, y2). The points nearer than d are discs around the corners and strips along the edges.
    Between two heights at which such curves end, turn or meet, the free part of every horizontal line lies between the
    same curves, which are offset lines and arcs: each such slab is integrated in closed form.
    """
    e = e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]
    if not len(e):
        return 0.0
    e = e - np.tile(e[0, :2], 2)
    p, q = e[:, :2], e[:, 2:]
    v = np.unique(np.concatenate((p, q)), axis=0)
    along = (q - p) / np.hypot(*(q - p).T)[:, None]
    off = d * np.stack((-along[:, 1], along[:, 0]), axis=1)
    a, b = np.concatenate((p + off, p - off)), np.concatenate((q + off, q - off))
    heights = np.unique(np.concatenate([v[:, 1], v[:, 1] - d, v[:, 1] + d, a[:, 1], b[:, 1], *_crossings(v, a, b, d)]))
    heights = heights[(heights >= v[:, 1].min()) & (heights <= v[:, 1].max())]
    y0, y1 = heights[:-1], heights[1:]
    total, step = 0.0, max(1, PAIRS // (4 * len(e)))
    for t in range(0, len(y0), step):
        total += _slabs(p, q, v, along, d, y0[t : t + step], y1[t : t + step])
    return float(total)


def _slabs(p: np.ndarray, q: np.ndarray, v: np.ndarray, along: np.ndarray, d: float, y0: np.ndarray, y1: np.ndarray) -> float:
    bottom, top = y0[0], y1[-1]
    near = (np.minimum(p[:, 1], q[:, 1]) <= top + d) & (np.maximum(p[:, 1], q[:, 1]) >= bottom - d)
    p, q, along, v = p[near], q[near], along[near], v[(v[:, 1] <= top + d) & (v[:, 1] >= bottom - d)]
    y, dy = ((y0 + y1) / 2)[:, None], y1 - y0
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.sqrt(d * d - (y - v[:, 1]) ** 2)  # not a number where the disc does not reach
        # strip of an edge: 0 <= place along it <= its length, -d <= place across it <= d
        ux, uy = along.T
        ahead = (y - p[:, 1]) * uy
        reach = np.hypot(*(q - p).T)
        ends = np.sort(np.stack((p[:, 0] - ahead / ux, p[:, 0] + (reach - ahead) / ux)), axis=0)
        beside = (y - p[:, 1]) * ux
        sides = np.sort(np.stack((p[:, 0] + (beside - d) / uy, p[:, 0] + (beside + d) / uy)), axis=0)
        ends[:, :, ux == 0] = np.where((0 <= ahead) & (ahead <= reach), np.array([-np.inf, np.inf])[:, None, None], np.nan)[:, :, ux == 0]
        sides[:, :, uy == 0] = np.where(np.abs(beside) <= d, np.array([-np.inf, np.inf])[:, None, None], np.nan)[:, :, uy == 0]
        low = np.concatenate((v[:, 0] - h, np.maximum(ends[0], sides[0])), axis=1)
        high = np.concatenate((v[:, 0] + h, np.minimum(ends[1], sides[1])), axis=1)
        empty = ~(low < high)
    low[empty], high[empty] = np.inf, -np.inf
    order = np.argsort(low, axis=1)
    rows = np.arange(len(y))[:, None]
    low, high = low[rows, order], high[rows, order]
    reached = np.maximum.accumulate(high, axis=1)
    last = np.maximum.accumulate(np.where(high >= reached, np.arange(high.shape[1]), 0), axis=1)
    s, k = np.nonzero((low[:, 1:] > reached[:, :-1]) & np.isfinite(low[:, 1:]))
    if not len(s):
        return 0.0
    left, right = order[s, last[s, k]], order[s, k + 1]
    x_left, x_right = reached[s, k], low[s, k + 1]
    inside = np.zeros(len(s), dtype=bool)
    for t in _tiles(len(s), len(p)):
        at = y[s[t]]
        cross = (p[:, 1] > at) != (q[:, 1] > at)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = p[:, 0] + (at - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
        inside[t] = (cross & (x < ((x_left + x_right) / 2)[t, None])).sum(axis=1) % 2 == 1
    s, left, right, x_left, x_right = s[inside], left[inside], right[inside], x_left[inside], x_right[inside]

    def under(curve: np.ndarray, x: np.ndarray, side: int) -> np.ndarray:
        """Integral of a curve's x over its slab: an arc of a disc, or a line, which is at its mean in the middle."""
        out = x * dy[s]
        arc = curve < len(v)
        c = v[curve[arc]]
        part = lambda u: (u * np.sqrt(np.maximum(d * d - u * u, 0)) + d * d * np.arcsin(np.clip(u / d, -1, 1))) / 2
        out[arc] = c[:, 0] * dy[s[arc]] + side * (part(y1[s[arc]] - c[:, 1]) - part(y0[s[arc]] - c[:, 1]))
        return out

    return float((under(right, x_right, -1) - under(left, x_left, 1)).sum())


def _with_areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last two columns, flat edge coordinates and distance, by the area left; equal ones are measured once while remembered."""
    known: dict[tuple[bytes, float], float] = {}

    def area(e: np.ndarray, d: float) -> float:
        key = (e.tobytes(), d)
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = eroded_area(e.reshape(-1, 4), d)
        return known[key]

    for batch in batches:
        *rest, coords, dist = batch.columns
        areas = [None if not e.is_valid or d is None else area(np.asarray(e.values), d) for e, d in zip(coords, dist.to_pylist())]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(areas, pa.float64())], names=[*batch.schema.names[:-2], "eroded"])


def eroded_areas(lots: DataFrame, planar: str, d: Column) -> DataFrame:
    """Add ``eroded`` and ``eroded_method``: area of a planar geometry that is left ``d`` or more from its boundary.

    Convex lots are column expressions; only others, with d > 0, go to the Arrow function, as a branch of their own.
    """
    flat = lots.withColumn("_d", F.abs(d)).withColumn("_convex", F.expr(G.is_convex_polygon(planar)) | (F.col("_d") == 0))
    exact = F.when(F.col("_d") == 0, F.expr(G.planar_area(planar))).otherwise(F.expr(G.convex_inset_area(f"get(get({planar}, 0), 0)", "_d")))
    one = flat.where("_convex").withColumn("eroded", exact).withColumn("eroded_method", F.lit("convex"))
    coords = f"flatten(transform({G.edges(planar)}, e -> array(e.x1, e.y1, e.x2, e.y2)))"
    bent = flat.where("NOT coalesce(_convex, false)").select(*lots.columns, F.expr(coords).alias("_e"), "_d")
    other = bent.mapInArrow(_with_areas, StructType([*lots.schema.fields, StructField("eroded", DoubleType())])).withColumn("eroded_method", F.lit("slabs"))
    return one.drop("_d", "_convex").unionByName(other)


def inset_areas(parcels: DataFrame, inset_m: Column) -> DataFrame:
    """Add ``inset_area_m2`` and ``inset_method``: the equal-area square metres left after an
    inward buffer, null where nothing is left."""
    out = eroded_areas(parcels.withColumn("_p", F.expr(G.project("geom"))).withColumn("_in", inset_m), "_p", F.col("_in"))
    left = F.when(F.col("eroded") > 0, F.col("eroded"))
    return out.withColumn("inset_area_m2", left).withColumnRenamed("eroded_method", "inset_method").drop("_p", "_in", "eroded")


# Texts of the envelope block.
LABEL = "approximate conceptual envelope"
UNAVAILABLE = (
    "Buildable envelope could not be computed for this parcel "
    "(parcel geometry unavailable or too small after setbacks)."
)
ASSUME_INSET = "Uniform inward setback of %s ft applied to the parcel polygon as an approximation."
ASSUME_AREA = (
    "Buildable area is measured on the parcel geography; it does not model "
    "the primary dwelling footprint, lot coverage limits, or floor-area "
    "ratio."
)
LIMITS = [
    "Approximate conceptual envelope only. Not a survey and not a site plan.",
    "Does not account for easements, slopes, utilities, trees, HOA, title, "
    "or existing structures.",
    "Parcel edge orientation (front / side / rear) is unknown; a single "
    "uniform setback was applied. Per-edge setbacks require professional "
    "review.",
]


def compact_number(c: Column) -> Column:
    """Shortest decimal text of a setback, without a trailing ``.0``."""
    return F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")


def envelope_block(area_m2: Column, inset_ft: Column) -> Column:
    """Envelope document; available only when some area is left. Orientation is never known,
    so an available envelope always calls for review."""
    ok = area_m2.isNotNull()
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    ft = compact_number(inset_ft)
    method = F.concat(
        F.lit("Inward buffer by "), F.format_string("%.4f", V.feet_to_meters(inset_ft)), F.lit(" m ("), ft,
        F.lit(" ft) on the equal-area parcel polygon, then its area."),
    )
    return F.struct(
        ok.alias("available"), F.lit(LABEL).alias("label"), F.when(ok, method).alias("method"),
        F.when(ok, F.bround(V.sqm_to_sqft(area_m2), 1)).alias("buildable_area_sqft"),
        F.when(ok, F.array(F.replace(F.lit(ASSUME_INSET), F.lit("%s"), ft), F.lit(ASSUME_AREA)))
        .otherwise(F.array().cast("array<string>")).alias("assumptions"),
        F.when(ok, arr(*LIMITS)).otherwise(arr(UNAVAILABLE)).alias("limitations"),
    )
