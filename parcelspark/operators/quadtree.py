"""Quadtree pieces of polygons: spatial predicates become equi-joins on cells.

Every feature is cut up by recursive halving of square cells until a cell holds few of its edges. The cells of one feature
do not overlap, so a point meets a feature in exactly one of them, and a cell in the feature's interior carries no edges at
all. Cells are half open; their size is 2**-level degrees, and a feature begins at the finest level at which its box lies
in two cells an axis, so it has four roots at most, whatever its size.

A piece decides a point test without the rest of the boundary. An even-odd ray towards +x meets edges in the cell, which
the piece holds unchanged, and edges right of it. Of the latter only the heights of their ends matter, and an end shared by
two of them cancels out: what is left are the few ``steps`` inside the cell's strip and one ``flip`` for ends above it. No
new coordinate is computed, so tests on pieces give what tests on whole polygons give.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame

from parcelspark.functions import geometry as G
from parcelspark.session import cut

COARSEST, DEEPEST = -8, 12  # cell sides of 256 degrees to 2**-12 degrees
PIECE_EDGES = 16  # a cell with more edges is halved
EVERY_LEVEL = list(range(COARSEST, DEEPEST + 1))
WIDE = -1  # tile of cells that are larger than tiles


def cell_key(level: str | int, cx: str, cy: str) -> str:
    """One long per cell: level, column, row."""
    half = 1 << 27
    return f"(CAST({level} AS long) * {1 << 56} + (CAST({cx} AS long) + {half}) * {1 << 28} + (CAST({cy} AS long) + {half}))"


def tile_key(level: str | int, cx: str, cy: str, tile_level: int) -> str:
    """Tile of a cell: its ancestor at ``tile_level``; ``WIDE`` for coarser cells."""
    up = lambda c: f"shiftright(CAST({c} AS long), CAST(greatest({level} - {tile_level}, 0) AS int))"
    return f"IF({level} < {tile_level}, {WIDE}L, {cell_key(tile_level, up(cx), up(cy))})"


def root_level(bbox: str, pad_x: str = "0D", pad_y: str = "0D") -> str:
    """Finest level at which the padded box lies in at most two cells an axis."""
    width = f"greatest({bbox}.xmax - {bbox}.xmin + 2 * {pad_x}, {bbox}.ymax - {bbox}.ymin + 2 * {pad_y}, 1e-9D)"
    return f"CAST(least({DEEPEST}, greatest({COARSEST}, floor(-log2({width})))) AS int)"


def box_cells(level: str, bbox: str, pad_x: str = "0D", pad_y: str = "0D") -> str:
    """``array<struct<cx,cy>>``: cells of one level under the padded box."""
    span = lambda lo, hi, pad: f"sequence(floor(({bbox}.{lo} - {pad}) * pow(2D, {level})), floor(({bbox}.{hi} + {pad}) * pow(2D, {level})))"
    rows = lambda cx: f"transform({span('ymin', 'ymax', pad_y)}, {G.fn(lambda cy: G.struct(cx=cx, cy=cy))})"
    return f"flatten(transform({span('xmin', 'xmax', pad_x)}, {G.fn(rows)}))"


def _odd_once(sorted_ends: str) -> str:
    """Values that occur an odd number of times, once each."""
    start = "named_struct('last', CAST(NULL AS double), 'odd', false, 'out', CAST(array() AS array<double>))"
    kept = lambda a: f"IF({a}.odd, concat({a}.out, array({a}.last)), {a}.out)"
    step = lambda a, y: f"IF({a}.last <=> {y}, named_struct('last', {y}, 'odd', NOT {a}.odd, 'out', {a}.out), named_struct('last', {y}, 'odd', true, 'out', {kept(a)}))"
    return f"aggregate({sorted_ends}, {start}, {G.fn(step)}, {G.fn(kept)})"


def _localized(df: DataFrame, pad_x: str, pad_y: str, areas: bool) -> DataFrame:
    """What cells keep of the edges, steps and rings they were given; cells wholly outside go."""
    top = "(_y0 + _s)"
    near = lambda e: (
        f"greatest({e}.x1, {e}.x2) >= _x0 - {pad_x} AND least({e}.x1, {e}.x2) <= _x0 + _s + {pad_x} "
        f"AND greatest({e}.y1, {e}.y2) >= _y0 - {pad_y} AND least({e}.y1, {e}.y2) <= {top} + {pad_y}"
    )
    right = lambda e: f"least({e}.x1, {e}.x2) > _x0 + _s AND greatest({e}.y1, {e}.y2) > _y0 AND least({e}.y1, {e}.y2) < {top} AND NOT ({near(e)})"
    ends = f"concat(steps, flatten(transform(filter(edges, {G.fn(right)}), {G.fn(lambda e: f'array({e}.y1, {e}.y2)')})))"
    clip = lambda r: G.struct(sign=f"{r}.sign", pts=G.clip_to_box(f"{r}.pts", "_x0", "_y0", "(_x0 + _s)", top))
    rest = [c for c in df.columns if c not in ("edges", "steps", "flip", "rings")]
    inside = G.fn(lambda y: f"{y} > _y0 AND {y} < {top}")
    above = f"size(filter(_ends, {G.fn(lambda y: f'{y} >= {top}')})) % 2 = 1"
    df = df.selectExpr("*", f"{ends} AS _ends").selectExpr(
        *rest, f"flip != ({above}) AS flip", f"filter(edges, {G.fn(near)}) AS edges", f"{_odd_once(f'array_sort(filter(_ends, {inside}))')} AS steps",
        *([f"filter(transform(rings, {G.fn(clip)}), {G.fn(lambda r: f'size({r}.pts) > 3')}) AS rings"] if areas else []),
    )
    return df.where(f"size(edges) > 0 OR {parity('', '_y0 + _s / 2')}")


def parity(f: str, y: str) -> str:
    """Parity at height ``y`` of all edges right of a piece's cell; of the whole boundary where it has no edges."""
    return f"({f}flip != (size(filter({f}steps, {G.fn(lambda v: f'{v} > {y}')})) % 2 = 1))"


def pieces(df: DataFrame, pad_x: str = "0D", pad_y: str = "0D", areas: bool = False, tile_level: int = 2) -> DataFrame:
    """Pieces of features with ``edges``, ``bbox`` and, for ``areas``, ``geom``; other columns stay.

    Adds level, cell, tile, x0, y0, side and full (no edges: the cell is wholly inside); ``edges`` are those within the
    padding of the cell. With ``areas`` the signed ``rings`` cut to the cell come along, whose areas add up over cells.

    Each round halves the cells of all features that still have many edges and writes the result, so a boundary of any
    length is soon dealt with by many tasks; layers of small features have no rounds.
    """
    keep = [c for c in df.columns if c not in ("edges", "bbox", "geom")]
    pads = [pad_x, pad_y]
    if pads != ["0D", "0D"]:
        df, pads = df.selectExpr("*", f"{pad_x} AS _px", f"{pad_y} AS _py"), ["_px", "_py"]
        keep = [*keep, "_px", "_py"]
    rooted = df.selectExpr(*keep, "edges", "bbox", *([f"{G.rings('geom')} AS rings"] if areas else []), f"{root_level('bbox', *pads)} AS _lv")
    shape = ["edges", "steps", "flip", *(["rings"] if areas else [])]
    cells = rooted.selectExpr(*keep, "edges", *(["rings"] if areas else []), "CAST(array() AS array<double>) AS steps", "false AS flip", "_lv", f"explode({box_cells('_lv', 'bbox', *pads)}) AS _c")
    at = lambda d, lv, cx, cy: d.selectExpr(*keep, *shape, f"{lv} AS _lv", f"{cx} AS _cx", f"{cy} AS _cy", f"pow(2D, -{lv}) AS _s").selectExpr("*", "_cx * _s AS _x0", "_cy * _s AS _y0")
    grown = cut(_localized(at(cells, "_lv", "_c.cx", "_c.cy"), *pads, areas))
    quarter = lambda i, j: G.struct(lv="_lv + 1", cx=f"2 * _cx + {i}", cy=f"2 * _cy + {j}")
    quarters = ", ".join(quarter(i, j) for i in (0, 1) for j in (0, 1))
    large, done = f"size(edges) > {PIECE_EDGES} AND _lv < {DEEPEST}", []
    for _ in range(DEEPEST - COARSEST):
        if grown.where(large).isEmpty():
            break
        done.append(grown.where(f"NOT ({large})"))
        step = grown.where(large).selectExpr(*keep, *shape, f"explode(array({quarters})) AS _c")
        grown = cut(_localized(at(step, "_c.lv", "_c.cx", "_c.cy"), *pads, areas).repartition("_cx", "_cy"))
    out = reduce(DataFrame.unionByName, [*done, grown])
    keep = [c for c in keep if c not in ("_px", "_py")]
    return out.selectExpr(
        *keep, "_lv AS level", f"{cell_key('_lv', '_cx', '_cy')} AS cell", f"{tile_key('_lv', '_cx', '_cy', tile_level)} AS tile",
        "_x0 AS x0", "_y0 AS y0", "_s AS side", "size(edges) = 0 AS full", *shape,
    )


def ancestors(pieces_: DataFrame, tile_level: int) -> DataFrame:
    """``above, cell, tile``: every coarser cell that holds a piece's cell. Narrow; no geometry."""
    own = pieces_.selectExpr("level", "cell", "tile", "CAST(floor(x0 / side) AS long) AS cx", "CAST(floor(y0 / side) AS long) AS cy").distinct()
    up = lambda lv, c: f"shiftright({c}, CAST(level - {lv} AS int))"
    keys = f"transform(sequence({COARSEST}, level - 1), {G.fn(lambda lv: cell_key(lv, up(lv, 'cx'), up(lv, 'cy')))})"
    return own.where(f"level > {COARSEST}").selectExpr(f"explode({keys}) AS above", "cell", "tile")


def point_cells(points: DataFrame, levels: list[int], tile_level: int, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row for each point and level in use, with the ``cell`` and ``tile`` it lies in."""
    at = lambda c, lv: f"floor({c} * {G.num(2.0**lv)})"
    keys = ", ".join(G.struct(c=cell_key(lv, at(x, lv), at(y, lv)), t=tile_key(lv, at(x, lv), at(y, lv), tile_level)) for lv in levels)
    # cells exist for places on the globe; the bounds also mark this side as selective for partition pruning
    real = points.where(f"{x} BETWEEN -180 AND 180 AND {y} BETWEEN -90 AND 90")
    return real.selectExpr("*", f"explode(array({keys})) AS _k").selectExpr("*", "_k.c AS cell", "_k.t AS tile").drop("_k")


def polygon_cells(polygons: DataFrame, levels: list[int], above: DataFrame, tile_level: int) -> DataFrame:
    """One row for each polygon (with ``bbox``) and each cell of a layer that may hold a piece meeting it.

    Pieces as large as the polygon's roots or larger are found by the polygon's own cells at their levels, smaller ones
    through the ancestors of their cells.
    """
    known = polygons.where("bbox.xmin >= -180 AND bbox.xmax <= 180").selectExpr("*", f"{root_level('bbox')} AS _lv")
    names = polygons.columns
    of_level = lambda lv: f"transform({box_cells(lv, 'bbox')}, {G.fn(lambda c: G.struct(c=cell_key(lv, f'{c}.cx', f'{c}.cy'), t=tile_key(lv, f'{c}.cx', f'{c}.cy', tile_level)))})"
    own = f"flatten(transform(filter(array({', '.join(map(str, levels))}), {G.fn(lambda lv: f'{lv} <= _lv')}), {G.fn(of_level)}))"
    found = known.selectExpr(*names, f"explode({own}) AS _k").selectExpr(*names, "_k.c AS cell", "_k.t AS tile")
    if max(levels, default=COARSEST) <= COARSEST:
        return found
    roots = f"transform({box_cells('_lv', 'bbox')}, {G.fn(lambda c: cell_key('_lv', f'{c}.cx', f'{c}.cy'))})"
    larger = known.where(f"_lv < {max(levels)}").selectExpr(*names, f"explode({roots}) AS above")
    return found.unionByName(larger.join(above, "above").drop("above"))


def _piece_covers(f: str, x: str, y: str) -> str:
    return f"({G.on_boundary(f'{f}edges', x, y)} OR {parity(f, y)} != {G.ray_parity(f'{f}edges', x, y)})"


def contains_point(x: str = "lon", y: str = "lat") -> str:
    """Point of the piece's cell strictly inside the feature."""
    return f"({parity('', y)} != {G.ray_parity('edges', x, y)} AND NOT {G.on_boundary('edges', x, y)})"


def covers_point(x: str = "lon", y: str = "lat") -> str:
    """Point of the piece's cell inside the feature or on its boundary."""
    return _piece_covers("", x, y)


def meets_piece(p: str = "p", f: str = "f") -> str:
    """A polygon shares a point with a piece: its part of a feature, in its cell.

    Boundaries that cross do so in some cell that holds both edges; else a polygon's corner lies in the feature and in the
    cell, or a corner of the feature, held by some piece, in the polygon. A full cell is all feature.
    """
    x1, y1 = f"({f}.x0 + {f}.side)", f"({f}.y0 + {f}.side)"
    corners = [(f"{f}.x0", f"{f}.y0"), (x1, f"{f}.y0"), (x1, y1), (f"{f}.x0", y1)]
    frame = "array(" + ", ".join(G.struct(x1=a[0], y1=a[1], x2=b[0], y2=b[1]) for a, b in zip(corners, corners[1:] + corners[:1])) + ")"
    in_cell = lambda s: f"{s}.x1 >= {f}.x0 AND {s}.x1 < {x1} AND {s}.y1 >= {f}.y0 AND {s}.y1 < {y1}"
    own = lambda s: f"{in_cell(s)} AND {_piece_covers(f'{f}.', f'{s}.x1', f'{s}.y1')}"
    around = lambda s: G.covers(f"{p}.edges", f"{s}.x1", f"{s}.y1")
    in_full = f"exists({p}.edges, {G.fn(in_cell)}) OR {G.edges_touch(f'{p}.edges', frame)} OR {G.covers(f'{p}.edges', f'{f}.x0', f'{f}.y0')}"
    cut = f"exists({p}.edges, {G.fn(own)}) OR {G.edges_touch(f'{p}.edges', f'{f}.edges')} OR exists({f}.edges, {G.fn(around)})"
    return f"IF({f}.full, {in_full}, {cut})"


def undivided(p: str = "p", f: str = "f") -> str:
    """No boundary of the feature comes near a polygon of the piece's cell, which so is wholly inside or wholly outside.

    All edges that meet the cell are held by the piece, so the boxes of its few edges decide.
    """
    inside = f"{p}.bbox.xmin >= {f}.x0 AND {p}.bbox.xmax < {f}.x0 + {f}.side AND {p}.bbox.ymin >= {f}.y0 AND {p}.bbox.ymax < {f}.y0 + {f}.side"
    near = lambda e: (
        f"greatest({e}.x1, {e}.x2) >= {p}.bbox.xmin AND least({e}.x1, {e}.x2) <= {p}.bbox.xmax "
        f"AND greatest({e}.y1, {e}.y2) >= {p}.bbox.ymin AND least({e}.y1, {e}.y2) <= {p}.bbox.ymax"
    )
    return f"({inside} AND NOT exists({f}.edges, {G.fn(near)}))"


def holds_start(p: str = "p", f: str = "f") -> str:
    """An undivided polygon lies in the feature: its first corner does."""
    x, y = (f"get({p}.edges, 0).{k}1" for k in "xy")
    return f"({parity(f'{f}.', y)} != {G.ray_parity(f'{f}.edges', x, y)})"


def near_piece(p: str = "p", f: str = "f") -> str:
    """The polygon's box meets the piece's cell, border included."""
    return f"{p}.bbox.xmin <= {f}.x0 + {f}.side AND {p}.bbox.xmax >= {f}.x0 AND {p}.bbox.ymin <= {f}.y0 + {f}.side AND {p}.bbox.ymax >= {f}.y0"


def _spread_step(shift: int, mask: int, v: str) -> str:
    return f"(({v} | shiftleft({v}, {shift})) & {mask}L)"


def morton(x: str, y: str) -> str:
    """Place of a point on a Z-order curve over cells of the deepest level."""

    def spread(v: str) -> str:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = G.let(v, partial(_spread_step, shift, mask))
        return v

    at = lambda c, half: f"CAST(floor(({c} + {half}) * {2**DEEPEST}D) AS long)"
    return f"({spread(at(x, '180D'))} | shiftleft({spread(at(y, '90D'))}, 1))"
