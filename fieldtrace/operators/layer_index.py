"""Layers of any size, as tables: polygons found through cells and bands, nearest features through rings of cells.

A polygon part is listed in the cells of a grid that suits its size, so in about a hundred at most. A cell that no edge
comes near is inside or outside as a whole; in the others a point is tested against the edges of the part in that row of
cells, polygon after polygon until one holds it. Both tests are those of the literal plans for small layers, edge by edge, with equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.groups import whole_groups
from fieldtrace.functions.shapes import Shape, parse, to_degrees
from fieldtrace.operators.spatial import project_point
from fieldtrace.sources.scratch import written

#: Points of a cell, and pieces of features around it, that meet in one task; how many of the points are bounded as one.
CELL_POINTS, CELL_PIECES, _BLOCK = 65_536, 16_384, 256
#: Pairs of points and polygons, or of points and edges, that are looked at once; edges up to which a polygon in a cell is tested beside others.
_PAIRS, _FEW_EDGES = 1_048_576, 64


@dataclass(frozen=True)
class LayerTable:
    """A layer as a table: ``layer_no`` (its order, unique), ``name``, ``kind`` (may be null), ``geometry`` (text in EPSG:``crs``)."""

    df: DataFrame
    crs: int = 4326

    def shapes(self, crs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, str | None, str | None, Shape]]]:
        """Reads features inside tasks; vertices in EPSG:``crs`` (4326 for degrees)."""
        own = self.crs

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, str | None, Shape]]:
            for b in batches:
                for r in b.to_pylist():
                    if r["geometry"] is not None:
                        shape = to_degrees(parse(r["geometry"]), own)
                        yield r["layer_no"], r["name"], r["kind"], shape if crs == 4326 else shape.moved(lambda x, y: project_point(x, y, crs))

        return read


def _edges(rings: tuple) -> np.ndarray:
    """``x1, y1, x2, y2`` of every edge of closed rings."""
    out = [np.hstack([v, np.vstack([v[1:], v[:1]])])[: len(v) - (ring[0] == ring[-1])] for ring in rings for v in [np.array(ring, float)]]
    return np.concatenate(out) if out else np.empty((0, 4))


def _inside(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = e[e[:, 1] != e[:, 3]].T
    x, y = x[:, None], y[:, None]
    return np.count_nonzero(((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), axis=1) % 2 == 1


def _cover(e: np.ndarray, buffer: float) -> tuple[int, np.ndarray]:
    """The level of a part's grid and its cells there: ``cx, cy, inside``."""
    low, high = np.minimum(e[:, :2], e[:, 2:]) - buffer, np.maximum(e[:, :2], e[:, 2:]) + buffer
    extent = float((high.max(0) - low.min(0)).max())
    level = int(np.ceil(np.log2(extent / 8))) if extent > 0 else -40
    size = 2.0**level
    # A cell more on each side: rounding in the division can't lose a point that lies on an edge.
    first, last = np.floor((low - size * 1e-9) / size).astype(np.int64), np.floor((high + size * 1e-9) / size).astype(np.int64)
    crossed = {(cx, cy) for (ax, ay), (bx, by) in zip(first.tolist(), last.tolist(), strict=True) for cx in range(ax, bx + 1) for cy in range(ay, by + 1)}
    cells = [(*c, 0) for c in crossed]
    for cx in range(first[:, 0].min(), last[:, 0].max() + 1):
        free = np.array([cy for cy in range(first[:, 1].min(), last[:, 1].max() + 1) if (cx, cy) not in crossed], np.int64)
        cells += [(cx, cy, 1) for cy in free[_inside(np.full(len(free), (cx + 0.5) * size), (free + 0.5) * size, e)].tolist()]
    return level, np.array(cells, np.int64)


_ENDS = ["x1", "y1", "x2", "y2"]


def _polygon_tables(layer: LayerTable, crs: int, buffer: float) -> tuple[DataFrame, DataFrame]:
    """Cells of all polygon parts, each with the part's edges (four numbers an edge) in its row of cells, and the polygons' names."""
    read = layer.shapes(crs)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, _, _, shape in read(batches):
            for rings in shape.parts if shape.kind == "polygon" else ():
                e = _edges(rings)
                if not len(e):
                    continue
                level, found = _cover(e, buffer)
                size, most = 2.0**level, max(1, _PAIRS // len(e))
                slack = buffer + size * 1e-9
                low, high = np.minimum(e[:, 1], e[:, 3]) - slack, np.maximum(e[:, 1], e[:, 3]) + slack
                for some in np.split(found, range(most, len(found), most)):
                    y = some[:, 1, None] * size  # edges that reach into the cell's row
                    which, edge = np.nonzero((some[:, 2, None] == 0) & (low <= y + size) & (high >= y))
                    edges = pa.ListArray.from_arrays(pa.array(4 * np.searchsorted(which, np.arange(len(some) + 1)), pa.int32()), pa.array(e[edge].ravel()))
                    columns = [pa.repeat(pa.scalar(level, pa.int32()), len(some)), *(pa.array(some[:, k]) for k in (0, 1)), pa.repeat(pa.scalar(no, pa.int64()), len(some)), pa.array(some[:, 2] == 1), edges]
                    yield pa.RecordBatch.from_arrays(columns, ["level", "cx", "cy", "no", "inside", "edges"])

    # Features are few bytes but much work: an even share for every task.
    spread = layer.df.repartition(int(layer.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = spread.mapInArrow(cells, "level int, cx long, cy long, no long, inside boolean, edges array<double>")
    return found, layer.df.select(F.col("layer_no").alias("_no"), F.col("name").alias("_name"))


def _segment(x: Column, y: Column, e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    span = dx * dx + dy * dy
    t = F.when(span > 0, F.least(F.greatest(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.when(span > 0, span), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt((x - (e["x1"] + t * dx)) ** 2 + (y - (e["y1"] + t * dy)) ** 2)


def _edge_tests(x: np.ndarray, y: np.ndarray, e: np.ndarray, buffer: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether a ray from a point crosses an edge, and whether the point is on it or within the buffer of it; ``e`` has its numbers last."""
    x1, y1, x2, y2 = (e[..., k] for k in range(4))
    dx, dy = x2 - x1, y2 - y1
    crossed = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (dx / np.where(dy != 0, dy, 1.0)))
    on = (np.abs((x - x1) * dy - (y - y1) * dx) <= 1e-15) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
    if buffer > 0:
        span = dx * dx + dy * dy
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(span > 0, span, np.inf), 0.0, 1.0)
        on |= np.sqrt((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2) <= buffer
    return crossed, on


def _held(x: np.ndarray, y: np.ndarray, which: np.ndarray, edges: np.ndarray, ends: np.ndarray, buffer: float) -> np.ndarray:
    """Whether polygon ``which`` (its edges end at ``ends``) holds a point: by the parity of crossings, or on an edge, or within the buffer of one."""
    out, count = np.zeros(len(x), bool), np.diff(ends)[which]
    few = np.flatnonzero((count > 0) & (count <= _FEW_EDGES))
    for some in np.split(few, range(_PAIRS // _FEW_EDGES, len(few), _PAIRS // _FEW_EDGES)):
        n = count[some]
        starts = np.cumsum(n) - n
        i = np.repeat(some, n)
        crossed, on = _edge_tests(x[i], y[i], edges[np.arange(len(i)) + np.repeat(ends[which[some]] - starts, n)], buffer)
        if len(some):
            out[some] = (np.add.reduceat(crossed.astype(np.int64), starts) % 2 == 1) | np.logical_or.reduceat(on, starts)
    many = np.flatnonzero(count > _FEW_EDGES)
    many = many[np.lexsort((y[many], which[many]))]
    for mine in np.split(many, np.flatnonzero(np.diff(which[many])) + 1) if len(many) else ():
        e = edges[ends[which[mine[0]]] : ends[which[mine[0]] + 1]]
        low, high = np.minimum(e[:, 1], e[:, 3]) - buffer * (1 + 1e-9), np.maximum(e[:, 1], e[:, 3]) + buffer * (1 + 1e-9)
        for some in np.split(mine, range(_FEW_EDGES, len(mine), _FEW_EDGES)):  # points of a narrow band meet few edges
            near = e[(low <= y[some[-1]]) & (high >= y[some[0]])]
            found = [_edge_tests(x[some, None], y[some, None], near[k : k + _PAIRS // _FEW_EDGES], buffer) for k in range(0, len(near), _PAIRS // _FEW_EDGES)]
            if found:
                out[some] = (sum(np.count_nonzero(c, axis=1) for c, _ in found) % 2 == 1) | np.any([o.any(1) for _, o in found], axis=0)
    return out


def _first_of(x: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, inside: np.ndarray, edges: np.ndarray, ends: np.ndarray, buffer: float) -> np.ndarray:
    """For each point the first of polygons ``first`` to ``last`` that holds it, or -1. More polygons at once are looked at the fewer points are left."""
    best, at, rest = np.full(len(x), -1), first.copy(), np.flatnonzero(first < last)
    boxes = np.tile([[-np.inf], [-np.inf], [np.inf], [np.inf]], len(inside))
    some = np.flatnonzero(np.diff(ends))
    for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
        if len(some):
            boxes[k, some] = f.reduceat(f(edges[:, k % 2], edges[:, k % 2 + 2]), ends[some]) + (-1 if k < 2 else 1) * buffer * (1 + 1e-9)
    while len(rest):
        n = np.minimum(last[rest] - at[rest], max(1, _PAIRS // (4 * len(rest))))
        i = np.repeat(rest, n)
        c = np.arange(len(i)) + np.repeat(at[rest] - np.cumsum(n) + n, n)
        can = np.flatnonzero(inside[c] | ((x[i] >= boxes[0, c]) & (x[i] <= boxes[2, c]) & (y[i] >= boxes[1, c]) & (y[i] <= boxes[3, c])))
        i, c = i[can], c[can]
        hit = inside[c].copy()
        asked = np.flatnonzero(~hit)
        hit[asked] = _held(x[i[asked]], y[i[asked]], c[asked], edges, ends, buffer)
        own, place = np.unique(i[hit], return_index=True)
        best[own] = c[hit][place]
        at[rest] += n
        rest = rest[(best[rest] < 0) & (at[rest] < last[rest])]
    return best


def _first_in_cells(asked: DataFrame, cells: DataFrame, buffer: float) -> DataFrame:
    """``_px, _py, no``: for points in cells the first polygon of the cell that holds one, where any does.

    A cell's points and polygons meet in one task, points of a full cell in several; no row is made for a point and a polygon.
    """
    cell = ["level", "cx", "cy"]
    full = asked.groupBy(*cell).agg(F.floor((F.count(F.lit(1)) - 1) / CELL_POINTS).alias("_last")).filter("_last > 0")
    parted = lambda df, part: df.join(full, cell, "left").withColumn("_part", part).drop("_last")
    last = F.coalesce(F.col("_last"), F.lit(0).cast("long"))
    points = parted(asked, F.pmod(F.xxhash64("_px", "_py"), last + 1)).withColumns({"no": F.lit(None).cast("long"), "edges": F.lit(None).cast("array<double>")})
    held = parted(cells, F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("edges", F.when(~F.col("inside"), F.col("edges")))
    none = F.lit(None).cast("double")
    columns = [*cell, "_part", "_px", "_py", "no", "edges"]
    both = points.select(columns).union(held.withColumns({"_px": none, "_py": none}).select(columns))
    order = Window.partitionBy(*cell, "_part").orderBy(F.col("no").asc_nulls_last())
    rows = both.withColumn("_i", F.row_number().over(order)).select("_px", "_py", "no", "edges", "_i")

    def answered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group, is_point = np.cumsum(t["_i"].to_numpy() == 1), pc.is_null(t["no"]).to_numpy()
        kept = t.filter(pa.array(~is_point))
        lists = kept["edges"].combine_chunks() if kept["edges"].num_chunks != 1 else kept["edges"].chunk(0)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy() // 4
        edges, ends = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), np.append(0, np.cumsum(length))
        asks = t.filter(pa.array(is_point)).select(["_px", "_py"])
        first, stop = (np.searchsorted(group[~is_point], group[is_point], side) for side in ("left", "right"))
        best = _first_of(*(asks[c].to_numpy() for c in ("_px", "_py")), first, stop, pc.is_null(lists).to_numpy(zero_copy_only=False), edges, ends, buffer)
        found = pa.array(best >= 0)
        asks = asks.filter(found).append_column("no", kept["no"].take(pa.array(best[best >= 0])))
        yield from asks.to_batches()

    return rows.mapInArrow(whole_groups(answered), "_px double, _py double, no long")


def _unhidden(cells: DataFrame, levels: list[int]) -> DataFrame:
    """Cells without those that a polygon earlier in order covers whole, in them or in a larger cell around: no point there has them first."""
    up = lambda c, n: F.floor(F.col(c) / F.lit(2.0**n)).cast("long")
    covered = cells.filter("inside").groupBy("level", "cx", "cy").agg(F.min("no").alias("_first"))
    places = cells.select("level", "cx", "cy").distinct()
    above = F.array_compact(F.array(*[F.when(F.col("level") == a, F.struct(F.lit(b).alias("level"), up("cx", b - a).alias("cx"), up("cy", b - a).alias("cy"))) for a in levels for b in levels if b >= a]))
    asked = places.select(*[F.col(c).alias(f"_{c}") for c in ("level", "cx", "cy")], F.explode(above).alias("_c")).select("_level", "_cx", "_cy", "_c.*")
    least = asked.join(covered, ["level", "cx", "cy"]).groupBy("_level", "_cx", "_cy").agg(F.min("_first").alias("_first"))
    kept = cells.join(least.toDF("level", "cx", "cy", "_first"), ["level", "cx", "cy"], "left")
    return kept.filter("_first is null or no < _first or (inside and no = _first)").drop("_first")


def with_polygon(df: DataFrame, x: Column, y: Column, layer: LayerTable, crs: int = 4326, buffer: float = 0) -> DataFrame:
    """Add ``_no, _name``: the first polygon, in layer order, that holds a point or is within ``buffer`` of it; else null.

    ``x, y`` and the buffer are in EPSG:``crs``. Points meet polygons by cell, once for each level that the layer has; equal
    points are looked up once. Where coordinates are null nothing is found. Cells are a written table, as several joins read
    them; a point meets polygons inside a task, in their order, until one holds it.
    """
    cells, names = _polygon_tables(layer, crs, buffer)
    cells = written(cells)
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # exponents of two: a few dozen at most
    marked = df.withColumns({"_px": x, "_py": y})
    if not levels:
        return marked.withColumns({"_no": F.lit(None).cast("long"), "_name": F.lit(None).cast("string")}).drop("_px", "_py")
    cells = _unhidden(cells, levels)
    points = marked.select("_px", "_py").filter("_px is not null and _py is not null").distinct()
    at = lambda v, n: F.floor(F.col(v) / F.lit(2.0**n)).cast("long")
    asked = points.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), at("_px", n).alias("cx"), at("_py", n).alias("cy")) for n in levels]))).select("_px", "_py", "_c.*")
    # The least number alone, as a hash aggregate holds it: a struct with a name would be sorted, candidate by candidate.
    first = _first_in_cells(asked, cells, buffer).groupBy("_px", "_py").agg(F.min("no").alias("_no"))
    return marked.join(first.join(names, "_no"), ["_px", "_py"], "left").drop("_px", "_py")


def _segments(layer: LayerTable, crs: int) -> DataFrame:
    """``no, x1, y1, x2, y2``: points, pieces of paths and edges of polygons."""
    read = layer.shapes(crs)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, _, _, shape in read(batches):
            rings = [np.array(r, float) for r in shape.rings()]
            if shape.kind == "polygon":
                e = _edges(tuple(tuple(map(tuple, r)) for r in rings))
            else:
                e = np.concatenate([np.hstack([v[:-1], v[1:]]) if len(v) > 1 else np.hstack([v, v]) for v in rings]) if rings else np.empty((0, 4))
            n = len(e)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(no, pa.int64()), n), *(pa.array(np.ascontiguousarray(e[:, i])) for i in range(4))], ["no", *_ENDS])

    return layer.df.mapInArrow(listed, "no long, x1 double, y1 double, x2 double, y2 double")


def _pieces(segments: DataFrame, size: float) -> DataFrame:
    """Each segment in the cells that it may pass: those around pieces of it that are no longer than a cell."""
    along = lambda a, k: F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * (k / F.col("_n"))
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / size), F.lit(1))
    cut = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    low = lambda a: F.floor(F.least(along(a, F.col("_i") - 1), along(a, F.col("_i"))) / size)
    high = lambda a: F.floor(F.greatest(along(a, F.col("_i") - 1), along(a, F.col("_i"))) / size)
    return cut.withColumn("cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y")))).drop("_n", "_i").distinct()


def _nearest_piece(at: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each point the place of the nearest piece in ``e``, the first of equally near ones.

    Blocks of points near each other meet only pieces that can be nearest to one of them: those whose box is not further
    from the block's box than the block's furthest corner is from an end of some piece.
    """
    strips = max(1, int((len(at) / _BLOCK) ** 0.5))
    strip = np.empty(len(at), np.int64)
    strip[np.argsort(at[:, 0])] = np.arange(len(at)) * strips // len(at)
    order, found = np.lexsort((at[:, 1], strip)), np.empty(len(at), np.int64)
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    for b in np.split(order, range(_BLOCK, len(at), _BLOCK)):
        p = at[b]
        first, last = p.min(0), p.max(0)
        least = np.hypot(*np.maximum(np.maximum(low - last, first - high), 0).T)
        most = np.minimum(*(np.hypot(*np.maximum(np.abs(v - first), np.abs(v - last)).T) for v in (e[:, :2], e[:, 2:]))).min()
        can = np.flatnonzero(least <= most * (1 + 1e-9) + 1e-9)
        best = np.full(len(p), np.inf)
        for some in np.split(can, range(2048, len(can), 2048)):
            x1, y1, x2, y2 = e[some].T
            dx, dy, x, y = x2 - x1, y2 - y1, p[:, :1], p[:, 1:]
            span = dx * dx + dy * dy
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(span > 0, span, np.inf), 0.0, 1.0)
            d = np.sqrt((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2)
            i = d.argmin(1)
            less = d[np.arange(len(p)), i] < best
            best[less], found[b[less]] = d[less, i[less]], some[i[less]]
    return found


def _met(rest: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """``_qx, _qy, no, d``: for each point of ``rest`` the nearest piece in its cell and the eight around it, if they hold one.

    A cell's points and pieces meet in parts of bounded size; a row is made for a point and a part, not for a pair.
    """
    cell = [F.floor(F.col(f"_q{a}") / size).alias(f"c{a}") for a in "xy"]
    points = rest.select("_qx", "_qy", *cell)
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    pieces = _pieces(segments, size).select("no", *_ENDS, around.alias("_c")).select("no", *_ENDS, "_c.*").distinct()
    shares = lambda df, most, name: df.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    both = shares(points, CELL_POINTS, "_parts").join(shares(pieces, CELL_PIECES, "_chunks"), ["cx", "cy"])
    keys = ["cx", "cy", "_part", "_chunk"]
    dealt = lambda df, by, own, ofs, other, n: df.join(both, ["cx", "cy"]).withColumns({own: F.pmod(F.xxhash64(*by), ofs), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))}).drop("_parts", "_chunks")
    points = dealt(points, ["_qx", "_qy"], "_part", F.col("_parts"), "_chunk", "_chunks")
    pieces = dealt(pieces, ["no", *_ENDS], "_chunk", F.col("_chunks"), "_part", "_parts")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({c: pa.array([], pa.int64() if c == "no" else pa.float64()) for c in ["_qx", "_qy", "no", *_ENDS]})
        right = right.sort_by("no").select(["no", *_ENDS])
        found = _nearest_piece(*(np.column_stack([t.column(c).to_numpy() for c in names]) for t, names in ((left, ["_qx", "_qy"]), (right, _ENDS))))
        taken = right.take(pa.array(found))
        return pa.table({"_qx": left.column("_qx"), "_qy": left.column("_qy"), **{c: taken.column(c) for c in taken.column_names}})

    met = points.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(nearest, "_qx double, _qy double, no long, x1 double, y1 double, x2 double, y2 double")
    # The distance that is given is the usual expression's.
    d = _segment(F.col("_qx"), F.col("_qy"), F.struct(*_ENDS))
    return met.select("_qx", "_qy", F.struct(d.alias("d"), "no").alias("_best")).groupBy("_qx", "_qy").agg(F.min("_best").alias("_best")).select("_qx", "_qy", F.col("_best.no").alias("_no"), F.col("_best.d").alias("_d"))


def with_nearest(df: DataFrame, x: Column, y: Column, layer: LayerTable, crs: int) -> DataFrame:
    """Add ``_no, _name, _kind, _d``: the nearest feature in EPSG:``crs`` and its distance, 0 inside a polygon; ties by layer order.

    Points look at their cell and the eight around it; those whose best is not surely nearest look again at cells four
    times as wide, until the block of cells holds the whole layer or no point is left. Points far from a cluster of features
    meet it inside tasks, block by block. A round is written, as the next one and the result both read it.
    """
    marked = df.withColumns({"_qx": x, "_qy": y})
    points = marked.select("_qx", "_qy").filter("_qx is not null and _qy is not null").distinct()
    held = written(with_polygon(points, F.col("_qx"), F.col("_qy"), layer, crs))
    inside = held.filter("_no is not null").select("_qx", "_qy", "_no", F.lit(0.0).alias("_d"))
    segments = written(_segments(layer, crs))
    low, high = (segments.agg(*[f(g(f"{a}1", f"{a}2")) for a in "xy"], F.count(F.lit(1))).first() for f, g in ((F.min, F.least), (F.max, F.greatest)))
    done, rest = [inside], held.filter("_no is null").select("_qx", "_qy")
    if low[0] is not None:
        ends = rest.agg(*[F.max(F.greatest(F.abs(F.col(f"_q{a}") - lo), F.abs(F.col(f"_q{a}") - hi))) for a, lo, hi in zip("xy", low, high, strict=False)]).first()
        furthest = max(v or 0.0 for v in ends)
        size = 2.0 ** int(np.ceil(np.log2(max(high[0] - low[0], high[1] - low[1], 1e-6) / max(1.0, (low[2] / 64) ** 0.5))))  # cells of about 64 pieces
        while not rest.isEmpty():
            tried = written(rest.join(_met(rest, segments, size), ["_qx", "_qy"], "left").withColumn("_sure", F.coalesce(F.col("_d") <= size, F.lit(False)) | F.lit(size >= furthest)))
            done.append(tried.filter("_sure").drop("_sure"))
            rest, size = tried.filter("not _sure").select("_qx", "_qy"), size * 4
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    names = layer.df.select(F.col("layer_no").alias("_no"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    return marked.join(found.join(names, "_no", "left"), ["_qx", "_qy"], "left").drop("_qx", "_qy")
