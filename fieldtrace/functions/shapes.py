"""Geometries of small layers: points, paths and polygons with holes, of one part or many."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrace.functions import geo

Point = tuple[float, float]


@dataclass(frozen=True)
class Shape:
    """``kind`` is point, line or polygon. A part is a list of rings (the first one outer, the rest holes); points and lines have one ring a part."""

    kind: str
    parts: tuple[tuple[tuple[Point, ...], ...], ...]

    def moved(self, f: Callable[[float, float], Point]) -> Shape:
        return Shape(self.kind, tuple(tuple(tuple(f(*p) for p in ring) for ring in part) for part in self.parts))

    def rings(self) -> Iterator[tuple[Point, ...]]:
        return (ring for part in self.parts for ring in part)


def polygon(ring: list[Point], *holes: list[Point]) -> Shape:
    return Shape("polygon", (tuple(tuple(map(tuple, r)) for r in (ring, *holes)),))


_KINDS = {"POINT": ("point", 0), "MULTIPOINT": ("point", 1), "LINESTRING": ("line", 1), "MULTILINESTRING": ("line", 2), "POLYGON": ("polygon", 2), "MULTIPOLYGON": ("polygon", 3)}


def _shape(kind: str, coordinates: list) -> Shape:
    """From nested coordinates as GeoJSON has them; heights are dropped."""
    name, depth = _KINDS[kind.upper()]
    flat = lambda ring: tuple((float(p[0]), float(p[1])) for p in ring)
    if name == "point":
        parts = [[[p]] for p in (coordinates if depth else [coordinates])]
    elif name == "line":
        parts = [[path] for path in (coordinates if depth == 2 else [coordinates])]
    else:
        parts = coordinates if depth == 3 else [coordinates]
    return Shape(name, tuple(tuple(flat(r) for r in part if r) for part in parts if part))


def from_geojson(geometry: dict | str) -> Shape:
    """A GeoJSON geometry; other kinds than points, lines and polygons are an error."""
    geometry = json.loads(geometry) if isinstance(geometry, str) else geometry
    if str(geometry.get("type", "")).upper() not in _KINDS:
        raise ValueError(f"unsupported geometry {geometry.get('type')!r}")
    return _shape(geometry["type"], geometry["coordinates"])


def from_wkt(text: str) -> Shape:
    """Well-known text; an ``SRID=...;`` before it is ignored."""
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(EMPTY|\(.*\))\s*", text, re.S)
    if not m or m[1].upper() not in _KINDS:
        raise ValueError(f"not a supported well-known text: {text[:40]!r}")
    kind = m[1].upper()
    if m[2] == "EMPTY":
        return Shape(_KINDS[kind][0], ())
    body = re.sub(r"([-+.\deE]+(?:\s+[-+.\deE]+)+)", lambda v: "[" + ",".join(v[0].split()) + "]", m[2])
    nested = json.loads(body.replace("(", "[").replace(")", "]"))
    if kind == "POINT":
        nested = nested[0]
    elif kind == "MULTIPOINT":
        nested = [p[0] if isinstance(p[0], list) else p for p in nested]
    return _shape(kind, nested)


def parse(text: str) -> Shape:
    return from_geojson(text) if text.lstrip().startswith("{") else from_wkt(text)


def utm_back(x: float, y: float, zone: int, north: bool) -> Point:
    """Longitude and latitude of UTM metres of one point, by Newton steps on the forward projection."""
    lon, lat = zone * 6 - 183.0, math.degrees((y - (0 if north else geo.UTM_NORTH)) / 6.37e6)
    for _ in range(12):
        x0, y0 = geo.utm_point(lon, lat, zone, north)
        h = 1e-6
        (xa, ya), (xb, yb) = geo.utm_point(lon + h, lat, zone, north), geo.utm_point(lon, lat + h, zone, north)
        a, b, c, d = (xa - x0) / h, (xb - x0) / h, (ya - y0) / h, (yb - y0) / h
        det = a * d - b * c
        lon, lat = lon + (d * (x - x0) - b * (y - y0)) / det, lat + (a * (y - y0) - c * (x - x0)) / det
    return lon, lat


def to_degrees(shape: Shape, crs: int) -> Shape:
    """Vertices of a layer in EPSG:``crs`` (4326, 3857 or UTM) as longitude and latitude."""
    if crs == 4326:
        return shape
    if crs == 3857:
        return shape.moved(lambda x, y: (math.degrees(x / geo.WGS84_A), math.degrees(2 * math.atan(math.exp(y / geo.WGS84_A)) - math.pi / 2)))
    if not (32601 <= crs <= 32660 or 32701 <= crs <= 32760):
        raise ValueError(f"EPSG:{crs} is not supported")
    return shape.moved(lambda x, y: utm_back(x, y, crs % 100, crs < 32700))


def holds(x: Column, y: Column, shape: Shape) -> Column:
    """True inside a polygon or on an edge of it; holes don't count, parts count each."""
    found = F.lit(False)
    for part in shape.parts if shape.kind == "polygon" else ():
        inside, edge = F.lit(False), F.lit(False)
        for ring in part:
            crossed, on = geo.ring_tests(x, y, list(ring))
            inside, edge = inside != crossed, edge | on
        found = found | inside | edge
    return F.coalesce(found, F.lit(False))


def distance(x: Column, y: Column, shape: Shape) -> Column:
    """Planar distance to the nearest part, 0 inside a polygon; null for a shape without parts."""
    closed = (lambda r: [*r] if r[0] == r[-1] else [*r, r[0]]) if shape.kind == "polygon" else list
    away = [geo.segment_distance(x, y, closed(ring)) for ring in shape.rings()]
    if not away:
        return F.lit(None).cast("double")
    least = F.least(*away) if len(away) > 1 else away[0]
    return F.when(holds(x, y, shape), F.lit(0.0)).otherwise(least) if shape.kind == "polygon" else least


def _crosses_itself(edges: np.ndarray) -> bool:
    """Whether two edges of a ring meet anywhere but at the vertex between neighbours. Edges are compared where their
    extents along x overlap."""
    n = len(edges)
    e = edges[np.argsort(np.minimum(edges[:, 0], edges[:, 2]), kind="stable")]
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    side = lambda a, b, p: np.sign((b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0]))
    within = lambda a, b, p: (np.minimum(a, b) <= p).all(-1) & (p <= np.maximum(a, b)).all(-1)
    for k in range(n - 1):
        other = e[k + 1 : np.searchsorted(low, high[k], "right")]
        a, b, c, d = e[k, :2], e[k, 2:], other[:, :2], other[:, 2:]
        s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
        # Neighbours share one vertex, and no more than that.
        joined = (a == d).all(-1) | (b == c).all(-1)
        apart = (s1 * s2 < 0) & (s3 * s4 < 0)
        touch = (s1 == 0) & within(a, b, c) | (s2 == 0) & within(a, b, d) | (s3 == 0) & within(c, d, a) | (s4 == 0) & within(c, d, b)
        back = joined & (s1 == 0) & (s2 == 0) & (((b - a) * (d - c)).sum(-1) < 0)
        if (apart | touch & ~joined | back).any() or n > 3 and ((a == d).all(-1) & (b == c).all(-1)).any():
            return True
    return False


def shape_fault(shape: Shape) -> str | None:
    """What makes a polygon unfit for a map, or None."""
    if shape.kind != "polygon":
        return "no polygon"
    if not shape.parts:
        return "empty"
    for part in shape.parts:
        rings = [np.array(r[:-1] if len(r) > 1 and r[0] == r[-1] else r, float) for r in part]
        for v in rings:
            if len(np.unique(v, axis=0)) < 3 or not np.isfinite(v).all():
                return "invalid: a ring needs three different vertices"
            nxt = np.roll(v, -1, 0)
            if np.sum(v[:, 0] * nxt[:, 1] - nxt[:, 0] * v[:, 1]) == 0:
                return "invalid: a ring without area"
            if _crosses_itself(np.hstack([v, nxt])):
                return "invalid: a ring crosses itself"
        outer = rings[0]
        nxt = np.roll(outer, -1, 0)
        for hole in rings[1:]:
            x, y = hole[0]
            over = (outer[:, 1] > y) != (nxt[:, 1] > y)
            t = (y - outer[over, 1]) / (nxt[over, 1] - outer[over, 1])
            if not np.count_nonzero(x < outer[over, 0] + t * (nxt[over, 0] - outer[over, 0])) % 2:
                return "invalid: a hole outside its polygon"
    return None
