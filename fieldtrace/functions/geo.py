"""Geodesy as column expressions: great circles, projections, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: WGS84 and the transverse Mercator grid (fixed values).
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST, UTM_NORTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def is_finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite(x: Column) -> Column:
    """The number, or null where it isn't finite: aggregates then skip it."""
    return F.when(is_finite(x), x)


def valid_coordinate(lon: Column, lat: Column) -> Column:
    return is_finite(lon) & is_finite(lat) & F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def _guard(value: Column, *inputs: Column) -> Column:
    ok = F.lit(True)
    for x in inputs:
        ok = ok & is_finite(x)
    return F.when(ok, value)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate isn't finite."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return _guard(F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)), lon1, lat1, lon2, lat2)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees; 0 for equal points, null if a coordinate isn't finite."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return _guard(F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)), lon1, lat1, lon2, lat2)


def abs_turn_rad(bearing: Column, previous: Column) -> Column:
    """Absolute change of bearing, 0 to pi."""
    return F.abs(F.pmod(bearing - previous + 180.0, F.lit(360.0)) - 180.0) * (math.pi / 180)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres."""
    return F.lit(WGS84_A) * F.radians(lon), F.lit(WGS84_A) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def _series() -> tuple[float, list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return a, alpha, beta


def utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Transverse Mercator metres in a UTM zone (Krueger series to the third order)."""
    a, alpha, _ = _series()
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return UTM_EAST + UTM_SCALE * a * x, F.when(north, 0.0).otherwise(UTM_NORTH) + UTM_SCALE * a * y


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of transverse Mercator metres."""
    a, _, beta = _series()
    xi = (y - F.when(north, 0.0).otherwise(UTM_NORTH)) / (UTM_SCALE * a)
    eta = (x - UTM_EAST) / (UTM_SCALE * a)
    xi1, eta1 = xi, eta
    for k, c in enumerate(beta, 1):
        xi1 = xi1 - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    n = WGS84_F / (2 - WGS84_F)
    phi = chi
    for k, c in enumerate([2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15], 1):
        phi = phi + c * F.sin(2 * k * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def ring_tests(x: Column, y: Column, ring: list[tuple[float, float]]) -> tuple[Column, Column]:
    """Whether a point is inside a ring (planar ray casting with literal vertices), and whether it is on its edge."""
    inside, edge = F.lit(False), F.lit(False)
    for (x1, y1), (x2, y2) in _edges(ring):
        crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
        slope = (x2 - x1) / (y2 - y1) if y2 != y1 else 0.0
        inside = inside != (crosses & (x < F.lit(x1) + (y - F.lit(y1)) * slope))
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        edge = edge | ((F.abs(cross) <= 1e-15) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return inside, edge


def segment_distance(x: Column, y: Column, path: list[tuple[float, float]]) -> Column:
    """Planar distance to a path of literal vertices (one vertex: to a point)."""
    if len(path) == 1:
        return F.sqrt((x - path[0][0]) ** 2 + (y - path[0][1]) ** 2)
    found = []
    for (x1, y1), (x2, y2) in zip(path, path[1:], strict=False):
        dx, dy = x2 - x1, y2 - y1
        span = dx * dx + dy * dy
        t = F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / span, F.lit(0.0)), F.lit(1.0)) if span else F.lit(0.0)
        found.append(F.sqrt((x - (F.lit(x1) + t * dx)) ** 2 + (y - (F.lit(y1) + t * dy)) ** 2))
    return F.least(*found) if len(found) > 1 else found[0]


def _edges(ring: list[tuple[float, float]]) -> list:
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return list(zip(closed, closed[1:], strict=False))


def mercator_point(lon: float, lat: float) -> tuple[float, float]:
    """EPSG:3857 metres of one point, for vertices given when a plan is built."""
    return WGS84_A * math.radians(lon), WGS84_A * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def utm_point(lon: float, lat: float, zone: int, north: bool) -> tuple[float, float]:
    """Transverse Mercator metres of one point, for vertices given when a plan is built."""
    a, alpha, _ = _series()
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(c * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, c in enumerate(alpha, 1))
    y = xi + sum(c * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, c in enumerate(alpha, 1))
    return UTM_EAST + UTM_SCALE * a * x, (0.0 if north else UTM_NORTH) + UTM_SCALE * a * y
