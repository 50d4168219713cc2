"""Planar geometry on plain columns: a ring is an array of (x, y) structs, a polygon an array of rings (even-odd rule).

Projection is transverse Mercator on the WGS84 ellipsoid by its series in the third flattening (sixth order), as
column arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.text import col

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<{RING}>"

_A, _F, _K0, _EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The public series (Krueger), forward and inverse, to the fourth power of n.
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def to_utm(lat: Column | str, lon: Column | str, meridian: float = 27.0) -> Column:
    """Struct (x, y) in metres, northern hemisphere; the zone is given by its central meridian (27: zone 35)."""
    e = math.sqrt(_F * (2 - _F))
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - F.lit(meridian))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(F.lit(2.0 * k) * xi) * F.sinh(F.lit(2.0 * k) * eta)
        y = y + F.lit(a) * F.sin(F.lit(2.0 * k) * xi) * F.cosh(F.lit(2.0 * k) * eta)
    return F.struct((F.lit(_K0 * _RADIUS) * x + _EASTING).alias("x"), (F.lit(_K0 * _RADIUS) * y).alias("y"))


def to_wgs84(x: Column | str, y: Column | str, meridian: float = 27.0) -> Column:
    """Struct (lat, lon) in degrees from northern UTM metres."""
    xi, eta = col(y) / F.lit(_K0 * _RADIUS), (col(x) - _EASTING) / F.lit(_K0 * _RADIUS)
    u, v = xi, eta
    for k, b in enumerate(_BETA, 1):
        u = u - F.lit(b) * F.sin(F.lit(2.0 * k) * xi) * F.cosh(F.lit(2.0 * k) * eta)
        v = v - F.lit(b) * F.cos(F.lit(2.0 * k) * xi) * F.sinh(F.lit(2.0 * k) * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for k, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * k) * chi)
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(F.atan2(F.sinh(v), F.cos(u))) + F.lit(meridian)).alias("lon"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as a lambda's variable: nested uses of a large expression don't multiply it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _edges(ring: Column) -> Column:
    """Array of (a, b) of consecutive points; the ring is closed if it isn't."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def clean_ring(ring: Column) -> Column:
    """Without nulls, repeated neighbours and the closing point; null with fewer than three points."""
    known = F.filter(ring, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    apart = let(known, lambda k: F.filter(k, lambda p, i: (i == 0) | (p != F.get(k, i - 1))))
    open_ = let(apart, lambda a: F.when((F.size(a) > 1) & (F.get(a, F.lit(0)) == F.element_at(a, -1)), F.slice(a, 1, F.size(a) - 1)).otherwise(a))
    return let(open_, lambda r: F.when(F.size(r) >= 3, r))


def clean_polygon(rings: Column | str) -> Column:
    """Repaired rings; null without any. Self-intersections stay and follow the even-odd rule."""
    return let(F.filter(F.transform(col(rings), clean_ring), lambda r: r.isNotNull()), lambda g: F.when(F.size(g) > 0, g))


def _signed(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(rings: Column | str) -> Column:
    """Outer ring's area less its holes' (the rings after the first)."""
    r = col(rings)
    return F.when(F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda s, x: F.when(s == 0, F.abs(_signed(x))).otherwise(s - F.abs(_signed(x)))))


def on_boundary(x: Column, y: Column, rings: Column, eps: float = 1e-9) -> Column:
    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        scale = F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]), F.lit(1.0))
        box = x.between(F.least(a["x"], b["x"]) - eps, F.greatest(a["x"], b["x"]) + eps) & y.between(F.least(a["y"], b["y"]) - eps, F.greatest(a["y"], b["y"]) + eps)
        return box & (F.abs(cross) <= F.lit(eps) * scale)

    return F.exists(rings, lambda r: F.exists(_edges(r), on))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd crossing count; points on an edge are undefined here (test on_boundary first)."""

    def crossings(r: Column) -> Column:
        def hit(e: Column) -> Column:
            a, b = e["a"], e["b"]
            return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"])

        return F.size(F.filter(_edges(r), hit))

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def distance(x: Column, y: Column, rings: Column) -> Column:
    """To the nearest edge (0 isn't implied for points inside)."""

    def to(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(length == 0, 1.0).otherwise(length))))
        px, py = a["x"] + t * dx - x, a["y"] + t * dy - y
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(F.flatten(F.transform(rings, _edges)), to))


def bounds(rings: Column | str) -> Column:
    points = F.flatten(col(rings))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def interior_point(rings: Column | str) -> Column:
    """Middle of the widest span of a horizontal line near half height; certain to lie inside a clean polygon."""
    r = col(rings)

    def line(ys: Column) -> Column:
        half = (F.array_min(ys) + F.array_max(ys)) / 2
        return let(half, lambda h: (F.array_max(F.filter(ys, lambda v: v <= h)) + F.array_min(F.filter(ys, lambda v: v > h))) / 2)

    def cut(y: Column) -> Column:
        crossed = F.filter(F.flatten(F.transform(r, _edges)), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        return F.array_sort(F.transform(crossed, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))

    def widest(xs: Column) -> Column:
        pairs = F.filter(F.transform(xs, lambda x, i: F.struct((F.get(xs, i + 1) - x).alias("w"), ((x + F.get(xs, i + 1)) / 2).alias("x"), (i % 2).alias("odd"))), lambda s: (s["odd"] == 0) & s["w"].isNotNull())
        return F.array_max(pairs)["x"]

    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(r), lambda p: p["y"])))
    return let(let(heights, line), lambda y: let(let(cut(y), widest), lambda x: F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y")))))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A polygon column from a rectangle's corners."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def wkt(rings: Column | str) -> Column:
    """POLYGON text; rings are closed."""
    text = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), text), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(col(rings), ring), ", "), F.lit(")"))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the lowest left point; fewer than three points give nothing."""
    p = sorted(set(points))

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    got = chain(p) + chain(p[::-1])
    return got if len(got) >= 3 else []
