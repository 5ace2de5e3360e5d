"""Geometry as Column expressions: points are struct(x, y), lines arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, (Column, str)) else F.col(x).alias("x") if isinstance(x, str) else x.alias("x"),
                    F.lit(y).cast("double").alias("y") if not isinstance(y, (Column, str)) else F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once; expressions in lambdas are copied otherwise."""
    return F.element_at(F.transform(F.array(value), f), 1)


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def _normal(angle: Column) -> Column:
    """The angle brought to (-pi, pi]."""
    turn = 2 * math.pi
    return F.when(angle > math.pi, angle - turn).when(angle <= -math.pi, angle + turn).otherwise(angle)


def turn_angle(a: Column, b: Column, c: Column) -> Column:
    """Change of direction at b in degrees: 0 is straight on, 180 a U-turn."""
    first, second = F.atan2(b["y"] - a["y"], b["x"] - a["x"]), F.atan2(c["y"] - b["y"], c["x"] - b["x"])
    return F.degrees(F.abs(_normal(second - first)))


def acute_angle(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    d = F.abs(_normal(F.atan2(dy2, dx2) - F.atan2(dy1, dx1)))
    return F.degrees(F.when(d > math.pi / 2, math.pi - d).otherwise(d))


def _pairs(line: Column) -> Column:
    return F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    return F.aggregate(_pairs(line), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"]))


def dedupe(line: Column, tolerance: float) -> Column:
    """Drops points within ``tolerance`` of the last one kept."""
    return F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 1, 1),
                       lambda kept, p: F.when(distance(F.element_at(kept, -1), p) > tolerance, F.concat(kept, F.array(p))).otherwise(kept))


def remove_collinear(line: Column, tolerance: float) -> Column:
    """Drops interior vertices whose turn from the last one kept is at most ``tolerance`` degrees."""
    n = F.size(line)
    inner = F.sequence(F.lit(2), n - 1)
    kept = F.aggregate(inner, F.slice(line, 1, 1), lambda out, i: F.when(
        turn_angle(F.element_at(out, -1), F.element_at(line, i), F.element_at(line, i + 1)) > tolerance, F.concat(out, F.array(F.element_at(line, i)))).otherwise(out))
    return F.when(n < 3, line).otherwise(F.concat(kept, F.slice(line, -1, 1)))


def clean(line: Column) -> Column:
    return remove_collinear(dedupe(line, 1e-6), 1e-4)


def measured(line: Column) -> Column:
    """Segments of a line with the measures of their ends: a, b, s0, s1."""
    empty = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,s0:double,s1:double>>")
    start = F.struct(F.lit(0.0).alias("at"), empty.alias("out"))
    def step(acc, e):
        return let(acc["at"] + distance(e["a"], e["b"]), lambda to: F.struct(
            to.alias("at"), F.concat(acc["out"], F.array(F.struct(e["a"].alias("a"), e["b"].alias("b"), acc["at"].alias("s0"), to.alias("s1")))).alias("out")))

    return F.aggregate(_pairs(line), start, step, lambda acc: acc["out"])


def along(a: Column, b: Column, share: Column) -> Column:
    return F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))


def point_at(line: Column, measure: Column) -> Column:
    """Point at a measure, clamped to the line."""
    return let(measured(line), lambda parts: _at(parts, measure))


def _at(parts: Column, measure: Column) -> Column:
    return let(F.greatest(F.lit(0.0), F.least(measure, F.element_at(parts, -1)["s1"])), lambda m: let(
        F.element_at(F.filter(parts, lambda e: e["s1"] >= m), 1),
        lambda part: along(part["a"], part["b"], F.when(part["s1"] > part["s0"], (m - part["s0"]) / (part["s1"] - part["s0"])).otherwise(0.0))))


def project(line: Column, p: Column) -> Column:
    """Measure of the point of the line nearest to p; the first one on ties."""
    def near(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        sq = dx * dx + dy * dy
        t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / sq))).otherwise(0.0)
        ox, oy = e["a"]["x"] + dx * t - p["x"], e["a"]["y"] + dy * t - p["y"]
        return F.struct((ox * ox + oy * oy).alias("d2"), (e["s0"] + t * (e["s1"] - e["s0"])).alias("m"))

    return F.array_min(F.transform(measured(line), near))["m"]


def sub_line(line: Column, start: Column, end: Column) -> Column:
    """The part of a line between two measures, with exact ends."""
    def part(parts):
        inner = F.transform(F.filter(parts, lambda e: (e["s1"] > start) & (e["s1"] < end)), lambda e: e["b"])
        return F.concat(F.array(_at(parts, start)), inner, F.array(_at(parts, end)))

    return let(let(measured(line), part), lambda found: dedupe(found, 1e-9))


def sample_measures(total: Column, step: float) -> Column:
    """0, step, 2 step, ...: the last one goes if what remains is under 0.3 step; then the end."""
    count = F.floor(total / step)
    count = F.when(total - count * step < 0.3 * step, F.greatest(count - 1, F.lit(0))).otherwise(count)
    return F.concat(F.transform(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint")), lambda k: k * F.lit(float(step))), F.array(total))


def disc_interval(a: Column, b: Column, c: Column, radius: Column) -> Column:
    """Measures (lo, hi) at which the segment is inside the disc; null if nowhere."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / n, dy / n
    at = (c["x"] - a["x"]) * ux + (c["y"] - a["y"]) * uy
    off = (c["x"] - a["x"]) * uy - (c["y"] - a["y"]) * ux
    half2 = radius * radius - off * off
    half = F.sqrt(F.greatest(half2, F.lit(0.0)))
    lo, hi = F.greatest(F.lit(0.0), at - half), F.least(n, at + half)
    return F.when((half2 >= 0) & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def point_segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / sq))).otherwise(0.0)
    ox, oy = ax + dx * t - px, ay + dy * t - py
    return ox * ox + oy * oy


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(a: list[Column], b: list[Column]) -> Column:
    """Proper crossing of two segments (ax, ay, bx, by)."""
    o1, o2 = orientation(*a, b[0], b[1]), orientation(*a, b[2], b[3])
    o3, o4 = orientation(*b, a[0], a[1]), orientation(*b, a[2], a[3])
    return (o1 * o2 < 0) & (o3 * o4 < 0)


def convex_corner(a: Column, b: Column, c: Column, area: Column) -> Column:
    """Whether b is a convex corner of a ring with this signed area."""
    cross = (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
    return cross * area > 0


def signed_area(ring: Column) -> Column:
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def liang_barsky(ax, ay, bx, by, xmin, ymin, xmax, ymax) -> Column:
    """Whether a segment meets a closed box."""
    dx, dy = bx - ax, by - ay
    lo, hi, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for d, low, high in ((dx, xmin - ax, xmax - ax), (dy, ymin - ay, ymax - ay)):
        outside = outside | ((d == 0) & ((low > 0) | (high < 0)))
        lo = F.greatest(lo, F.when(d != 0, F.least(low / d, high / d)).otherwise(lo))
        hi = F.least(hi, F.when(d != 0, F.greatest(low / d, high / d)).otherwise(hi))
    return ~outside & (lo <= hi)


# Transverse Mercator on WGS84, zone 37 north: third-order series.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_A = 6378137 / (1 + _N) * (1 + _N * _N / 4 + _N * _N * _N * _N / 64)
_ALPHA = (_N / 2 - 2 * _N * _N / 3 + 5 * _N**3 / 16, 13 * _N * _N / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N * _N / 3 + 37 * _N**3 / 96, _N * _N / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N * _N / 3 - 2 * _N**3, 7 * _N * _N / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
CENTRAL, SCALE, EAST = 39.0, 0.9996, 500000.0


def to_metric(lon: Column, lat: Column) -> Column:
    """(x, y) in metres of a WGS84 position."""
    lam, phi = F.radians(lon - CENTRAL), F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EAST + SCALE * _A * e).alias("x"), (SCALE * _A * n).alias("y"))


def to_wgs84(x: Column, y: Column) -> Column:
    """(lon, lat) in degrees of a metric position."""
    xi, eta = y / (SCALE * _A), (x - EAST) / (SCALE * _A)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((CENTRAL + F.degrees(F.atan2(F.sinh(v), F.cos(u)))).alias("lon"), F.degrees(phi).alias("lat"))


def offset(a: Column, b: Column, d: Column) -> Column:
    """The point ``d`` from a in the direction of b; a where they coincide."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.sqrt(dx * dx + dy * dy)
    share = F.when(n > 0, d / n).otherwise(0.0)
    return point(a["x"] + dx * share, a["y"] + dy * share)


def nearest_point(line: Column, p: Column) -> Column:
    """The point of a polyline nearest to p."""
    return point_at(line, project(line, p))


def segments_distance2(a: list[Column], b: list[Column]) -> Column:
    """Square of the distance of two segments (ax, ay, bx, by): 0 where they meet."""
    o = [orientation(*a, b[0], b[1]), orientation(*a, b[2], b[3]), orientation(*b, a[0], a[1]), orientation(*b, a[2], a[3])]
    ends = F.least(point_segment_distance2(a[0], a[1], *b), point_segment_distance2(a[2], a[3], *b), point_segment_distance2(b[0], b[1], *a), point_segment_distance2(b[2], b[3], *a))
    return F.when((o[0] * o[1] < 0) & (o[2] * o[3] < 0), F.lit(0.0)).otherwise(ends)


def profile_cost(price: Column, length: Column, h0: Column, h1: Column, normal: float, rate: float) -> tuple[Column, Column]:
    """What a straight profile costs beyond the normal depth, and the integral of its distance from it.

    The extra factor is ``rate`` for each metre that lies below ``normal``; a
    profile through the normal depth counts its two parts.
    """
    a, b = h0 - normal, h1 - normal
    through = a * b < 0
    low = F.when(through, F.greatest(a, b) * F.greatest(a, b) / (F.abs(a) + F.abs(b)) / 2).otherwise(F.greatest((a + b) / 2, F.lit(0.0)))
    off = F.when(through, (a * a + b * b) / (F.abs(a) + F.abs(b)) / 2).otherwise(F.abs(a + b) / 2)
    return price * length * rate * low, length * off


def profile_cost_mm(length_mm: Column, h0_mm: Column, h1_mm: Column, normal_mm: int) -> tuple[Column, Column, Column]:
    """The integrals of ``profile_cost`` over whole millimetres, exact: (below the normal depth, distance from it), both in mm2 times the divisor, and the divisor."""
    a, b = h0_mm - normal_mm, h1_mm - normal_mm
    through = a * b < 0
    top, both = F.greatest(a, b, F.lit(0)), F.abs(a) + F.abs(b)
    return F.when(through, length_mm * top * top).otherwise(length_mm * F.greatest(a + b, F.lit(0))), F.when(through, length_mm * (a * a + b * b)).otherwise(length_mm * F.abs(a + b)), F.when(through, 2 * both).otherwise(F.lit(2))
