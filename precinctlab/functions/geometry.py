"""Ring arithmetic on arrays of (x, y) structs, without UDFs."""

from __future__ import annotations

import math
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(value: Column, f) -> Column:
    """f(value), with the value computed once a row however often f names it: inside a lambda, Spark would compute it again at each step."""
    return F.transform(F.array(value), f)[0]


def _sides(ring: Column, f) -> Column:
    def over(r):
        n = F.size(r)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + f(r[i], r[(i + 1) % n]))

    return once(ring, over)


def area(ring: Column) -> Column:
    """Shoelace area of an open ring."""
    return F.abs(_sides(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def perimeter(ring: Column) -> Column:
    return _sides(ring, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def compact(a: Column, p: Column) -> Column:
    """Polsby-Popper score of an area and a perimeter."""
    return F.when(p > 0, F.least(F.lit(1.0), 4 * F.pi() * a / (p * p)))


def polsby_popper(ring: Column) -> Column:
    return once(ring, lambda r: once(F.struct(area(r).alias("a"), perimeter(r).alias("p")), lambda m: compact(m["a"], m["p"])))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of the area of an open ring; null without area."""
    twice = _sides(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    moment = lambda c: _sides(ring, lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    part = lambda m: once(twice, lambda t: F.when(t != 0, m / (3 * t)))
    return part(moment("x")), part(moment("y"))


def rounded(a: Column, far: Column) -> Column:
    """Area over that of the circle with the squared radius ``far``, 1 at most."""
    return F.when(far > 0, F.least(F.lit(1.0), a / (F.pi() * far)))


def farthest2(ring: Column) -> Column:
    """Squared distance of the area's centre to the farthest vertex."""

    def over(r):
        x, y = centroid(r)
        return once(F.struct(x.alias("x"), y.alias("y")), lambda c: F.array_max(F.transform(r, lambda p: (p["x"] - c["x"]) * (p["x"] - c["x"]) + (p["y"] - c["y"]) * (p["y"] - c["y"]))))

    return once(ring, over)


def reock(ring: Column) -> Column:
    """Area over that of the circle around the area's centre through the farthest vertex, 1 at most."""
    return once(ring, lambda r: once(farthest2(r), lambda far: rounded(area(r), far)))


def measures(ring: Column) -> Column:
    """Struct of area, perimeter and far, the squared distance of the farthest vertex: what the scores need, each computed once."""
    return once(ring, lambda r: F.struct(area(r).alias("area"), perimeter(r).alias("perimeter"), farthest2(r).alias("far")))


@F.pandas_udf(T.DoubleType())
def hull_area(ring: pd.Series) -> pd.Series:
    """Area of the convex hull, by monotone chains over the sorted vertices."""

    def one(r):
        if r is None:
            return None
        hull = _hull([(p["x"], p["y"]) for p in r])
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2

    return ring.map(one)


def hull_ratio(ring: Column, own: Column | None = None) -> Column:
    """Area, ``own`` if it is known, over that of the convex hull, 1 at most."""
    hull = hull_area(ring)
    return F.when(hull > 0, F.least(F.lit(1.0), (area(ring) if own is None else own) / hull))


def distance2(ring: Column, x: Column, y: Column) -> Column:
    """Squared distance of a point to the nearest side of an open ring."""

    def over(v):
        r, x, y = v["r"], v["x"], v["y"]
        n = F.size(r)

        def side(i):
            p, q = F.get(r, i), F.get(r, (i + 1) % n)
            dx, dy = q["x"] - p["x"], q["y"] - p["y"]
            along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
            return once(along, lambda t: (p["x"] + t * dx - x) * (p["x"] + t * dx - x) + (p["y"] + t * dy - y) * (p["y"] + t * dy - y))

        return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), side))

    return once(F.struct(ring.alias("r"), x.alias("x"), y.alias("y")), over)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether the point lies in an open ring."""

    def over(v):
        r, x, y = v["r"], v["x"], v["y"]
        n = F.size(r)

        def cross(acc, i):
            p, q = r[i], r[(i + 1) % n]
            hit = ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
            return acc != hit

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), cross)

    return once(F.struct(ring.alias("r"), x.alias("x"), y.alias("y")), over)


def signed_area(ring: Column) -> Column:
    """Area of an open ring, negative where it runs clockwise."""
    return _sides(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def polygons_area(polygons: Column) -> Column:
    """Area of an array of polygons, each an outer ring and its holes."""
    one = lambda p: F.aggregate(p, F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("sign")), lambda s, r: F.struct((s["a"] + s["sign"] * area(r)).alias("a"), F.lit(-1.0).alias("sign")))["a"]
    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + one(p))


def polygons_perimeter(polygons: Column) -> Column:
    """Length of all rings, holes included."""
    return F.aggregate(F.flatten(polygons), F.lit(0.0), lambda s, r: s + perimeter(r))


@F.arrow_udf(T.ArrayType(T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())))
def hull_points(points: pa.Array) -> pa.Array:
    """Corners of the convex hull of an array of points, counterclockwise; null stays null."""
    return pa.array([None if p is None else [{"x": x, "y": y} for x, y in _hull([(q["x"], q["y"]) for q in p if q])] for p in points.to_pylist()], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(some):
        kept: list[tuple[float, float]] = []
        for p in some:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return chain(points) + chain(points[::-1])


@F.arrow_udf(T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType()).add("r", T.DoubleType()))
def smallest_circle(points: pa.Array) -> pa.Array:
    """The smallest circle around an array of points; null without points.

    Hull corners go in one by one in a fixed shuffled order; one that lies
    outside has to be on the new circle, which is then rebuilt from those before
    it: expected time in proportion to the corners.
    """
    return pa.array([None if not p else dict(zip("xyr", _circle([(q["x"], q["y"]) for q in p if q]))) for p in points.to_pylist()], pa.struct([("x", pa.float64()), ("y", pa.float64()), ("r", pa.float64())]))


def _circle(points: list[tuple[float, float]]) -> tuple[float, float, float]:
    p = _hull(points)
    random.Random(len(p)).shuffle(p)
    scale = max(max(abs(x - p[0][0]), abs(y - p[0][1])) for x, y in p) or 1.0
    outside = lambda c, q: math.hypot(q[0] - c[0], q[1] - c[1]) > c[2] + 1e-12 * scale
    two = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.hypot(a[0] - b[0], a[1] - b[1]) / 2)

    def three(a, b, c):
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return max(two(a, b), two(a, c), two(b, c), key=lambda o: o[2])
        x = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        y = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return a[0] + x, a[1] + y, math.hypot(x, y)

    best = (*p[0], 0.0)
    for i, a in enumerate(p):
        if outside(best, a):
            best = (*a, 0.0)
            for j, b in enumerate(p[:i]):
                if outside(best, b):
                    best = two(a, b)
                    for c in p[:j]:
                        if outside(best, c):
                            best = three(a, b, c)
    return best


# The ellipsoid of 1980 (axis, inverse flattening), and equal-area cones (two standard parallels, origin) of the contiguous states and Alaska.
ELLIPSOID = (6378137.0, 298.257222101)
CONUS, ALASKA = (29.5, 45.5, 23.0, -96.0), (55.0, 65.0, 50.0, -154.0)


def albers(lon: Column, lat: Column, cone: tuple[float, float, float, float] = CONUS) -> tuple[Column, Column]:
    """Metres (x, y) of degrees in an equal-area cone on the ellipsoid."""
    axis, flat = ELLIPSOID
    e2 = 2 / flat - 1 / flat**2
    e = math.sqrt(e2)

    def q(s, log):
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m2(d):
        s = math.sin(math.radians(d))
        return (1 - s * s) / (1 - e2 * s * s)

    first, second, origin = (q(math.sin(math.radians(d)), math.log) for d in cone[:3])
    n = (m2(cone[0]) - m2(cone[1])) / (second - first)
    c = m2(cone[0]) + n * first
    rho = axis * F.sqrt(c - n * q(F.sin(F.radians(lat)), F.log)) / n
    theta = n * F.radians(lon - cone[3])
    return rho * F.sin(theta), axis * math.sqrt(c - n * origin) / n - rho * F.cos(theta)


def projected(polygons: Column, cone: tuple[float, float, float, float] = CONUS) -> Column:
    """Polygons of degrees in metres."""

    def point(p):
        x, y = albers(p["x"], p["y"], cone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, point)))
