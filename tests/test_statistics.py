"""Resampling, split schedules, places, metropolitan areas, circles and the projection against plain computations."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinctlab.functions import geometry
from precinctlab.operators import places, resampling, series, shapes, splits

POINTS = "array<struct<x:double,y:double>>"


def test_cluster_bootstrap_against_loop(spark):
    r = random.Random(2)
    rows = [(f"c{r.randrange(12):02d}", x := r.gauss(0, 2), 3 * x + r.gauss(0, 1)) for _ in range(300)] + [("c01", None, 1.0), (None, 0.5, 2.0)]
    got = resampling.cluster_bootstrap(spark.createDataFrame(rows, "c string, x double, y double").repartition(3), "c", "y", "x", draws=300, seed=9).first()
    kept = [row for row in rows if row[0] is not None and row[1] is not None]
    names = sorted({c for c, *_ in kept})
    slopes = []
    for b in range(300):
        take = [names[int(hashlib.md5(f"9:{b}:{j}".encode()).hexdigest()[:8], 16) % len(names)] for j in range(len(names))]
        sample = [(x, y) for t in take for c, x, y in kept if c == t]
        slopes.append(np.polyfit(*zip(*sample), 1)[0])
    slopes.sort()
    assert (got.low, got.high) == (pytest.approx(slopes[7], abs=2e-6), pytest.approx(slopes[292], abs=2e-6))
    assert got.n_clusters == len(names) and got.n == len(kept) and got.slope == pytest.approx(np.polyfit([x for _, x, _ in kept], [y for *_, y in kept], 1)[0], abs=2e-6)
    flat = resampling.cluster_bootstrap(spark.range(5).select(F.col("id").alias("c"), F.lit(1).alias("x"), F.col("id").alias("y")), "c", "y", "x", draws=20).collect()
    assert [(r.slope, r.low, r.high, r.n) for r in flat] == [(None, None, None, 5)]
    none = resampling.cluster_bootstrap(spark.createDataFrame([], "c string, x double, y double"), "c", "y", "x", draws=20).collect()
    assert [(r.low, r.n) for r in none] == [(None, 0)]


def test_bootstrap_of_its_gate(spark):
    """4,082 units in 64 clusters, 10,000 draws: within the minute that is asked for."""
    import time

    u = spark.range(4082).select((F.col("id") % 64).alias("c"), (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 997).alias("y"))
    began = time.time()
    assert resampling.cluster_bootstrap(u, "c", "y", "x").first().low is not None and time.time() - began < 60


def test_partisan_intervals(spark):
    r = random.Random(5)
    rows = [(i + 1, d := r.randrange(0, 900), p := r.randrange(1, 900), d + p, d / (d + p)) for i in range(14)]
    e = spark.createDataFrame(rows, "district int, dem long, rep long, total long, dem_pct double")
    got = {x.metric: x for x in resampling.report_with_intervals(e, draws=200, seed=1).collect()}
    want = {m: [] for m in got}
    for b in range(200):
        s = [rows[int(hashlib.md5(f"1:{b}:{j}".encode()).hexdigest()[:8], 16) % 14] for j in range(14)]
        wasted = [(d - t / 2, p) if d > p else (d, p - t / 2) for _, d, p, t, _ in s]
        votes = sum(t for *_, t, _ in s)
        want["efficiency_gap"].append((sum(w[1] for w in wasted) - sum(w[0] for w in wasted)) / votes)
        want["mean_median"].append(np.mean([x[4] for x in s]) - np.median([x[4] for x in s]))
        swing = 0.5 - sum(x[1] for x in s) / votes
        want["partisan_bias"].append(0.5 - np.mean([x[4] + swing >= 0.5 for x in s]))
    for m, v in want.items():
        v.sort()
        assert (got[m].ci_low, got[m].ci_high) == (pytest.approx(v[5], abs=1e-6), pytest.approx(v[195], abs=1e-6)) and got[m].ci_available
    few = resampling.report_with_intervals(e.where("district < 9"), draws=20).collect()
    assert all(x.ci_low is None and x.ci_high is None and not x.ci_available for x in few) and len(few) == 3


def test_p_values(spark):
    known = [(0.0, 30, 1.0), (1.0, 30, 0.0), (0.5, 12, 0.0978546142578), (0.01, 1000, 0.7521238409748), (-0.632, 10, 0.04995), (0.3, 2, None)]
    got = spark.createDataFrame(known, "r double, n long, p double").select("p", series.correlation_p(F.col("r"), F.col("n")).alias("q")).collect()
    for x in got:
        assert x.q is None if x.p is None else x.q == pytest.approx(x.p, abs=1e-5 if x.p == 0.04995 else 1e-6)
    rows = [("few", i, i * i) for i in range(9)] + [("flat", 1, i) for i in range(20)] + [("line", i, -2 * i) for i in range(20)] + [("line", None, 3)]
    out = {r.g: (r.r, r.p, r.n) for r in series.sorting_index(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b").collect()}
    assert out["few"] == (None, None, 9) and out["flat"] == (None, None, 20) and out["line"] == (-1.0, 0.0, 20)


def test_splits(spark):
    k = spark.createDataFrame([(8,), (5,), (5,), (1,), (0,), (None,)], "k int")
    got = {}
    for r in splits.bisection_schedule(k).collect():
        got.setdefault(r.seats, []).append((r.depth, r.path, r.k, r.k_left, r.k_right))
    assert sorted(got[5]) == [(0, "", 5, 2, 3), (1, "0", 2, 1, 1), (1, "1", 3, 1, 2), (2, "11", 2, 1, 1)] and len(got[8]) == 7 and set(got) == {5, 8}

    def largest(n):
        return max(p for p in range(2, n + 1) if n % p == 0 and all(p % q for q in range(2, p)))

    def rule(n):
        if n <= 3:
            return "direct", [1] * n
        p = largest(n)
        return ("halves", [n // 2, n - n // 2]) if p == n else ("equal", [n // p] * p)

    def depth(n):
        return 0 if n <= 1 else 1 + max(map(depth, rule(n)[1]))

    rules = {r.k: (r.kind, r.sub) for r in splits.prescriptions(spark, 120).collect()}
    assert rules == {n: rule(n) for n in range(1, 121)}
    depths = {r.k: r.depth for r in splits.cut_depths(spark, 120).collect()}
    assert depths == {n: depth(n) for n in range(1, 121)} and (depths[8], depths[17], depths[38], depths[52]) == (3, 4, 2, 3)
    chambers = spark.createDataFrame([("a", 6, 12, 30), ("b", 7, 8, 9), ("c", 1, 1, 1)], "s string, x int, y int, z int")
    spine = {r.s: (r.trunk, r.x, r.y, r.z) for r in splits.spines(chambers, "s", ["x", "y", "z"]).collect()}
    assert spine == {"a": ([2, 3], [2, 3], [2, 3, 2], [2, 3, 5]), "b": ([], [7], [2, 2, 2], [3, 3]), "c": ([], [], [], [])}
    with pytest.raises(Exception, match="no seat"):
        splits.spines(spark.createDataFrame([("a", 0, 1)], "s string, x int, y int"), "s", ["x", "y"]).collect()


def test_labels(spark):
    box = lambda x: [[[(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)], [(x + 4, 4.0), (x + 6, 4.0), (x + 6, 6.0), (x + 4, 6.0)]]]
    units = spark.createDataFrame([(i + 1, box(10.0 * i)) for i in range(5)] + [(9, None)], f"district int, polygons array<array<{POINTS}>>")
    rows = [(1, "Big", 2_000_000, 1.0, 1.0), (2, "Big", 900_000, 2.0, 1.0), (3, "Side", 30_000, 3.0, 1.0), (4, "Near", 700_000, 11.0, 1.0), (5, "Little", 11_000, 12.0, 1.0), (6, "Near", 600_000, 21.0, 1.0), (7, "Alone", 9_000, 22.0, 1.0), (8, "Town", 12_000, 23.0, 2.0),
            (9, "Lake", 5_000_000, 35.0, 5.0), (10, "Out", 1, -5.0, 5.0), (11, "Tie", 10, 31.0, 1.0), (12, "Tie too", 10, 32.0, 1.0), (13, "Nowhere", 4, None, None)]
    placed = places.places_in_districts(spark.createDataFrame(rows, "geoid long, name string, population long, x double, y double"), units, 3.0)
    got = {r.district: (r.largest_city, r.city_population) for r in places.district_labels(placed, 5).collect()}
    assert got == {1: ("Side", 30_000), 2: ("Near", 700_000), 3: ("Town", 12_000), 4: ("Tie", 10), 5: ("None", 0)}


def test_metros(spark):
    parts = spark.createDataFrame([(1, "NY"), (1, "NJ"), (2, "NY"), (3, "NJ"), (3, "PA"), (4, "CT"), (4, "NJ"), (5, "TX"), (5, "OK"), (6, None), (6, "NY"), (7, "NY"), (7, "NY")], "district int, state string")
    metros = spark.createDataFrame([("York", 1, s, s == "NY") for s in ("NY", "NJ", "CT")] + [("Phil", 2, s, s in ("PA", "NJ")) for s in ("PA", "NJ", "DE", "NY")], "metro string, place int, state string, core boolean")
    m = places.metro_matches(parts, metros)
    assert {r.district: (r.states, r.metro) for r in m.collect()} == {1: ("NJ-NY", "York"), 3: ("NJ-PA", "Phil"), 4: ("CT-NJ", None), 5: ("OK-TX", None)}
    assert {r.metro: (r.n_districts, r.share) for r in places.metro_summary(m).collect()} == {"York": (1, 0.25), "Phil": (1, 0.25), None: (2, 0.5)}


def smallest(points):
    """The least circle of two or three points that holds all."""
    best, points = (math.inf, None), [(x - points[0][0], y - points[0][1]) for x, y in points]
    options = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b) / 2) for a, b in itertools.combinations(points, 2)]
    for a, b, c in itertools.combinations(points, 3):
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if d:
            m = lambda p: p[0] ** 2 + p[1] ** 2
            x = (m(a) * (b[1] - c[1]) + m(b) * (c[1] - a[1]) + m(c) * (a[1] - b[1])) / d
            y = (m(a) * (c[0] - b[0]) + m(b) * (a[0] - c[0]) + m(c) * (b[0] - a[0])) / d
            options.append((x, y, math.dist((x, y), a)))
    for x, y, r in options or [(*points[0], 0.0)]:
        if r < best[0] and all(math.dist((x, y), p) <= r * (1 + 1e-9) + 1e-12 for p in points):
            best = (r, (x, y))
    return best


def test_circles_against_all_triples(spark):
    r = random.Random(3)
    sets = [[(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(n)] for n in (1, 2, 3, 5, 9, 14)] + [[(0.0, 0.0), (1.0, 1.0), (3.0, 3.0)], [(0.0, 0.0)] * 4, [(float(x), float(y)) for x in range(4) for y in range(3)]]
    sets += [[(1e6 + 3 * math.cos(t), 2e6 + 3 * math.sin(t)) for t in range(12)]]
    rows = [(i, s) for i, s in enumerate(sets)] + [(90, []), (91, None)]
    df = spark.createDataFrame(rows, f"i int, p {POINTS}")
    got = {x.i: x.c for x in df.select("i", geometry.smallest_circle(F.col("p")).alias("c")).collect()}
    assert got[90] is None and got[91] is None
    for i, s in enumerate(sets):
        assert got[i].r == pytest.approx(smallest(sorted(set(s)))[0] if len(set(s)) > 1 else 0.0, abs=1e-8)
        assert all(math.dist((got[i].x, got[i].y), p) <= got[i].r + 1e-7 for p in s)
    square = lambda x: [[[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]]]
    c = shapes.enclosing_circles(spark.createDataFrame([(1, square(0.0)), (1, square(1.0))], f"district int, polygons array<array<{POINTS}>>")).first()
    assert (c.x, c.y, c.r, c.reock) == (1.0, 0.5, pytest.approx(math.sqrt(1.25), abs=1e-6), pytest.approx(2 / (math.pi * 1.25), abs=1e-6))


def test_projection_keeps_areas(spark):
    at = lambda lon, lat: [(lon, lat), (lon + 0.01, lat), (lon + 0.01, lat + 0.01), (lon, lat + 0.01)]
    rows = [(lon, lat, [[at(lon, lat)]]) for lon in (-124.0, -96.0, -70.0) for lat in (25.0, 37.5, 49.0)]
    df = spark.createDataFrame(rows, f"lon double, lat double, p array<array<{POINTS}>>")
    axis, flat = geometry.ELLIPSOID
    e2 = 2 / flat - 1 / flat**2
    for r in df.select("lon", "lat", geometry.polygons_area(geometry.projected(F.col("p"))).alias("a")).collect():
        strip = lambda d: (1 - e2) * math.cos(math.radians(d)) / (1 - e2 * math.sin(math.radians(d)) ** 2) ** 2
        want = axis**2 * math.radians(0.01) ** 2 * (strip(r.lat) + 4 * strip(r.lat + 0.005) + strip(r.lat + 0.01)) / 6
        assert r.a == pytest.approx(want, rel=2e-6)
    x, y = geometry.albers(F.lit(-96.0), F.lit(23.0))
    assert spark.range(1).select(x, y).first() == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6))
