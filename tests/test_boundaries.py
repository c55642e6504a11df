"""Shapefiles, boundaries and dissolve against brute force on rings with T-junctions, corner contacts, enclaves and slanted sides."""

import itertools
import random
import struct
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from precinctlab.functions import geometry
from precinctlab.operators import boundaries, spatial
from precinctlab.sources import binary, shapefile

SCHEMA = "geoid string, district int, polygons array<array<array<struct<x:double,y:double>>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def cuttings(r, x0, y0, x1, y1, depth):
    """Random cuts of a rectangle into rectangles and triangles; vertices of one cut lie inside sides of another."""
    if depth == 0 or (x1 - x0 < 2 and y1 - y0 < 2):
        return [[box(x0, y0, x1, y1)]] if r.random() < 0.7 else [[[(x0, y0), (x1, y0), (x1, y1)]], [[(x0, y0), (x1, y1), (x0, y1)]]]
    if x1 - x0 >= max(2, y1 - y0):
        m = r.randint(x0 + 1, x1 - 1)
        return cuttings(r, x0, y0, m, y1, depth - 1) + cuttings(r, m, y0, x1, y1, depth - 1)
    m = r.randint(y0 + 1, y1 - 1)
    return cuttings(r, x0, y0, x1, m, depth - 1) + cuttings(r, x0, m, x1, y1, depth - 1)


@pytest.fixture(scope="module")
def shapes():
    """geoid -> polygons in whole metres."""
    r = random.Random(8)
    out = [[p] for p in cuttings(r, 0, 0, 60, 40, 6)]
    out.append([[box(62, 0, 80, 20), box(66, 4, 72, 10)[::-1]]])  # with a hole, filled by the next two
    out += [[[box(66, 4, 72, 7)]], [[box(66, 7, 72, 10)]]]
    out.append([[box(80, 20, 90, 30)]])  # meets the last but two at a corner
    out.append([[box(70, 20, 74, 24)[::-1]], [box(100, 0, 104, 4)]])  # a part elsewhere, clockwise
    out.append([[[(60, 40), (64, 44), (60, 48)]]])  # at a corner of the cuttings
    out.append([[[(62, 42), (70, 50), (80, 46)]]])  # along part of a slanted side
    return {f"{i:03d}": p for i, p in enumerate(out)}


def rows(shapes, group=lambda i: 1):
    return [(g, group(i), [[[(float(x), float(y)) for x, y in ring] for ring in poly] for poly in p]) for i, (g, p) in enumerate(shapes.items())]


def sides_of(polygons):
    return [(r[i], r[(i + 1) % len(r)]) for p in polygons for r in p for i in range(len(r))]


def shared(s, t):
    (a, b), (c, d) = s, t
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    if cross(a, b, c) or cross(a, b, d):
        return 0.0
    dot = lambda p: Fraction((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)
    lo, hi = sorted((dot(c), dot(d)))
    return float(max(0, min(1, hi) - max(0, lo))) * np.hypot(b[0] - a[0], b[1] - a[1])


def gap2(p, s):
    (ax, ay), (bx, by) = s
    t = Fraction((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay), (bx - ax) ** 2 + (by - ay) ** 2)
    t = max(Fraction(0), min(Fraction(1), t))
    return (ax + t * (bx - ax) - p[0]) ** 2 + (ay + t * (by - ay) - p[1]) ** 2


def by_hand(shapes, reach):
    out = {}
    for u, v in itertools.combinations(sorted(shapes), 2):
        p, q = sides_of(shapes[u]), sides_of(shapes[v])
        near = min(min(gap2(a, t) for a, _ in p for t in q), min(gap2(a, s) for a, _ in q for s in p))
        if near <= reach**2:
            out[u, v] = sum(shared(s, t) for s in p for t in q), float(near) ** 0.5
    return out


@pytest.mark.parametrize(("reach", "cell", "snap"), [(0.0, 7.0, 1.0), (3.5, 5.0, 0.5), (0.0, 1000.0, 0.01)])
def test_contacts_against_all_pairs(spark, shapes, reach, cell, snap):
    df = spark.createDataFrame([*rows(shapes), ("nil", 1, None), ("few", 1, [[[(0.0, 0.0), (1.0, 1.0)]]])], SCHEMA)
    got = {(r.u, r.v): (r.length, r.gap) for r in boundaries.contacts(df, snap=snap, cell=cell, reach=reach).collect()}
    want = by_hand(shapes, reach)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {bool(length) for length, _ in want.values()} == {True, False}


def test_three_holders_and_graph(spark):
    far = lambda *b: [[[(x + 1e6, y + 2e6) for x, y in box(*b)]]]
    shapes = {"a": far(0, 0, 10, 10), "b": far(10, 0, 20, 10), "c": far(10, 2, 14, 6), "d": far(10, 10, 20, 20), "e": far(20.5, 0, 30, 10), "z": far(500, 0, 501, 1)}  # c lies over b
    df = spark.createDataFrame(rows(shapes), SCHEMA)
    got = {(r.u, r.v): (r.kind, r.w) for r in boundaries.boundary_graph(df, least=0.0, cell=6.0, reach=1.0).collect()}
    land = {("a", "b"): 10.0, ("a", "c"): 4.0, ("b", "c"): 4.0, ("b", "d"): 10.0}
    assert got == {k: ("land", w) for k, w in land.items()} | {("a", "d"): ("point", 0.1), ("b", "e"): ("water", 7.0), ("d", "e"): ("water", 7.0)}
    kept = boundaries.boundary_graph(df, cell=6.0)
    assert {(r.u, r.v) for r in kept.collect()} == {("a", "b"), ("b", "d")}
    outer = {r.geoid: r.external for r in boundaries.external_perimeters(df, boundaries.boundary_graph(df, least=0.0, cell=6.0)).collect()}
    assert outer["z"] == 4.0 and outer["d"] == pytest.approx(29.9) and outer["a"] == pytest.approx(25.9)
    with pytest.raises(ValueError, match="degrees"):
        boundaries.boundary_graph(spark.createDataFrame(rows({"a": [[box(1, 1, 2, 2)]]}), SCHEMA))
    assert boundaries.boundary_graph(df.where("false")).collect() == []
    edges = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "z"), ("a", "nil"), ("a", "gone")], "u string, v string")
    got = {(r.u, r.v): (r.kind, r.w) for r in boundaries.edge_lengths(edges, spark.createDataFrame([*rows(shapes), ("nil", 1, None)], SCHEMA), cell=6.0).collect()}
    assert got == {("a", "b"): ("land", 10.0), ("a", "d"): ("point", 0.1), ("b", "z"): ("water", 10.0), ("a", "nil"): ("error", 10.0), ("a", "gone"): ("error", 10.0)}


def test_far_and_wide_places(spark):
    """Boxes of very different sizes, strays far from every ring, points far from each other: against all pairs, in few rows."""
    r = random.Random(6)
    b = [(i, x := r.randint(-500, 500), y := r.randint(-500, 500), x + (w := r.choice([0, 1, 3, 40, 700])), y + r.choice([0, 2, w])) for i in range(70)] + [(99, None, 0, 1, 1)]
    got = [tuple(x) for x in spatial.overlapping_boxes(spark.createDataFrame(b, "id long, x0 long, y0 long, x1 long, y1 long"), 2.0).collect()]
    c = b[:-1]
    want = {(p[0], q[0]) for p in c for q in c if p[0] < q[0] and max(p[1], q[1]) <= min(p[3], q[3]) and max(p[2], q[2]) <= min(p[4], q[4])}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.overlapping_boxes(spark.createDataFrame([], "id long, x0 long, y0 long, x1 long, y1 long"), 2.0).collect() == []
    rings = {1: box(0, 0, 10, 10), 2: box(2000, 0, 2001, 1), 3: box(-50, -900, 0, -890)}
    points = {f"p{i}": (r.uniform(-3000, 3000), r.uniform(-3000, 3000)) for i in range(40)} | {"in": (5.0, 5.0), "nil": (None, None)}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], "geoid string, x double, y double")
    polygons = spark.createDataFrame([(d, [(float(x), float(y)) for x, y in ring]) for d, ring in rings.items()], "district int, ring array<struct<x:double,y:double>>")

    def nearest(p):
        def d2(ring):
            out = []
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                out.append((ax + t * (bx - ax) - p[0]) ** 2 + (ay + t * (by - ay) - p[1]) ** 2)
            return min(out)

        return min(rings, key=lambda d: (d2(rings[d]), d))

    got = {x.geoid: x.district for x in spatial.locate(df, polygons, 4.0).collect()}
    assert got == {k: 1 if k == "in" else nearest(p) for k, p in points.items() if k != "nil"}
    some = spark.createDataFrame([(i, *p) for i, p in enumerate([*points.values()][:40])], "id long, x double, y double")
    there = [(i, r.uniform(-9000, 9000), r.uniform(-90, 90)) for i in range(9)]
    near = {x.id: x.to for x in spatial.nearest_points(some, spark.createDataFrame(there, "id long, x double, y double"), 5.0).collect()}
    assert near == {i: min(there, key=lambda t: ((t[1] - p[0]) ** 2 + (t[2] - p[1]) ** 2, t[0]))[0] for i, p in enumerate([*points.values()][:40])}
    with pytest.raises(Exception, match="more than two holders"):
        one = [(g, [(float(x), float(y)) for x, y in box(0, 0, 1, 1)]) for g in "abc"]
        spatial.shared_sides(spark.createDataFrame(one, "geoid string, ring array<struct<x:double,y:double>>"))[0].collect()


def test_median(spark):
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 7 + [9.0] * 6, [float(i * i % 997) for i in range(4001)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert boundaries.median(df, "v") == (float(np.median(values)) if values else None)


def cells_of(polygons):
    """Unit squares of a drawing by ray casting at their middles, for polygons with sides on whole numbers or diagonals: both triangles' middles."""
    out = set()
    for cx, cy in itertools.product(range(-1, 106), range(-1, 52)):
        for k, (dx, dy) in enumerate(((0.7, 0.2), (0.3, 0.6))):
            hit = False
            for p in polygons:
                for ring in p:
                    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                        if (ay > cy + dy) != (by > cy + dy) and cx + dx < ax + (cy + dy - ay) * (bx - ax) / (by - ay):
                            hit = not hit
            if hit:
                out.add((cx, cy, k))
    return out


def area2(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


@pytest.mark.parametrize("cell", [3.0, 500.0])
def test_dissolve_against_cells(spark, cell):
    r = random.Random(4)
    parts = [[p] for p in cuttings(r, 0, 0, 24, 18, 6)] + [[[box(30, 0, 40, 10), box(32, 2, 36, 6)[::-1]]], [[box(32, 2, 36, 4)]], [[box(33, 4, 36, 6)]], [[box(32, 4, 33, 6)]]]
    shapes = {f"{i:03d}": p for i, p in enumerate(parts)}
    n = len(parts)
    group = lambda i: 9 if i == n - 4 else 1 if i == n - 3 else 9 if i == n - 2 else 3 if i == n - 1 else i * 7 % 4
    got = {x.district: [[[(p.x, p.y) for p in ring] for ring in poly] for poly in x.polygons] for x in boundaries.dissolve(spark.createDataFrame(rows(shapes, group), SCHEMA), snap=1.0, cell=cell).collect()}
    assert set(got) == {group(i) for i in range(n)}
    for d, polygons in got.items():
        members = [p for i, p in enumerate(parts) if group(i) == d]
        whole = sum(abs(area2(ring)) * (1 if k == 0 else -1) for p in members for poly in p for k, ring in enumerate(poly))
        assert whole == sum(area2(ring) for poly in polygons for ring in poly)  # holes run clockwise
        assert all(area2(poly[0]) > 0 and all(area2(h) < 0 for h in poly[1:]) for poly in polygons)
        one = [p for m in members for p in m]
        assert set().union(*(cells_of([p]) for p in one)) == cells_of(polygons)
        for poly in polygons:
            for ring in poly:
                for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]):
                    assert (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])
    assert [len(p) for p in got[9]] == [2]  # the enclave's other part is cut off from nothing: one ring and one hole


def test_dissolve_odd_cases(spark):
    make = lambda s, g=lambda i: 1: spark.createDataFrame(rows(s, g), SCHEMA)
    frame = {str(i): [[box(x, y, x + 1, y + 1)]] for i, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1))}
    ring = boundaries.dissolve(make(frame), snap=1.0).first().polygons
    assert [[len(r) for r in p] for p in ring] == [[4, 4]]
    corner = boundaries.dissolve(make({"a": [[box(0, 0, 1, 1)]], "b": [[box(1, 1, 2, 2)]], "c": [[box(5, 5, 6, 6)]]}), snap=1.0).first().polygons
    assert [[len(r) for r in p] for p in corner] == [[4]] * 3
    assert boundaries.dissolve(make(frame).where("false")).collect() == []
    with pytest.raises(Exception, match="overlap"):
        boundaries.dissolve(make({"a": [[box(0, 0, 2, 2)]], "b": [[box(0, 0, 2, 2)]]}), snap=1.0).collect()


def test_long_ring(spark):
    """Some 1,200 corners: as many rounds as that has digits, each as quick as the first."""
    teeth = [(x, y) for i in range(300) for x, y in ((2 * i, 9), (2 * i + 1, 9), (2 * i + 1, 5), (2 * i + 2, 5))]
    ring = [(0, 0), (600, 0), *teeth[::-1]]
    got = boundaries.dissolve(spark.createDataFrame(rows({"a": [[ring]]}), SCHEMA), snap=1.0, cell=50.0).first().polygons
    bent = [b for a, b, c in zip(ring[-1:] + ring, ring, ring[1:] + ring[:1]) if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])]
    found = [(p.x, p.y) for p in got[0][0]]
    at = found.index(bent[0])
    assert len(got) == len(got[0]) == 1 and found[at:] + found[:at] == bent


def test_shapefile_round_trip(spark, shapes, tmp_path):
    shapefile.register(spark)
    table = [(f"5000595{i:04d}", i * 10 if i % 3 else None, i / 7, bool(i % 2), "Ångström" if i % 2 else None, p) for i, (_, _, p) in enumerate(rows(shapes))]
    table.append(("50005990000", 1, None, None, "no shape", None))
    df = spark.createDataFrame(table, "GEOID string, ALAND long, SHARE double, FLAG boolean, NAME string, polygons array<array<array<struct<x:double,y:double>>>>")
    path = str(tmp_path / "t")
    df.repartition(3).write.format("shapefile").mode("append").save(path)
    back = spark.read.format("shapefile").option("records", 4).load(path)
    key = lambda r: (r.GEOID, r.ALAND, r.SHARE, r.FLAG, r.NAME)
    assert Counter(map(key, back.collect())) == Counter(map(key, df.collect()))
    assert back.rdd.getNumPartitions() >= len(table) // 4
    want = {r.GEOID: r.polygons for r in df.collect()}
    spin = lambda ring: min(tuple(ring[i:] + ring[:i]) for i in range(len(ring)))
    for r in back.collect():
        if want[r.GEOID] is None:
            assert r.polygons is None
            continue
        points = lambda polys: sorted(sorted(min(spin(x), spin(x[::-1])) for x in ([(p.x, p.y) for p in ring] for ring in poly)) for poly in polys)
        assert points(r.polygons) == points(want[r.GEOID])
    t = shapefile.tracts(spark, path).collect()
    assert [r.geoid for r in t] == sorted(x[0] for x in table[:-1]) and {r.population for r in t} == {0} and t[0].aland == 0
    files = sorted(tmp_path.glob("t/*.shp"))
    assert files and not list(tmp_path.glob("t/_*"))
    data = files[0].read_bytes()
    assert struct.unpack(">i", data[:4])[0] == 9994 and 2 * struct.unpack(">i", data[24:28])[0] == len(data)


def test_shapefile_faults(spark, tmp_path):
    shapefile.register(spark)
    one = spark.createDataFrame([("5000595710", [[box(0.0, 0.0, 1.0, 1.0)]])], "GEOID string, polygons array<array<array<struct<x:double,y:double>>>>")
    for name, df, message in (("short", one, "11 characters"), ("nocode", one.withColumnRenamed("GEOID", "CODE"), "GEOID")):
        df.coalesce(1).write.format("shapefile").mode("append").save(str(tmp_path / name))
        with pytest.raises(Exception, match=message):
            shapefile.tracts(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="no shapefile"):
        spark.read.format("shapefile").load(str(tmp_path / "none"))
    f = next((tmp_path / "short").glob("*.shp"))
    f.write_bytes(f.read_bytes()[:-20])
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("shapefile").load(str(tmp_path / "short")).collect()
    z = struct.pack("<i4dii", 15, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + np.array([[0, 0], [0, 1], [1, 1], [0, 0]], "<f8").tobytes() + np.zeros(6, "<f8").tobytes()
    assert [len(r) for r in shapefile.decode_shape(z, 1)[0]] == [3]
    with pytest.raises(ValueError, match="record 7"):
        shapefile.decode_shape(struct.pack("<i", 3) + z[4:], 7)
    lake = shapefile.nested([np.array(r, float) for r in (box(0, 0, 9, 9)[::-1], box(1, 1, 8, 8), box(2, 2, 3, 3)[::-1], box(20, 20, 21, 21))])
    assert [[len(r) for r in p] for p in lake] == [[4, 4], [4], [4]]


def test_wkb_with_holes(spark, shapes):
    df = spark.createDataFrame([*rows(shapes), ("nil", 1, None)], SCHEMA)
    back = df.select("geoid", "polygons", binary.wkb_polygons(binary.polygons_to_wkb("polygons")).alias("again")).collect()
    assert all(r.polygons == r.again for r in back) and any(r.again is None for r in back)
    areas = {r.geoid: (r.a, r.p) for r in df.where("geoid <> 'nil'").select("geoid", geometry.polygons_area(df["polygons"]).alias("a"), geometry.polygons_perimeter(df["polygons"]).alias("p")).collect()}
    for g, p in shapes.items():
        want = sum(abs(area2(r)) / 2 * (1 if k == 0 else -1) for poly in p for k, r in enumerate(poly))
        assert areas[g][0] == pytest.approx(want) and areas[g][1] == pytest.approx(sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in sides_of(p)))


def test_rounds_send_no_sides_to_the_driver(spark, monkeypatch):
    """Small files of many sides were broadcast in every round."""
    plans = []
    keep = boundaries.written
    monkeypatch.setattr(boundaries, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    ring = lambda x: [[[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]]]
    units = spark.createDataFrame([(1, ring(float(x))) for x in range(6)], "district int, polygons array<array<array<struct<x:double,y:double>>>>")
    t = boundaries.traced(boundaries.outlines(units, 0.25, 8.0))
    plans.append(t._jdf.queryExecution().executedPlan().toString())
    assert t.count() == 14 and len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_shapes_by_the_block():
    """Records were encoded and decoded one by one; blocks of them give each record's own bytes and polygons."""
    r = random.Random(4)
    ring = lambda n: [{"x": r.random(), "y": r.random()} for _ in range(n)]
    square = lambda x, y, w: [{"x": float(a), "y": float(b)} for a, b in box(x, y, x + w, y + w)]
    table = [None, [], [[ring(2)]], [[square(0, 0, 9), square(1, 1, 2), square(5, 5, 2)], [square(20, 0, 3)[::-1]]], [[square(0, 0, 4)]], [[[]], [ring(5)]], *([[ring(r.randint(3, 9))] for _ in range(r.randint(1, 3))] for _ in range(30))]

    def content(polygons):
        rings = []
        for polygon in polygons or []:
            for i, x in enumerate(polygon):
                p = np.array([(q["x"], q["y"]) for q in x]).reshape(-1, 2)
                if len(p) >= 3:
                    p = p if (shapefile.signed_area(p) < 0) == (i == 0) else p[::-1]
                    rings.append(np.concatenate([p, p[:1]]))
        if not rings:
            return struct.pack("<i", 0)
        points = np.concatenate(rings)
        starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
        return struct.pack("<i4dii", 5, *points.min(axis=0), *points.max(axis=0), len(rings), len(points)) + starts.tobytes() + points.tobytes()

    data, size, boxes, some = shapefile.encode_shapes(pa.array(table, shapefile.ARROW_POLYGONS))
    want = [content(x) for x in table]
    assert data.tobytes() == b"".join(want) and size.tolist() == [len(x) for x in want] and some.tolist() == [len(x) > 4 for x in want]
    back = shapefile.decode_shapes(data, np.cumsum(size) - size, size, np.arange(len(size))).to_pylist()
    tuples = lambda polygons: polygons and [[[(q["x"], q["y"]) for q in x] for x in p] for p in polygons]
    for got, x in zip(back, want):
        n_parts, n_points = struct.unpack_from("<ii", x, 36) if len(x) > 4 else (0, 0)
        points = np.frombuffer(x, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2) if n_parts else np.zeros((0, 2))
        rings = [p[:-1] for p in np.split(points, np.frombuffer(x, "<i4", n_parts, 44)[1:])] if n_parts else []
        assert (tuples(got) or None) == ([[[tuple(q) for q in p.tolist()] for p in polygon] for polygon in shapefile.nested(rings)] or None)
