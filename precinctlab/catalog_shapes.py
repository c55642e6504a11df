"""Registered queries of shapefiles, boundaries, dissolve and circles, with their SQL.

The units stand as bricks of 2,000 by 1,000 metres, 30 a row: every third row is
shifted by half a brick, so that its sides meet two bricks each, and a river of
500 metres follows every tenth row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import LAB, REACH, register, simple
from .functions import geometry
from .operators import boundaries
from .operators.attributes import r6
from .plans import adapters as a
from .sources import binary, shapefile
from .sources.shared import scratch

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def ring(x0, y0, x1, y1):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))


def placed(s, d):
    """idx, geoid and the lower left corner (x0, y0) of each brick."""
    col, row = F.col("idx") % a.WIDTH, F.floor(F.col("idx") / a.WIDTH)
    return a.units_only(s, d).select("idx", "geoid", (1e6 + 2000 * col + F.when(row % 3 == 1, 1000).otherwise(0)).alias("x0"), (2e6 + 1000 * row + 500 * F.floor(row / 10)).alias("y0"))


def bricks(s, d):
    """geoid, polygons; every 11th unit has no geometry."""
    x, y = F.col("x0"), F.col("y0")
    return placed(s, d).select("idx", "geoid", F.when(F.col("idx") % 11 != 7, F.array(F.array(ring(x, y, x + 2000, y + 1000)))).alias("polygons"))


BRICKS = "bk AS (SELECT idx, geoid, 1e6::DOUBLE + 2000 * (idx % 30) + CASE WHEN idx // 30 % 3 = 1 THEN 1000 ELSE 0 END AS x0, 2e6::DOUBLE + 1000 * (idx // 30) + 500 * (idx // 300) AS y0, idx // 30 AS r, idx % 11 <> 7 AS has FROM unit)\n"
PAIRS = BRICKS + """, pr AS (SELECT least(p.geoid, q.geoid) AS u, greatest(p.geoid, q.geoid) AS v, least(p.x0, q.x0) + 2000 - greatest(p.x0, q.x0) AS ox, least(p.y0, q.y0) + 1000 - greatest(p.y0, q.y0) AS oy
  FROM bk p JOIN bk q ON p.idx < q.idx AND q.r - p.r <= 1 AND abs(p.x0 - q.x0) <= 3000 WHERE p.has AND q.has),
ct AS (SELECT u, v, CASE WHEN ox > 0 AND oy = 0 THEN ox WHEN oy > 0 AND ox = 0 THEN oy ELSE 0 END AS length, sqrt(greatest(0, -ox) ** 2 + greatest(0, -oy) ** 2) AS gap FROM pr),
md AS (SELECT coalesce(median(length), 100) AS m FROM ct WHERE length > 0),
kd AS (SELECT u, v, CASE WHEN length > 0 THEN 'land' WHEN gap = 0 THEN 'point' ELSE 'water' END AS kind, CASE WHEN length > 0 THEN length WHEN gap = 0 THEN 0.1 ELSE m END AS w FROM ct, md WHERE gap <= 600)
"""
simple("boundary_graph", lambda s, d: boundaries.boundary_graph(bricks(s, d), least=0.0, reach=600.0).select("u", "v", "kind", r6("w").alias("w")), PAIRS + "SELECT u, v, kind, round(w, 6) AS w FROM kd")
simple("boundary_graph_by_length", lambda s, d: boundaries.boundary_graph(bricks(s, d), least=1000.5).select("u", "v", r6("w").alias("w")), PAIRS + "SELECT u, v, round(w, 6) AS w FROM kd WHERE w > 1000.5 AND kind = 'land'")
simple("boundary_lengths", lambda s, d: boundaries.edge_lengths(a.edges(s, d), bricks(s, d)).select("u", "v", "kind", r6("w").alias("w")), PAIRS + """, ed AS (SELECT e.u, e.v, c.length, c.gap, p.has AND q.has AS present FROM edge e JOIN bk p ON p.geoid = e.u JOIN bk q ON q.geoid = e.v LEFT JOIN (SELECT * FROM ct WHERE gap = 0) c ON c.u = e.u AND c.v = e.v),
em AS (SELECT coalesce(median(length), 100) AS m FROM ed WHERE length > 0)
SELECT u, v, CASE WHEN length > 0 THEN 'land' WHEN gap = 0 THEN 'point' WHEN present THEN 'water' ELSE 'error' END AS kind, round(CASE WHEN length > 0 THEN length WHEN gap = 0 THEN 0.1 ELSE m END, 6) AS w FROM ed, em""")
simple("outer_perimeters", lambda s, d: boundaries.external_perimeters(bricks(s, d), boundaries.boundary_graph(bricks(s, d), least=10.0)).select("geoid", r6("external").alias("external")), PAIRS + """, ends AS (SELECT u AS geoid, w FROM kd WHERE kind = 'land' UNION ALL SELECT v, w FROM kd WHERE kind = 'land')
SELECT geoid, round(greatest(0, any_value(CASE WHEN has THEN 6000 ELSE 0 END) - coalesce(sum(w), 0)), 6) AS external FROM bk LEFT JOIN ends USING (geoid) GROUP BY geoid""")


def unit_squares(s, d):
    """district, polygons: unit squares in a plan with enclaves that meet at corners."""
    x, y = F.col("idx") % a.WIDTH, F.floor(F.col("idx") / a.WIDTH)
    district = F.when((x % 5 == 2) & (y % 5 == 2) | (x % 5 == 3) & (y % 5 == 3), 2).when(x < 15, 1).otherwise(3)
    return a.units_only(s, d).select(district.cast("int").alias("district"), F.array(F.array(ring(x, y, x + 1, y + 1))).alias("polygons"))


# polygons by connection along sides, holes by Euler's formula, vertices by the four squares around each corner of the lattice
simple("dissolved_polygons", lambda s, d: boundaries.dissolve(unit_squares(s, d), snap=0.25, cell=8.0).select("district", F.size("polygons").alias("n_polygons"), F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p) - 1).alias("n_holes"),
       r6(geometry.polygons_area(F.col("polygons"))).alias("area"), r6(geometry.polygons_perimeter(F.col("polygons"))).alias("perimeter"), F.aggregate(F.flatten("polygons"), F.lit(0), lambda n, r: n + F.size(r)).alias("n_vertices")), """
pn AS (SELECT geoid, idx % 30 AS x, idx // 30 AS y, CASE WHEN (idx % 5 = 2 AND idx // 30 % 5 = 2) OR (idx % 5 = 3 AND idx // 30 % 5 = 3) THEN 2 WHEN idx % 30 < 15 THEN 1 ELSE 3 END AS district FROM unit),
""" + LAB.format(p="pn").replace("lab AS", "lab AS", 1) + ", ins AS (SELECT * FROM lab WHERE du = dv), " + REACH.format(e="ins") + """
, cp AS (SELECT district, count(DISTINCT c) AS n FROM (SELECT node, min(label) AS c FROM lb GROUP BY node) t JOIN pn ON geoid = node GROUP BY 1), f AS (SELECT district, count(*) AS n FROM pn GROUP BY 1), i AS (SELECT du AS district, count(*) AS n FROM ins GROUP BY 1),
cr AS (SELECT district, x + dx AS cx, y + dy AS cy, count(*) AS n, sum(CASE WHEN dx = dy THEN 1 ELSE 0 END) AS diagonal FROM pn, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy) GROUP BY 1, 2, 3),
v AS (SELECT district, count(*) FILTER (n = 4) AS inner_n, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND diagonal IN (0, 2) THEN 2 ELSE 0 END) AS corners FROM cr GROUP BY 1)
SELECT district, CAST(cp.n AS INTEGER) AS n_polygons, CAST(cp.n - (f.n - coalesce(i.n, 0) + inner_n) AS INTEGER) AS n_holes, CAST(f.n AS DOUBLE) AS area, CAST(4 * f.n - 2 * coalesce(i.n, 0) AS DOUBLE) AS perimeter, CAST(corners AS INTEGER) AS n_vertices FROM cp JOIN f USING (district) LEFT JOIN i USING (district) JOIN v USING (district)""")


def parcels(s, d):
    """geoid, polygons: a brick, with a hole in every fifth and a second part in every seventh; every 11th has no geometry."""
    x, y = F.col("x0"), F.col("y0")
    one = F.when(F.col("idx") % 5 == 0, F.array(ring(x, y, x + 2000, y + 1000), ring(x + 200, y + 200, x + 500, y + 600))).otherwise(F.array(ring(x, y, x + 2000, y + 1000)))
    return placed(s, d).select("idx", "geoid", F.when(F.col("idx") % 11 != 7, F.when(F.col("idx") % 7 == 0, F.array(one, F.array(ring(x + 2e5, y, x + 2e5 + 100, y + 100)))).otherwise(F.array(one))).alias("polygons"))


def measured(df, *more):
    return df.select("geoid", *more, r6(geometry.polygons_area(F.col("polygons"))).alias("area"), r6(geometry.polygons_perimeter(F.col("polygons"))).alias("perimeter"), F.size(F.flatten("polygons")).alias("n_rings"))


PARCELS = "round(2e6 - CASE WHEN idx % 5 = 0 THEN 120000 ELSE 0 END + CASE WHEN idx % 7 = 0 THEN 10000 ELSE 0 END, 6)::DOUBLE AS area, round(6000 + CASE WHEN idx % 5 = 0 THEN 1400 ELSE 0 END + CASE WHEN idx % 7 = 0 THEN 400 ELSE 0 END, 6)::DOUBLE AS perimeter, CAST(1 + (idx % 5 = 0)::INTEGER + (idx % 7 = 0)::INTEGER AS INTEGER) AS n_rings FROM unit WHERE idx % 11 <> 7"


@register("tract_shapefile_scan", f"SELECT geoid, CAST(coalesce(CASE WHEN idx % 3 > 0 THEN idx * 10 END, 0) AS BIGINT) AS aland, CAST(idx % 17 AS BIGINT) AS awater, CAST(0 AS BIGINT) AS population, {PARCELS}")
def _tracts(s, d):
    path = scratch(s, "tracts")
    shapefile.register(s)
    p = parcels(s, d).select(F.col("geoid").alias("GEOID"), F.when(F.col("idx") % 3 > 0, (F.col("idx") * 10).cast("long")).alias("ALAND"), (F.col("idx") % 17).cast("long").alias("AWATER"), "polygons")
    # a table of few file splits is written by all cores
    p.repartition(s.sparkContext.defaultParallelism, "GEOID").write.format("shapefile").mode("append").save(path)
    return measured(shapefile.tracts(s, path), "aland", "awater", "population")


simple("wkb_holes_roundtrip", lambda s, d: measured(parcels(s, d).where("polygons is not null").select("geoid", binary.wkb_polygons(binary.polygons_to_wkb("polygons")).alias("polygons"))), f"SELECT geoid, {PARCELS}")
