"""Registered queries of resampling, split schedules, places, metropolitan areas and circles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import simple
from .catalog_more import SEATS, seats
from .catalog_shapes import BRICKS, bricks, ring
from .functions import geometry
from .operators import attributes, places, resampling, series, shapes, splits
from .operators.attributes import r6
from .plans import adapters as a

TWENTY = "tw AS (SELECT CAST(idx % 20 + 1 AS INTEGER) AS district, sum(dem) AS dem, sum(rep) AS rep, sum(dem + rep) AS total FROM unit GROUP BY 1), el AS (SELECT *, CASE WHEN total = 0 THEN 0.5 ELSE dem / total END AS dem_pct FROM tw)\n"
DRAWS = """, rw AS (SELECT row_number() OVER (ORDER BY district) - 1 AS i, * FROM el), n AS (SELECT count(*) AS n FROM el),
dr AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || j), 1, 8) AS BIGINT) % n AS i FROM (SELECT unnest(range(1000)) AS b), n, LATERAL (SELECT unnest(range(n)) AS j)),
sw AS (SELECT b, sum(CASE WHEN dem > rep THEN rep ELSE rep - total / 2 END) AS wr, sum(CASE WHEN dem > rep THEN dem - total / 2 ELSE dem END) AS wd, sum(total) AS t, sum(dem) AS d, avg(dem_pct) AS mean, quantile_cont(dem_pct, 0.5) AS med FROM dr JOIN rw USING (i) GROUP BY b),
pb AS (SELECT b, 0.5 - avg(CASE WHEN dem_pct + (0.5 - d / t) >= 0.5 THEN 1.0 ELSE 0.0 END) AS v FROM dr JOIN rw USING (i) JOIN sw USING (b) GROUP BY b),
vs AS (SELECT 'efficiency_gap' AS metric, (wr - wd) / t AS v FROM sw UNION ALL SELECT 'mean_median', mean - med FROM sw UNION ALL SELECT 'partisan_bias', v FROM pb),
sv AS (SELECT metric, list(v ORDER BY v) AS l FROM vs GROUP BY 1)
"""
POINT = """, m AS (SELECT 'efficiency_gap' AS metric, round((sum(CASE WHEN dem > rep THEN rep ELSE rep - total / 2 END) - sum(CASE WHEN dem > rep THEN dem - total / 2 ELSE dem END)) / sum(total), 6) AS value FROM el
UNION ALL SELECT 'mean_median', round(avg(dem_pct) - quantile_cont(dem_pct, 0.5), 6) FROM el UNION ALL SELECT 'partisan_bias', round(0.5 - avg(CASE WHEN dem_pct + h >= 0.5 THEN 1.0 ELSE 0.0 END), 6) FROM el, (SELECT 0.5 - sum(dem) / sum(total) AS h FROM el))
"""


def twenty(s, d):
    u = a.units(s, d)
    return attributes.elections(u, u.select("geoid", (F.col("idx") % 20 + 1).cast("int").alias("district")))


simple("partisan_report_intervals", lambda s, d: resampling.report_with_intervals(twenty(s, d)).select("metric", "value", "direction", "ci_low", "ci_high"), TWENTY + DRAWS + POINT + "SELECT metric, value, CASE WHEN value >= 0 THEN 'Democratic' ELSE 'Republican' END AS direction, round(l[26], 6) AS ci_low, round(l[976], 6) AS ci_high FROM m JOIN sv USING (metric)")
simple("cluster_bootstrap", lambda s, d: resampling.cluster_bootstrap(a.units(s, d), "county", "dem", "rep", draws=10_000), """
cl AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, * FROM (SELECT substr(geoid, 1, 5) AS c, count(*) AS n, sum(rep) AS sx, sum(dem) AS sy, sum(rep * rep) AS sxx, sum(rep * dem) AS sxy FROM unit GROUP BY 1)), k AS (SELECT count(*) AS k FROM cl),
dr AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || j), 1, 8) AS BIGINT) % k AS i FROM (SELECT unnest(range(10000)) AS b), k, LATERAL (SELECT unnest(range(k)) AS j)),
sl AS (SELECT b, CAST(sum(n) * sum(sxy) - sum(sx) * sum(sy) AS DOUBLE) / nullif(CAST(sum(n) * sum(sxx) - sum(sx) * sum(sx) AS DOUBLE), 0) AS v FROM dr JOIN cl USING (i) GROUP BY b), so AS (SELECT list(v ORDER BY v) AS l FROM sl WHERE v IS NOT NULL)
SELECT round(regr_slope(dem, rep), 6) AS slope, round(any_value(l[CAST(floor(len(l) * 0.025) AS INTEGER) + 1]), 6) AS low, round(any_value(l[CAST(floor(len(l) * 0.975) AS INTEGER) + 1]), 6) AS high, any_value(k) AS n_clusters, count(*) AS n FROM unit, so, k""")

# the tail of Student's t by Simpson's rule
simple("sorting_significance", lambda s, d: series.sorting_index(a.units(s, d).withColumn("far", F.col("idx") * 7919 % 101), "county", "far", "pop"), """
g AS (SELECT substr(geoid, 1, 5) AS county, corr(idx * 7919 % 101, pop) AS r, count(*) AS n FROM unit GROUP BY 1), t AS (SELECT county, r, n, n - 2 AS f, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM g WHERE n >= 10),
i AS (SELECT county, sum(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * (1 + (t * j / 2000) ** 2 / f) ** (-(f + 1) / 2)) * t / 6000 AS s FROM t, (SELECT unnest(range(2001)) AS j) GROUP BY county, t)
SELECT g.county, round(CASE WHEN g.n >= 10 THEN g.r END, 6) AS r, round(1 - 2 * s * exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()), 6) AS p, g.n FROM g LEFT JOIN t USING (county) LEFT JOIN i USING (county)""")

TREE = SEATS + ", tr(seats, depth, path, k) AS (SELECT DISTINCT CAST(house AS BIGINT), 0, '', CAST(house AS BIGINT) FROM st UNION ALL SELECT seats, depth + 1, path || side, CASE side WHEN '0' THEN k // 2 ELSE k - k // 2 END FROM tr, (VALUES ('0'), ('1')) v(side) WHERE k > 1)\n"
simple("bisection_schedule", lambda s, d: splits.bisection_schedule(seats(s, d).select(F.col("house").alias("k"))), TREE + "SELECT seats, depth, path, k, k // 2 AS k_left, k - k // 2 AS k_right FROM tr WHERE k > 1")
simple("splits_per_depth", lambda s, d: splits.splits_per_depth(seats(s, d).select(F.col("house").alias("k"))), TREE + "SELECT seats, depth, count(*) AS n_splits FROM tr WHERE k > 1 GROUP BY 1, 2")

TOP = 435
RULE = f"""nm AS (SELECT unnest(range(1, {TOP + 1})) AS k), pr AS (SELECT k AS p FROM nm WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM nm m WHERE m.k BETWEEN 2 AND CAST(floor(sqrt(nm.k)) AS BIGINT) AND nm.k % m.k = 0)),
rl AS (SELECT k, max(p) AS p, CASE WHEN k <= 3 THEN 'direct' WHEN max(p) = k THEN 'halves' ELSE 'equal' END AS kind FROM nm LEFT JOIN pr ON k % p = 0 GROUP BY k),
ps AS (SELECT k, kind, CASE kind WHEN 'direct' THEN k WHEN 'halves' THEN 2 ELSE p END AS parts, CASE kind WHEN 'direct' THEN list_transform(range(k), lambda x: 1) WHEN 'halves' THEN [k // 2, k - k // 2] ELSE list_transform(range(p), lambda x: k // p) END AS sub FROM rl)
"""


def prescribed(s, d):
    """Rules of the seat numbers that the states' houses have."""
    p = splits.prescriptions(s, TOP).join(seats(s, d).select(F.col("house").cast("long").alias("k")).distinct(), "k", "left_semi")
    return p.select("k", "kind", "parts", F.array_join("sub", ",").alias("sub"))


simple("split_prescriptions", prescribed, SEATS + ", " + RULE + "SELECT k, kind, parts, array_to_string(sub, ',') AS sub FROM ps WHERE k IN (SELECT house FROM st)")
simple("cut_depths", lambda s, d: splits.cut_depths(s, TOP).join(seats(s, d).select(F.col("house").cast("long").alias("k")).distinct(), "k", "left_semi"), SEATS + ", " + RULE + ", dt(whole, k, depth) AS (SELECT k, k, 0 FROM nm UNION ALL SELECT whole, child, depth + 1 FROM dt JOIN (SELECT DISTINCT k, unnest(sub) AS child FROM ps WHERE k > 1) c USING (k))\nSELECT whole AS k, max(depth) AS depth FROM dt WHERE whole IN (SELECT house FROM st) GROUP BY 1")
FACTORS = "list_transform(list_sort(flatten(list_transform(range(2, {n} + 1), lambda p: CASE WHEN {n} % p = 0 AND len(list_filter(range(2, p), lambda q: p % q = 0)) = 0 THEN list_transform(list_filter(range(1, 10), lambda e: {n} % CAST(p ** e AS BIGINT) = 0), lambda e: p) ELSE [] END))), lambda x: x)"
simple("chamber_spines", lambda s, d: splits.spines(seats(s, d), "state", ["k", "senate", "house"]).select("state", *[F.array_join(c, ",").alias(c) for c in ("trunk", "k", "senate", "house")]), SEATS + ", gg AS (SELECT *, gcd(gcd(k, senate), house) AS g FROM st), ff AS (SELECT state, " + ", ".join(f"{FACTORS.format(n=n)} AS {c}" for n, c in (("g", "f"), ("(k // g)", "kf"), ("(senate // g)", "sf"), ("(house // g)", "hf"))) + " FROM gg)\nSELECT state, array_to_string(f, ',') AS trunk, array_to_string(list_concat(f, kf), ',') AS k, array_to_string(list_concat(f, sf), ',') AS senate, array_to_string(list_concat(f, hf), ',') AS house FROM ff")


def cities(s, d):
    """Suppliers as places on the units' squares and beyond them; names repeat."""
    k = F.col("s_suppkey").cast("long")
    rows = a.units_only(s, d).agg((F.max(F.floor(F.col("idx") / a.WIDTH)) + 1).alias("rows"))
    p = a.read(s, d, "supplier").join(F.broadcast(rows))  # one row
    return p.select(k.alias("geoid"), F.concat(F.lit("City "), k % 17).alias("name"), (k * 104729 % 1_400_000).alias("population"), (k % 31 + 0.5).alias("x"), (k * 13 % (F.col("rows") + 1) + 0.25).alias("y"))


def areas(s, d):
    x, y = F.col("idx") % a.WIDTH, F.floor(F.col("idx") / a.WIDTH)
    return a.units_only(s, d).join(a.plan_b(s, d, 9), "geoid").select("district", F.array(F.array(ring(x, y, x + 1, y + 1))).alias("polygons"))


simple("district_labels", lambda s, d: places.district_labels(places.places_in_districts(cities(s, d), areas(s, d), 4.0), 10), """
sq AS (SELECT idx % 30 AS x, idx // 30 AS y, CAST(idx * 9 // (SELECT count(*) FROM unit) + 1 AS INTEGER) AS district FROM unit), ro AS (SELECT max(y) + 1 AS n FROM sq), ct AS (SELECT CAST(s_suppkey AS BIGINT) AS geoid, 'City ' || CAST(s_suppkey % 17 AS BIGINT) AS name, CAST(s_suppkey AS BIGINT) * 104729 % 1400000 AS population, s_suppkey % 31 AS x, s_suppkey * 13 % (n + 1) AS y FROM supplier, ro),
rk AS (SELECT district, geoid, name, population, ct.x + 0.5::DOUBLE AS x, ct.y + 0.25::DOUBLE AS y, row_number() OVER (PARTITION BY district ORDER BY population DESC, geoid) AS r FROM ct JOIN sq USING (x, y)),
ld AS (SELECT *, CASE WHEN population > 1000000 THEN 'huge' WHEN population > 500000 THEN 'major' ELSE 'other' END AS class, row_number() OVER (PARTITION BY CASE WHEN population > 1000000 THEN 1 WHEN population > 500000 THEN 2 ELSE 3 END, name ORDER BY district) AS turn FROM rk WHERE r = 1),
nx AS (SELECT l.district, min(k.r) AS r FROM ld l JOIN rk k ON k.district = l.district AND k.r > 1 AND k.name <> l.name WHERE (class = 'huge' AND k.r <= 10 AND k.population > 20000) OR (class = 'major' AND turn > 1 AND k.r <= 5 AND k.population > 10000) GROUP BY 1),
ax AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS district)
SELECT ax.district, coalesce(k.name, 'None') AS largest_city, CAST(coalesce(k.population, 0) AS BIGINT) AS city_population, k.x, k.y FROM ax LEFT JOIN nx USING (district) LEFT JOIN rk k ON k.district = ax.district AND k.r = coalesce(nx.r, 1)""")


def metros(s, d):
    """Two overlapping areas of counties per region; the first two counties of each are its core."""
    n = a.read(s, d, "nation").select(F.col("n_regionkey").cast("int").alias("g"), F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0")).alias("state"), (F.col("n_nationkey") % 5).alias("i"))
    named = lambda name, place, where, core: n.where(where).select(F.concat(F.lit(name), "g").alias("metro"), place.alias("place"), "state", core.alias("core"))
    return named("Wide ", F.col("g") * 2 + 1, "i >= 0", F.col("i") < 2).union(named("Near ", F.col("g") * 2, "i < 4", F.col("i") < 1))


def reaching(s, d):
    return a.units_only(s, d).select(F.floor(F.col("idx") / 2).alias("district"), F.substring("geoid", 1, 5).alias("state"))


METRO = """nt AS (SELECT n_regionkey AS g, lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') AS state, n_nationkey % 5 AS i FROM nation),
mt AS (SELECT 'Wide ' || g AS metro, g * 2 + 1 AS place, list(state) AS states, list(state) FILTER (i < 2) AS core FROM nt GROUP BY g UNION ALL SELECT 'Near ' || g, g * 2, list(state), list(state) FILTER (i < 1) FROM nt WHERE i < 4 GROUP BY g),
ds AS (SELECT idx // 2 AS district, list_sort(list(DISTINCT substr(geoid, 1, 5))) AS states FROM unit GROUP BY 1 HAVING count(DISTINCT substr(geoid, 1, 5)) > 1),
mm AS (SELECT ds.district, array_to_string(ds.states, '-') AS states, (SELECT metro FROM mt WHERE list_has_all(mt.states, ds.states) AND list_has_any(coalesce(mt.core, []), ds.states) ORDER BY place LIMIT 1) AS metro FROM ds)
"""
simple("metro_matches", lambda s, d: places.metro_matches(reaching(s, d), metros(s, d)), METRO + "SELECT district, states, metro FROM mm")
simple("metro_summary", lambda s, d: places.metro_summary(places.metro_matches(reaching(s, d), metros(s, d))), METRO + "SELECT metro, count(*) AS n_districts, round(count(*) / (SELECT count(*) FROM mm), 6) AS share FROM mm GROUP BY 1")


def grouped(s, d):
    """Bricks near the origin in districts of five."""
    b = bricks(s, d).where("polygons IS NOT NULL")
    near = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct((q["x"] / 1000 - 1000).alias("x"), (q["y"] / 1000 - 2000).alias("y")))))
    return b.select(F.floor(F.col("idx") / 5).alias("district"), near.alias("polygons"))


# every pair and triple of corners, the smallest of those around all of them
simple("enclosing_circles", lambda s, d: shapes.enclosing_circles(grouped(s, d)), BRICKS + """, gp AS (SELECT idx // 5 AS district, x0 / 1000 - 1000 AS x0, y0 / 1000 - 2000 AS y0 FROM bk WHERE has),
pt AS (SELECT DISTINCT district, x0 + dx AS x, y0 + dy AS y FROM gp, (VALUES (0, 0), (2, 0), (0, 1), (2, 1)) v(dx, dy)), nu AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY x, y) AS i FROM pt), ar AS (SELECT district, 2 * count(*) AS area FROM gp GROUP BY 1),
tw AS (SELECT p.district, (p.x + q.x) / 2 AS cx, (p.y + q.y) / 2 AS cy, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS d2 FROM nu p JOIN nu q ON p.district = q.district AND p.i < q.i),
th AS (SELECT p.district, p.x AS ax, p.y AS ay, q.x - p.x AS bx, q.y - p.y AS by_, r.x - p.x AS cx, r.y - p.y AS cy, 2 * ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) AS d FROM nu p JOIN nu q ON p.district = q.district AND p.i < q.i JOIN nu r ON q.district = r.district AND q.i < r.i),
tc AS (SELECT district, ax + ux AS cx, ay + uy AS cy, ux * ux + uy * uy AS r2 FROM (SELECT district, ax, ay, (cy * (bx * bx + by_ * by_) - by_ * (cx * cx + cy * cy)) / d AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by_ * by_)) / d AS uy FROM th WHERE d <> 0)),
al AS (SELECT district, cx, cy, d2 / 4 AS r2 FROM tw UNION ALL SELECT * FROM tc), ok AS (SELECT al.district, cx, cy, r2 FROM al WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.district = al.district AND (pt.x - al.cx) ** 2 + (pt.y - al.cy) ** 2 > al.r2 + 1e-9)),
bs AS (SELECT district, arg_min(cx, r2) AS cx, arg_min(cy, r2) AS cy, min(r2) AS r2 FROM ok GROUP BY 1)
SELECT district, round(cx, 6) AS x, round(cy, 6) AS y, round(sqrt(r2), 6) AS r, round(least(1.0, area / (pi() * r2)), 6) AS reock FROM bs JOIN ar USING (district)""")

simple("equal_area_points", lambda s, d: a.units_only(s, d).select("geoid", *[r6(c / 1000).alias(n) for n, c in zip("xy", geometry.albers(-125 + (F.col("idx") % 30) * 2.0, 25 + F.floor(F.col("idx") / 30) % 25 * 1.0))]), """
ab AS (SELECT 2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE ** 2 AS e2), ec AS (SELECT e2, sqrt(e2) AS e FROM ab), pt AS (SELECT geoid, -125 + (idx % 30) * 2.0::DOUBLE AS lon, 25 + idx // 30 % 25 * 1.0::DOUBLE AS lat FROM unit),
ph AS (SELECT 'a' AS n, 29.5::DOUBLE AS p UNION ALL SELECT 'b', 45.5 UNION ALL SELECT 'o', 23.0 UNION ALL SELECT geoid, lat FROM pt),
qs AS (SELECT n, cos(radians(p)) ** 2 / (1 - e2 * sin(radians(p)) ** 2) AS m2, (1 - e2) * (sin(radians(p)) / (1 - e2 * sin(radians(p)) ** 2) - ln((1 - e * sin(radians(p))) / (1 + e * sin(radians(p)))) / (2 * e)) AS q FROM ph, ec),
cn AS (SELECT x.m2 AS m2, x.q AS q1, (x.m2 - y.m2) / (y.q - x.q) AS k, o.q AS q0 FROM qs x, qs y, qs o WHERE x.n = 'a' AND y.n = 'b' AND o.n = 'o'),
rh AS (SELECT geoid, k * radians(lon + 96) AS t, 6378137 * sqrt(cn.m2 + k * q1 - k * q) / k AS r, 6378137 * sqrt(cn.m2 + k * q1 - k * q0) / k AS r0 FROM pt JOIN qs ON n = geoid, cn)
SELECT geoid, round(r * sin(t) / 1000, 6) AS x, round((r0 - r * cos(t)) / 1000, 6) AS y FROM rh""")
