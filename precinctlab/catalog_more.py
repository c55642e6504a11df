"""Registered queries of roll-ups, graph building, shapes, sampling weights and scalars, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CANON, EL, K, LAB, QUOTA, REACH, TR, heavy, minority_share, over, register, simple, state_pops  # noqa: F401
from .operators import allocation, attributes, comparison, graph, partisan, roll_ups, series, shapes, spatial
from .operators.attributes import r6
from .plans import adapters as a

#: Orthogonal polynomials of degree 0 to 3, one step a degree.
STEP = """, s{k} AS (SELECT sum(p1 * p1) AS pp, sum(x * p1 * p1) AS xpp, sum(y * p1) AS yp FROM c{k}),
c{n} AS (SELECT x, y, p1 AS p0, (x - CASE WHEN pp > 1e-30 THEN xpp / pp ELSE 0 END) * p1 - {back} * p0 AS p1, fit + CASE WHEN pp > 1e-30 THEN yp / pp ELSE 0 END * p1 AS fit,
at1 AS at0, -(CASE WHEN pp > 1e-30 THEN xpp / pp ELSE 0 END) * at1 - {back} * at0 AS at1, bias + CASE WHEN pp > 1e-30 THEN yp / pp ELSE 0 END * at1 AS bias, CASE WHEN pp > 1e-30 THEN pp ELSE 1 END AS before FROM c{k}, s{k})"""
CUBIC = EL + ", c0 AS (SELECT dem / total - 0.5 AS x, CASE WHEN dem > rep THEN 1.0::DOUBLE ELSE 0.0 END AS y, 0.0::DOUBLE AS p0, 1.0::DOUBLE AS p1, 0.0::DOUBLE AS fit, 0.0::DOUBLE AS at0, 1.0::DOUBLE AS at1, 0.0::DOUBLE AS bias, 1.0::DOUBLE AS before FROM el WHERE total > 0)" + "".join(STEP.format(k=k, n=k + 1, back="(pp / before)" if k else "0.0") for k in range(4))
simple("partisan_bias_cubic", over(partisan.bias_cubic), CUBIC + """
SELECT round(CASE WHEN count(*) < 3 THEN avg(y) - 0.5 ELSE max(bias) - 0.5 END, 4) AS cubic_bias, round(CASE WHEN count(*) < 3 THEN 1.0 WHEN var_pop(y) > 0 THEN 1 - sum((y - fit) ** 2) / (var_pop(y) * count(*)) ELSE 0 END, 4) AS r_squared FROM c4""")
simple("partisan_report", over(partisan.report), EL + """
, n AS (SELECT count(*) AS n, round(sum(dem) / sum(total), 6) AS v, round(count(*) FILTER (dem > rep) / count(*), 6) AS s FROM el),
m AS (SELECT 'efficiency_gap' AS metric, round((sum(CASE WHEN dem > rep THEN rep ELSE rep - total / 2 END) - sum(CASE WHEN dem > rep THEN dem - total / 2 ELSE dem END)) / sum(total), 6) AS value FROM el
UNION ALL SELECT 'mean_median', round(avg(dem_pct) - quantile_cont(dem_pct, 0.5), 6) FROM el UNION ALL SELECT 'partisan_bias', round(0.5 - avg(CASE WHEN dem_pct + h >= 0.5 THEN 1.0 ELSE 0.0 END), 6) FROM el, (SELECT 0.5 - sum(dem) / sum(total) AS h FROM el))
SELECT metric, value, CASE WHEN value >= 0 THEN 'Democratic' ELSE 'Republican' END AS direction, n >= 10 AS ci_available, CASE WHEN n < 10 THEN 'at least 10 districts are needed, found ' || n END AS ci_reason, v AS dem_vote_share, s AS dem_seat_share FROM m, n""")
simple("close_call_districts", over(partisan.close_calls), EL + "SELECT district, round(dem_pct, 6) AS dem_share, CASE WHEN dem_pct >= 0.5 THEN 'above' ELSE 'below' END AS side FROM el WHERE dem_pct BETWEEN 0.48 AND 0.52")


def by_state(s, d):
    return a.units(s, d).groupBy("state").agg(F.sum("pop").alias("pop"), F.sum("dem").alias("dem"), F.sum("rep").alias("rep"))


simple("competitive_states", lambda s, d: by_state(s, d).select("state", r6(F.abs(F.col("dem") - F.col("rep")) / (F.col("dem") + F.col("rep"))).alias("margin")).where("margin < 0.05"),
       "SELECT * FROM (SELECT substr(geoid, 1, 2) AS state, round(abs(sum(dem) - sum(rep)) / (sum(dem) + sum(rep)), 6) AS margin FROM unit GROUP BY 1) WHERE margin < 0.05")
simple("populated_units", lambda s, d: a.units(s, d).where("pop >= 100").select("geoid", "pop"), "SELECT geoid, pop FROM unit WHERE pop >= 100")
simple("density_class", lambda s, d: a.units(s, d).select("geoid", roll_ups.density_class(F.col("pop") / (F.col("idx") % 11 + 1), 100, 40, (3, 5, 7)).alias("size")),
       "SELECT geoid, CASE WHEN pop / (idx % 11 + 1) >= 100 THEN '7-member' WHEN pop / (idx % 11 + 1) >= 40 THEN '5-member' ELSE '3-member' END AS size FROM unit")


def state_districts(s, d):
    u = a.units(s, d).join(a.plan_a(s, d), "geoid")
    return u.where("state <> '05'").groupBy("state", "district").agg(F.sum("pop").alias("population"))


simple("us_aggregate", lambda s, d: roll_ups.us_aggregate(state_districts(s, d), by_state(s, d).select("state", F.col("pop").alias("population"))), """
r AS (SELECT substr(geoid, 1, 2) AS state, CASE WHEN substr(geoid, 1, 2) = '05' THEN 1 ELSE district END AS district, CAST(sum(pop) AS BIGINT) AS population FROM unit JOIN plan_a USING (geoid) GROUP BY 1, 2),
m AS (SELECT state, avg(population) AS m FROM r GROUP BY 1) SELECT state, district, population, round(m, 6) AS state_mean, round(100 * (population - m) / m, 6) AS deviation_pct FROM r JOIN m USING (state)""")


def plan_leans(s, d):
    """config, district, lean, score of both plans."""
    u, parts = a.units(s, d), []
    for name in ("plan_a", "plan_b"):
        e = attributes.elections(u, getattr(a, name)(s, d))
        parts.append(e.select(F.lit(name).alias("config"), "district", (1000 * (F.col("dem_pct") - 0.5)).alias("lean"), (F.col("total") / 1000).alias("score")))
    return parts[0].union(parts[1])


LEANS = "ln AS (" + " UNION ALL ".join(f"SELECT '{p}' AS config, district, 1000 * (sum(dem) / (sum(dem) + sum(rep)) - 0.5) AS lean, (sum(dem) + sum(rep)) / 1000 AS score FROM {p} JOIN unit USING (geoid) GROUP BY 2" for p in ("plan_a", "plan_b")) + ")\n"
simple("config_metrics", lambda s, d: roll_ups.config_metrics(plan_leans(s, d)), LEANS + "SELECT config, count(*) AS n_districts, round(avg(abs(lean)), 6) AS mean_abs_lean, round(stddev_samp(lean), 6) AS std_lean, " + ", ".join(f"count(*) FILTER (abs(lean) > {t}) AS safe_{t}, round(100 * count(*) FILTER (abs(lean) > {t}) / count(*), 6) AS safe_{t}_pct" for t in (10, 15, 20)) + ", round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score FROM ln GROUP BY 1")
simple("config_pivot", lambda s, d: roll_ups.pivoted(plan_leans(s, d), "district", "config", ["plan_a", "plan_b"], "lean"), LEANS + "SELECT district, round(avg(lean) FILTER (config = 'plan_a'), 6) AS plan_a, round(avg(lean) FILTER (config = 'plan_b'), 6) AS plan_b FROM ln GROUP BY 1")
simple("quantile_summary", lambda s, d: roll_ups.quantiles(a.units(s, d), "pop"), "SELECT count(pop) AS n, round(avg(pop), 6) AS mean, round(quantile_cont(pop, 0.5), 6) AS median, round(quantile_cont(pop, 0.25), 6) AS q25, round(quantile_cont(pop, 0.75), 6) AS q75 FROM unit")
simple("sides_compared", lambda s, d: roll_ups.compare_sides(plan_leans(s, d).where("config = 'plan_a'").withColumn("lean", F.abs("lean")), plan_leans(s, d).where("config = 'plan_b'").withColumn("lean", F.abs("lean")), "district", ["score", "lean"]), LEANS + """
SELECT x.district, round(x.score, 6) AS ours_score, round(y.score, 6) AS theirs_score, round(abs(x.lean), 6) AS ours_lean, round(abs(y.lean), 6) AS theirs_lean, round(100 * (x.score - y.score) / y.score, 6) AS score_improvement_pct, round(100 * (abs(x.lean) - abs(y.lean)) / nullif(abs(y.lean), 0), 6) AS lean_improvement_pct
FROM ln x JOIN ln y ON x.district = y.district AND x.config = 'plan_a' AND y.config = 'plan_b'""")
simple("extreme_units", lambda s, d: roll_ups.extremes(a.units(s, d).select("geoid", "pop"), "geoid", "pop", 5), "(SELECT 'top' AS side, geoid, pop FROM unit ORDER BY pop DESC, geoid LIMIT 5) UNION ALL (SELECT 'bottom', geoid, pop FROM unit ORDER BY pop, geoid LIMIT 5)".replace("(SELECT 'top'", "t AS (SELECT 'top'", 1).replace(" UNION ALL (SELECT 'bottom'", ", b AS (SELECT 'bottom' AS side") + " SELECT * FROM t UNION ALL SELECT * FROM b")
simple("reassignment_stability", lambda s, d: roll_ups.reassigned(a.plan_a(s, d), a.plan_b(s, d), F.substring("geoid", 1, 2)), "SELECT substr(geoid, 1, 2) AS grp, count(*) AS n_units, count(*) FILTER (x.district <> y.district) AS n_moved, round(1 - count(*) FILTER (x.district <> y.district) / count(*), 6) AS stability FROM plan_a x JOIN plan_b y USING (geoid) GROUP BY 1")
simple("urban_share", lambda s, d: roll_ups.urban_share(a.units(s, d).select("state", "pop", (F.col("idx") % 11 + 1).cast("double").alias("area")), 100.0), "SELECT substr(geoid, 1, 2) AS state, round(sum(CASE WHEN pop / (idx % 11 + 1) > 100 THEN pop ELSE 0 END) / sum(pop), 6) AS urban_share FROM unit GROUP BY 1")
CROSS = "cs AS (SELECT district, substr(geoid, 1, 2) AS state, count(*) AS n_units, CAST(sum(pop) AS BIGINT) AS pop FROM unit JOIN plan_b USING (geoid) GROUP BY 1, 2)\n"
simple("cross_state_composition", lambda s, d: roll_ups.cross_state(a.units(s, d), a.plan_b(s, d)), CROSS + "SELECT district, state, n_units, pop, round(pop / sum(pop) OVER (PARTITION BY district), 6) AS seat_fraction FROM cs")
simple("cross_state_pairs", lambda s, d: roll_ups.shared_pairs(roll_ups.cross_state(a.units(s, d), a.plan_b(s, d))), CROSS + "SELECT x.state AS state_a, y.state AS state_b, count(*) AS n_districts FROM cs x JOIN cs y ON x.district = y.district AND x.state < y.state GROUP BY 1, 2")
simple("vote_disaggregation", lambda s, d: roll_ups.disaggregated(a.units(s, d).select("geoid", F.col("county").alias("area"), F.col("pop").alias("vap")), a.units(s, d).where("state <> '03'").groupBy(F.col("county").alias("area")).agg(F.sum("dem").alias("dem"), F.sum("rep").alias("rep"))), """
c AS (SELECT substr(geoid, 1, 5) AS area, sum(pop) AS p, CASE WHEN substr(area, 1, 2) <> '03' THEN sum(dem) END AS d, CASE WHEN substr(area, 1, 2) <> '03' THEN sum(rep) END AS r FROM unit GROUP BY 1)
SELECT geoid, round(coalesce(d, 0) * coalesce(pop / nullif(p, 0), 0), 6) AS dem_votes, round(coalesce(r, 0) * coalesce(pop / nullif(p, 0), 0), 6) AS rep_votes, round(CASE WHEN d IS NULL OR p <= 0 OR d + r = 0 THEN 0.5 ELSE d / (d + r) END, 6) AS dem_share FROM unit JOIN c ON area = substr(geoid, 1, 5)""")


def log_weights(s, d):
    return a.units(s, d).select(F.col("idx").alias("id"), (F.col("pop") / 50.0 - F.col("idx") % 7).alias("lw"))


LW = "lw AS (SELECT idx AS id, pop / 50.0::DOUBLE - idx % 7 AS lw FROM unit), mx AS (SELECT max(lw) AS m FROM lw), sm AS (SELECT sum(exp(lw - m)) AS s, sum(exp(2 * (lw - m))) AS q, max(m) AS m, count(*) AS n FROM lw, mx)\n"
simple("weight_summary", lambda s, d: roll_ups.weight_summary(log_weights(s, d)), LW + "SELECT n, round(m + ln(s), 6) AS log_sum, round(s * s / q, 6) AS ess FROM sm")
simple("weight_softmax", lambda s, d: roll_ups.softmax(log_weights(s, d)).select("id", r6("weight").alias("weight")), LW + "SELECT id, round(exp(lw - m) / s, 6) AS weight FROM lw, sm")
simple("systematic_resample", lambda s, d: roll_ups.systematic_resample(log_weights(s, d), 500, 0.00137).select(F.col("draw").cast("long").alias("draw"), "id"), LW + """
, cw AS (SELECT id, sum(exp(lw - m) / s) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM lw, sm), dr AS (SELECT CAST(unnest(range(0, 500)) AS BIGINT) AS draw)
SELECT draw, (SELECT min(id) FROM cw WHERE upto >= 0.00137 + draw / 500.0 - 2e-12) AS id FROM dr""")
simple("ensemble_report", lambda s, d: roll_ups.ensemble_report(a.traces(s, d), 50.0), TR + """, c AS (SELECT chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM tr GROUP BY 1), g AS (SELECT count(*) AS k, max(n) AS n, avg(v) AS w, var_samp(m) AS b FROM c)
SELECT k AS n_chains, k * n AS n_steps, round(sqrt(((n - 1) / n * w + b) / w), 6) AS r_hat, (SELECT round(avg(CASE WHEN value <= 50.0 THEN 1.0 ELSE 0.0 END), 6) FROM tr) AS percentile_rank, sqrt(((n - 1) / n * w + b) / w) < 1.05 AS passed FROM g""")


def hamming(s, d):
    return series.hamming_by_lag(series.trimmed(a.traces(s, d)).select("chain", F.lit(0).alias("unit"), "step", F.floor(F.col("value") / 10).alias("label")), 4)


simple("hamming_tau", lambda s, d: roll_ups.integrated_time(hamming(s, d)), TR + """, h AS (SELECT b.step - a.step AS lag, round(avg(CASE WHEN floor(a.value / 10) <> floor(b.value / 10) THEN 1.0 ELSE 0.0 END), 6) AS h FROM tr a JOIN tr b ON a.chain = b.chain AND b.step - a.step BETWEEN 1 AND 4 GROUP BY 1)
SELECT round(1 + 2 * coalesce(sum(1 - h), 0), 6) AS tau FROM h WHERE lag < coalesce((SELECT min(lag) FROM h WHERE h >= 1), 99)""")

# graphs
simple("chamber_adjacency", lambda s, d: graph.chamber_adjacency(a.edges(s, d), a.plan_b(s, d)), LAB.format(p="plan_b") + ", ins AS (SELECT * FROM lab WHERE du = dv), " + REACH.format(e="ins") + """
, comp AS (SELECT node, min(label) AS c FROM lb GROUP BY node), sz AS (SELECT district, c, count(*) AS n FROM comp JOIN plan_b ON geoid = node GROUP BY 1, 2), best AS (SELECT district, c FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY n DESC, c) AS r FROM sz) WHERE r = 1),
main AS (SELECT node FROM comp JOIN plan_b ON geoid = node JOIN best USING (district, c)) SELECT least(du, dv) AS d1, greatest(du, dv) AS d2, count(*) AS n_edges FROM lab WHERE du <> dv AND u IN (FROM main) AND v IN (FROM main) GROUP BY 1, 2""")


@register("exit_code", "lab AS (SELECT e.*, x.district AS du, y.district AS dv FROM edge e JOIN plan_a x ON x.geoid = e.u JOIN plan_a y ON y.geoid = e.v), ins AS (SELECT * FROM lab WHERE du = dv), " + REACH.format(e="ins") + """
, comp AS (SELECT node, min(label) AS c FROM lb GROUP BY node), nc AS (SELECT district, count(DISTINCT c) AS n FROM comp JOIN plan_a ON geoid = node GROUP BY 1),
hs AS (SELECT DISTINCT x.district AS h, y.district AS s FROM plan_b x JOIN plan_a y USING (geoid)), sp AS (SELECT h, count(*) > 1 AS spans FROM hs GROUP BY h), bad AS (SELECT s FROM hs JOIN sp USING (h) GROUP BY s HAVING count(*) <> 2 OR bool_or(spans))
SELECT district, CAST(CASE WHEN abs(pop - i) / i > 0.02 THEN 1 ELSE 0 END + CASE WHEN coalesce(nc.n, 0) > 1 THEN 2 ELSE 0 END + CASE WHEN district IN (FROM bad) THEN 4 ELSE 0 END + CASE WHEN dem + rep = 0 THEN 8 ELSE 0 END AS INTEGER) AS code FROM full_dist LEFT JOIN nc USING (district), (SELECT avg(pop) AS i FROM full_dist)""")
def _exit(s, d):
    plan = a.plan_a(s, d)
    x = attributes.by_district(a.units(s, d), plan, ["pop", "dem", "rep"], K)
    x = x.join(F.broadcast(x.agg(F.avg("pop").alias("i"))))
    x = x.join(graph.contiguity(a.edges(s, d), plan, K).select("district", "contiguous"), "district")
    x = x.join(comparison.nesting_violations(a.plan_b(s, d), plan, 2).select(F.col("senate_district").alias("district"), F.lit(True).alias("broken")), "district", "left")
    return x.select("district", comparison.exit_code(F.abs(F.col("pop") - F.col("i")) / F.col("i") > 0.02, ~F.col("contiguous"), F.coalesce("broken", F.lit(False)), F.col("dem") + F.col("rep") == 0).cast("int").alias("code"))


def points(s, d):
    return a.units_only(s, d).select("geoid", (F.col("idx") % a.WIDTH).cast("double").alias("x"), F.floor(F.col("idx") / a.WIDTH).cast("double").alias("y"))


simple("bridge_edges", lambda s, d: graph.bridges(heavy(s, d), points(s, d), 2.0), "hv AS (SELECT * FROM edge WHERE w >= 5), " + REACH.format(e="hv") + """
, comp AS (SELECT node, min(label) AS c FROM lb GROUP BY node), best AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), pt AS (SELECT geoid, idx % 30 AS x, idx // 30 AS y, substr(geoid, 1, 5) AS county, c = (FROM best) AS main FROM unit JOIN comp ON node = geoid),
cand AS (SELECT p.geoid AS id, q.geoid AS t, row_number() OVER (PARTITION BY p.geoid ORDER BY p.county <> q.county, (p.x - q.x) ** 2 + (p.y - q.y) ** 2, q.geoid) AS r FROM pt p JOIN pt q ON NOT p.main AND q.main)
SELECT DISTINCT least(id, t) AS u, greatest(id, t) AS v FROM cand WHERE r = 1""")


def squares(s, d):
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return points(s, d).select("geoid", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


SIDES = """pt AS (SELECT geoid, CAST(idx % 30 AS DOUBLE) AS x, CAST(idx // 30 AS DOUBLE) AS y FROM unit),
sd AS (SELECT geoid, x AS x0, y AS y0, x + 1 AS x1, y AS y1 FROM pt UNION ALL SELECT geoid, x, y + 1, x + 1, y + 1 FROM pt UNION ALL SELECT geoid, x, y, x, y + 1 FROM pt UNION ALL SELECT geoid, x + 1, y, x + 1, y + 1 FROM pt)
"""
simple("adjacency_build", lambda s, d: spatial.shared_sides(squares(s, d))[0], SIDES + "SELECT a.geoid AS u, b.geoid AS v, sum(1.0::DOUBLE) AS length, count(*) AS n_sides FROM sd a JOIN sd b USING (x0, y0, x1, y1) WHERE a.geoid < b.geoid GROUP BY 1, 2")
simple("external_perimeters", lambda s, d: spatial.shared_sides(squares(s, d))[1], SIDES + ", n AS (SELECT x0, y0, x1, y1, min(geoid) AS geoid FROM sd GROUP BY ALL HAVING count(*) = 1) SELECT geoid, sum(1.0::DOUBLE) AS external, count(*) AS n_external FROM n GROUP BY 1")
simple("small_boundary_filter", lambda s, d: a.edges(s, d).where("w >= 3"), "SELECT u, v, w FROM edge WHERE w >= 3")
simple("minority_augment", lambda s, d: graph.augment_by_class(a.edges(s, d), minority_share(s, d), 0.5), "sh AS (SELECT geoid, CASE WHEN pop = 0 THEN 0 ELSE (pop - white) / pop END AS share FROM unit) SELECT u, v, round(w * CASE WHEN (x.share >= 0.5) = (y.share >= 0.5) THEN 2.0 ELSE 0.5 END, 6) AS w FROM edge JOIN sh x ON x.geoid = u JOIN sh y ON y.geoid = v")


def lat_lon(s, d):
    return points(s, d).select("geoid", (F.col("y") + F.col("x") / 10).alias("lat"), F.col("x").alias("lon"))


AXIS = "pt AS (SELECT geoid, idx // 30 + (idx % 30) / 10 AS lat, CAST(idx % 30 AS DOUBLE) AS lon FROM unit), cv AS (SELECT var_pop(lat) AS a, covar_pop(lat, lon) AS c, var_pop(lon) AS b FROM pt), ax AS (SELECT CASE WHEN abs(c) > 1e-12 THEN atan2(c, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) - a) WHEN a < b THEN pi() / 2 ELSE 0 END AS angle FROM cv)\n"
simple("minor_axis", lambda s, d: graph.minor_axis(lat_lon(s, d)).select(r6("angle").alias("angle")), AXIS + "SELECT round(angle, 6) AS angle FROM ax")
simple("directional_penalty", lambda s, d: graph.directional_penalty(a.edges(s, d), lat_lon(s, d), 0.5), AXIS + "SELECT u, v, round(w * (1 + 0.5 * abs(sin(atan2(q.lat - p.lat, q.lon - p.lon) - angle))), 6) AS w FROM edge JOIN pt p ON p.geoid = u JOIN pt q ON q.geoid = v, ax")
simple("composed_weights", lambda s, d: graph.composed(a.edges(s, d), lambda e: graph.augment_by_class(e, minority_share(s, d), 0.5), lambda e: graph.subdivision_weights(e, {5: 2.0}), lambda e: graph.boundary_penalty(e, 0.5)), "sh AS (SELECT geoid, CASE WHEN pop = 0 THEN 0 ELSE (pop - white) / pop END AS share FROM unit) SELECT u, v, round(w * CASE WHEN (x.share >= 0.5) = (y.share >= 0.5) THEN 2.0 ELSE 0.5 END * CASE WHEN substr(u, 1, 5) = substr(v, 1, 5) THEN 3.0 ELSE 1.0 END * CASE WHEN substr(u, 1, 2) <> substr(v, 1, 2) THEN 1.5 ELSE 1.0 END, 6) AS w FROM edge JOIN sh x ON x.geoid = u JOIN sh y ON y.geoid = v")
simple("united_weights", lambda s, d: graph.united(a.edges(s, d).where("w >= 3"), a.edges(s, d).select("u", "v", (6 - F.col("w")).alias("w"))), "SELECT u, v, CASE WHEN w >= 3 THEN greatest(w, 6 - w) ELSE 6 - w END AS w FROM edge")
simple("vertex_weights", lambda s, d: a.units(s, d).select("geoid", F.array(F.col("pop").cast("long"), F.greatest(F.lit(1), F.floor((F.col("idx") % 11) * 25000 / 10000)).cast("long")).alias("weights")).select("geoid", F.array_join(F.col("weights").cast("array<string>"), " ").alias("weights")), "SELECT geoid, pop || ' ' || greatest(1, CAST(floor((idx % 11) * 25000 / 10000) AS BIGINT)) AS weights FROM unit")

# shapes and scalars
simple("compactness_scores", lambda s, d: shapes.compactness(a.units_only(s, d).select("geoid", shapes.ell_ring((F.col("idx") % 4 + 1).cast("double"), (F.col("idx") % 6 + 1).cast("double")).alias("ring")), "geoid"), """
r AS (SELECT geoid, CAST(idx % 4 + 1 AS DOUBLE) AS a, CAST(idx % 6 + 1 AS DOUBLE) AS b FROM unit), p AS (SELECT *, 0.75 * a * b AS ar, 2 * (a + b) AS pe, greatest(49 * a * a + 25 * b * b, 25 * a * a + 49 * b * b) / 144 AS far FROM r), q AS (SELECT *, least(1.0, 4 * pi() * ar / (pe * pe)) AS pp FROM p)
SELECT geoid, round(ar, 6) AS area, round(pe, 6) AS perimeter, round(pp, 6) AS polsby_popper, round(least(1.0, ar / (pi() * far)), 6) AS reock, round(ar / (0.875 * a * b), 6) AS hull_ratio,
CASE WHEN pp >= 0.6 THEN 'Highly compact' WHEN pp >= 0.5 THEN 'Very compact' WHEN pp >= 0.4 THEN 'Compact' WHEN pp >= 0.3 THEN 'Moderately compact' WHEN pp >= 0.2 THEN 'Somewhat compact' ELSE 'Not compact' END AS band FROM q""")


def seats(s, d):
    return state_pops(s, d).select("state", (F.col("pop") % 60 + 2).cast("int").alias("k"), (F.col("pop") % 7 * 10 + 20).cast("int").alias("senate"), (F.col("pop") % 5 * 30 + 60).cast("int").alias("house"))


SEATS = "st AS (SELECT n_name AS state, CAST(count(*) % 60 + 2 AS INTEGER) AS k, CAST(count(*) % 7 * 10 + 20 AS INTEGER) AS senate, CAST(count(*) % 5 * 30 + 60 AS INTEGER) AS house FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)\n"
simple("chamber_compatibility", lambda s, d: seats(s, d).select("state", roll_ups.greatest_divisor(roll_ups.greatest_divisor(F.col("k"), F.col("senate")), F.col("house")).alias("g"), "k", "senate", "house").select("state", "g", r6(100 * (1 - F.col("g") / F.least("k", "senate", "house"))).alias("score"), F.when(F.col("house") % F.col("senate") == 0, (F.col("house") / F.col("senate")).cast("int")).otherwise(0).alias("nesting_ratio")), SEATS + "SELECT state, CAST(gcd(gcd(k, senate), house) AS BIGINT) AS g, round(100 * (1 - gcd(gcd(k, senate), house) / least(k, senate, house)), 6) AS score, CAST(CASE WHEN house % senate = 0 THEN house // senate ELSE 0 END AS INTEGER) AS nesting_ratio FROM st")
simple("bisection_depth", lambda s, d: seats(s, d).select("state", roll_ups.depth_for(F.col("k")).alias("depth")).select("state", "depth", r6(roll_ups.tolerance_at(F.col("depth"), 5)).alias("tolerance")), SEATS + ", dp AS (SELECT state, CAST(ceil(log2(k) - 1e-12) AS INTEGER) AS depth FROM st) SELECT state, depth, round(1 + 0.005 * CASE WHEN depth <= 1 THEN 0.2 WHEN depth = 2 THEN 0.4 WHEN depth = 3 THEN 0.6 ELSE 1 END, 6) AS tolerance FROM dp")
simple("compactness_bound", lambda s, d: seats(s, d).select("state", r6(roll_ups.bound(1 / F.col("k"), F.col("k"), F.col("senate"), F.col("house"), F.col("senate") % 9, F.col("house") % 7)).alias("bound")), SEATS + "SELECT state, round(sqrt(4 * pi() * senate / (0.25 + senate % 9) ** 2 * (4 * pi() * house / (0.25 + house % 7) ** 2)), 6) AS bound FROM st")
simple("seat_sequence", lambda s, d: allocation.seat_sequence(state_pops(s, d), "state", "pop", 100, 2), """
p AS (SELECT n_name AS state, count(*) AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), q AS (SELECT state, CAST(i + 1 AS INTEGER) AS nth, pop / sqrt(i * (i + 1)) AS pr FROM p, (SELECT unnest(range(2, 101)) AS i)),
r AS (SELECT *, row_number() OVER (ORDER BY pr DESC, state, nth) AS r FROM q) SELECT 2 * (SELECT count(*) FROM p) + r AS seat, state, nth, round(pr, 6) AS priority FROM r WHERE 2 * (SELECT count(*) FROM p) + r <= 100""")
simple("apportionment_check", lambda s, d: allocation.seat_differences(allocation.huntington_hill(state_pops(s, d), "state", "pop", 100), seats(s, d).select("state", (F.col("k") % 3 + 3).cast("long").alias("seats")), "state"), SEATS + """
, p AS (SELECT n_name AS state, count(*) AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), q AS (SELECT state, row_number() OVER (ORDER BY pop / sqrt(i * (i + 1)) DESC, state) AS r FROM p, (SELECT unnest(range(1, 101)) AS i)),
hh AS (SELECT state, 1 + count(r) AS seats FROM p LEFT JOIN (SELECT * FROM q WHERE r <= 100 - (SELECT count(*) FROM p)) USING (state) GROUP BY state)
SELECT state, seats AS got, CAST(k % 3 + 3 AS BIGINT) AS expected, seats - (k % 3 + 3) AS difference FROM hh JOIN st USING (state) WHERE seats <> k % 3 + 3""")
simple("prime_divergence", lambda s, d: allocation.prime_divergence(s, seats(s, d).select("k").distinct(), 64), """
n AS (SELECT DISTINCT CAST(count(*) % 60 + 2 AS INTEGER) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), pr AS (SELECT unnest([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61]) AS p),
f AS (SELECT v, p, unnest(range(1, 7)) AS e FROM (SELECT k AS v FROM n UNION SELECT k + 1 FROM n), pr), g AS (SELECT v, list(p ORDER BY p, e) AS fs FROM f WHERE v % CAST(p ** e AS BIGINT) = 0 GROUP BY v)
SELECT k, CAST(coalesce((SELECT min(i) FROM (SELECT unnest(range(1, 8)) AS i) WHERE a.fs[i] IS DISTINCT FROM b.fs[i]), 1) AS INTEGER) AS level FROM n JOIN g a ON a.v = k JOIN g b ON b.v = k + 1""")
simple("baseline_proportionality", lambda s, d: allocation.against_single_member(a.read(s, d, "events").groupBy("user_id", F.col("event_type").alias("party")).agg(F.count("*").alias("votes")), "party", "votes", 5, "user_id"), """
p AS (SELECT user_id, event_type AS party, count(*) AS votes FROM events GROUP BY 1, 2), q AS (SELECT user_id, party, row_number() OVER (PARTITION BY user_id ORDER BY votes / CAST(i AS DOUBLE) DESC, party) AS r FROM p, (SELECT unnest(range(1, 6)) AS i)),
w AS (SELECT party, sum(votes) AS votes FROM p GROUP BY 1), m AS (SELECT party, count(*) AS n FROM q WHERE r <= 5 GROUP BY 1), o AS (SELECT party, count(*) AS n FROM q WHERE r = 1 GROUP BY 1)
SELECT party, round(votes / sum(votes) OVER (), 6) AS vote_share, round(coalesce(m.n, 0) / sum(m.n) OVER (), 6) AS multi_share, round(coalesce(o.n, 0) / sum(o.n) OVER (), 6) AS single_share FROM w LEFT JOIN m USING (party) LEFT JOIN o USING (party)""")
