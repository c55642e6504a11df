"""Registered queries of rounds and reporting, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import K, LAB, REACH, simple
from .operators import reporting, rounds
from .operators.shapes import shape_scores
from .plans import adapters as a


def found(s, d):
    return rounds.regions(a.plan_b(s, d), K)


BANDS = "CASE WHEN m IS NULL THEN 'No Data' WHEN m >= 20 THEN 'Strong D' WHEN m >= 10 THEN 'Lean D' WHEN m >= 5 THEN 'Tilt D' WHEN m >= -5 THEN 'Tossup' WHEN m >= -10 THEN 'Tilt R' WHEN m >= -20 THEN 'Lean R' ELSE 'Strong R' END"
REGIONS = "rg AS (SELECT geoid, district, CAST(r AS INTEGER) AS round, CAST((district - 1) * (1 << r) // 8 AS INTEGER) AS region FROM plan_b, unnest([1, 2, 3]) AS t(r))"
simple("round_lineage", lambda s, d: rounds.lineage(found(s, d)), REGIONS + "\nSELECT x.round, x.region, min(y.region) AS parent FROM (SELECT round, region, min(geoid) AS geoid FROM rg GROUP BY 1, 2) x JOIN rg y ON y.geoid = x.geoid AND y.round = x.round - 1 GROUP BY 1, 2")
simple("rounds_hierarchy", lambda s, d: rounds.hierarchy(found(s, d), a.units(s, d), K), REGIONS + """
, h AS (SELECT round, region + 1 AS region_id, CAST(sum(pop) AS BIGINT) AS population, count(*) AS n_units, count(DISTINCT district) AS n_districts FROM rg JOIN unit USING (geoid) GROUP BY 1, 2),
p AS (SELECT * FROM h UNION ALL SELECT CAST(r AS INTEGER), region_id, population, n_units, n_districts FROM h, unnest([4, 5, 6]) AS t(r) WHERE round = 3)
SELECT round, region_id, population, n_units, n_districts, round(100 * (population - i) / i, 3) AS deviation_from_ideal_pct FROM (SELECT *, (SELECT sum(pop) FROM unit) * n_districts / 7.0::DOUBLE AS i FROM p)""")
simple("rounds_political", lambda s, d: rounds.political(found(s, d), a.units(s, d)), REGIONS + f"""
, h AS (SELECT round, region + 1 AS region, CAST(sum(pop) AS BIGINT) AS population, CAST(sum(dem) AS BIGINT) AS dem, CAST(sum(rep) AS BIGINT) AS rep FROM rg JOIN unit USING (geoid) GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN dem + rep > 0 THEN 100 * (dem / (dem + rep)) ELSE 0 END AS dp, CASE WHEN dem + rep > 0 THEN 100 * (rep / (dem + rep)) ELSE 0 END AS rp, dp - rp AS m FROM h)
SELECT round, region, population, dem, rep, round(dp, 2) AS dem_pct, round(rp, 2) AS rep_pct, round(m, 2) AS margin, {BANDS} AS lean FROM m""")


def county_seats(s, d):
    """Votes of two parties by state, and the counties that each leads; ties lead for nobody."""
    c = a.units(s, d).groupBy("state", "county").agg(F.sum("dem").alias("dem"), F.sum("rep").alias("rep"))
    st = c.groupBy("state").agg(F.sum("dem").alias("dem"), F.sum("rep").alias("rep"), F.count_if(F.col("dem") > F.col("rep")).alias("dem_seats"), F.count_if(F.col("rep") > F.col("dem")).alias("rep_seats"))
    return st.select("state", F.explode(F.array(*[F.struct(F.lit(p).alias("party"), F.col(p).alias("votes"), F.col(f"{p}_seats").alias("seats")) for p in ("dem", "rep")])).alias("x")).select("state", "x.*")


simple("disproportion_bands", lambda s, d: reporting.disproportion(county_seats(s, d), "state"), """
c AS (SELECT substr(geoid, 1, 2) AS state, substr(geoid, 1, 5) AS county, sum(dem) AS dem, sum(rep) AS rep FROM unit GROUP BY 1, 2),
t AS (SELECT state, sum(dem) AS dem, sum(rep) AS rep, count(*) FILTER (dem > rep) AS ds, count(*) FILTER (rep > dem) AS rs FROM c GROUP BY 1),
g AS (SELECT state, sqrt(((100 * (coalesce(dem / nullif(dem + rep, 0), 0) - coalesce(ds / nullif(ds + rs, 0), 0))) ** 2 + (100 * (coalesce(rep / nullif(dem + rep, 0), 0) - coalesce(rs / nullif(ds + rs, 0), 0))) ** 2) / 2) AS g FROM t)
SELECT state, round(g, 6) AS gallagher, CASE WHEN g < 1 THEN 'Exceptionally high proportionality' WHEN g < 2 THEN 'Very high proportionality' WHEN g < 3 THEN 'High proportionality' WHEN g < 5 THEN 'Moderate proportionality' WHEN g < 8 THEN 'Low proportionality' WHEN g < 12 THEN 'Disproportional' ELSE 'Highly disproportional' END AS band FROM g""")

RECT = "rc AS (SELECT geoid, CAST(idx % 4 + 1 AS DOUBLE) AS a, CAST(idx % 6 + 1 AS DOUBLE) AS b FROM unit), sc AS (SELECT geoid, substr(geoid, 1, 2) AS state, idx, a * b AS area, 2 * (a + b) AS perimeter, round(least(1.0, 4 * pi() * a * b / ((2 * (a + b)) ** 2)), 6) AS polsby_popper, round(a * b / (pi() * (a * a + b * b) / 4), 6) AS reock FROM rc JOIN unit USING (geoid))\n"


def scores(s, d):
    return shape_scores(a.units_only(s, d)).withColumn("state", F.substring("geoid", 1, 2))


simple("compactness_bands", lambda s, d: scores(s, d).select("geoid", "polsby_popper", reporting.compact_band(F.col("polsby_popper")).alias("band")),
       RECT + "SELECT geoid, polsby_popper, CASE WHEN polsby_popper >= 0.6 THEN 'Highly compact' WHEN polsby_popper >= 0.5 THEN 'Very compact' WHEN polsby_popper >= 0.4 THEN 'Compact' WHEN polsby_popper >= 0.3 THEN 'Moderately compact' WHEN polsby_popper >= 0.2 THEN 'Somewhat compact' ELSE 'Not compact' END AS band FROM sc")
simple("state_compactness", lambda s, d: reporting.state_shapes(scores(s, d)), RECT + "SELECT state, count(*) AS num_districts, round(avg(polsby_popper), 6) AS mean_pp, round(avg(reock), 6) AS mean_reock, round(avg(perimeter), 6) AS mean_perimeter, round(avg(area), 6) AS mean_area FROM sc GROUP BY 1")
ODD = "CAST(right(geoid, 1) AS INT) % 2 = 1"
simple("years_compared", lambda s, d: reporting.years_compared(scores(s, d).where(ODD), scores(s, d).where(f"NOT {ODD}"), "state", "polsby_popper"), RECT + """, o AS (SELECT state, count(*) AS n, avg(polsby_popper) AS m, median(polsby_popper) AS q FROM sc WHERE CAST(right(geoid, 1) AS INTEGER) % 2 = 1 GROUP BY 1),
e AS (SELECT state, count(*) AS n, avg(polsby_popper) AS m, median(polsby_popper) AS q FROM sc WHERE CAST(right(geoid, 1) AS INTEGER) % 2 = 0 GROUP BY 1)
SELECT state, o.n AS ours_n, round(o.m, 6) AS ours_mean, round(o.q, 6) AS ours_median, e.n AS theirs_n, round(e.m, 6) AS theirs_mean, round(e.q, 6) AS theirs_median, round(100 * (o.m / e.m - 1), 6) AS improvement_pct FROM o JOIN e USING (state)""")


def labels(s, d):
    """Part names with dashes or blanks, type words, and some segments of paths."""
    p = a.read(s, d, "part")
    return p.select(F.explode(F.array("p_brand", F.translate("p_brand", "#", "-"), F.concat(F.lit("."), F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, "runs").otherwise("reports_2"), F.lit(""))).alias("label"))


simple("label_check", lambda s, d: reporting.label_check(labels(s, d), "label"), """
lb AS (SELECT unnest([p_brand, replace(p_brand, '#', '-'), '.' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'runs' ELSE 'reports_2' END, '']) AS label FROM part)
SELECT DISTINCT label, CASE WHEN label IS NULL OR label = '' THEN 'empty' WHEN label[1] = '.' THEN 'leading dot' WHEN NOT regexp_full_match(label, '[a-zA-Z0-9_-]+') THEN 'character' WHEN label IN ('runs', 'analysis', 'reports', '.redist', 'configs') THEN 'reserved' END AS fault FROM lb""")


def share_bands(s, d, plan):
    """Minority share of each district with its 95 % interval for as many people."""
    x = a.units(s, d).join(getattr(a, plan)(s, d), "geoid").groupBy("district").agg(F.sum("pop").alias("n"), F.sum(F.col("pop") - F.col("white")).alias("m"))
    p = F.col("m") / F.col("n")
    half = 1.96 * F.sqrt(p * (1 - p) / F.col("n"))
    return x.select("district", p.alias("point"), (p - half).alias("low"), (p + half).alias("high"))


SHARE = ", ".join(f"s{p} AS (SELECT district, point, point - h AS low, point + h AS high FROM (SELECT *, 1.96 * sqrt(point * (1 - point) / n) AS h FROM (SELECT district, sum(pop) AS n, sum(pop - white) / sum(pop) AS point FROM plan_{p} JOIN unit USING (geoid) GROUP BY 1)))" for p in "ab") + "\n"
simple("indeterminate_districts", lambda s, d: reporting.indeterminate(share_bands(s, d, "plan_a"), 0.8), SHARE + "SELECT count(*) AS n_districts, count(*) FILTER (low < 0.8 AND high > 0.8) AS n_indeterminate, count(*) FILTER (low >= 0.8) AS n_majority FROM sa")
simple("claims_suppressed", lambda s, d: reporting.claims(share_bands(s, d, "plan_a"), share_bands(s, d, "plan_b"), "district"), SHARE + """SELECT district, round(sa.point - sb.point, 6) AS difference, NOT CASE WHEN sa.point > sb.point THEN sa.low > sb.high WHEN sa.point < sb.point THEN sa.high < sb.low ELSE false END AS monotone_suppressed,
sa.low <= sb.high AND sb.low <= sa.high AS other_suppressed FROM sa JOIN sb USING (district)""")
simple("density_seat_targets", lambda s, d: reporting.seat_targets(a.units(s, d).select("pop", (F.col("pop") / (F.col("idx") % 11 + 1)).alias("density")), (3, 5, 7), 100, 40), """
c AS (SELECT CASE WHEN pop / (idx % 11 + 1) >= 100 THEN 7 WHEN pop / (idx % 11 + 1) >= 40 THEN 5 ELSE 3 END AS members, sum(pop) AS pop FROM unit GROUP BY 1),
t AS (SELECT members, floor(round_even(pop / (SELECT sum(pop) FROM c) * 435, 0) / members) AS n FROM c), f AS (SELECT * FROM t WHERE n > 0)
SELECT members, CAST(n + CASE WHEN members = (SELECT max(members) FROM f) THEN floor((435 - (SELECT sum(n * members) FROM f)) / members) ELSE 0 END AS BIGINT) AS n_districts FROM f""")
INSIDE = LAB.format(p="plan_b") + ", ins AS (SELECT * FROM lab WHERE du = dv)"
simple("stranded_units", lambda s, d: reporting.stranded(a.edges(s, d).where("w >= 3"), a.plan_b(s, d)), INSIDE.replace("du = dv", "du = dv AND w >= 3") + ", " + REACH.format(e="ins") + """
, comp AS (SELECT node, min(label) AS c FROM lb GROUP BY node), sz AS (SELECT district, c, row_number() OVER (PARTITION BY district ORDER BY count(*) DESC, c) AS k FROM comp JOIN plan_b ON geoid = node GROUP BY 1, 2)
SELECT node AS geoid, p.district FROM comp JOIN plan_b p ON p.geoid = node JOIN sz ON sz.district = p.district AND sz.c = comp.c WHERE k > 1""")
simple("induced_subgraphs", lambda s, d: reporting.induced(a.edges(s, d), a.units_only(s, d).select("geoid", F.substring("geoid", 1, 5).alias("grp"))), """
n AS (SELECT geoid, substr(geoid, 1, 5) AS grp, CAST(row_number() OVER (PARTITION BY substr(geoid, 1, 5) ORDER BY geoid) - 1 AS INTEGER) AS i FROM unit)
SELECT a.grp, a.i AS local_u, b.i AS local_v, w FROM edge JOIN n a ON a.geoid = u JOIN n b ON b.geoid = v WHERE a.grp = b.grp""")
simple("district_statistics", lambda s, d: reporting.district_statistics(a.units(s, d), a.plan_b(s, d), a.edges(s, d)), INSIDE + """
, sh AS (SELECT du AS district, count(*) AS c FROM ins GROUP BY 1), x AS (SELECT district, CAST(sum(pop) AS BIGINT) AS population, count(*) AS n, sum(pop * coalesce(100 * (dem - rep) / nullif(dem + rep, 0), 0)) AS s FROM plan_b JOIN unit USING (geoid) GROUP BY 1)
SELECT district, population, n AS n_units, round(coalesce(s / nullif(population, 0), 0), 6) AS lean, CAST(4 * n - 2 * coalesce(c, 0) AS BIGINT) AS perimeter, round(4 * pi() * n / (4 * n - 2 * coalesce(c, 0)) ** 2, 6) AS polsby_popper FROM x LEFT JOIN sh USING (district)""")


def votes(s, d):
    return a.units(s, d).where("dem + rep > 50")


simple("unit_table", lambda s, d: reporting.unit_table(a.units(s, d), a.units_only(s, d).select("geoid", (F.col("idx") % 4).alias("area")), votes(s, d)), """
v AS (SELECT geoid, pop, idx % 4 AS area, CASE WHEN dem + rep > 50 THEN dem ELSE 0 END AS dem, CASE WHEN dem + rep > 50 THEN rep ELSE 0 END AS rep FROM unit)
SELECT geoid, pop AS total_population, dem AS dem_votes, rep AS rep_votes, dem + rep AS total_votes, round(coalesce(dem / nullif(dem + rep, 0), 0), 6) AS dem_vote_share, round(CASE WHEN area > 0 THEN pop / area ELSE 0 END, 6) AS pop_density FROM v""")
simple("party_weights", lambda s, d: reporting.party_weights(a.units(s, d)), "SELECT geoid, greatest(dem, 1) AS democratic_weight, greatest(rep, 1) AS republican_weight, greatest(oth, 1) AS other_weight FROM unit")
TURN = "concat({}[15:16], {}[13:14], {}[11:12], {}[9:10], {}[7:8], {}[5:6], {}[3:4], {}[1:2])"
simple("chain_seeds", lambda s, d: reporting.chain_seeds(a.traces(s, d).select("chain").distinct(), 42), "h AS (SELECT chain, printf('%016X', chain) AS c FROM (SELECT DISTINCT chain FROM trace)), "
       "g AS (SELECT chain, sha256(unhex(hex(encode('ENSEMBLE_CHAIN_')) || " + TURN.replace("{}", "c") + " || hex(encode('_')) || '2A00000000000000')) AS g FROM h)\nSELECT chain, " + TURN.replace("{}", "g") + " AS seed FROM g")
simple("iso_times", lambda s, d: a.read(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("key"), reporting.iso_time(F.col("o_orderkey").cast("long") * 86399 * 7 - 86400).alias("at")),
       "SELECT CAST(o_orderkey AS BIGINT) AS key, strftime(make_timestamp(greatest(CAST(o_orderkey AS BIGINT) * 86399 * 7 - 86400, 0) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
simple("ascii_names", lambda s, d: a.units(s, d).select("geoid", reporting.ascii_safe(F.concat("place", F.lit(" – "), F.lit("é"), "geoid")).alias("name")), "SELECT geoid, regexp_replace(place || ' – é' || geoid, '[^\\x00-\\x7F]', '?', 'g') AS name FROM unit")
