"""Registered queries of plan packages, election files, national merges and checked graph files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import register, simple
from .operators import graph, nationwide, series
from .operators.attributes import r6
from .plans import adapters as a
from .sources import binary, elections, plan_package, tables
from .sources.shared import scratch


def by_state(s, d):
    """Plan of blocks within each state: state, geoid, district 1..7; a few units of state 04 have a short code."""
    p = a.plan_b(s, d).withColumn("state", F.substring("geoid", 1, 2))
    short = (F.col("state") == "04") & F.col("geoid").endswith("7")
    return p.select("state", F.when(short, F.substring("geoid", 1, 10)).otherwise(F.col("geoid")).alias("geoid"), "district")


def headers(plan):
    """Metadata per state: each state breaks other rules."""
    state = F.col("state")
    text = {"label": F.when(state != "05", F.concat(F.lit("plan "), state)), "state_fips": state, "state_code": F.concat(F.lit("S"), state), "year": F.lit("2020"), "chamber": F.lit("congressional"), "population_source": F.lit("total"), "created_at": F.lit("2026-01-01T00:00:00Z"), "created_by": F.lit("test")}
    k = F.when(state == "02", 9).when(state == "03", 5).otherwise(7)
    shapes = F.when(state == "01", F.lit('{"type":"FeatureCollection","features":[]}')).when(state == "04", F.lit('{"type":"Point"}'))
    return plan.select("state").distinct().select("state", *[c.alias(n) for n, c in text.items()], k.alias("num_districts"), F.lit(0.5).alias("balance_tolerance_pct"), shapes.alias("geometry"))


def written(s, d, version=plan_package.VERSION):
    path = scratch(s, "packages")
    p = by_state(s, d)
    plan_package.packages(p, headers(p), "state", version).write.partitionBy("state").text(path)
    return plan_package.read_packages(s, path)


def of_state(df, *more):
    return df.select(F.regexp_extract("file", "state=([0-9]+)", 1).alias("state"), *more)


PLAN = "ps AS (SELECT substr(geoid, 1, 2) AS state, CASE WHEN substr(geoid, 1, 2) = '04' AND geoid LIKE '%7' THEN substr(geoid, 1, 10) ELSE geoid END AS geoid, district FROM plan_b), ks AS (SELECT DISTINCT state, CASE state WHEN '02' THEN 9 WHEN '03' THEN 5 ELSE 7 END AS k FROM ps)\n"
FOUND = PLAN + """, fd AS (SELECT state, 'error' AS severity, 'label is given' AS rule, 1 AS n FROM ks WHERE state = '05' UNION ALL SELECT state, 'error', 'geometry is a feature collection', 1 FROM ks WHERE state = '04'
UNION ALL SELECT state, 'error', 'units have 11 digits', count(*) FILTER (length(geoid) <> 11) FROM ps GROUP BY 1 HAVING count(*) FILTER (length(geoid) <> 11) > 0
UNION ALL SELECT state, 'error', 'districts are in range', count(*) FROM ps JOIN ks USING (state) WHERE district > k GROUP BY 1
UNION ALL SELECT state, CASE WHEN max(district) > any_value(k) THEN 'error' ELSE 'warning' END, CASE WHEN max(district) > any_value(k) THEN 'num_districts is not exceeded' ELSE 'num_districts is reached' END, 1 FROM ps JOIN ks USING (state) GROUP BY state HAVING max(district) <> any_value(k)
UNION ALL SELECT state, 'warning', 'districts have units', any_value(k) - count(DISTINCT district) FILTER (district <= k) FROM ps JOIN ks USING (state) GROUP BY state HAVING any_value(k) > count(DISTINCT district) FILTER (district <= k))
"""
simple("plan_package_findings", lambda s, d: of_state(plan_package.findings(written(s, d)), "severity", "rule", "n"), FOUND + "SELECT state, severity, rule, CAST(n AS BIGINT) AS n FROM fd")
simple("plan_package_verdicts", lambda s, d: of_state(plan_package.verdicts(written(s, d, "0.3")), "valid", "n_errors", "n_warnings"), FOUND + "SELECT ks.state, count(*) FILTER (severity = 'error') = 0 AS valid, count(*) FILTER (severity = 'error') AS n_errors, 1 + count(*) FILTER (severity = 'warning') AS n_warnings FROM ks LEFT JOIN fd USING (state) GROUP BY 1")
simple("rplan_roundtrip", lambda s, d: plan_package.assignments(written_whole(s, d)).select("geoid", "district"), "SELECT geoid, district FROM plan_a")


def written_whole(s, d):
    path = scratch(s, "package")
    p = a.plan_a(s, d).withColumn("state", F.substring("geoid", 1, 2))
    plan_package.packages(p, headers(p), "state").write.partitionBy("state").text(path)
    return plan_package.read_packages(s, path)


def by_party(s, d):
    return a.units(s, d).select("geoid", F.col("dem").cast("double").alias("dem_votes"), F.col("rep").cast("double").alias("rep_votes"))


@register("election_csv_scan", "SELECT geoid, CAST(dem AS DOUBLE) AS dem_votes, CAST(rep AS DOUBLE) AS rep_votes FROM unit")
def _election_csv(s, d):
    path = scratch(s, "election")
    by_party(s, d).withColumn("geoid", F.regexp_replace("geoid", "^0+", "")).write.option("header", True).csv(path)
    return tables.typed_csv(s, path, tables.ELECTION)


@register("places_csv_scan", "SELECT geoid, any_value(place) AS place_name, CAST(sum(pop) AS BIGINT) AS place_pop FROM unit GROUP BY geoid")
def _places_csv(s, d):
    path = scratch(s, "places")
    a.units(s, d).groupBy("geoid").agg(F.max("place").alias("place_name"), F.sum("pop").cast("long").alias("place_pop")).write.option("header", True).csv(path)
    return tables.typed_csv(s, path, tables.PLACES)


@register("presidential_scan", """p AS (SELECT geoid, pop, dem AS biden, rep AS trump, CASE WHEN idx % 5 > 0 THEN oth END AS jorgensen, 1 AS write_in FROM unit),
q AS (SELECT *, trump + biden + coalesce(jorgensen, 0) + write_in AS total, CASE WHEN trump + biden > 0 THEN round(biden / (trump + biden) * 100, 2) END AS b2, CASE WHEN trump + biden > 0 THEN round(trump / (trump + biden) * 100, 2) END AS t2 FROM p), m AS (SELECT *, round(b2 - t2, 2) AS m FROM q)
SELECT geoid, CAST(total AS DOUBLE) AS total_votes, round(trump / total * 100, 2) AS trump_pct, round((jorgensen + write_in) / total * 100, 2) AS other_pct, b2 AS biden_two_party_pct, m AS dem_margin, CASE WHEN pop > 0 THEN round(total / pop * 100, 2) END AS turnout_rate,
CASE WHEN m IS NULL THEN 'No Data' WHEN m >= 20 THEN 'Strong D' WHEN m >= 10 THEN 'Lean D' WHEN m >= 5 THEN 'Tilt D' WHEN m >= -5 THEN 'Tossup' WHEN m >= -10 THEN 'Tilt R' WHEN m >= -20 THEN 'Lean R' ELSE 'Strong R' END AS lean FROM m""")
def _presidential(s, d):
    path = scratch(s, "presidential")
    u = a.units(s, d)
    put = {"biden": F.col("dem"), "trump": F.col("rep"), "jorgensen": F.when(F.col("idx") % 5 > 0, F.col("oth")), "write_in": F.lit(1), "geoid": F.regexp_replace("geoid", "^0+", ""), "population": F.col("pop")}
    u.select(*[put.get(n, F.lit("1")).cast("string").alias(c) for c, n in elections.PRESIDENTIAL.items()], F.lit("x").alias("not wanted")).write.option("header", True).csv(path)
    return elections.presidential(s, path).select("geoid", "total_votes", "trump_pct", "other_pct", "biden_two_party_pct", "dem_margin", "turnout_rate", "lean")


def block_groups(s, d):
    """Three block groups a unit, without leading zeros, in seven districts."""
    b = a.units_only(s, d).withColumn("g", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    return b.select(F.regexp_replace(F.concat("geoid", "g"), "^0+", "").alias("geoid"), ((F.col("idx") + F.col("g")) % 7 + 1).cast("int").alias("district"))


def party_results(s, d):
    u = a.units(s, d).where("idx % 9 > 0")
    return u.select("geoid", F.col("dem").alias("dem_votes"), F.col("rep").alias("rep_votes"), F.col("oth").alias("lib_votes"), F.lit(1).alias("grn_votes"), F.lit(0).alias("oth_votes"))


GROUPS = "bg AS (SELECT geoid || g AS bg, CAST((idx + g) % 7 + 1 AS INTEGER) AS district, dem, rep, oth, idx % 9 > 0 AS has FROM unit, (VALUES (1), (2), (3)) v(g))\n"
simple("block_group_votes", lambda s, d: elections.block_group_votes(block_groups(s, d), party_results(s, d))[0], GROUPS + "SELECT district, CAST(sum(dem) AS BIGINT) AS dem_votes, CAST(sum(rep) AS BIGINT) AS rep_votes, CAST(sum(oth) AS BIGINT) AS lib_votes, count(*) AS grn_votes, CAST(0 AS BIGINT) AS oth_votes FROM bg WHERE has GROUP BY 1")
simple("block_groups_without_votes", lambda s, d: elections.block_group_votes(block_groups(s, d), party_results(s, d))[1], GROUPS + "SELECT bg AS geoid, district FROM bg WHERE NOT has")


def state_graphs(s, d):
    """Vertices numbered within their state, and the edges inside states."""
    v = a.units(s, d).select("state", (F.row_number().over(Window.partitionBy("state").orderBy("geoid")) - 1).alias("vertex"), "geoid", F.col("pop").alias("weight"))
    end = lambda c, n: v.select(F.col("geoid").alias(c), F.col("state").alias(f"{n}s"), F.col("vertex").alias(n))
    e = a.edges(s, d).withColumnsRenamed({"u": "gu", "v": "gv"}).join(end("gu", "u"), "gu").join(end("gv", "v"), "gv").where("us = vs").select(F.col("us").alias("state"), "u", "v", "w")
    return v, e


NATION = "nv AS (SELECT row_number() OVER (ORDER BY geoid) - 1 AS number, substr(geoid, 1, 2) AS state, geoid, pop AS weight FROM unit)\n"
simple("national_vertices", lambda s, d: nationwide.merged_graph(*state_graphs(s, d))[0], NATION + "SELECT number, state, geoid, weight FROM nv")
simple("national_edges", lambda s, d: nationwide.merged_graph(*state_graphs(s, d))[1], NATION + "SELECT least(p.number, q.number) AS u, greatest(p.number, q.number) AS v, w FROM edge JOIN nv p ON p.geoid = u JOIN nv q ON q.geoid = v WHERE p.state = q.state")


def state_documents(s, d):
    """An analysis per state; the first one lacks a member that others have."""
    t = a.units(s, d).groupBy("state").agg(F.sum("pop").alias("population"), F.count("*").alias("n_units"), F.round(F.sum("dem") / F.sum(F.col("dem") + F.col("rep")), 4).alias("dem_share"))
    rows = F.array(*[F.struct(F.lit(i).alias("district"), (F.col("n_units") + i).alias("value")) for i in (1, 2)])
    whole = F.to_json(F.struct(F.lit("proportionality").alias("analyzer"), "population", "n_units", F.when(F.col("state") != "03", F.col("dem_share")).alias("dem_share"), F.when(F.col("state") != "01", F.lit("yes")).alias("late"), rows.alias("districts")))
    return t.select("state", whole.alias("content"))


STATE = "sd AS (SELECT substr(geoid, 1, 2) AS state, sum(pop) AS population, count(*) AS n_units, round(sum(dem) / sum(dem + rep), 4) AS dem_share FROM unit GROUP BY 1)\n"
simple("national_state_table", lambda s, d: nationwide.state_table(state_documents(s, d), "2020").select("state", "year", "population", "n_units", F.col("dem_share").try_cast("double").alias("dem_share")), STATE + "SELECT state, '2020' AS year, CAST(CAST(population AS BIGINT) AS VARCHAR) AS population, CAST(n_units AS VARCHAR) AS n_units, CASE WHEN state <> '03' THEN dem_share END AS dem_share FROM sd")
simple("national_district_records", lambda s, d: nationwide.district_records(state_documents(s, d)), STATE + "SELECT state, CAST(i AS INTEGER) AS district, 'value' AS name, CAST(n_units + i AS VARCHAR) AS value FROM sd, (VALUES (1), (2)) v(i)")


@register("graph_file_vertices", "x AS (SELECT geoid, substr(geoid, 1, 2) AS graph, row_number() OVER (PARTITION BY substr(geoid, 1, 2) ORDER BY geoid) - 1 AS vertex, pop, idx FROM unit)\nSELECT graph, vertex, pop AS weight, CASE WHEN graph <> '02' THEN CAST(idx % 7 AS DOUBLE) / 2 END AS outer, CASE WHEN graph <> '02' THEN CAST(idx AS DOUBLE) END AS area FROM x".replace("AS outer", "AS \"outer\""))
def _graph_vertices(s, d):
    v, e = a.state_graphs(s, d)
    v = v.select("graph", "vertex", "weight", (F.col("idx") % 7 / 2).alias("outer"), F.col("idx").cast("double").alias("area"))
    plain = v.where("graph = '02'").drop("outer", "area")
    files = binary.graph_files(v.where("graph <> '02'"), e.where("graph <> '02'")).union(binary.graph_files(plain, e.where("graph = '02'")))
    return binary.graph_vertices(files)


def ways(s, d):
    """The lattice both ways, with some ways missing, some of another weight, and loops."""
    e = a.edges(s, d)
    back = e.where("w <> 5").select(F.col("v").alias("u"), F.col("u").alias("v"), F.when(F.col("w") == 4, 9.0).otherwise(F.col("w")).alias("w"))
    loops = a.units_only(s, d).where("idx % 50 = 3").select(F.col("geoid").alias("u"), F.col("geoid").alias("v"), F.lit(1.0).alias("w"))
    return e.union(back).union(loops)


simple("graph_structure_checks", lambda s, d: graph.structure_checks(ways(s, d), a.units_only(s, d).where("idx % 40 <> 1").select(F.col("geoid").alias("node")).union(s.range(2).select(F.concat(F.lit("alone "), "id").alias("node")))), """
SELECT 'asymmetric' AS rule, count(*) FILTER (w >= 4) AS violations FROM edge UNION ALL SELECT 'loops', count(*) FILTER (idx % 50 = 3) FROM unit UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'unknown_ends', count(*) FILTER (idx % 40 = 1) FROM unit
UNION ALL SELECT 'isolated', 2 UNION ALL SELECT 'components', 2""")

simple("ess_geyer", lambda s, d: series.ess(a.traces(s, d)).select("chain", r6("ess").alias("ess"), "n"), """
c AS (SELECT chain, step, value - avg(value) OVER (PARTITION BY chain) AS x, count(*) OVER (PARTITION BY chain) AS n FROM trace), v AS (SELECT chain, any_value(n) AS n, sum(x * x) AS v FROM c GROUP BY 1),
k AS (SELECT chain, n, v, unnest(range(0, CAST(greatest(n // 4, 2) // 2 AS BIGINT))) AS k FROM v WHERE n >= 4 AND v > 0), r AS (SELECT p.chain, CAST((q.step - p.step - 1) // 2 AS BIGINT) AS k, sum(p.x * q.x) AS s FROM c p JOIN c q ON p.chain = q.chain AND q.step - p.step BETWEEN 1 AND greatest(p.n // 4, 2) GROUP BY 1, 2),
m AS (SELECT chain, k, n, min(coalesce(s, 0) / v) OVER (PARTITION BY chain ORDER BY k) AS m FROM k LEFT JOIN r USING (chain, k)), t AS (SELECT chain, sum(m) FILTER (m > 0) AS t FROM m GROUP BY 1)
SELECT chain, round(CASE WHEN n < 4 OR v = 0 THEN n ELSE least(n, n / (1 + 2 * coalesce(t, 0))) END, 6)::DOUBLE AS ess, n FROM v LEFT JOIN t USING (chain)""")
