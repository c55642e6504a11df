"""Registered queries of gates, certificates, ensembles, expected files, lookups and particle files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register, simple
from .catalog_more import SEATS, seats
from .functions import states
from .operators import gates, series
from .operators.attributes import r6
from .plans import adapters as a
from .sources import particles
from .sources.shared import scratch


def manifests(s, d):
    """A manifest per customer; some of other schemas, modes by market."""
    c = a.read(s, d, "customer")
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "lenient").when(F.col("c_mktsegment") == "MACHINERY", "draft").when(F.col("c_custkey") % 100 == 7, F.lit(None).cast("string")).otherwise("strict")
    schema = F.when(F.col("c_custkey") % 3 == 0, "civic-coi v1").when(F.col("c_custkey") % 3 == 1, "civic-coi v2").otherwise("plan v1")
    return c.select(F.concat(F.lit("inputs/"), "c_custkey", F.lit("/manifest.json")).alias("path"), schema.alias("schema_version"), mode.alias("validate_mode"), F.col("c_name").alias("label"))


CIVIC = """WITH m AS (SELECT 'inputs/' || c_custkey || '/manifest.json' AS path, c_name AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 'lenient' WHEN c_mktsegment = 'MACHINERY' THEN 'unknown:draft' WHEN c_custkey % 100 = 7 THEN 'unknown:' ELSE 'strict' END AS mode FROM customer WHERE c_custkey % 3 < 2)
"""
register("civic_manifests", CIVIC + "SELECT path, label, mode, mode = 'strict' AS strict FROM m", base=False)(lambda s, d: gates.civic_manifests(manifests(s, d)))
register("civic_gate", CIVIC + "SELECT 'refused' AS outcome, count(*) FILTER (mode = 'strict') AS n_strict, count(*) FILTER (mode <> 'strict') AS n_offending FROM m", base=False)(lambda s, d: gates.civic_gate(manifests(s, d)))


def halves(s, d):
    """Each state's counties in two halves: people as areas, crossing weights as outer lengths."""
    u = a.units(s, d)
    e = a.edges(s, d).groupBy(F.substring("u", 1, 2).alias("state")).agg(F.sum("w").alias("w"))
    t = u.groupBy("state").agg(F.count("*").alias("n"), F.sum(F.when(F.col("idx") % 2 == 0, F.col("pop")).otherwise(0)).cast("double").alias("area_a"), F.sum(F.when(F.col("idx") % 2 == 1, F.col("pop")).otherwise(0)).cast("double").alias("area_b"))
    return t.join(e, "state").select("state", (1 / F.col("n")).alias("lambda2"), "n", "area_a", "area_b", F.col("w").alias("outer_a"), (F.col("w") / 2 + 40).alias("outer_b"), (F.col("n") / 2000).alias("achieved"))


simple("bisection_certificates", lambda s, d: gates.certificates(halves(s, d), "state", 0.5), """
hv AS (SELECT substr(geoid, 1, 2) AS state, count(*) AS n, sum(CASE WHEN idx % 2 = 0 THEN pop ELSE 0 END) AS aa, sum(CASE WHEN idx % 2 = 1 THEN pop ELSE 0 END) AS ab FROM unit GROUP BY 1), ew AS (SELECT substr(u, 1, 2) AS state, sum(w) AS w FROM edge GROUP BY 1),
bo AS (SELECT state, n, sqrt(4 * pi() * aa / (0.25 + w) ** 2 * (4 * pi() * ab / (0.25 + w / 2 + 40) ** 2)) AS b FROM hv JOIN ew USING (state))
SELECT state, 0.25::DOUBLE AS least_cut, round(b, 6) AS bound, round(n / 2000 / b, 6) AS ratio, n / 2000 / b >= 0.5 AS certified FROM bo""")

GEYER = """c AS (SELECT step, value - avg(value) OVER () AS x FROM pl), v AS (SELECT count(*) AS n, sum(x * x) AS v FROM c), r AS (SELECT CAST((q.step - p.step - 1) // 2 AS BIGINT) AS k, sum(p.x * q.x) AS s FROM c p JOIN c q ON q.step - p.step BETWEEN 1 AND (SELECT greatest(n // 4, 2) FROM v) GROUP BY 1),
k AS (SELECT unnest(range(0, CAST(greatest(n // 4, 2) // 2 AS BIGINT))) AS k FROM v), m AS (SELECT k, min(coalesce(s, 0) / v.v) OVER (ORDER BY k) AS m FROM k LEFT JOIN r USING (k), v), t AS (SELECT coalesce(sum(m) FILTER (m > 0), 0) AS t FROM m)
"""


def some_chains(s, d):
    """The first six users' chains of one length."""
    return series.trimmed(a.traces(s, d).where("chain < 6"))


simple("validated_ensemble", lambda s, d: gates.validated_ensemble(some_chains(s, d), 50.0), """
fw AS (SELECT chain, max(step) AS n FROM trace WHERE chain < 6 GROUP BY 1), tr AS (SELECT chain, step, value FROM trace WHERE chain < 6 AND step <= (SELECT min(n) FROM fw)), pl AS (SELECT row_number() OVER (ORDER BY chain, step) AS step, value FROM tr),
ch AS (SELECT chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM tr GROUP BY 1), rh AS (SELECT count(*) AS n_chains, max(n) AS n, sqrt(((max(n) - 1) / max(n) * avg(v) + var_samp(m)) / avg(v)) AS r FROM ch), """ + GEYER + """
SELECT n_chains, rh.n AS n_per_chain, round(r, 6) AS r_hat, round(least(v.n, v.n / (1 + 2 * t)), 6)::DOUBLE AS ess, (SELECT round(avg(CASE WHEN value <= 50.0 THEN 1.0 ELSE 0.0 END), 6) FROM tr) AS percentile_rank, r < 1.05 AND least(v.n, v.n / (1 + 2 * t)) >= 100 AS passed FROM rh, v, t""")

OUTPUTS = [("assign", "data/final_assignments.json", True), ("rounds", "maps/round_{round_num}_{round_regions}_regions.png", True), ("summary", "data/district_summary.csv", True), ("cities", "data/district_cities.csv", False)]


def outputs(s):
    return s.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("script"), F.lit(p).alias("pattern"), F.lit(r).alias("required")) for n, p, r in OUTPUTS])))


def found_files(s, d):
    """What is there: every file but some of some states."""
    e = gates.expected_files(seats(s, d).select("state", "k"), outputs(s))
    return e.where(~((F.length("state") % 3 == 0) & F.col("file").contains("round_2_")) & ~((F.length("state") % 4 == 1) & (F.col("script") == "cities")) & (F.col("state") != "BRAZIL"))


FILES = SEATS + """, rd AS (SELECT state, k, unnest(range(1, CAST(ceil(log2(k) - 1e-12) AS BIGINT) + 1)) AS r FROM st),
ex AS (SELECT state, 'data/final_assignments.json' AS file, true AS required FROM st UNION ALL SELECT state, 'data/district_summary.csv', true FROM st UNION ALL SELECT state, 'data/district_cities.csv', false FROM st
UNION ALL SELECT state, 'maps/round_' || r || '_' || least(CAST(2 ** r AS BIGINT), k) || '_regions.png', true FROM rd),
fo AS (SELECT *, NOT (length(state) % 3 = 0 AND file LIKE '%round_2_%') AND NOT (length(state) % 4 = 1 AND file LIKE '%cities%') AND state <> 'BRAZIL' AS there FROM ex)
"""
simple("output_gaps", lambda s, d: gates.output_gaps(gates.expected_files(seats(s, d).select("state", "k"), outputs(s)), found_files(s, d)), FILES + """SELECT state, count(*) AS n_expected, count(*) FILTER (there) AS n_found, count(*) FILTER (required AND NOT there) AS n_missing, coalesce(string_agg(file, ';' ORDER BY file) FILTER (required AND NOT there), '') AS missing,
CASE WHEN count(*) FILTER (there) = 0 THEN 'nothing' WHEN count(*) FILTER (required AND NOT there) > 0 THEN 'incomplete' WHEN count(*) FILTER (NOT there) > 0 THEN 'optional files missing' ELSE 'complete' END AS status FROM fo GROUP BY 1""")


def group_shares(s, d, shift):
    u = a.units(s, d).withColumn("district", ((F.col("idx") + shift * (F.col("idx") % 3)) % 97).cast("int"))
    groups = ("black", "hispanic", "asian", "white")
    t = u.groupBy("state", "district").agg(F.sum("pop").alias("pop"), *[F.sum(g).alias(g) for g in groups])
    return t.select("state", *[F.when(F.col("pop") > 0, F.col(g) / F.col("pop")).otherwise(0.0).alias(f"pct_{g}") for g in groups])


def shares_sql(name, shift):
    return f"{name} AS (SELECT state, count(*) FILTER (b > 0.5) AS black, count(*) FILTER (h > 0.5) AS hispanic, count(*) FILTER (s > 0.5) AS asian, count(*) FILTER (1 - w > 0.5) AS coalition, count(*) FILTER (b > 0.5 OR h > 0.5 OR s > 0.5) AS total FROM (SELECT substr(geoid, 1, 2) AS state, coalesce(sum(black) / nullif(sum(pop), 0), 0) AS b, coalesce(sum(hispanic) / nullif(sum(pop), 0), 0) AS h, coalesce(sum(asian) / nullif(sum(pop), 0), 0) AS s, coalesce(sum(white) / nullif(sum(pop), 0), 0) AS w FROM unit GROUP BY 1, (idx + {shift} * (idx % 3)) % 97) GROUP BY 1)\n"


simple("minority_district_counts", lambda s, d: gates.minority_counts(group_shares(s, d, 0), "state"), shares_sql("mc", 0) + "SELECT state, black, hispanic, asian, coalition, total FROM mc")
simple("minority_status", lambda s, d: gates.minority_status(gates.minority_counts(group_shares(s, d, 0), "state"), gates.minority_counts(group_shares(s, d, 1), "state"), "state"), shares_sql("ec", 0) + ", " + shares_sql("dc", 1) + "SELECT state, e.total AS enacted, d.total AS drawn, CASE WHEN e.total = 0 THEN 'N/A' WHEN d.total >= e.total THEN 'Compliant' WHEN e.total - d.total = 1 THEN 'At Risk' ELSE 'Non-compliant' END AS status FROM ec e JOIN dc d USING (state)")
simple("model_size", lambda s, d: gates.model_size(a.edges(s, d), a.units_only(s, d), 7), """
c AS (SELECT (SELECT count(*) FROM unit) AS v, (SELECT count(*) FROM edge) AS e), p AS (SELECT unnest([{'name': 'x_binary', 'n': v * 7}, {'name': 'z_binary', 'n': e}, {'name': 'flow', 'n': 14 * e}, {'name': 'coverage', 'n': v}, {'name': 'balance', 'n': 14}, {'name': 'cut', 'n': 14 * e}, {'name': 'flow_bounds', 'n': 14 * e},
{'name': 'flow_conservation', 'n': (v - 1) * 7}, {'name': 'flow_root', 'n': 7}, {'name': 'variables', 'n': 7 * v + 15 * e}, {'name': 'constraints', 'n': v + 14 + 28 * e + 7 * (v - 1) + 7}]) AS x FROM c) SELECT x.name AS name, CAST(x.n AS BIGINT) AS n FROM p""")


def area_units(s, d):
    return a.units(s, d).select("geoid", F.col("county").alias("area"), F.when(F.col("county") == "01001", 0).otherwise(F.col("pop")).alias("vap"))


def area_results(s, d):
    return a.units(s, d).where("county <> '01006'").groupBy(F.col("county").alias("area")).agg(*[F.sum(c).alias(c) for c in ("dem", "rep", "oth")])


simple("party_disaggregation", lambda s, d: gates.party_votes(area_units(s, d), area_results(s, d), {"lib": 0.7, "grn": 0.2, "other": 0.1}), """
w AS (SELECT geoid, substr(geoid, 1, 5) AS area, CASE WHEN substr(geoid, 1, 5) = '01001' THEN 0 ELSE pop END AS vap FROM unit), p AS (SELECT geoid, area, coalesce(vap / nullif(sum(vap) OVER (PARTITION BY area), 0), 1 / count(*) OVER (PARTITION BY area)) AS part FROM w),
r AS (SELECT substr(geoid, 1, 5) AS area, sum(dem) AS dem, sum(rep) AS rep, sum(oth) AS oth FROM unit WHERE substr(geoid, 1, 5) <> '01006' GROUP BY 1), l AS (SELECT area, unnest([{'p': 'dem', 'v': dem * 1.0::DOUBLE}, {'p': 'rep', 'v': rep * 1.0::DOUBLE}, {'p': 'lib', 'v': oth * 0.7::DOUBLE}, {'p': 'grn', 'v': oth * 0.2::DOUBLE}, {'p': 'other', 'v': oth * 0.1::DOUBLE}]) AS x FROM r)
SELECT geoid, x.p AS party, round(x.v * part, 6) AS votes FROM p JOIN l USING (area)""")
simple("county_populations", lambda s, d: gates.coarse_units(a.units(s, d), a.edges(s, d))[0], "SELECT substr(geoid, 1, 5) AS unit, CAST(sum(pop) AS BIGINT) AS population, count(*) AS n_units FROM unit GROUP BY 1")


def coded(s, d):
    """A postal code per unit, by its number."""
    codes = F.array(*[F.lit(p) for p, _, _ in states.STATES], F.lit("ZZ"))
    return a.units_only(s, d).select("geoid", F.element_at(codes, (F.col("idx") % (len(states.STATES) + 1) + 1).cast("int")).alias("postal"))


TABLE = "sc(postal, code, name) AS (VALUES " + ", ".join(f"('{p}', '{c}', '{n}')" for p, c, n in states.STATES) + "), cd AS (SELECT geoid, coalesce((SELECT p FROM (SELECT postal AS p, row_number() OVER (ORDER BY code) - 1 AS i FROM sc) WHERE i = idx % 52), 'ZZ') AS postal FROM unit)\n"


def looked_up(s, d):
    p = F.col("postal")
    code = states.census_code(p)
    return coded(s, d).select("geoid", "postal", code.alias("code"), states.state_name(p).alias("name"), states.postal_code(code).alias("again"), states.county_term(p).alias("term"), states.county_term(p, plural=True).alias("terms"))


simple("state_lookups", looked_up, TABLE + """
SELECT geoid, postal, code, name, CASE WHEN code IS NOT NULL THEN postal END AS again, CASE postal WHEN 'LA' THEN 'parish' WHEN 'AK' THEN 'borough' ELSE 'county' END AS term, CASE postal WHEN 'LA' THEN 'parishes' WHEN 'AK' THEN 'boroughs' ELSE 'counties' END AS terms FROM cd LEFT JOIN sc USING (postal)""")


def county_names(s, d):
    return a.units(s, d).where("county <> '02009'").groupBy("county").agg(F.max("place").alias("name"))


simple("county_contexts", lambda s, d: states.county_context(a.units_only(s, d).select(F.when(F.col("idx") % 100 == 3, F.substring("geoid", 1, 4)).otherwise(F.col("geoid")).alias("geoid")), county_names(s, d)), """
cn AS (SELECT substr(geoid, 1, 5) AS county, any_value(place) AS name FROM unit WHERE substr(geoid, 1, 5) <> '02009' GROUP BY 1), u AS (SELECT CASE WHEN idx % 100 = 3 THEN substr(geoid, 1, 4) ELSE geoid END AS geoid FROM unit)
SELECT geoid, CASE WHEN length(geoid) < 5 THEN geoid ELSE coalesce(name, substr(geoid, 1, 5)) END AS context FROM u LEFT JOIN cn ON county = substr(geoid, 1, 5)""")


@register("particle_files", """p AS (SELECT CAST(chain % 7 AS INTEGER) AS run, CAST(chain // 7 AS INTEGER) AS particle_idx, list(CAST(step % 5 + 1 AS INTEGER) ORDER BY step) AS plan, max(value) AS weight FROM trace WHERE step <= 8 GROUP BY chain)
SELECT run, particle_idx, array_to_string(plan, ',') AS plan, CASE WHEN particle_idx % 5 > 0 THEN round(ln(weight), 6) END AS log_weight, true AS intact FROM p""")
def _particles(s, d):
    path = scratch(s, "particles")
    t = a.traces(s, d).where("step <= 8").groupBy("chain").agg(F.transform(F.sort_array(F.collect_list("step")), lambda x: (x % 5 + 1).cast("int")).alias("plan"), F.max("value").alias("weight"))
    t = t.select((F.col("chain") % 7).cast("int").alias("run"), F.lit(42).cast("long").alias("base_seed"), F.floor(F.col("chain") / 7).cast("int").alias("particle_idx"), "plan", F.col("weight"))
    t = t.withColumn("weight", F.when(F.col("particle_idx") % 5 > 0, F.col("weight")).otherwise(0.0))
    particles.particle_files(t, "run").write.partitionBy("run").text(path)
    r = particles.read_particles(s, path).select(F.regexp_extract("file", "run=([0-9]+)", 1).cast("int").alias("run"), "intact", F.explode("particles").alias("p"))
    return r.select("run", "p.particle_idx", F.array_join("p.plan", ",").alias("plan"), r6("p.log_weight").alias("log_weight"), "intact")
