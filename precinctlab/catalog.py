"""All registered queries of the plan operators, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from . import catalog_files
from .operators import allocation, attributes, comparison, graph, partisan, series, shapes
from .operators.attributes import r6
from .plans import adapters as a

K = a.K
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, base: bool = True):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = (f"WITH RECURSIVE {a.BASE}" + (", " if not sql.lstrip().upper().startswith("SELECT") else "\n") + sql) if base else sql
        return f

    return add


def simple(name: str, f, sql: str | None = None):
    register(name, sql)(f)


def up(f, *more):
    """A query over units and the interleaved plan."""
    return lambda s, d: f(a.units(s, d), a.plan_a(s, d), *more)


def over(f, *more):
    """A query over district votes."""
    return lambda s, d: f(attributes.elections(a.units(s, d), a.plan_a(s, d)), *more)


EL = "el AS (SELECT district, dem, rep, dem + rep AS total, CASE WHEN dem + rep = 0 THEN 0.5 ELSE dem / (dem + rep) END AS dem_pct FROM dist)\n"
simple("demographic_by_district", up(attributes.demographics, K), """
SELECT district, pop AS total_pop, """ + ", ".join(f"round(CASE WHEN pop = 0 THEN 0 ELSE {g} / pop END, 6) AS pct_{g}" for g in attributes.GROUPS) + """,
round(1 - CASE WHEN pop = 0 THEN 0 ELSE white / pop END, 6) AS pct_minority, 1 - CASE WHEN pop = 0 THEN 0 ELSE white / pop END >= 0.5 AS is_majority_minority FROM full_dist""")
simple("demographic_majority_group", up(attributes.majority_group, K), """
m AS (SELECT district, pop, unnest([{'n': white, 'g': 'white'}, {'n': black, 'g': 'black'}, {'n': asian, 'g': 'asian'}, {'n': hispanic, 'g': 'hispanic'}, {'n': other, 'g': 'other'}]) AS x FROM full_dist),
t AS (SELECT district, pop, max(x) AS x FROM m GROUP BY 1, 2)
SELECT district, x.g AS majority_group, round(100 * CASE WHEN pop = 0 THEN 0 ELSE x.n / pop END, 2) AS majority_pct FROM t""")
simple("political_by_district", up(attributes.political, K), """
SELECT district, dem + rep AS total_votes, dem AS dem_votes, rep AS rep_votes, round(CASE WHEN dem + rep = 0 THEN 0 ELSE dem / (dem + rep) END, 6) AS dem_pct,
round(CASE WHEN dem + rep = 0 THEN 0 ELSE rep / (dem + rep) END, 6) AS rep_pct, round(CASE WHEN dem + rep = 0 THEN 0 ELSE dem / (dem + rep) - rep / (dem + rep) END, 6) AS margin,
CASE WHEN dem + rep = 0 THEN TRUE ELSE dem / (dem + rep) - rep / (dem + rep) >= 0 END AS lean_dem, dem = 0 OR rep = 0 AS is_uncontested FROM full_dist""")
simple("partisan_districts", up(attributes.partisan_districts), EL + """
SELECT district, dem AS dem_votes, rep AS rep_votes, round(dem_pct, 6) AS dem_pct, round(abs(dem - rep) / greatest(total, 1), 6) AS margin,
abs(dem - rep) / greatest(total, 1) < 0.05 AS is_competitive, dem = 0 OR rep = 0 AS is_uncontested FROM el""".replace("SELECT", ", z AS (SELECT 1) SELECT", 0))
simple("urban_by_district", up(attributes.urban, K), """
u AS (SELECT district, count(*) AS num_places, max({'pop': pop, 'place': place}) AS m FROM plan_a JOIN unit USING (geoid) GROUP BY 1)
SELECT a.district, nullif(m.place, '') AS largest_city, coalesce(m.pop, 0) AS largest_city_pop, coalesce(num_places, 0) AS num_places FROM axis a LEFT JOIN u USING (district)""")
simple("vra_mm_districts", up(attributes.minority_districts), """
SELECT district, round((pop - white) / pop, 6) AS pct_minority, round(black / pop, 6) AS pct_black, round(hispanic / pop, 6) AS pct_hispanic, (pop - white) / pop > 0.5 AS is_mm FROM dist""")
simple("population_balance", up(attributes.population_balance), "SELECT round(max(abs(pop - i) / i), 6) AS max_deviation FROM dist, (SELECT avg(pop) AS i FROM dist)")
simple("district_summary", up(attributes.summary, K), """
u AS (SELECT district, max({'pop': pop, 'place': place}) AS m FROM plan_a JOIN unit USING (geoid) GROUP BY 1), t AS (SELECT CAST(sum(pop) // 7 AS BIGINT) AS ideal_pop FROM full_dist)
SELECT f.district, pop AS total_pop, ideal_pop, round(abs(pop - ideal_pop) / ideal_pop, 6) AS pop_deviation_pct, abs(pop - ideal_pop) / ideal_pop <= 0.05 AS pop_balance_ok,
round(1 - CASE WHEN pop = 0 THEN 0 ELSE white / pop END, 6) AS pct_minority, 1 - CASE WHEN pop = 0 THEN 0 ELSE white / pop END >= 0.5 AS is_majority_minority,
round(CASE WHEN dem + rep = 0 THEN 0 ELSE dem / (dem + rep) END, 6) AS dem_pct, 2 * dem >= dem + rep AS lean_dem, m.place AS largest_city FROM full_dist f CROSS JOIN t LEFT JOIN u ON u.district = f.district""")
simple("diversity_index", up(attributes.diversity, K), "SELECT district, round((" + " + ".join(f"CASE WHEN {g} > 0 THEN -({g} / pop) * ln({g} / pop) ELSE 0 END" for g in attributes.GROUPS) + ") / ln(5.0), 6) AS diversity FROM full_dist")
simple("lean_bands", up(attributes.lean_bands, K), """
m AS (SELECT district, CASE WHEN dem + rep > 0 THEN 100 * (dem - rep) / (dem + rep) END AS m FROM full_dist)
SELECT district, CASE WHEN m IS NULL THEN 'No Data' WHEN m >= 20 THEN 'Strong D' WHEN m >= 10 THEN 'Lean D' WHEN m >= 5 THEN 'Tilt D' WHEN m >= -5 THEN 'Tossup' WHEN m >= -10 THEN 'Tilt R' WHEN m >= -20 THEN 'Lean R' ELSE 'Strong R' END AS lean FROM m""")
SPLIT = "sp AS (SELECT {e} AS {k}, count(*) AS n_units, list_sort(list(DISTINCT district)) AS d FROM plan_b JOIN unit USING (geoid) GROUP BY 1)\nSELECT {k}, n_units, CAST(len(d) AS INTEGER) AS split_severity, array_to_string(d, ',') AS districts FROM sp WHERE len(d) > 1"
simple("county_splits", lambda s, d: attributes.splits(a.units(s, d), a.plan_b(s, d), "county", "county_fips"), SPLIT.format(e="substr(geoid, 1, 5)", k="county_fips"))
simple("municipal_splits", lambda s, d: attributes.splits(a.units(s, d), a.plan_b(s, d), "place", "place_name"), SPLIT.format(e="place", k="place_name"))
simple("split_score", lambda s, d: attributes.split_score(a.units(s, d), a.plan_b(s, d), "county"),
       "sp AS (SELECT substr(geoid, 1, 5), count(DISTINCT district) AS d FROM plan_b JOIN unit USING (geoid) GROUP BY 1) SELECT count(*) AS n_areas, count(*) FILTER (d > 1) AS n_split, round(1 - count(*) FILTER (d > 1) / count(*), 6) AS score FROM sp")
simple("turnout_weighted", up(attributes.weighted_turnout), "SELECT district, round(sum(dem + rep) / sum(pop), 6) AS turnout FROM plan_a JOIN unit USING (geoid) WHERE pop > 0 GROUP BY 1")
simple("mm_counts_by_type", up(attributes.minority_status), """SELECT count(*) FILTER (black / pop > 0.5) AS black_mm, count(*) FILTER (hispanic / pop > 0.5) AS hispanic_mm, count(*) FILTER (asian / pop > 0.5) AS asian_mm,
count(*) FILTER (black / pop > 0.5 OR hispanic / pop > 0.5 OR asian / pop > 0.5) AS total_mm FROM dist""")
simple("unmatched_units", lambda s, d: attributes.unmatched(a.units(s, d), a.plan_a(s, d).where("district < 6")), "SELECT count(*) AS n_unmatched FROM unit WHERE idx % 7 + 1 >= 6")

simple("efficiency_gap", over(partisan.efficiency_gap), EL + """
SELECT round((sum(CASE WHEN dem > rep THEN rep ELSE rep - total / 2 END) - sum(CASE WHEN dem > rep THEN dem - total / 2 ELSE dem END)) / sum(total), 6) AS efficiency_gap FROM el""")
simple("mean_median", over(partisan.mean_median), EL + "SELECT round(avg(dem_pct) - quantile_cont(dem_pct, 0.5), 6) AS mean_median FROM el")
simple("statewide_shares", over(partisan.statewide), EL + "SELECT round(sum(dem) / sum(total), 6) AS dem_vote_share, round(count(*) FILTER (dem > rep) / count(*), 6) AS dem_seat_share FROM el")
simple("partisan_bias_uniform", over(partisan.bias_uniform_swing), EL + "SELECT round(0.5 - avg(CASE WHEN dem_pct + s >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS partisan_bias FROM el, (SELECT 0.5 - sum(dem) / sum(total) AS s FROM el)")
simple("partisan_bias_simple", over(partisan.bias_simple), EL + "SELECT round(count(*) FILTER (dem_pct > 0.5) / count(*) - sum(dem) / sum(total), 6) AS simple_bias FROM el")
simple("seats_votes_curve", over(partisan.seats_votes), EL + """
SELECT CAST(i AS INTEGER) AS swing_points, round((SELECT sum(dem) / sum(total) FROM el) + i / 100, 6) AS vote_share, count(*) FILTER (dem_pct + i / 100 >= 0.5) AS seats FROM el, (SELECT unnest(range(-10, 11)) AS i) GROUP BY i""")
simple("proportionality", over(partisan.proportionality), EL + """
, z AS (SELECT sum(dem) AS d, sum(total) AS t, count(*) FILTER (CASE WHEN total > 0 THEN dem / total ELSE 0 END >= 0.5) AS ds, count(*) AS n, count(*) FILTER (dem = 0 OR rep = 0) AS un FROM el)
SELECT round(d / t, 6) AS dem_vote_share, ds AS dem_seats, n - ds AS rep_seats, round(ds / n, 6) AS dem_seat_share, un AS n_uncontested, round(100 * (ds / n - d / t), 6) AS gap_pp, t > 0 AS available FROM z""")
simple("competitive_districts", over(partisan.competitive), EL + "SELECT count(*) FILTER (abs(dem - rep) / greatest(total, 1) < 0.05) AS n_competitive, count(*) AS n_districts FROM el")
simple("bootstrap_ci", over(partisan.bootstrap), EL + """
, rw AS (SELECT row_number() OVER (ORDER BY district) - 1 AS i, dem_pct FROM el), n AS (SELECT count(*) AS n FROM el), dr AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || j), 1, 8) AS BIGINT) % n AS i FROM (SELECT unnest(range(1000)) AS b), n, LATERAL (SELECT unnest(range(n)) AS j)),
st AS (SELECT b, avg(dem_pct) - quantile_cont(dem_pct, 0.5) AS m FROM dr JOIN rw USING (i) GROUP BY b), so AS (SELECT m, row_number() OVER (ORDER BY m) AS r FROM st)
SELECT (SELECT m FROM so WHERE r = floor(1000 * 0.025) + 1) AS low, (SELECT m FROM so WHERE r = floor(1000 * 0.975) + 1) AS high""")

SEATS = 435


def state_pops(s, d):
    return a.read(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("pop")).join(F.broadcast(a.read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("state"), "pop")


def parties(s, d):
    return a.read(s, d, "events").groupBy(F.col("event_type").alias("party")).agg(F.count("*").alias("votes"))


simple("huntington_hill", lambda s, d: allocation.huntington_hill(state_pops(s, d), "state", "pop", SEATS), """
p AS (SELECT n_name AS state, count(*) AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
q AS (SELECT state, row_number() OVER (ORDER BY pop / sqrt(i * (i + 1)) DESC, state) AS r FROM p, (SELECT unnest(range(1, 436)) AS i))
SELECT state, 1 + count(r) AS seats FROM p LEFT JOIN (SELECT * FROM q WHERE r <= 435 - (SELECT count(*) FROM p)) USING (state) GROUP BY state""")
QUOTA = """
p AS (SELECT event_type AS party, count(*) AS votes FROM events GROUP BY 1), q AS (SELECT party, row_number() OVER (ORDER BY votes / CAST({div} AS DOUBLE) DESC, party) AS r FROM p, (SELECT unnest(range(1, 21)) AS i)),
al AS (SELECT party, count(r) AS seats FROM p LEFT JOIN (SELECT * FROM q WHERE r <= 20) USING (party) GROUP BY party)
"""
simple("dhondt", lambda s, d: allocation.dhondt(parties(s, d), "party", "votes", 20), QUOTA.format(div="i") + "SELECT party, seats FROM al")
simple("dhondt_threshold", lambda s, d: allocation.dhondt_threshold(parties(s, d), "party", "votes", 20, 0.2), """
p AS (SELECT event_type AS party, count(*) AS votes FROM events GROUP BY 1), f AS (SELECT * FROM p WHERE votes >= 0.2 * (SELECT sum(votes) FROM p)),
f2 AS (SELECT * FROM f UNION ALL (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM f) ORDER BY votes DESC, party LIMIT 1)),
q AS (SELECT party, row_number() OVER (ORDER BY votes / CAST(i AS DOUBLE) DESC, party) AS r FROM f2, (SELECT unnest(range(1, 21)) AS i))
SELECT party, count(r) AS seats FROM p LEFT JOIN (SELECT * FROM q WHERE r <= 20) USING (party) GROUP BY party""")
simple("sainte_lague", lambda s, d: allocation.sainte_lague(parties(s, d), "party", "votes", 20), QUOTA.format(div="2 * i - 1") + "SELECT party, seats FROM al")
simple("multi_member_seats", lambda s, d: allocation.dhondt(a.read(s, d, "events").groupBy("user_id", F.col("event_type").alias("party")).agg(F.count("*").alias("votes")), "party", "votes", 5, ["user_id"]), """
p AS (SELECT user_id, event_type AS party, count(*) AS votes FROM events GROUP BY 1, 2),
q AS (SELECT user_id, party, row_number() OVER (PARTITION BY user_id ORDER BY votes / CAST(i AS DOUBLE) DESC, party) AS r FROM p, (SELECT unnest(range(1, 6)) AS i))
SELECT p.user_id, p.party, count(r) AS seats FROM p LEFT JOIN (SELECT * FROM q WHERE r <= 5) w ON p.user_id = w.user_id AND p.party = w.party GROUP BY 1, 2""")


@register("gallagher", QUOTA.format(div="i") + ", t AS (SELECT sum(votes) AS v, sum(seats) AS s FROM p JOIN al USING (party)) SELECT round(sqrt(sum(10000 * (votes / v - seats / s) ** 2) / 2), 6) AS gallagher, round(sum(abs(votes / v - seats / s)), 6) AS deviation FROM p JOIN al USING (party), t")
def _gallagher(s, d):
    p = parties(s, d)
    return allocation.gallagher(p, allocation.dhondt(p, "party", "votes", 20), "party", "votes")


simple("natural_threshold", lambda s, d: state_pops(s, d).select("state", r6(1 / (F.col("pop") + 1)).alias("threshold")), "SELECT n_name AS state, round(1 / (count(*) + 1), 6) AS threshold FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
simple("prime_factors", lambda s, d: allocation.prime_factors(state_pops(s, d).select(F.col("pop").cast("int").alias("n")).distinct()).select("n", "largest", "is_prime"), """
p AS (SELECT DISTINCT CAST(count(*) AS INTEGER) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), f AS (SELECT n, i FROM p, (SELECT unnest(range(2, 100000)) AS i) WHERE i <= n AND n % i = 0),
g AS (SELECT n, i FROM f WHERE NOT EXISTS (SELECT 1 FROM f h WHERE h.n = f.n AND h.i < f.i AND f.i % h.i = 0))
SELECT p.n, CAST(max(i) AS INTEGER) AS largest, coalesce(max(i) = p.n, FALSE) AS is_prime FROM p LEFT JOIN g USING (n) GROUP BY p.n""")


def two(f, *more):
    return lambda s, d: f(a.plan_a(s, d), a.plan_b(s, d), *more)


CANON = "ca AS (SELECT geoid, CAST(dense_rank() OVER (ORDER BY m) AS INTEGER) AS district FROM (SELECT geoid, min(geoid) OVER (PARTITION BY district) AS m FROM plan_a)), cb AS (SELECT geoid, CAST(dense_rank() OVER (ORDER BY m) AS INTEGER) AS district FROM (SELECT geoid, min(geoid) OVER (PARTITION BY district) AS m FROM plan_b))\n"
simple("canonical_labels", lambda s, d: comparison.canonical(a.plan_a(s, d)), CANON + "SELECT geoid, district FROM ca")
simple("assignment_diff", two(comparison.assignment_diff), CANON + "SELECT count(*) FILTER (ca.district IS NULL) AS missing_in_a, count(*) FILTER (cb.district IS NULL) AS missing_in_b, count(*) FILTER (ca.district <> cb.district) AS differing FROM ca FULL JOIN cb USING (geoid)")
simple("plan_jaccard", two(comparison.jaccard), """
o AS (SELECT x.district AS da, y.district AS db, count(*) AS n FROM plan_a x JOIN plan_b y USING (geoid) GROUP BY 1, 2), na AS (SELECT district, count(*) AS n FROM plan_a GROUP BY 1), nb AS (SELECT district, count(*) AS n FROM plan_b GROUP BY 1)
SELECT round(avg(j), 6) AS plan_jaccard FROM (SELECT da, max(o.n / (na.n + nb.n - o.n)) AS j FROM o JOIN na ON na.district = da JOIN nb ON nb.district = db GROUP BY da)""")
simple("plan_agreement", two(comparison.agreement), "SELECT round(count(*) FILTER (x.district = y.district) / greatest(count(x.district), count(y.district)), 6) AS plan_agreement FROM plan_a x FULL JOIN plan_b y USING (geoid)")
simple("plan_diff_summary", two(comparison.diff_summary), """
j AS (SELECT x.district AS da, y.district AS db FROM plan_a x JOIN plan_b y USING (geoid) WHERE x.district <> y.district)
SELECT (SELECT count(*) FROM j) AS units_changed, (SELECT count(DISTINCT d) FROM (SELECT da AS d FROM j UNION ALL SELECT db FROM j)) AS districts_touched""")
simple("nesting_violations", two(comparison.nesting_violations, 2), """
p AS (SELECT DISTINCT x.district AS h, y.district AS s FROM plan_a x JOIN plan_b y USING (geoid)), sp AS (SELECT h, count(*) > 1 AS spans FROM p GROUP BY h)
SELECT s AS senate_district, count(*) AS house_districts, 2 AS expected_count FROM p JOIN sp USING (h) GROUP BY s HAVING count(*) <> 2 OR bool_or(spans)""")
simple("plan_validation", lambda s, d: comparison.validate(a.plan_a(s, d), a.units_only(s, d), K), """
SELECT unnest(['district_range', 'empty_districts', 'geoid_format', 'repeated_units', 'unassigned_units']) AS rule, unnest([(SELECT count(*) FROM plan_a WHERE district NOT BETWEEN 1 AND 7), 7 - (SELECT count(DISTINCT district) FROM plan_a),
(SELECT count(*) FROM plan_a WHERE NOT regexp_full_match(geoid, '[0-9]{11}')), (SELECT count(*) - count(DISTINCT geoid) FROM plan_a), (SELECT count(*) FROM unit WHERE geoid NOT IN (SELECT geoid FROM plan_a))]) AS violations""")


@register("national_union", "SELECT CAST(substr(geoid, 1, 2) AS VARCHAR) AS state, count(*) AS n, CAST(sum(pop) AS BIGINT) AS pop FROM unit GROUP BY 1")
def _national(s, d):
    u = a.units(s, d)
    return comparison.national([u.where(F.col("state") == x).select("state", "pop") for x in ("01", "02", "03", "04", "05")]).groupBy("state").agg(F.count("*").alias("n"), F.sum("pop").alias("pop"))


def gp(f, plan="plan_a", *more):
    return lambda s, d: f(a.edges(s, d), getattr(a, plan)(s, d), *more)


LAB = "lab AS (SELECT e.*, x.district AS du, y.district AS dv FROM edge e JOIN {p} x ON x.geoid = e.u JOIN {p} y ON y.geoid = e.v)\n"
simple("lattice_edges", lambda s, d: a.edges(s, d), "SELECT u, v, w FROM edge")
simple("cut_edges", gp(graph.cut_edges, "plan_b"), LAB.format(p="plan_b") + "SELECT count(*) FILTER (du <> dv) AS n_cut, coalesce(sum(w) FILTER (du <> dv), 0) AS weight_cut, count(*) AS n_edges FROM lab")
simple("adjacent_pairs", gp(graph.adjacent_pairs, "plan_b"), LAB.format(p="plan_b") + "SELECT least(du, dv) AS d1, greatest(du, dv) AS d2, count(*) AS n_edges FROM lab WHERE du <> dv GROUP BY 1, 2")
simple("county_coarsening", lambda s, d: graph.coarsen(a.edges(s, d), a.units_only(s, d)), "SELECT least(substr(u, 1, 5), substr(v, 1, 5)) AS u, greatest(substr(u, 1, 5), substr(v, 1, 5)) AS v, count(*) AS n_edges, sum(w) AS w FROM edge WHERE substr(u, 1, 5) <> substr(v, 1, 5) GROUP BY 1, 2")
REACH = "adj AS (SELECT u AS x, v AS y FROM {e} UNION ALL SELECT v, u FROM {e}), lb(node, label) AS (SELECT geoid, geoid FROM unit UNION SELECT a.y, lb.label FROM lb JOIN adj a ON a.x = lb.node)\n"


def heavy(s, d):
    return a.edges(s, d).where("w >= 5")


simple("connected_components", lambda s, d: graph.components(heavy(s, d), a.units_only(s, d).select(F.col("geoid").alias("node"))),
       "hv AS (SELECT * FROM edge WHERE w >= 5), " + REACH.format(e="hv") + "SELECT node, min(label) AS component FROM lb GROUP BY node")
simple("district_contiguity", gp(graph.contiguity, "plan_b", K), LAB.format(p="plan_b") + ", ins AS (SELECT * FROM lab WHERE du = dv), " + REACH.format(e="ins") + """
, comp AS (SELECT node, min(label) AS c FROM lb GROUP BY node), sz AS (SELECT district, c, count(*) AS n FROM comp JOIN plan_b ON geoid = node GROUP BY 1, 2)
SELECT a.district, count(c) <= 1 AS contiguous, CAST(coalesce(sum(n), 0) AS BIGINT) AS tract_count, count(c) AS component_count, CAST(coalesce(sum(n) - max(n), 0) AS BIGINT) AS disconnected FROM axis a LEFT JOIN sz USING (district) GROUP BY 1""")
simple("subset_polsby_popper", lambda s, d: graph.subset_polsby_popper(a.edges(s, d), a.plan_b(s, d), a.units(s, d).select("geoid", (F.col("pop") + 1).cast("double").alias("area"), (F.col("idx") % 3).cast("double").alias("outer"))), LAB.format(p="plan_b") + """
, ar AS (SELECT district, sum(CAST(pop + 1 AS DOUBLE)) AS area, sum(CAST(idx % 3 AS DOUBLE)) AS ext FROM unit JOIN plan_b USING (geoid) GROUP BY 1), cr AS (SELECT district, sum(w) AS c FROM (SELECT du AS district, w FROM lab WHERE du <> dv UNION ALL SELECT dv, w FROM lab WHERE du <> dv) GROUP BY 1)
SELECT district, round(CASE WHEN ext + coalesce(c, 0) > 0 THEN 4 * pi() * area / ((ext + coalesce(c, 0)) ** 2) ELSE 0 END, 6) AS pp FROM ar LEFT JOIN cr USING (district)""")


def minority_share(s, d):
    return a.units(s, d).select("geoid", attributes.ratio(F.col("pop") - F.col("white"), F.col("pop")).alias("share"))


def dem_share(s, d):
    return a.units(s, d).select("geoid", attributes.ratio(F.col("dem"), F.col("dem") + F.col("rep"), 0.5).alias("share"))


MS = "sh AS (SELECT geoid, CASE WHEN pop = 0 THEN 0 ELSE (pop - white) / pop END AS share FROM unit)"
DS = "sh AS (SELECT geoid, CASE WHEN dem + rep = 0 THEN 0.5 ELSE dem / (dem + rep) END AS share FROM unit)"
ENDS = ", en AS (SELECT e.*, x.share AS xu, y.share AS xv FROM edge e JOIN sh x ON x.geoid = e.u JOIN sh y ON y.geoid = e.v)\n"
simple("vra_weights", lambda s, d: graph.share_weights(a.edges(s, d), minority_share(s, d), 0.5), MS + ENDS + "SELECT u, v, round(greatest(3.0, 10 * (1 - 0.7 * (SELECT avg(CASE WHEN share >= 0.5 THEN 1.0 ELSE 0.0 END) FROM sh))), 6) AS alpha FROM en WHERE xu >= 0.5 AND xv >= 0.5")
simple("partisan_weights", lambda s, d: graph.lean_weights(a.edges(s, d), dem_share(s, d)), DS + ENDS + "SELECT u, v, round(greatest(3.0, 10 * (1 - 0.7 * (SELECT avg(CASE WHEN share >= 0.55 OR share <= 0.45 THEN 1.0 ELSE 0.0 END) FROM sh))), 6) AS alpha FROM en WHERE (xu >= 0.55 AND xv >= 0.55) OR (xu <= 0.45 AND xv <= 0.45)")
simple("similarity_weights", lambda s, d: graph.similarity_weights(a.edges(s, d), dem_share(s, d), 4.0, 0.1), DS + ENDS + "SELECT u, v, CAST(4.0 AS DOUBLE) AS alpha FROM en WHERE abs(xu - xv) < 0.1")
simple("subdivision_weights", lambda s, d: graph.subdivision_weights(a.edges(s, d), {5: 2.0, 2: 0.5}), "SELECT u, v, round(w * (1 + CASE WHEN substr(u, 1, 5) = substr(v, 1, 5) THEN 2.0 ELSE 0 END + CASE WHEN substr(u, 1, 2) = substr(v, 1, 2) THEN 0.5 ELSE 0 END), 6) AS w FROM edge")
simple("coi_weights", lambda s, d: graph.community_weights(a.edges(s, d), dem_share(s, d), "share"), DS + ENDS + "SELECT u, v, round(w * (1 + (coalesce(xu, 0) + coalesce(xv, 0)) / 2), 6) AS w FROM en")
simple("cross_lean_weights", lambda s, d: graph.cross_lean(a.edges(s, d), dem_share(s, d)), DS + ENDS + "SELECT u, v, round(CASE WHEN (xu >= 0.5) <> (xv >= 0.5) THEN w * 0.1 ELSE w END, 6) AS w FROM en")
simple("boundary_penalty", lambda s, d: graph.boundary_penalty(a.edges(s, d), 0.5), "SELECT u, v, round(CASE WHEN substr(u, 1, 2) <> substr(v, 1, 2) THEN w * 1.5 ELSE w END, 6) AS w FROM edge")
simple("graph_checks", lambda s, d: graph.graph_checks(a.edges(s, d), a.units_only(s, d).select(F.col("geoid").alias("node"))), """SELECT (SELECT count(*) FROM edge WHERE u = v) AS loops, (SELECT count(*) FROM edge) - (SELECT count(*) FROM (SELECT DISTINCT u, v FROM edge)) AS repeated,
(SELECT count(*) FROM edge WHERE w <= 0) AS non_positive, (SELECT count(*) FROM (SELECT u AS x FROM edge UNION ALL SELECT v FROM edge) WHERE x NOT IN (SELECT geoid FROM unit)) AS unknown_ends""")
simple("metis_text", lambda s, d: graph.metis_text(a.edges(s, d), a.units(s, d).select("geoid", (F.col("idx") + 1).alias("number"), F.col("pop").alias("weight"))), """
nb AS (SELECT x.idx + 1 AS number, y.idx + 1 AS b, CAST(round(w * 1000) AS BIGINT) AS w FROM edge JOIN unit x ON x.geoid = u JOIN unit y ON y.geoid = v UNION ALL SELECT y.idx + 1, x.idx + 1, CAST(round(w * 1000) AS BIGINT) FROM edge JOIN unit x ON x.geoid = u JOIN unit y ON y.geoid = v),
tx AS (SELECT number, string_agg(b || ' ' || w, ' ' ORDER BY b, w) AS t FROM nb GROUP BY 1) SELECT 0 AS number, (SELECT count(*) FROM unit) || ' ' || (SELECT count(*) FROM edge) || ' 011' AS line UNION ALL SELECT idx + 1 AS number, trim(pop || ' ' || coalesce(t, '')) AS line FROM unit LEFT JOIN tx ON number = idx + 1""")

TR = "n AS (SELECT min(m) AS n FROM (SELECT max(step) AS m FROM trace GROUP BY chain)), tr AS (SELECT chain, step, value FROM trace, n WHERE step <= n)"
simple("rhat", lambda s, d: series.r_hat(series.trimmed(a.traces(s, d))), TR + """, c AS (SELECT chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM tr GROUP BY 1), g AS (SELECT count(*) AS k, max(n) AS n, avg(v) AS w, var_samp(m) AS b FROM c)
SELECT k AS n_chains, n AS n_per_chain, round(CASE WHEN w = 0 THEN 1 ELSE sqrt(((n - 1) / n * w + b) / w) END, 6) AS r_hat, CASE WHEN w = 0 THEN FALSE ELSE sqrt(((n - 1) / n * w + b) / w) >= 1.05 END AS above_threshold FROM g""")
simple("autocorrelation", lambda s, d: series.autocorrelation(series.trimmed(a.traces(s, d)), 5), TR + """, x AS (SELECT chain, step, value - avg(value) OVER (PARTITION BY chain) AS x FROM tr), z AS (SELECT chain, sum(x * x) AS z FROM x GROUP BY 1),
p AS (SELECT a.chain, CAST(b.step - a.step AS INTEGER) AS lag, sum(a.x * b.x) AS p FROM x a JOIN x b ON a.chain = b.chain AND b.step - a.step BETWEEN 0 AND 5 GROUP BY 1, 2) SELECT lag, round(avg(p / z), 6) AS rho FROM p JOIN z USING (chain) WHERE z > 0 GROUP BY 1""")
simple("percentile_rank", lambda s, d: series.percentile_rank(a.traces(s, d), 50.0), "SELECT round(avg(CASE WHEN value <= 50.0 THEN 1.0 ELSE 0.0 END), 6) AS percentile_rank FROM trace")
simple("percentile_plan", lambda s, d: series.percentile_plan(a.traces(s, d), 0.25), "r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY value, step) - 1 AS r, count(*) OVER (PARTITION BY chain) AS n FROM trace) SELECT chain, step, round(value, 6) AS value FROM r WHERE r = floor((n - 1) * 0.25)")
simple("hamming_by_lag", lambda s, d: series.hamming_by_lag(series.trimmed(a.traces(s, d)).select("chain", F.lit(0).alias("unit"), "step", F.floor(F.col("value") / 10).alias("label")), 4), TR + "SELECT CAST(b.step - a.step AS INTEGER) AS lag, round(avg(CASE WHEN floor(a.value / 10) <> floor(b.value / 10) THEN 1.0 ELSE 0.0 END), 6) AS hamming FROM tr a JOIN tr b ON a.chain = b.chain AND b.step - a.step BETWEEN 0 AND 4 GROUP BY 1".replace("SELECT", " SELECT", 1))
simple("cumulative_resample", lambda s, d: series.cumulative_weights(a.units(s, d).select(F.col("idx").alias("id"), F.col("pop").alias("weight"))), "SELECT idx AS id, round(sum(pop) OVER (ORDER BY idx) / sum(pop) OVER (), 6) AS cumulative FROM unit")
simple("lorenz_curve", lambda s, d: series.lorenz(a.units(s, d).select("geoid", "pop", (F.col("idx") % 11 + 1).alias("area")), "pop", "area", "geoid"), "l AS (SELECT geoid, pop, idx % 11 + 1 AS ar FROM unit) SELECT geoid, round(sum(pop) OVER w / sum(pop) OVER (), 6) AS x_share, round(sum(ar) OVER w / sum(ar) OVER (), 6) AS y_share FROM l WINDOW w AS (ORDER BY pop / ar, geoid ROWS UNBOUNDED PRECEDING)")
simple("geographic_sorting_corr", lambda s, d: series.correlation(a.units(s, d), "pop", "dem"), "SELECT round(corr(pop, dem), 6) AS r, count(*) AS n FROM unit")
simple("linear_trend", lambda s, d: series.trend(a.units(s, d), "dem", "pop"), "SELECT round(regr_slope(dem, pop), 6) AS slope, round(regr_intercept(dem, pop), 6) AS intercept, round(regr_r2(dem, pop), 6) AS r2 FROM unit")
simple("wls_fit", lambda s, d: series.wls(a.units(s, d), "dem", "rep", "pop"), "z AS (SELECT CAST(pop AS DOUBLE) AS w, CAST(rep AS DOUBLE) AS x, CAST(dem AS DOUBLE) AS y FROM unit), q AS (SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM z) SELECT round((s * sxy - sx * sy) / (s * sxx - sx * sx), 6) AS slope, round((sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s, 6) AS intercept FROM q")
simple("holm_adjust", lambda s, d: series.holm(a.units(s, d).groupBy(F.col("place").alias("name")).agg((F.avg(F.col("idx") % 100) / 1000).alias("p"))), "t AS (SELECT place AS name, avg(idx % 100) / 1000 AS p FROM unit GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS n FROM t) SELECT name, round(max(least(1.0, (n - r + 1) * p)) OVER (ORDER BY r), 6) AS p_adjusted FROM r")
simple("rank_in_state", lambda s, d: series.national_rank(a.units(s, d), "state", "pop", "geoid"), "SELECT substr(geoid, 1, 2) AS state, geoid, CAST(rank() OVER (PARTITION BY substr(geoid, 1, 2) ORDER BY pop DESC) AS INTEGER) AS rank_in_group, CAST(rank() OVER (ORDER BY pop DESC) AS INTEGER) AS rank_overall FROM unit")
simple("props_json_scan", lambda s, d: a.read(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m")).select("event_id", F.explode("m").alias("key", "value")), "SELECT event_id, unnest(json_keys(props)) AS key, props ->> ('$.' || unnest(json_keys(props))) AS value FROM events")
simple("polsby_popper", lambda s, d: shapes.shape_scores(a.units_only(s, d)), """
r AS (SELECT geoid, CAST(idx % 4 + 1 AS DOUBLE) AS a, CAST(idx % 6 + 1 AS DOUBLE) AS b FROM unit) SELECT geoid, round(a * b, 6) AS area, round(2 * (a + b), 6) AS perimeter, round(least(1.0, 4 * pi() * a * b / ((2 * (a + b)) ** 2)), 6) AS polsby_popper, round(a * b / (pi() * (a * a + b * b) / 4), 6) AS reock FROM r""")


def queries() -> dict:
    from . import catalog_gates, catalog_more, catalog_packages, catalog_reports, catalog_shapes, catalog_stats, catalog_streams  # noqa: F401  register themselves

    return _QUERIES | catalog_files.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_gates, catalog_more, catalog_packages, catalog_reports, catalog_shapes, catalog_stats, catalog_streams  # noqa: F401

    return _SQL | catalog_files.SQL
