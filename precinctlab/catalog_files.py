"""Queries of the file formats, joins on places, robust errors and streams, with their SQL.

Files are written from the driver's tables by Spark and read back by the scans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.geometry import area
from .operators import attributes, robust, spatial
from .operators.attributes import r6, ratio
from .plans import adapters as a
from .sources import binary, plan_files, records, tables
from .sources.shared import scratch
from .streaming import tallies

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, base: bool = True):
    def add(f):
        QUERIES[name] = f
        SQL[name] = f"WITH RECURSIVE {a.BASE}{'' if sql.startswith('SELECT') else ', '}{sql}" if base else sql
        return f

    return add


def dem_share(s, d):
    return a.units(s, d).select("geoid", ratio(F.col("dem"), F.col("dem") + F.col("rep"), 0.5).alias("share"))


def square(x, y):
    """Unit square with its lower left corner at (x, y), an open ring."""
    at = lambda i, j: F.struct((x + i).cast("double").alias("x"), (y + j).cast("double").alias("y"))
    return F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))


def column():
    return F.col("idx") % a.WIDTH


def row():
    return F.floor(F.col("idx") / a.WIDTH)


@query("shares_tsv_scan", "SELECT geoid, round(CASE WHEN dem + rep = 0 THEN 0.5 ELSE dem / (dem + rep) END, 6) AS share FROM unit")
def _shares(s, d):
    path = scratch(s, "shares")
    plan_files.shares_export(dem_share(s, d), path, "district votes")
    return tables.aligned_shares(a.units_only(s, d), tables.shares_tsv(s, path)).select("geoid", r6("share").alias("share"))


@query("demographics_csv_scan", "SELECT geoid, pop AS total_pop, round(CASE WHEN pop = 0 THEN 0 ELSE (pop - white) / pop END, 6) AS share FROM unit")
def _demographics(s, d):
    path = scratch(s, "demographics")
    u = a.units(s, d)
    u.select("geoid", F.col("pop").alias("total_pop"), *[F.col(g).alias(n) for g, n in (("white", "white_non_hispanic"), ("black", "black_non_hispanic"), ("asian", "asian_non_hispanic"), ("hispanic", "hispanic"), ("other", "other"))]).write.option("header", True).csv(path)
    t = tables.typed_csv(s, path, tables.DEMOGRAPHICS)
    return tables.minority_fractions(t).join(t.select("geoid", "total_pop"), "geoid").select("geoid", "total_pop", r6("share").alias("share"))


@query("population_source_scan", "SELECT geoid, CAST(dem + rep AS BIGINT) AS population FROM unit")
def _population(s, d):
    path = scratch(s, "population")
    a.units(s, d).select("geoid", F.col("pop").alias("total"), (F.col("dem") + F.col("rep")).alias("vap"), F.col("dem").alias("cvap")).write.option("header", True).csv(path)
    return tables.population_source(tables.typed_csv(s, path, tables.POPULATION), "vap")


@query("census_geography_scan", "SELECT CAST(idx AS VARCHAR) AS logrecno, geoid, place AS name, CAST(idx * 10 AS BIGINT) AS arealand, CAST(0 AS BIGINT) AS areawatr, CAST(idx % 30 AS DOUBLE) AS intptlat, CAST(idx // 30 AS DOUBLE) AS intptlon, pop AS population FROM unit WHERE idx % 2 = 0")
def _geography(s, d):
    u, geo, pop = a.units(s, d), scratch(s, "geo"), scratch(s, "pop")
    put = {2: F.when(F.col("idx") % 2 == 0, "140").otherwise("150"), 7: F.col("idx").cast("string"), 8: F.col("geoid"), 84: (F.col("idx") * 10).cast("string"), 87: F.col("place"), 92: column().cast("string"), 93: row().cast("string")}
    u.select(F.concat_ws("|", *[put.get(i, F.lit("")) for i in range(97)]).alias("value")).write.text(geo)
    u.select(F.concat_ws("|", F.lit("PLST"), F.lit("US"), F.lit("000"), F.lit("01"), F.col("idx").cast("string"), F.col("pop").cast("string")).alias("value")).write.text(pop)
    return tables.census_geography(s, geo).join(tables.census_population(s, pop), "logrecno", "left")


@query("chain_log_scan", "SELECT CAST(dense_rank() OVER (ORDER BY CAST(chain AS VARCHAR)) - 1 AS INTEGER) AS chain, CAST(step AS BIGINT) AS step, 'value' AS metric, value FROM trace")
def _chains(s, d):
    path = scratch(s, "chains")
    a.traces(s, d).select(F.to_json(F.struct(F.col("chain").cast("string").alias("chain"), "step", F.struct("value").alias("metrics"))).alias("value")).write.text(path)
    return tables.chain_logs(s, path)


@query("chain_export_roundtrip", "SELECT geoid, district FROM plan_a")
def _chain_export(s, d):
    path = scratch(s, "export")
    by_state = a.plan_a(s, d).withColumn("state", F.substring("geoid", 1, 2))
    plan_files.chain_export(by_state, "state").write.partitionBy("state").text(path)
    return plan_files.assignment_map(plan_files.documents(s, path), "assignment").select(F.col("key").alias("geoid"), "district")


@query("indexed_assignment_scan", "SELECT geoid, district FROM plan_b")
def _indexed(s, d):
    path = scratch(s, "indexed")
    index = a.units_only(s, d)
    by_place = a.plan_b(s, d).join(index, "geoid").groupBy((F.col("idx") % 8).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string").alias("k"), "district")))).alias("value"))
    by_place.write.partitionBy("part").text(path)
    return plan_files.keyed_by_geoid(plan_files.assignment_map(plan_files.documents(s, path)), index)


@query("feature_properties_roundtrip", "SELECT geoid, district FROM plan_b")
def _features(s, d):
    path = scratch(s, "features")
    plan_files.feature_export(a.plan_b(s, d).withColumn("state", F.substring("geoid", 1, 2)), "state").write.partitionBy("state").text(path)
    return plan_files.feature_properties(plan_files.documents(s, path))


@query("units_csv_roundtrip", "SELECT geoid, district FROM plan_a")
def _units_csv(s, d):
    path = scratch(s, "csv")
    plan_files.units_csv(a.plan_a(s, d), path)
    return plan_files.two_column_csv(s, path)


@query("district_placeholders", """SELECT district, '{"type":"Feature","geometry":null,"properties":{"district":' || district || ',"tract_count":' || count(*) || '}}' AS value FROM plan_a GROUP BY 1""")
def _placeholders(s, d):
    return plan_files.district_placeholders(a.plan_a(s, d))


@query("adjacency_file_roundtrip", """x AS (SELECT geoid, substr(geoid, 1, 2) AS graph, row_number() OVER (PARTITION BY substr(geoid, 1, 2) ORDER BY geoid) - 1 AS n FROM unit)
SELECT p.graph, least(p.n, q.n) AS u, greatest(p.n, q.n) AS v, w FROM edge e JOIN x p ON p.geoid = e.u JOIN x q ON q.geoid = e.v WHERE p.graph = q.graph""")
def _adjacency(s, d):
    v, e = a.state_graphs(s, d)
    return binary.graph_edges(binary.graph_files(v.select("graph", "vertex", "weight"), e))


@query("wkb_roundtrip", "SELECT geoid, CAST((idx % 4 + 1) * (idx % 6 + 1) AS DOUBLE) AS area, 4 AS n_points FROM unit")
def _wkb(s, d):
    x, y = (F.col("idx") % 4 + 1).cast("double"), (F.col("idx") % 6 + 1).cast("double")
    at = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    zero = F.lit(0.0)
    coded = a.units_only(s, d).select("geoid", binary.ring_to_wkb(F.array(at(zero, zero), at(x, zero), at(x, y), at(zero, y))).alias("g"))
    return coded.select("geoid", binary.wkb_rings("g")[0].alias("r")).select("geoid", area(F.col("r")).alias("area"), F.size("r").alias("n_points"))


@query("box_join", "b AS (SELECT idx AS id, idx % 30 AS x, idx // 30 AS y FROM unit) SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.id < q.id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1")
def _boxes(s, d):
    b = a.units_only(s, d).select(F.col("idx").alias("id"), column().alias("x0"), row().alias("y0"), (column() + 1).alias("x1"), (row() + 1).alias("y1"))
    return spatial.overlapping_boxes(b, 2.0)


@query("plan_import_by_points", "SELECT geoid, CAST(CASE WHEN idx % 30 < 28 THEN idx % 30 // 4 + 1 ELSE 7 END AS INTEGER) AS district FROM unit")
def _locate(s, d):
    u = a.units_only(s, d)
    points = u.select("geoid", (column() + 0.5).alias("x"), (row() + 0.5).alias("y"))
    top = u.select(F.max(row() + 1).cast("double").alias("top"))
    x = F.col("id").cast("double")
    at = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    # seven bands of four columns; the last two columns lie outside and go to the nearest
    bands = s.range(7).join(F.broadcast(top)).select((F.col("id") + 1).cast("int").alias("district"), F.array(at(x * 4, F.lit(0.0)), at(x * 4 + 4, F.lit(0.0)), at(x * 4 + 4, F.col("top")), at(x * 4, F.col("top"))).alias("ring"))
    return spatial.locate(points, bands, 8.0)


@query("dissolved_perimeter", """i AS (SELECT x.district, count(*) AS n FROM edge JOIN plan_b x ON x.geoid = u JOIN plan_b y ON y.geoid = v WHERE x.district = y.district GROUP BY 1), c AS (SELECT district, count(*) AS n FROM plan_b GROUP BY 1)
SELECT district, CAST(4 * c.n - 2 * coalesce(i.n, 0) AS DOUBLE) AS perimeter, CAST(4 * c.n - 2 * coalesce(i.n, 0) AS BIGINT) AS n_sides FROM c LEFT JOIN i USING (district)""")
def _dissolve(s, d):
    u = a.units_only(s, d).join(a.plan_b(s, d), "geoid").select("district", square(column(), row()).alias("ring"))
    return spatial.dissolved_perimeter(u)


@query("hc3_fit", """z AS (SELECT CAST(rep AS DOUBLE) AS x, CAST(dem AS DOUBLE) AS y FROM unit), f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b FROM z),
q AS (SELECT b, n, sqrt(sum((x - mx) ** 2 * ((y - my - b * (x - mx)) / (1 - 1 / n - (x - mx) ** 2 / sxx)) ** 2)) / sxx AS e FROM z, f GROUP BY b, n, sxx)
SELECT round(b, 6) AS slope, round(e, 6) AS hc3_error, round(b / e, 6) AS t, n FROM q""")
def _hc3(s, d):
    return robust.hc3(a.units(s, d), "dem", "rep")


@query("variance_inflation", "SELECT round(1 / (1 - corr(dem, rep) ** 2), 6) AS vif FROM unit")
def _vif(s, d):
    return robust.variance_inflation(a.units(s, d), "dem", "rep")


@query("streamed_tallies", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS party, count(*) AS votes, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", base=False)
def _tallies(s, d):
    found = tallies.settle(tallies.window_tallies(tallies.stream(s, f"{d}/events.parquet")))
    return found.groupBy(F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "party").agg(F.sum("votes").alias("votes"), F.round(F.sum("total"), 4).alias("total"))


@query("streamed_moments", "SELECT CAST(user_id AS BIGINT) AS chain, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY 1", base=False)
def _moments(s, d):
    return tallies.settle(tallies.chain_moments(tallies.stream(s, f"{d}/events.parquet"))).select("chain", "n", r6("mean").alias("mean"), F.round("variance", 4).alias("variance"))


def fixed(put: dict, layout: dict):
    """A line with each value of ``put`` at its place."""
    out, at = [], 0
    for n, (start, end) in sorted(((n, layout[n]) for n in put), key=lambda x: x[1]):
        out += [F.lit(" " * (start - at)), F.rpad(put[n].cast("string"), end - start, " ")]
        at = end
    return F.concat(*out).alias("value")


def tract_fields(year: int) -> dict:
    put = {"sumlev": F.when(F.col("idx") % 2 == 0, records.LEVELS[year]).otherwise("150"), "logrecno": F.col("idx"), "state": F.substring("geoid", 1, 2), "county": F.substring("geoid", 3, 3), "tract": F.substring("geoid", 6, 6), "arealand": F.col("idx") * 10,
           "name": F.col("place"), "intptlat": column().cast("double"), "intptlon": F.when(column() == 0, "").otherwise(row().cast("string"))}
    return put | ({"population": F.col("pop")} if year == 2000 else {})


TRACTS = "SELECT CAST(idx AS VARCHAR) AS logrecno, geoid, place AS name, CAST(idx * 10 AS BIGINT) AS arealand, CAST(0 AS BIGINT) AS areawatr, CAST(idx % 30 AS DOUBLE) AS intptlat, CASE WHEN idx % 30 = 0 THEN 0.0::DOUBLE ELSE CAST(idx // 30 AS DOUBLE) END AS intptlon, pop AS population FROM unit WHERE idx % 2 = 0"


@query("census_2010_scan", TRACTS)
def _tracts_2010(s, d):
    u, geo, pop = a.units(s, d), scratch(s, "geo2010"), scratch(s, "pop2010")
    u.select(fixed(tract_fields(2010), records.LAYOUTS[2010])).write.text(geo)
    u.select(F.concat_ws(",", F.lit("PLST"), F.lit("US"), F.lit("000"), F.lit("01"), F.col("idx").cast("string"), F.col("pop").cast("string"), F.lit("7")).alias("value")).write.text(pop)
    return records.fixed_geography(s, geo, 2010).join(records.comma_population(s, pop), "logrecno", "left")


@query("census_2000_scan", TRACTS)
def _tracts_2000(s, d):
    geo = scratch(s, "geo2000")
    a.units(s, d).select(fixed(tract_fields(2000), records.LAYOUTS[2000])).write.text(geo)
    return records.fixed_geography(s, geo, 2000)


RACE = "list_extract(['Black', 'white', 'Hispanic', 'Asian', 'Native', 'other'], CAST((o_orderkey % 6) + 1 AS BIGINT))"


@query("candidate_disputes", f"""c AS (SELECT 'Candidate ' || o_custkey AS candidate_name, CASE WHEN o_custkey % 2 = 0 THEN 'DEM' ELSE 'REP' END AS party, {RACE} AS race, 'Curator ' || (o_orderkey % 3) AS curator FROM orders)
SELECT candidate_name, party, CAST(count(DISTINCT curator) AS INTEGER) AS n_curators, array_to_string(list_sort(list(DISTINCT curator)), ',') AS curators, count(DISTINCT race) AS n_races FROM c GROUP BY 1, 2 HAVING count(DISTINCT curator) > 1""")
def _disputes(s, d):
    path, documents = scratch(s, "candidates"), scratch(s, "attestations")
    a.read(s, d, "region").select(F.col("r_name").alias("value")).write.text(documents)  # any files stand for the documents
    name = F.min(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("doc")
    doc = s.read.text(documents).select(name)
    o = a.read(s, d, "orders").join(F.broadcast(doc))  # one row
    even = F.col("o_custkey") % 2 == 0
    race = F.element_at(F.array(*[F.lit(x) for x in records.RACES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o.select(F.concat(F.lit("Candidate "), "o_custkey").alias("candidate_name"), F.when(even, "DEM").otherwise("REP").alias("party"), race.alias("race"), F.concat(F.lit("Curator "), F.col("o_orderkey") % 3).alias("curator"), F.lit("professor").alias("curator_credentials"), F.lit("2026-01-01").alias("curator_attestation_date"), F.lit("survey").alias("source"),
             F.when(even, "yes").otherwise("0").alias("independently_verified"), F.col("doc").alias("attestation_doc_path"), F.lit("TXT").alias("attestation_doc_format")).write.option("header", True).csv(path)
    return records.disputed_candidates(records.candidate_annotations(s, path, documents))


@query("analysis_shares_scan", """x AS (SELECT district, CASE WHEN dem + rep = 0 THEN 0.5 ELSE dem / (dem + rep) END AS v FROM dist)
SELECT shape, CAST(n AS INTEGER) AS n_shares, CAST(k AS INTEGER) AS leaning_seats FROM (SELECT count(*) AS n0, count(*) FILTER (v >= 0.5) AS k0 FROM x) t, (VALUES ('districts', 1), ('list', 1), ('none', 0), ('top', 1)) s(shape, f), LATERAL (SELECT t.n0 * f AS n, t.k0 * f AS k) q""")
def _analysis(s, d):
    path = scratch(s, "analysis")
    e = attributes.elections(a.units(s, d), a.plan_a(s, d)).agg(F.collect_list("dem_pct").alias("v"))  # a row per district
    each = F.to_json(F.transform("v", lambda x: F.struct(x.alias("dem_share"))))
    shapes = {"districts": F.concat(F.lit('{"districts": '), each, F.lit("}")), "list": F.concat(F.lit('{"per_district_dem_share": '), F.to_json("v"), F.lit("}")), "top": each, "none": F.lit('{"other": 1}')}
    rows = e.select(F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), x.alias("text")) for n, x in shapes.items()])).alias("x")).select("x.*")
    rows.write.partitionBy("shape").text(path)
    read = s.read.text(path).select("shape", records.analysis_shares(F.col("value")).alias("v"))
    return read.select("shape", F.size("v").alias("n_shares"), F.size(F.filter("v", lambda x: x >= 0.5)).alias("leaning_seats"))
