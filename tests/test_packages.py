"""Plan packages, strict scans, election files, national merges and graph checks."""

import numpy as np
import pytest

from precinctlab.operators import graph, nationwide, series
from precinctlab.sources import binary, elections, plan_files, plan_package, tables


def package(spark, tmp_path, name, **changes):
    meta = {"label": "p", "state_fips": "53", "state_code": "WA", "year": "2020", "chamber": "congressional", "num_districts": 2, "population_source": "total", "created_at": "t", "created_by": "me", "geometry": None} | changes
    units = meta.pop("units", {"53000000001": 1, "53000000002": 2})
    version = meta.pop("version", "0.1")
    row = spark.createDataFrame([("k", *meta.values())], "k string, " + ", ".join(f"{c} {'int' if c == 'num_districts' else 'string'}" for c in meta))
    plan = spark.createDataFrame([("k", g, d) for g, d in units.items()], "k string, geoid string, district int")
    plan_package.packages(plan, row, "k", version).select("value").coalesce(1).write.text(str(tmp_path / name))
    return plan_package.read_packages(spark, str(tmp_path / name))


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({}, set()), ({"version": "0.2"}, {("warning", "minor version is known", 1)}), ({"version": "1.0"}, {("fatal", "major version is 0", 1)}), ({"version": "x.1"}, {("fatal", "major version is 0", 1)}),
        ({"version": "01"}, {("error", "version is major.minor", 1)}), ({"label": None, "year": ""}, {("error", "label is given", 1), ("error", "year is given", 1)}), ({"num_districts": None}, {("error", "num_districts is positive", 1)}),
        ({"num_districts": 4}, {("warning", "num_districts is reached", 1), ("warning", "districts have units", 2)}),
        ({"num_districts": 1}, {("error", "districts are in range", 1), ("error", "num_districts is not exceeded", 1)}),
        ({"units": {"530000000012": 1, "5300000000x": 2, "53000000002": 0}}, {("error", "units have 11 digits", 2), ("error", "districts are in range", 1)}),
        ({"geometry": '{"type": "FeatureCollection", "features": []}'}, set()), ({"geometry": '{"a": 1}'}, {("error", "geometry is a feature collection", 1)}), ({"units": {}}, set()),
    ],
)
def test_package_rules(spark, tmp_path, changes, want):
    p = package(spark, tmp_path, "p", **changes)
    assert {(r.severity, r.rule, r.n) for r in plan_package.findings(p).collect()} == want
    v = plan_package.verdicts(p).first()
    assert (v.valid, v.n_errors, v.n_warnings) == (not any(s != "warning" for s, *_ in want), sum(s != "warning" for s, *_ in want), sum(s == "warning" for s, *_ in want))
    units = changes.get("units", {"53000000001": 1, "53000000002": 2})
    assert {(r.geoid, r.district) for r in plan_package.assignments(p).collect()} == set(units.items())


def test_no_package(spark, tmp_path):
    (tmp_path / "x.json").write_text("[1, 2")
    with pytest.raises(Exception, match="(?i)malformed"):
        plan_package.read_packages(spark, str(tmp_path)).collect()


def test_headers_only_first(spark, tmp_path):
    def put(name, *texts):
        (tmp_path / name).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / name / f"{i}.txt").write_text(t)
        return str(tmp_path / name)

    ok = put("a", "# made\n\ngeoid\tshare\n1\t0.5\n2\t0.25\n", "3\t1\n", "# only\n", "unit\tx\n")
    assert sorted(tuple(r) for r in tables.shares_tsv(spark, ok).collect()) == [("00000000001", 0.5), ("00000000002", 0.25), ("00000000003", 1.0)]
    for name, text in (("b", "1\t0.5\ngeoid\tshare\n"), ("c", "h\tx\n1\t0.5\n2\n"), ("d", "1\t0.5\n\n2\tnone\n3\t0.1\n"), ("e", "h\tx\nh\tx\n1\t0.5\n")):
        with pytest.raises(Exception, match="no share"):
            tables.shares_tsv(spark, put(name, text, "7\t0.5\n")).collect()
    with pytest.raises(Exception, match="out of range"):
        tables.shares_tsv(spark, put("f", "1\t1.5\n")).collect()
    csv = put("g", "GEOID,district\n00000000001,3\n", "7,00000000002\n")
    assert sorted(tuple(r) for r in plan_files.two_column_csv(spark, csv).collect()) == [("00000000001", 3), ("00000000002", 7)]
    for name, text in (("h", "00000000001,3\na,b\n"), ("i", "GEOID,district\n00000000001,x\n")):
        with pytest.raises(Exception, match="no unit and district"):
            plan_files.two_column_csv(spark, put(name, text)).collect()


def test_presidential(spark, tmp_path):
    head = [*elections.PRESIDENTIAL, "more"]
    cell = {"tract_GEOID": "1001020100", "tract_population": "200", "G20PRERTRU": "30", "G20PREDBID": "60", "G20PRELJOR": "8", "G20PREOWRI": "2"}
    none = cell | {"tract_GEOID": "01001020200", "G20PRERTRU": "0", "G20PREDBID": "0", "G20PRELJOR": "", "G20PREOWRI": "0", "tract_population": "0"}
    lines = [",".join(head), *(",".join(c.get(h, "7") for h in head) for c in (cell, none))]
    (tmp_path / "p.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    a, b = elections.presidential(spark, str(tmp_path / "p.csv")).orderBy("geoid").collect()
    assert (a.geoid, a.total_votes, a.trump_pct, a.other_pct, a.biden_two_party_pct, a.dem_margin, a.turnout_rate, a.lean, a.county_fips) == ("01001020100", 100, 30.0, 10.0, 66.67, 33.34, 50.0, "Strong D", "7")
    assert (b.total_votes, b.trump_pct, b.dem_margin, b.turnout_rate, b.lean) == (0, None, None, None, "No Data")
    (tmp_path / "q.csv").write_text("tract_GEOID\n1\n")
    with pytest.raises(ValueError, match="G20PRERTRU"):
        elections.presidential(spark, str(tmp_path / "q.csv"))


def test_block_groups(spark):
    d = spark.createDataFrame([("10010201001", 1), ("010010201002", 2), ("010010209001", 2)], "geoid string, district int")
    r = spark.createDataFrame([("1001020100", 5, 6, 1, 0, 2)], "geoid string, dem_votes int, rep_votes int, lib_votes int, grn_votes int, oth_votes int")
    votes, lost = elections.block_group_votes(d, r)
    assert sorted(tuple(x) for x in votes.collect()) == [(1, 5, 6, 1, 0, 2), (2, 5, 6, 1, 0, 2)] and [x.geoid for x in lost.collect()] == ["010010209001"]


def test_national(spark):
    v = spark.createDataFrame([("B", 0, "b0", 1), ("A", 1, "a1", 2), ("A", 0, "a0", 3), ("B", 4, "b4", 5)], "state string, vertex int, geoid string, weight int")
    e = spark.createDataFrame([("A", 1, 0, 2.0), ("B", 0, 4, 3.0), ("B", 0, 9, 1.0), ("C", 0, 1, 1.0)], "state string, u int, v int, w double")
    vertices, edges = nationwide.merged_graph(v, e)
    assert sorted((r.number, r.geoid) for r in vertices.collect()) == [(0, "a0"), (1, "a1"), (2, "b0"), (3, "b4")]
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 2.0), (2, 3, 3.0)]
    docs = spark.createDataFrame([("B", '{"analyzer": "x", "n": 3, "more": true}'), ("A", '{"analyzer": "x", "n": 1.5, "name": "q"}'), ("C", "[1]"), ("D", None)], "state string, content string")
    assert [tuple(r) for r in nationwide.state_table(docs, "2020").orderBy("state").collect()] == [("A", "2020", "1.5", "q"), ("B", "2020", "3", "")]
    assert nationwide.state_table(docs.where("false"), "2020").collect() == []
    rows = spark.createDataFrame([("A", '{"districts": [{"district": 2, "v": 7}, {"district": 1, "w": null}]}')], "state string, content string")
    assert [tuple(r) for r in nationwide.district_records(rows).where("name = 'v'").collect()] == [("A", 2, "v", "7")]


def test_checked_graph_files():
    weights, u, v, w = np.array([5, 6, 7]), np.array([0, 2]), np.array([1, 1]), np.array([1.5, 2.5])
    data = binary.encode_graph(weights, u, v, w, np.array([1.0, 2.0, 3.0]), np.array([4.0, 5.0, 6.0]))
    got = binary.decode_graph(data)
    assert got[0].tolist() == [5, 6, 7] and got[1].tolist() == [(0, 1, 1.5), (1, 2, 2.5)] and got[2].tolist() == [1, 2, 3] and got[3].tolist() == [4, 5, 6]
    old = data[:4] + (2).to_bytes(4, "little") + data[8:-52]
    assert binary.decode_graph(old)[2] is None
    at = 16 + 24 + 4  # the first neighbour of vertex 0
    assert data[at : at + 4] == (1).to_bytes(4, "little")
    for broken, message in ((data[:at] + b"\2" + data[at + 1 :], "differ"), (data[:-1], "cut short"), (data[:50], "cut short")):
        with pytest.raises(ValueError, match=message):
            binary.decode_graph(broken)


def test_structure(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    both = [("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 2.0), ("d", "c", 2.5), ("d", "e", 1.0), ("e", "e", 1.0), ("a", "b", 1.0), ("a", "z", 1.0), ("z", "a", 1.0)]
    got = {r.rule: r.violations for r in graph.structure_checks(spark.createDataFrame(both, "u string, v string, w double"), nodes).collect()}
    assert got == {"asymmetric": 2, "loops": 1, "repeated": 1, "unknown_ends": 1, "isolated": 1, "components": 2}


def test_ess_by_plain_sums(spark):
    rng = np.random.default_rng(4)
    chains = {0: rng.normal(size=120), 1: np.cumsum(rng.normal(size=90)), 2: np.ones(8), 3: np.array([1.0, 2.0]), 4: np.sin(np.arange(60))}
    rows = [(c, i + 1, float(x)) for c, v in chains.items() for i, x in enumerate(v)]
    got = {r.chain: r.ess for r in series.ess(spark.createDataFrame(rows, "chain long, step long, value double").repartition(3)).collect()}
    for c, v in chains.items():
        n, x = len(v), v - v.mean()
        want = float(n)
        if n >= 4 and x @ x > 0:
            rho = [sum(x[i] * x[i + k] for i in range(n - k)) / sum(x * x) for k in range(max(n // 4, 2) + 1)]
            total, low = 0.0, float("inf")
            for k in range(1, max(n // 4, 2), 2):
                low = min(low, rho[k] + rho[k + 1]) if k + 1 < len(rho) else 0
                if low <= 0:
                    break
                total += low
            want = min(n, n / (1 + 2 * total))
        assert got[c] == pytest.approx(want)


def test_graph_files_beyond_a_million_customers(spark, tmp_path):
    """Geoids keep six digits of a customer key: units that share one made edges of a unit with itself, which no graph file holds."""
    import __spark_entry__
    import duckdb
    from pyspark.sql import functions as F

    for name in ("nation", "orders", "lineitem", "customer"):
        t = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "customer":
            t = t.withColumns({"c_custkey": F.col("c_custkey") + 999_960, "c_nationkey": (F.col("c_custkey") / 50).cast("int")})
        if name == "orders":
            t = t.withColumn("o_custkey", F.col("o_custkey") + 999_960)
        t.write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, columns in (("graph_file_vertices", ("graph", "area")), ("adjacency_file_roundtrip", None)):
        got = [r.asDict() for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
        if columns:  # which of the units that share a geoid comes first, SQL leaves open
            want = duckdb.sql(f"SELECT graph, vertex, weight, \"outer\", area FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
            assert len(want) == 150 and sorted((r["graph"], r["vertex"]) for r in got) == sorted(x[:2] for x in want)
            assert sorted((r["graph"], r["weight"], r["outer"] or 0, r["area"] or 0) for r in got) == sorted((g, w, o or 0, z or 0) for g, _, w, o, z in want)
        else:  # inside rows of 30 and states: each link once
            state = lambda i: (i - 999_960) // 50
            region = dict(duckdb.sql("SELECT n_nationkey, n_regionkey FROM nation").fetchall())
            pairs = [(i, j) for i in range(999_960, 1_000_110) for j in ([i + 1] if i % 30 < 29 else []) + [i + 30] if j < 1_000_110 and region[state(i)] == region[state(j)]]
            assert len(got) == len(pairs) and all(r["u"] < r["v"] for r in got)
