"""Gates, certificates, ensembles, expected files, lookups and particle files on small odd tables."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinctlab.functions import states
from precinctlab.operators import gates
from precinctlab.sources import particles

MANIFEST = "path string, schema_version string, validate_mode string, label string"


@pytest.mark.parametrize(
    ("modes", "allow", "want"),
    [([], False, ("none found", 0, 0)), (["strict"] * 2, False, ("all strict", 2, 0)), (["strict", "lenient"], False, ("refused", 1, 1)), (["advisory", "odd", None], True, ("allowed", 0, 3))],
)
def test_civic_gate(spark, modes, allow, want):
    rows = [(f"p{i}", "civic-coi v1", m, "l") for i, m in enumerate(modes)] + [("q", "plan v1", "lenient", "l"), ("r", None, "lenient", "l")]
    df = spark.createDataFrame(rows, MANIFEST)
    assert tuple(gates.civic_gate(df, allow).first()) == want
    assert {r.mode for r in gates.civic_manifests(df).collect()} == {m if m in ("strict", "lenient", "advisory") else f"unknown:{m or ''}" for m in modes}


def test_certificates(spark):
    rows = [("a", 0.4, 10, 4.0, 9.0, 3.0, 5.0, 1.0), ("none", 0.0, 4, 1.0, 1.0, 0.0, 1.0, 0.5)]
    a, none = gates.certificates(spark.createDataFrame(rows, "k string, lambda2 double, n int, area_a double, area_b double, outer_a double, outer_b double, achieved double"), "k", 0.05).orderBy("k").collect()
    top = math.sqrt(4 * math.pi * 4 / 16 * (4 * math.pi * 9 / 36))
    assert (a.least_cut, a.bound, a.ratio, a.certified) == (1.0, pytest.approx(top, abs=1e-6), pytest.approx(1 / top, abs=1e-6), 1 / top >= 0.95)
    assert (none.bound, none.ratio, none.certified) == (0.0, None, False)


def test_ensembles(spark):
    rng = np.random.default_rng(1)
    make = lambda v: spark.createDataFrame([(c, i + 1, None if x is None else float(x)) for c, s in enumerate(v) for i, x in enumerate(s)], "chain long, step long, value double")
    good = [rng.normal(size=200) for _ in range(4)]
    r = gates.validated_ensemble(make(good), 0.0).first()
    assert r.passed and r.n_chains == 4 and r.n_per_chain == 200 and r.ess > 100
    x = np.concatenate(good)
    x = x - x.mean()
    rho = [x[: len(x) - k] @ x[k:] / (x @ x) for k in range(len(x) // 4 + 1)]
    total, low = 0.0, float("inf")
    for k in range(1, len(rho) - 1, 2):
        low = min(low, rho[k] + rho[k + 1])
        if low <= 0:
            break
        total += low
    assert r.ess == pytest.approx(min(len(x), len(x) / (1 + 2 * total)), abs=1e-5)
    assert not gates.validated_ensemble(make([s + 9 * i for i, s in enumerate(good)]), 0.0).first().passed
    for bad, message in (([*good[:3], good[3][:9]], "trim"), ([*good[:3], [None, *good[3][1:]]], "lack"), (good[:3], "four chains")):
        with pytest.raises(Exception, match=message):
            gates.validated_ensemble(make(bad), 0.0).collect()


def test_expected_files(spark):
    s = spark.createDataFrame([("one", 1), ("five", 5)], "state string, k int")
    o = spark.createDataFrame([("r", "m/{round_num}_{round_regions}.png", True), ("a", "a.json", True), ("c", "c.csv", False)], "script string, pattern string, required boolean")
    e = gates.expected_files(s, o)
    files = {(r.state, r.file) for r in e.collect()}
    assert files == {("one", "a.json"), ("one", "c.csv"), ("five", "a.json"), ("five", "c.csv"), ("five", "m/1_2.png"), ("five", "m/2_4.png"), ("five", "m/3_5.png")}
    found = spark.createDataFrame([("one", "a.json"), ("five", "a.json"), ("five", "m/1_2.png"), ("five", "c.csv"), ("five", "other")], "state string, file string")
    got = {r.state: (r.n_expected, r.n_found, r.n_missing, r.missing, r.status) for r in gates.output_gaps(e, found).collect()}
    assert got == {"one": (2, 1, 0, "", "optional files missing"), "five": (5, 3, 2, "m/2_4.png;m/3_5.png", "incomplete")}
    assert {r.status for r in gates.output_gaps(e, found.where("false")).collect()} == {"nothing"}


def test_minorities(spark):
    d = spark.createDataFrame([("A", 0.6, 0.1, 0.0, 0.3), ("A", 0.3, 0.3, 0.0, 0.4), ("A", 0.0, 0.5, 0.0, 0.5), ("A", 0.0, 0.51, 0.0, 0.49), ("B", 0.1, 0.1, 0.1, 0.7)], "s string, pct_black double, pct_hispanic double, pct_asian double, pct_white double")
    n = gates.minority_counts(d, "s")
    assert {r.s: tuple(r)[1:] for r in n.collect()} == {"A": (1, 1, 0, 3, 2), "B": (0, 0, 0, 0, 0)}
    table = lambda rows: spark.createDataFrame(rows, "s string, total long")
    got = {r.s: r.status for r in gates.minority_status(table([("A", 2), ("B", 0), ("C", 3), ("D", 1), ("E", 2)]), table([("A", 1), ("B", 4), ("C", 1), ("D", 1)]), "s").collect()}
    assert got == {"A": "At Risk", "B": "N/A", "C": "Non-compliant", "D": "Compliant", "E": "Non-compliant"}


def test_votes_and_sizes(spark):
    units = spark.createDataFrame([("u", "x", 3), ("v", "x", 1), ("w", "y", 0), ("z", "y", 0), ("q", "none", 4)], "geoid string, area string, vap int")
    results = spark.createDataFrame([("x", 8, 4, 10), ("y", 2, 2, 0)], "area string, dem int, rep int, oth int")
    got = {(r.geoid, r.party): r.votes for r in gates.party_votes(units, results, {"lib": 0.7, "grn": 0.3}).collect()}
    assert got == {("u", "dem"): 6, ("u", "rep"): 3, ("u", "lib"): 5.25, ("u", "grn"): 2.25, ("v", "dem"): 2, ("v", "rep"): 1, ("v", "lib"): 1.75, ("v", "grn"): 0.75, ("w", "dem"): 1, ("w", "rep"): 1, ("w", "lib"): 0, ("w", "grn"): 0, ("z", "dem"): 1, ("z", "rep"): 1, ("z", "lib"): 0, ("z", "grn"): 0}
    size = {r.name: r.n for r in gates.model_size(spark.createDataFrame([("a", "b"), ("b", "c")], "u string, v string"), spark.range(3), 2).collect()}
    assert size["variables"] == 3 * 2 + 2 + 8 and size["constraints"] == 3 + 4 + 8 + 8 + 4 + 2
    pops, edges = gates.coarse_units(spark.createDataFrame([("01001a", 2), ("01001b", 3), ("01003a", 4)], "geoid string, pop int"), spark.createDataFrame([("01001a", "01003a", 1.0), ("01001a", "01001b", 1.0)], "u string, v string, w double"))
    assert {tuple(r) for r in pops.collect()} == {("01001", 5, 2), ("01003", 4, 1)} and [tuple(r) for r in edges.collect()] == [("01001", "01003", 1, 1.0)]
    with pytest.raises(Exception, match="no county"):
        gates.coarse_units(spark.createDataFrame([("01", 2)], "geoid string, pop int"), spark.createDataFrame([], "u string, v string, w double"))[0].collect()


def test_lookups(spark):
    df = spark.createDataFrame([("VT",), ("DC",), ("LA",), ("ZZ",), (None,)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(states.census_code(p), states.state_name(p), states.postal_code(states.census_code(p)), states.county_term(p), states.county_term(p, True)).collect()]
    assert got == [("50", "Vermont", "VT", "county", "counties"), ("11", "District of Columbia", "DC", "county", "counties"), ("22", "Louisiana", "LA", "parish", "parishes"), (None, None, None, "county", "counties"), (None, None, None, "county", "counties")]
    assert len({c for _, c, _ in states.STATES}) == 51


def test_particles(spark, tmp_path):
    rows = [("r", 7, 1, [1, 2], 0.25), ("r", 7, 0, [2, 2], 0.0), ("t", 8, 0, [3], 1.0)]
    files = particles.particle_files(spark.createDataFrame(rows, "run string, base_seed long, particle_idx int, plan array<int>, weight double"), "run")
    text = {r.run: r.value for r in files.collect()}
    lines = text["r"].split("\n")
    assert lines[:2] == ['{"plan":[2,2],"log_weight":-inf,"particle_idx":0}', '{"plan":[1,2],"log_weight":-1.386294,"particle_idx":1}']
    meta = json.loads(lines[2])
    assert meta["file_sha256"] == hashlib.sha256(("\n".join(lines[:2]) + "\n").encode()).hexdigest() and (meta["n_particles"], meta["k"], meta["base_seed"]) == (2, 2, 7)
    for name, content in (("a", text["r"] + "\n"), ("b", text["t"].replace("[3]", "[4]")), ("c", lines[0] + "\n")):
        (tmp_path / name).write_text(content)
    got = {r.file[-1]: (r.intact, [p.log_weight for p in r.particles]) for r in particles.read_particles(spark, str(tmp_path)).collect()}
    assert got == {"a": (True, [None, -1.386294]), "b": (False, [0.0]), "c": (False, [None])}
