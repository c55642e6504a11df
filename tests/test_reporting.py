"""Small fixtures for rounds and reporting."""

import hashlib

from pyspark.sql import functions as F

from precinctlab.operators import reporting, rounds


def test_rounds_of_five_districts(spark):
    plan = spark.createDataFrame([(f"{i:02d}", i % 5 + 1) for i in range(10)], "geoid string, district int")
    r = rounds.regions(plan, 5)
    last = {(x.district, x.region) for x in r.where("round = 3").collect()}
    assert last == {(d, d - 1) for d in range(1, 6)}
    up = {(x.round, x.region): x.parent for x in rounds.lineage(r).collect()}
    assert up == {(2, 0): 0, (2, 1): 0, (2, 2): 1, **{(3, d): d // 2 for d in range(5)}}
    units = plan.select("geoid", F.lit(10).alias("pop"))
    h = rounds.hierarchy(r, units, 5).collect()
    assert sorted({x.round for x in h}) == [1, 2, 3, 4, 5, 6]
    assert {x.deviation_from_ideal_pct for x in h} == {0.0}
    assert rounds.depth_of(1) == 0 and rounds.depth_of(8) == 3 and rounds.depth_of(9) == 4


def test_label_rules(spark):
    names = ["", None, ".redist", "runs", "a b", "ok_1-x", "é", "x\n", "configs"]
    got = {x.label: x.fault for x in reporting.label_check(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert got == {"": "empty", None: "empty", ".redist": "leading dot", "runs": "reserved", "a b": "character", "ok_1-x": None, "é": "character", "x\n": "character", "configs": "reserved"}


def test_claims(spark):
    shape = "k int, point double, low double, high double"
    a = spark.createDataFrame([(1, 0.6, 0.55, 0.65), (2, 0.5, 0.5, 0.5), (3, 0.4, 0.3, 0.5), (4, 0.2, 0.1, 0.3)], shape)
    b = spark.createDataFrame([(1, 0.5, 0.45, 0.54), (2, 0.5, 0.5, 0.5), (3, 0.6, 0.5, 0.7), (4, 0.5, 0.4, 0.6)], shape)
    got = {x.k: (x.monotone_suppressed, x.other_suppressed) for x in reporting.claims(a, b, "k").collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, True), 4: (False, False)}
    one = reporting.indeterminate(a, 0.5).first()
    assert (one.n_districts, one.n_indeterminate, one.n_majority) == (4, 0, 2)


def test_seat_targets_take_up_the_rest(spark):
    units = spark.createDataFrame([(500, 120.0), (300, 50.0), (200, 1.0)], "pop long, density double")
    got = {x.members: x.n_districts for x in reporting.seat_targets(units, (3, 5, 7), 100, 40).collect()}
    # 217.5 goes to the even 218 and 31 districts of 7, 130.5 to 130 and 26 of 5, 87 to 29 of 3; one seat is over
    assert got == {7: 31, 5: 26, 3: 29}
    assert reporting.seat_targets(units, (5,), 100, 40).first().n_districts == 87


def test_stranded_units_and_equal_parts(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2)], "geoid string, district int")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 1.0), ("c", "d", 1.0)], "u string, v string, w double")
    assert {x.geoid for x in reporting.stranded(edges, plan).collect()} == {"c", "e"}


def test_chain_seeds_times_and_text(spark):
    for x in reporting.chain_seeds(spark.range(3).select(F.col("id").alias("chain")), 7).collect():
        digest = hashlib.sha256(b"ENSEMBLE_CHAIN_" + x.chain.to_bytes(8, "little") + b"_" + (7).to_bytes(8, "little")).digest()
        assert int(x.seed, 16) == int.from_bytes(digest[:8], "little")
    at = spark.createDataFrame([(-5,), (0,), (951782399,), (4102444800,)], "s long").select(reporting.iso_time(F.col("s")).alias("t")).collect()
    assert [x.t for x in at] == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "2000-02-28T23:59:59Z", "2100-01-01T00:00:00Z"]
    assert spark.range(1).select(reporting.ascii_safe(F.lit("a–é😀"))).first()[0] == "a???"


def test_times_after_9999_have_no_sign(spark):
    at = spark.createDataFrame([(253402300799,), (253402300800,), (527228 * 86399 * 7 - 86400,)], "s long").select(reporting.iso_time(F.col("s")).alias("t")).collect()
    assert [x.t for x in at] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "12074-05-22T06:50:04Z"]
