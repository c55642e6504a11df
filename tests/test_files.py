"""File formats, joins on places and robust errors on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinctlab.operators import robust, spatial
from precinctlab.sources import binary, plan_files, tables


def lines(spark, path, *text):
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.text(str(path))
    return str(path)


def test_share_lines(spark, tmp_path):
    p = lines(spark, tmp_path / "a", "# made", "", "geoid\tdem_share", "1001020100\t0.42\r", "22001950100\t1")
    assert {tuple(r) for r in tables.shares_tsv(spark, p).collect()} == {("01001020100", 0.42), ("22001950100", 1.0)}
    q = lines(spark, tmp_path / "b", "01001020100\t1.5")
    with pytest.raises(Exception, match="out of range"):
        tables.shares_tsv(spark, q).collect()


def test_csv_header_is_checked(spark, tmp_path):
    p = lines(spark, tmp_path / "a", "geoid,rep_votes,dem_votes", "01001020100,1,2")
    with pytest.raises(Exception, match="(?i)header|conform"):
        tables.typed_csv(spark, p, tables.ELECTION).collect()
    with pytest.raises(ValueError):
        tables.population_source(spark.createDataFrame([("1", 2)], "geoid string, total long"), "vap")


def test_minority_fraction_edges(spark):
    t = spark.createDataFrame([("1", 0, 0), ("2", 10, 12), ("3", 10, 4)], "geoid string, total_pop long, white_non_hispanic long")
    assert [r.share for r in tables.minority_fractions(t).orderBy("geoid").collect()] == [0.0, 0.0, pytest.approx(0.6)]


def test_chain_log_steps_from_lines(spark, tmp_path):
    p = lines(spark, tmp_path / "a", '{"metrics": {"cut": 3}}', "", '{"metrics": {"cut": 5}}')
    assert [tuple(r) for r in tables.chain_logs(spark, p).orderBy("step").collect()] == [(0, 0, "cut", 3.0), (0, 1, "cut", 5.0)]


def test_csv_of_either_order(spark, tmp_path):
    p = lines(spark, tmp_path / "a", "district,GEOID20", '3,"01001020100"', "01001020200,4")
    assert {tuple(r) for r in plan_files.two_column_csv(spark, p).collect()} == {("01001020100", 3), ("01001020200", 4)}
    with pytest.raises(Exception, match="no unit and district"):
        plan_files.two_column_csv(spark, lines(spark, tmp_path / "b", "district,GEOID20", "01001020200,north")).collect()


def test_partition_list_counts_lines(spark):
    d = spark.createDataFrame([("f", "0\n1\n1\n")], "file string, content string")
    assert [r.part for r in plan_files.partition_list(d, 3).orderBy("vertex").collect()] == [0, 1, 1]
    with pytest.raises(Exception, match="expected 4"):
        plan_files.partition_list(d, 4).collect()


def test_graph_bytes():
    data = binary.encode_graph(np.array([5, 6, 7]), np.array([2, 0]), np.array([1, 1]), np.array([300.0, 500.5]))
    weights, edges, outer, areas = binary.decode_graph(data)
    assert outer is None and areas is None
    assert weights.tolist() == [5, 6, 7] and [tuple(e) for e in edges.tolist()] == [(0, 1, 500.5), (1, 2, 300.0)]
    for broken in (b"X" + data[1:], data[:4] + b"\x63" + data[5:], data[:40], data[:12] + b"\x09" + data[13:]):
        with pytest.raises(ValueError):
            binary.decode_graph(broken)
    assert binary.decode_graph(binary.encode_graph(*(np.array([]),) * 4))[0].tolist() == []


def test_multipolygon_and_null(spark):
    import struct

    ring = struct.pack("<I", 3) + np.array([[0, 0], [1, 0], [0, 1]], "<f8").tobytes()
    one = struct.pack("<BII", 1, 3, 2) + ring + ring
    many = struct.pack("<BII", 1, 6, 2) + one + one
    got = spark.createDataFrame([(bytearray(many),), (None,)], "g binary").select(binary.wkb_rings("g").alias("r")).collect()
    assert sorted(-1 if r.r is None else len(r.r) for r in got) == [-1, 2]


def test_boxes_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    lo = rng.integers(-8, 8, (60, 2))
    hi = lo + rng.integers(0, 5, (60, 2))
    b = [(i, float(p[0]), float(p[1]), float(q[0]), float(q[1])) for i, (p, q) in enumerate(zip(lo, hi))]
    want = {(x[0], y[0]) for x in b for y in b if x[0] < y[0] and max(x[1], y[1]) <= min(x[3], y[3]) and max(x[2], y[2]) <= min(x[4], y[4])}
    got = [tuple(r) for r in spatial.overlapping_boxes(spark.createDataFrame([*b, (99, None, 0.0, 1.0, 1.0)], "id long, x0 double, y0 double, x1 double, y1 double"), 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_outside_and_empty(spark):
    ring = "array<struct<x:double,y:double>>"
    polygons = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, [(8.0, 0.0), (9.0, 0.0), (9.0, 1.0)])], f"district int, ring {ring}")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 7.0, 5.0)], "geoid string, x double, y double")
    assert {tuple(r) for r in spatial.locate(points, polygons, 1.0).collect()} == {("a", 1), ("b", 2)}
    assert spatial.locate(points.where("false"), polygons, 1.0).count() == 0


def test_hc3_against_matrix_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=30)
    y = 2 * x + rng.normal(size=30) * (1 + abs(x))
    m = np.c_[np.ones(30), x]
    inv = np.linalg.inv(m.T @ m)
    e = y - m @ (inv @ m.T @ y)
    h = np.einsum("ij,jk,ik->i", m, inv, m)
    cov = inv @ (m.T * (e / (1 - h)) ** 2) @ m @ inv
    got = robust.hc3(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double"), "y", "x").first()
    assert got.hc3_error == pytest.approx(cov[1, 1] ** 0.5, abs=1e-5) and got.n == 30
    flat = robust.hc3(spark.range(5).select(F.lit(1).alias("x"), F.col("id").alias("y")), "y", "x").collect()
    assert all(r.hc3_error is None for r in flat)


def test_many_chains_in_a_file(spark, tmp_path):
    """Named chains share a file and go on in another; lines without a name belong to their file's chain."""
    (tmp_path / "a.jsonl").write_text('{"chain": "10", "metrics": {"cut": 1}}\n{"chain": "9", "step": 4, "metrics": {"cut": 2}}\n\n{"chain": "10", "metrics": {"cut": 3}}\n')
    (tmp_path / "b.jsonl").write_text('{"chain": "10", "metrics": {"cut": 5}}\n{"metrics": {"cut": 7}}\n')
    got = {tuple(x) for x in tables.chain_logs(spark, str(tmp_path)).collect()}
    assert got == {(0, 0, "cut", 1.0), (0, 1, "cut", 3.0), (0, 2, "cut", 5.0), (1, 4, "cut", 2.0), (2, 0, "cut", 7.0)}
