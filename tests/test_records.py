"""Small files for the scans of records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from precinctlab.sources import records

HEAD = ",".join(records.ANNOTATION)


def row(name="Ann", race="Black", curator="C1", truth="yes", doc="x.jpeg", form="jpg"):
    return f"{name},DEM,{race},{curator},phd,2026-01-01,survey,{truth},docs/{doc},{form}"


def written(tmp_path, *rows):
    root = tmp_path / "root"
    docs = root / "docs"
    docs.mkdir(parents=True)
    (root / "x.jpeg").write_bytes(b"same name, other folder")
    (docs / "x.jpeg").write_bytes(b"paper")
    (docs / "x.pdf").write_bytes(b"other")
    path = tmp_path / "c.csv"
    path.write_text("\n".join([HEAD, *rows]) + "\n")
    return str(path), str(root)


def test_annotations_and_disputes(spark, tmp_path):
    path, docs = written(tmp_path, row(), row(curator="C2", race="white", truth="0"), row(curator="C2"), row("Bo"))
    found = records.candidate_annotations(spark, path, docs)
    got = found.collect()
    assert len(got) == 4 and {x.attestation_doc_sha256 for x in got} == {hashlib.sha256(b"paper").hexdigest()}
    assert sorted(x.independently_verified for x in got) == [False, True, True, True]
    assert {x.attestation_doc_format for x in got} == {"jpg"}
    (d,) = records.disputed_candidates(found).collect()
    assert (d.candidate_name, d.n_curators, d.curators, d.n_races) == ("Ann", 2, "C1,C2", 2)


@pytest.mark.parametrize("bad", [{"name": ""}, {"race": "black"}, {"truth": "maybe"}, {"form": "rtf"}, {"form": "pdf"}, {"doc": "y.jpeg"}])
def test_annotations_that_fail(spark, tmp_path, bad):
    path, docs = written(tmp_path, row(**bad))
    with pytest.raises(Exception):
        records.candidate_annotations(spark, path, docs).collect()


def test_missing_column(spark, tmp_path):
    (tmp_path / "c.csv").write_text("candidate_name,party\nA,B\n")
    with pytest.raises(ValueError, match="race"):
        records.candidate_annotations(spark, str(tmp_path / "c.csv"), str(tmp_path))


def test_analysis_shapes(spark):
    texts = {
        '{"districts": [{"dem_share": 0.55}, {"x": 1}, {"dem_share": null}]}': [0.55],
        '{"per_district_dem_share": [0.4, 0.6]}': [0.4, 0.6],
        '[{"dem_share": 0.1}]': [0.1],
        '{"districts": {"a": 1}, "per_district_dem_share": [0.3]}': [0.3],
        "{}": [],
        "not json": [],
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", records.analysis_shares(F.col("t")).alias("v")).collect()
    assert {x.t: x.v for x in got} == texts
    means = {'{"mean_polsby_popper": 0.42}': 0.42, '{"districts": [{"polsby_popper": 0.2}, {}, {"polsby_popper": 0.4}]}': 0.3, '{"districts": []}': None, "": None}
    got = spark.createDataFrame([(t,) for t in means], "t string").select("t", records.analysis_compactness(F.col("t")).alias("m")).collect()
    assert {x.t: x.m and round(x.m, 9) for x in got} == means
