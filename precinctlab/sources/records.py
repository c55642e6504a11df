"""Scans of older census layouts, candidate annotations and analysis files of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start (from 0) and end of the fields of the fixed-width geography files.
LAYOUTS = {
    2010: {"sumlev": (8, 11), "logrecno": (18, 25), "state": (27, 29), "county": (29, 32), "tract": (54, 60), "arealand": (205, 214), "areawatr": (214, 223), "name": (228, 318), "intptlat": (336, 347), "intptlon": (347, 359)},
    2000: {"sumlev": (8, 16), "logrecno": (18, 25), "state": (29, 31), "county": (31, 34), "tract": (55, 61), "arealand": (170, 180), "areawatr": (184, 194), "name": (200, 290), "population": (292, 297), "intptlat": (310, 319), "intptlon": (319, 331)},
}
#: The summary level of tracts.
LEVELS = {2010: "140", 2000: "14000000"}

#: Columns, races, words of truth and document formats of candidate annotations.
ANNOTATION = ["candidate_name", "party", "race", "curator", "curator_credentials", "curator_attestation_date", "source", "independently_verified", "attestation_doc_path", "attestation_doc_format"]
RACES = ["Black", "white", "Hispanic", "Asian", "Native", "other"]
TRUE, FALSE = ["true", "True", "TRUE", "1", "yes"], ["false", "False", "FALSE", "0", "no"]
FORMATS = {"pdf": "pdf", "docx": "docx", "md": "md", "txt": "txt", "png": "png", "jpg": "jpg", "jpeg": "jpg", "tif": "tiff", "tiff": "tiff"}


def fixed_geography(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Tracts of a fixed-width geography file: logrecno, geoid, name, areas, internal point and, in 2000, population.

    Blank numbers are 0; others that do not parse fail the job.
    """
    at = {n: F.trim(F.substring("value", a + 1, z - a)) for n, (a, z) in LAYOUTS[year].items()}
    rows = spark.read.option("encoding", "ISO-8859-1").text(path).where(at["sumlev"] == LEVELS[year])
    number = lambda n, t: F.when(at[n] == "", F.lit(0).cast(t)).otherwise(at[n].cast(t)).alias(n)
    more = [number("population", "long")] if "population" in at else []
    return rows.select(at["logrecno"].alias("logrecno"), F.concat(at["state"], at["county"], at["tract"]).alias("geoid"), at["name"].alias("name"), number("arealand", "long"), number("areawatr", "long"), number("intptlat", "double"), number("intptlon", "double"), *more)


def comma_population(spark: SparkSession, path: str) -> DataFrame:
    """logrecno and population of the comma-separated files of 2010: the fifth and sixth field."""
    f = F.split("value", ",", -1)
    return spark.read.option("encoding", "ISO-8859-1").text(path).select(F.trim(F.get(f, F.lit(4))).alias("logrecno"), F.get(f, F.lit(5)).cast("long").alias("population"))


def _need(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value.cast("string"), F.lit("")))).cast("string"))


def _format(extension: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, means in FORMATS.items():
        out = F.when(F.lower(extension) == name, means).otherwise(out)
    return out


def candidate_annotations(spark: SparkSession, path: str, documents: str) -> DataFrame:
    """Annotations with the digest of each attestation document, which has its path below ``documents``.

    A missing column is an error; an empty field, a race, truth word or format not listed, a format unlike the path's
    extension and a document that is not there fail the job.
    """
    t = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if lost := [c for c in ANNOTATION if c not in t.columns]:
        raise ValueError(f"columns missing: {', '.join(lost)}")
    t = t.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ANNOTATION])
    t = t.select(*[_need(F.col(c) != "", F.col(c), f"empty {c}").alias(c) for c in ANNOTATION])
    stated, seen = _format(F.col("attestation_doc_format")), _format(F.regexp_extract("attestation_doc_path", r"\.([^./]+)$", 1))
    t = t.withColumn("race", _need(F.col("race").isin(RACES), F.col("race"), "race")).withColumn("attestation_doc_format", _need(F.coalesce(stated == seen, F.lit(False)), stated, "document format"))
    word = F.col("independently_verified")
    t = t.withColumn("independently_verified", _need(word.isin(TRUE + FALSE), word, "truth word").isin(TRUE))
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(documents)
    root = f"{documents.rstrip('/')}/"
    found = base.select(F.substr("path", F.instr("path", root) + F.lit(len(root))).alias("attestation_doc_path"), F.sha2("content", 256).alias("digest"))
    t = t.join(found, "attestation_doc_path", "left")
    return t.select(*ANNOTATION, _need(F.col("digest").isNotNull(), F.col("digest"), "document missing").alias("attestation_doc_sha256"))


def disputed_candidates(annotations: DataFrame) -> DataFrame:
    """Candidates of a party that several curators annotate: their number and names, and the number of different races."""
    c = annotations.groupBy("candidate_name", "party").agg(F.array_sort(F.collect_set("curator")).alias("curators"), F.count_distinct("race").alias("n_races"))
    return c.where(F.size("curators") > 1).select("candidate_name", "party", F.size("curators").alias("n_curators"), F.array_join("curators", ",").alias("curators"), "n_races")


def analysis_shares(text: Column) -> Column:
    """Shares of an analysis file: of ``districts``, else of ``per_district_dem_share``, else of the file itself as a list.  Entries without a number are left out; no list gives an empty one."""
    rows = lambda x: F.transform(F.from_json(x, "array<struct<dem_share: double>>"), lambda r: r["dem_share"])
    of = lambda name: F.get_json_object(text, f"$.{name}")
    found = F.when(of("districts").startswith("["), rows(of("districts")))
    found = found.when(of("per_district_dem_share").startswith("["), F.from_json(of("per_district_dem_share"), "array<double>")).when(F.ltrim(text).startswith("["), rows(text))
    return F.filter(F.coalesce(found, F.array().cast("array<double>")), lambda x: x.isNotNull())


def analysis_compactness(text: Column) -> Column:
    """Mean Polsby-Popper score: ``mean_polsby_popper``, else the mean over ``districts``, else null."""
    rows = F.from_json(F.get_json_object(text, "$.districts"), "array<struct<polsby_popper: double>>")
    known = F.filter(F.transform(rows, lambda r: r["polsby_popper"]), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))
    return F.coalesce(F.get_json_object(text, "$.mean_polsby_popper").try_cast("double"), mean)
