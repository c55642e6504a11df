"""Plan exchange: assignments as JSON maps, feature collections, CSV of either column order, and partition lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import data_lines, pad, without_headers


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file and content of whole JSON files; one file is one plan."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def assignment_map(docs: DataFrame, field: str | None = None) -> DataFrame:
    """file, key, district from a JSON map of unit to district; ``field`` names the member that holds it ("assignment" in chain exports)."""
    parsed = F.from_json("content", "map<string, int>") if field is None else F.from_json("content", f"`{field}` map<string, int>")[field]
    return docs.select("file", F.explode(parsed).alias("key", "district"))


def keyed_by_geoid(assignments: DataFrame, index: DataFrame) -> DataFrame:
    """geoid, district for maps keyed by position or by id; ``index`` has idx and geoid. Keys of 11 digits are ids."""
    by_id = assignments.where("length(key) = 11").select(F.col("key").alias("geoid"), "district")
    by_place = assignments.where("length(key) < 11").join(index, F.col("key").try_cast("long") == F.col("idx")).select("geoid", "district")
    return by_id.union(by_place)


def feature_properties(docs: DataFrame) -> DataFrame:
    """geoid, district from features that carry their assignment as properties (GEOID or geoid, district or district_id)."""
    f = docs.select(F.explode(F.from_json("content", "features array<struct<properties map<string, string>>>")["features"]).alias("f")).select("f.properties")
    one = lambda *names: F.coalesce(*[F.col("properties")[n] for n in names])
    return f.select(pad(one("GEOID", "geoid")).alias("geoid"), one("district", "district_id").try_cast("int").alias("district")).where("geoid is not null and district is not null")


def two_column_csv(spark: SparkSession, path: str) -> DataFrame:
    """geoid, district from a CSV of these two columns in either order, header or not.

    In each row the longer run of digits is the unit.  The first row of a file
    may be a header, without a number; any other row without two is an error.
    """
    f = F.transform(F.split("value", ","), lambda x: F.regexp_replace(F.trim(x), '"', ""))
    number = lambda i: F.coalesce(F.get(f, F.lit(i)).rlike("^[0-9]+$"), F.lit(False))
    lines = without_headers(data_lines(spark, path), number(0) | number(1), "no unit and district: ")
    a = F.when(number(0) & number(1), F.get(f, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no unit and district: "), F.col("value"))))
    rows = lines.select(a.alias("a"), F.get(f, F.lit(1)).alias("b"))
    first = F.length("a") >= F.length("b")
    return rows.select(pad(F.when(first, F.col("a")).otherwise(F.col("b"))).alias("geoid"), F.when(first, F.col("b")).otherwise(F.col("a")).cast("int").alias("district"))


def chain_export(plan: DataFrame, *by: str) -> DataFrame:
    """One JSON document {"assignment": {geoid: district}} for each plan (one row per value of ``by``)."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("geoid", "district"))))
    return plan.groupBy(*by).agg(F.to_json(F.struct(pairs.alias("assignment"))).alias("value"))


def feature_export(plan: DataFrame, *by: str) -> DataFrame:
    """One feature collection for each plan; features without geometry carry geoid and district."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("geoid").alias("GEOID"), "district").alias("properties"))
    return plan.groupBy(*by).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(feature)).alias("features"))).alias("value"))


def district_placeholders(plan: DataFrame) -> DataFrame:
    """One feature line per district: null geometry and the number of units."""
    n = plan.groupBy("district").agg(F.count("*").alias("tract_count"))
    return n.select("district", F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("geometry"), F.struct("district", "tract_count").alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def units_csv(plan: DataFrame, path: str) -> None:
    """Sorted CSV of geoid and district; part files in order of geoid."""
    plan.select("geoid", "district").orderBy("geoid").write.option("header", True).csv(path)


def shares_export(shares: DataFrame, path: str, provenance: str) -> None:
    """Tab-separated share lines with six decimals, each part under its comment line."""
    head = shares.sparkSession.createDataFrame([(f"# {provenance}",), ("geoid\tdem_share",)], "value string")
    head.union(shares.select(F.format_string("%s\t%.6f", "geoid", "share").alias("value"))).write.text(path)


def partition_list(docs: DataFrame, expected: int) -> DataFrame:
    """vertex (from 0) and part of a partition file with one part number per line; another number of lines fails."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
    checked = F.when(F.size(lines) == expected, lines).otherwise(F.raise_error(F.lit(f"expected {expected} lines")).cast("array<string>"))
    return docs.select("file", F.posexplode(checked).alias("vertex", "part")).select("file", "vertex", F.trim("part").cast("int").alias("part"))
