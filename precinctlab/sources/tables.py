"""Scans of attribute files: typed CSV, share TSV, census geography, chain logs.

A file that breaks its format fails the job with a message (``raise_error``);
missing optional values become the defaults named in each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEMOGRAPHICS = "geoid string, total_pop long, white_non_hispanic long, black_non_hispanic long, asian_non_hispanic long, hispanic long, other long"
ELECTION = "geoid string, dem_votes double, rep_votes double"
PLACES = "geoid string, place_name string, place_pop long"
POPULATION = "geoid string, total long, vap long, cvap long"

#: Positions in the 97 fields of the 2020 redistricting geography header.
GEO_FIELDS = {"sumlev": 2, "logrecno": 7, "geoid": 8, "arealand": 84, "areawatr": 85, "name": 87, "intptlat": 92, "intptlon": 93}


def pad(geoid: Column) -> Column:
    """Unit ids as 11 digits; longer or other strings stay as they are."""
    return F.when(F.length(geoid) < 11, F.lpad(geoid, 11, "0")).otherwise(geoid)


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must name the columns of ``schema`` in order; a value of another type fails the job."""
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return read.withColumn("geoid", pad(F.col("geoid")))


def population_source(table: DataFrame, source: str = "total") -> DataFrame:
    """geoid and the chosen population; an absent column is an error, an absent value 0."""
    if source not in ("total", "vap", "cvap") or source not in table.columns:
        raise ValueError(f"population source {source!r} is not a column of the table")
    return table.select("geoid", F.coalesce(source, F.lit(0)).cast("long").alias("population"))


def minority_fractions(table: DataFrame) -> DataFrame:
    """(total - white) / total within 0..1; no population gives 0."""
    total, white = F.col("total_pop"), F.col("white_non_hispanic")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - white) / total))
    return table.select(pad(F.col("geoid")).alias("geoid"), F.when(total > 0, share).otherwise(0.0).alias("share"))


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and place (a struct that orders the lines of a file) of lines that are not blank."""
    place = F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where(F.trim("value") != "")


def without_headers(lines: DataFrame, data: Column, what: str) -> DataFrame:
    """The lines for which ``data`` holds; of others, only the first of a file, its header, is let through, and any other fails the job."""
    good = F.coalesce(data, F.lit(False))
    # places are compared within one aggregation only: their numbers differ from one use of the scan to another
    files = lines.groupBy("file").agg(F.min(F.when(good, F.col("place"))).alias("first"), F.count_if(~good).alias("n"), F.max_by("value", F.when(~good, F.col("place"))).alias("last"), F.max(F.when(~good, F.col("place"))).alias("odd"))
    broken = files.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("odd") > F.col("first"))))
    fail = broken.select(F.raise_error(F.concat(F.lit(what), F.col("last"))).cast("string").alias("value"))
    return lines.where(good).select("value").unionByName(fail)


def shares_tsv(spark: SparkSession, path: str) -> DataFrame:
    """geoid and share from tab-separated lines; comments, blank lines and a header of any wording are skipped.

    A header is the first other line of a file if its second field is no
    number; any later line without a number there, and a share outside 0..1,
    fail the job.
    """
    number = F.try_element_at(F.split(F.rtrim(F.col("value")), "\t"), F.lit(2)).try_cast("double")
    lines = without_headers(data_lines(spark, path).where(~F.col("value").startswith("#")), number.isNotNull(), "no share: ")
    typed = lines.select(F.split(F.rtrim(F.col("value")), "\t")[0].alias("geoid"), number.alias("x"))
    checked = F.when(F.col("x").between(0, 1), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("share out of range at "), "geoid")).cast("double"))
    return typed.select(pad(F.trim("geoid")).alias("geoid"), checked.alias("share"))


def aligned_shares(units: DataFrame, shares: DataFrame, default: float = 0.5) -> DataFrame:
    """Every unit with its share, or the default where the file has none."""
    return units.select("geoid").join(shares, "geoid", "left").select("geoid", F.coalesce("share", F.lit(default)).alias("share"))


def census_geography(spark: SparkSession, path: str, level: str = "140") -> DataFrame:
    """Rows of one summary level from pipe-delimited geography files: logrecno, geoid, name, areas, internal point.

    Numbers that do not parse become 0.
    """
    at = {n: F.get(F.col("f"), F.lit(i)) for n, i in GEO_FIELDS.items()}
    rows = spark.read.option("encoding", "ISO-8859-1").text(path).select(F.split("value", r"\|", -1).alias("f")).where(at["sumlev"] == level)
    number = lambda n, t: F.coalesce(at[n].try_cast(t), F.lit(0).cast(t)).alias(n)
    return rows.select(at["logrecno"].alias("logrecno"), at["geoid"].alias("geoid"), at["name"].alias("name"), number("arealand", "long"), number("areawatr", "long"), number("intptlat", "double"), number("intptlon", "double"))


def census_population(spark: SparkSession, path: str) -> DataFrame:
    """logrecno and total population: the fifth and sixth of the pipe-delimited fields."""
    f = F.split("value", r"\|", -1)
    return spark.read.text(path).select(F.get(f, F.lit(4)).alias("logrecno"), F.coalesce(F.get(f, F.lit(5)).try_cast("long"), F.lit(0)).alias("population"))


def chain_logs(spark: SparkSession, path: str) -> DataFrame:
    """chain (number from 0, by name), step, metric, value from JSON lines {chain?, step?, metrics}.

    A chain's name is its lines' ``chain``, so that a file may hold many, or
    else the path of its file.  Blank lines are skipped.  Lines without steps
    are numbered from 0 in the order of files and lines.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).where(F.trim("value") != "")
    lines = lines.withColumn("j", F.from_json("value", "chain string, step long, metrics map<string, double>", {"mode": "FAILFAST"})).withColumn("name", F.coalesce("j.chain", "file"))
    chains = lines.select("name").distinct().withColumn("chain", F.row_number().over(Window.orderBy("name")) - 1)
    order = F.row_number().over(Window.partitionBy("name").orderBy("file", "at", "id")) - 1
    parsed = lines.withColumn("step", F.coalesce("j.step", order.cast("long")))
    return parsed.join(chains, "name").select("chain", "step", F.explode("j.metrics").alias("metric", "value"))
