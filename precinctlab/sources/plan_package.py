"""Plan packages: one JSON file per plan with version, metadata, assignments and optional shapes, and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's version and names.
VERSION = "0.1"
TEXTS = ("label", "state_fips", "state_code", "year", "chamber", "population_source", "created_at", "created_by")
METADATA = ", ".join([*(f"{t}: string" for t in TEXTS), "num_districts: int", "balance_tolerance_pct: double", "seed: bigint", "notes: string"])
PACKAGE = f"struct<rplan_version: string, metadata: struct<{METADATA}>, assignments: map<string, int>, geometry: string>"
SHAPES = "FeatureCollection"


def packages(plans: DataFrame, metadata: DataFrame, key: str, version: str = VERSION) -> DataFrame:
    """key and value, the text of each plan's file.

    plans: key, geoid, district; metadata: key, any of the format's metadata
    columns, and optionally ``geometry``, a text of features.  A null value is
    left out of the file; texts that the format requires are empty instead.
    """
    named = [f.name for f in metadata.schema if f.name in METADATA.replace(":", "").replace(",", "").split()]
    meta = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in TEXTS else F.col(c) for c in named])
    shapes = F.col("geometry") if "geometry" in metadata.columns else F.lit(None).cast("string")
    units = plans.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("geoid", F.col("district").cast("int").alias("district"))))).alias("assignments"))
    body = F.to_json(F.struct(F.lit(version).alias("rplan_version"), meta.alias("metadata"), F.coalesce("assignments", F.create_map().cast("map<string,int>")).alias("assignments")))
    # the shapes are JSON already
    whole = F.when(shapes.isNull(), body).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"geometry":'), shapes, F.lit("}")))
    return metadata.join(units, key, "left").select(key, whole.alias("value"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """file and package (version, metadata, assignments, geometry) of whole files; a text that is no such package is an error."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.from_json("value", PACKAGE, {"mode": "FAILFAST"}).alias("package"))


def assignments(read: DataFrame) -> DataFrame:
    """file, label, geoid, district."""
    return read.select("file", F.col("package.metadata.label").alias("label"), F.explode("package.assignments").alias("geoid", "district"))


def findings(read: DataFrame) -> DataFrame:
    """file, severity (fatal, error or warning), rule, n: what each package breaks.

    A version that is no ``major.minor`` is an error, another major version
    fatal, a higher minor one a warning; required metadata must be there;
    units have 11 digits and districts lie in 1..num_districts (n counts those
    that don't); a highest district under num_districts and districts without
    units (n counts them) are warnings; shapes must be a feature collection.
    """
    p, m = F.col("package"), F.col("package.metadata")
    parts = F.split(p["rplan_version"], r"\.", 2)
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(1 << 32))
    whole = F.size(parts) == 2
    k = F.coalesce(m["num_districts"], F.lit(0))
    keys, values = F.coalesce(F.map_keys(p["assignments"]), F.array().cast("array<string>")), F.coalesce(F.map_values(p["assignments"]), F.array().cast("array<int>"))
    bad_units = F.size(F.filter(keys, lambda g: ~g.rlike("^[0-9]{11}$")))
    bad_districts = F.size(F.filter(values, lambda d: (d < 1) | (d > k)))
    top = F.coalesce(F.array_max(values), F.lit(0))
    some = (k > 0) & (F.size(values) > 0)
    unused = k - F.size(F.array_distinct(F.filter(values, lambda d: d.between(1, k))))
    kind = F.get_json_object(p["geometry"], "$.type")

    def rule(severity: str, name: str, broken: Column, n: Column | int = 1) -> Column:
        n = n if isinstance(n, Column) else F.lit(n)
        return F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), n.cast("long").alias("n")))

    rules = [
        rule("error", "version is major.minor", F.coalesce(~whole, F.lit(True))), rule("fatal", "major version is 0", whole & (number(0) != 0)), rule("warning", "minor version is known", whole & (number(0) == 0) & (number(1) > 1)),
        *[rule("error", f"{t} is given", F.coalesce(m[t], F.lit("")) == "") for t in TEXTS], rule("error", "num_districts is positive", k <= 0),
        rule("error", "units have 11 digits", bad_units > 0, bad_units), rule("error", "districts are in range", (k > 0) & (bad_districts > 0), bad_districts),
        rule("error", "num_districts is not exceeded", some & (top > k)), rule("warning", "num_districts is reached", some & (top < k)), rule("warning", "districts have units", some & (unused > 0), unused),
        rule("error", "geometry is a feature collection", p["geometry"].isNotNull() & (F.coalesce(kind, F.lit("")) != SHAPES)),
    ]
    return read.select("file", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("file", "x.*")


def verdicts(read: DataFrame) -> DataFrame:
    """file, valid, n_errors, n_warnings: a package is valid without errors and fatal findings."""
    f = findings(read).groupBy("file").agg(F.count_if(F.col("severity") != "warning").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    zero = F.lit(0).cast("long")
    return read.select("file").join(f, "file", "left").select("file", (F.coalesce("e", zero) == 0).alias("valid"), F.coalesce("e", zero).alias("n_errors"), F.coalesce("w", zero).alias("n_warnings"))
