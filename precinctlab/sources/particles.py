"""Sampler results as JSON lines: a line per particle, then one of metadata with the digest of the lines before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
RECORD, VERSION = "metadata", "1.0"
LINE = "plan array<int>, log_weight double, particle_idx int"
META = "record_type string, base_seed long, n_particles int, k int, smc_version string, ensemble_output_version string, file_sha256 string"


def particle_files(particles: DataFrame, run: str) -> DataFrame:
    """run and value: one run's file as text.

    particles: run, base_seed, particle_idx, plan (array of districts), weight.
    Lines come by particle; a weight of 0 is written as -inf.  A run's lines
    are one row, as its digest wants.
    """
    log_weight = F.when(F.col("weight") > 0, F.format_string("%.6f", F.log("weight"))).otherwise("-inf")
    line = F.concat(F.lit('{"plan":'), F.to_json("plan"), F.lit(',"log_weight":'), log_weight, F.lit(',"particle_idx":'), F.col("particle_idx").cast("string"), F.lit("}\n"))
    rows = particles.select(run, "base_seed", "particle_idx", line.alias("line"), F.array_max("plan").alias("k"))
    whole = rows.groupBy(run).agg(F.first("base_seed").alias("base_seed"), F.count("*").alias("n"), F.max("k").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("particle_idx", "line"))), lambda x: x["line"]), "").alias("lines"))
    meta = F.to_json(F.struct(F.lit(RECORD).alias("record_type"), F.col("base_seed"), F.col("n").cast("int").alias("n_particles"), "k", F.lit(VERSION).alias("smc_version"), F.lit(VERSION).alias("ensemble_output_version"), F.sha2(F.col("lines"), 256).alias("file_sha256")))
    return whole.select(run, F.concat("lines", meta).alias("value"))


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    """file, particles (array), meta, intact: whether the digest is that of the particle lines; a file without metadata has none and is not intact."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\n+$", ""), "\n").alias("lines"))
    last = F.from_json(F.element_at("lines", -1), META)
    is_meta = F.coalesce(last["record_type"] == RECORD, F.lit(False))
    body = F.when(is_meta, F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines"))
    own = F.sha2(F.concat(F.array_join("body", "\n"), F.lit("\n")), 256)
    t = text.select("file", body.alias("body"), F.when(is_meta, last).alias("meta"))
    # -inf is no JSON number; it stands for a weight of 0
    parsed = F.transform("body", lambda x: F.from_json(F.replace(x, F.lit(":-inf,"), F.lit(":null,")), LINE))
    return t.select("file", parsed.alias("particles"), "meta", F.coalesce(F.col("meta.file_sha256") == own, F.lit(False)).alias("intact"))
