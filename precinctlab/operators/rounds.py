"""Rounds of a nested division: after round r the districts lie in 2^r regions or fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import lean_band, ratio


def depth_of(k: int) -> int:
    """Rounds that k districts need."""
    return (k - 1).bit_length()


def regions(plan: DataFrame, k: int) -> DataFrame:
    """geoid, district, round (from 1), region (from 0); districts are 1 to k."""
    depth = depth_of(k)
    each = plan.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    return each.withColumn("region", F.expr(f"CAST((district - 1) * shiftleft(1, round) DIV {1 << depth} AS INT)"))


def lineage(found: DataFrame) -> DataFrame:
    """round (from 2), region and the region of the round before that holds its first unit."""
    first = found.groupBy("round", "region").agg(F.min("geoid").alias("geoid"))
    before = found.select((F.col("round") + 1).alias("round"), "geoid", F.col("region").alias("parent"))
    return first.join(before, ["round", "geoid"]).select("round", "region", "parent")


def hierarchy(found: DataFrame, units: DataFrame, k: int, least: int = 6) -> DataFrame:
    """Population of each region against that of its districts' equal shares; the last round is repeated up to round ``least``."""
    depth = depth_of(k)
    total = units.agg(F.sum("pop").alias("total"))
    r = found.join(units.select("geoid", "pop"), "geoid").groupBy("round", "region").agg(F.sum("pop").alias("population"), F.count("*").alias("n_units"), F.count_distinct("district").alias("n_districts"))
    r = r.join(F.broadcast(total))  # one row
    ideal = F.col("total") * F.col("n_districts") / k
    r = r.select("round", (F.col("region") + 1).alias("region_id"), "population", "n_units", "n_districts", F.round(100 * ratio(F.col("population") - ideal, ideal), 3).alias("deviation_from_ideal_pct"))
    rounds = F.when(F.col("round") == depth, F.sequence("round", F.greatest("round", F.lit(least)))).otherwise(F.array("round"))
    return r.withColumn("round", F.explode(rounds))


def political(found: DataFrame, units: DataFrame) -> DataFrame:
    """Votes, two-party percentages, margin in points and lean of each region with units."""
    r = found.join(units.select("geoid", "pop", "dem", "rep"), "geoid").groupBy("round", "region").agg(*[F.sum(c).alias(c) for c in ("pop", "dem", "rep")])
    total = F.col("dem") + F.col("rep")
    dp, rp = 100 * ratio(F.col("dem"), total), 100 * ratio(F.col("rep"), total)
    return r.select("round", (F.col("region") + 1).alias("region"), F.col("pop").alias("population"), "dem", "rep", F.round(dp, 2).alias("dem_pct"), F.round(rp, 2).alias("rep_pct"), F.round(dp - rp, 2).alias("margin"), lean_band(dp - rp).alias("lean"))
