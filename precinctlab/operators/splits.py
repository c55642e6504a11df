"""Split schedules of seat numbers as recursive queries over a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .allocation import prime_sequence
from .roll_ups import greatest_divisor

#: Up to so many parts a region is cut directly.
DIRECT = 3


def bisection_schedule(seats: DataFrame) -> DataFrame:
    """seats, depth, path, k, k_left, k_right: every halving that a number of seats needs; seats: k (repeated numbers count once).

    The path has 0 for the lesser half and 1 for the other, from the whole.
    A number under 2 needs none.
    """
    return seats.sparkSession.sql(
        """WITH RECURSIVE t(seats, k, depth, path) AS (
          SELECT k, k, 0, '' FROM {seats} UNION ALL
          SELECT seats, x.k, depth + 1, path || x.side FROM (SELECT seats, depth, path, explode(array(struct('0' AS side, k DIV 2 AS k), struct('1' AS side, k - k DIV 2 AS k))) AS x FROM t WHERE k > 1))
        SELECT seats, depth, path, k, k DIV 2 AS k_left, k - k DIV 2 AS k_right FROM t WHERE k > 1""",
        seats=seats.select(F.col("k").cast("long").alias("k")).where("k > 1").distinct(),
    )


def splits_per_depth(seats: DataFrame) -> DataFrame:
    """seats, depth, n_splits of every depth that has one."""
    return bisection_schedule(seats).groupBy("seats", "depth").agg(F.count("*").alias("n_splits"))


def prescriptions(spark: SparkSession, top: int) -> DataFrame:
    """k, kind, parts, sub (array of the parts' seats) for k = 1..top.

    Up to 3 seats are cut directly; a prime is halved; another number is cut
    into its largest prime factor of equal parts, so that numbers with the same
    largest factor share their first cut.
    """
    f = prime_sequence(spark, max(2, top)).select(F.col("n").alias("k"), F.array_max("factors").cast("long").alias("p"))
    k = spark.range(1, top + 1).withColumnRenamed("id", "k").join(f, "k", "left")
    half = F.expr("k DIV 2")
    kind = F.when(F.col("k") <= DIRECT, "direct").when(F.col("p") == F.col("k"), "halves").otherwise("equal")
    k = k.withColumn("kind", kind)
    parts = F.when(F.col("kind") == "direct", F.col("k")).when(F.col("kind") == "halves", 2).otherwise(F.col("p"))
    sub = F.when(F.col("kind") == "direct", F.array_repeat(F.lit(1).cast("long"), F.col("k").cast("int"))).when(F.col("kind") == "halves", F.array(half, F.col("k") - half)).otherwise(F.array_repeat(F.expr("k DIV p"), F.col("p").cast("int")))
    return k.select("k", "kind", parts.cast("long").alias("parts"), sub.alias("sub"))


def cut_depths(spark: SparkSession, top: int) -> DataFrame:
    """k, depth: the longest way from the whole to one seat by ``prescriptions``."""
    p = prescriptions(spark, top).where("k > 1").select("k", F.explode(F.array_distinct("sub")).alias("child"))
    return spark.sql(
        """WITH RECURSIVE t(whole, k, depth) AS (
          SELECT id, id, 0 FROM {numbers} UNION ALL
          SELECT whole, child, depth + 1 FROM t JOIN {cuts} c ON c.k = t.k)
        SELECT whole AS k, max(depth) AS depth FROM t GROUP BY whole""",
        numbers=spark.range(1, top + 1), cuts=p,
    )


def spines(chambers: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, trunk and a spine per chamber: prime factors of the common divisor, then those of what is left.

    Numbers under 1 are an error.
    """
    low = F.least(*names)
    g = F.col(names[0]).cast("long")
    for n in names[1:]:
        g = greatest_divisor(g, F.col(n))
    c = chambers.select(key, *[F.when(low >= 1, F.col(n).cast("long")).otherwise(F.raise_error(F.lit("a chamber has no seat")).cast("long")).alias(n) for n in names]).withColumn("g", g)
    parts = c.select(key, F.explode(F.array(F.struct(F.lit("trunk").alias("part"), F.col("g").alias("n")), *[F.struct(F.lit(n).alias("part"), F.expr(f"`{n}` DIV g").alias("n")) for n in names])).alias("x")).select(key, "x.*")
    top = parts.agg(F.max("n")).first()[0] or 1
    f = prime_sequence(chambers.sparkSession, max(2, top)).select("n", "factors")
    found = parts.join(f, "n", "left").select(key, "part", F.coalesce("factors", F.array().cast("array<bigint>")).alias("f"))
    wide = found.groupBy(key).pivot("part", ["trunk", *names]).agg(F.first("f"))
    return wide.select(key, "trunk", *[F.concat("trunk", n).alias(n) for n in names])
