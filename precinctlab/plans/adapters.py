"""Unit, plan, edge and trace tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 7
WIDTH = 30
GROUPS = {"white": "BUILDING", "black": "AUTOMOBILE", "asian": "MACHINERY", "hispanic": "HOUSEHOLD", "other": "FURNITURE"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer: idx, geoid, county, state, place, pop, votes and population groups."""
    q = F.col("l_quantity").cast("long")
    sums = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.sum(q).alias("pop"), *[F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0)).alias(n) for f, n in (("A", "dem"), ("R", "rep"), ("N", "oth"))])
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    u = c.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    geoid = F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    pop = F.coalesce("pop", F.lit(0))
    return u.select(
        F.col("c_custkey").alias("idx"), geoid.alias("geoid"), F.substring(geoid, 1, 5).alias("county"), F.substring(geoid, 1, 2).alias("state"), F.col("n_name").alias("place"),
        pop.alias("pop"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("dem", "rep", "oth")], *[F.when(F.col("c_mktsegment") == s, pop).otherwise(0).alias(g) for g, s in GROUPS.items()])


def plan_a(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """Interleaved plan: geoid, district."""
    return units_only(spark, d).select("geoid", (F.col("idx") % k + 1).cast("int").alias("district"))


def plan_b(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """Plan of consecutive blocks: geoid, district."""
    u = units_only(spark, d)
    n = u.agg(F.count("*").alias("n"))
    return u.join(F.broadcast(n)).select("geoid", F.expr(f"CAST(idx * {k} DIV n + 1 AS INT)").alias("district"))


def units_only(spark: SparkSession, d: str) -> DataFrame:
    """idx and geoid without the sums."""
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("idx"), F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("geoid"))


def links(spark: SparkSession, d: str, width: int = WIDTH) -> DataFrame:
    """Neighbours to the right and below: idx, to (which need not be a unit)."""
    c = units_only(spark, d)
    right = c.where(F.col("idx") % width != width - 1).select("idx", (F.col("idx") + 1).alias("to"))
    return right.union(c.select("idx", (F.col("idx") + width).alias("to")))


def edges(spark: SparkSession, d: str, width: int = WIDTH) -> DataFrame:
    """Lattice of the units: u < v (geoid), weight w."""
    c, e = units_only(spark, d), links(spark, d, width)
    # units of small files have many rows: as a broadcast they would pass whole through the driver
    ends = e.join(c.withColumnRenamed("geoid", "ga").hint("merge"), "idx").join(c.select(F.col("idx").alias("to"), F.col("geoid").alias("gb")).hint("merge"), "to")
    return ends.select(F.least("ga", "gb").alias("u"), F.greatest("ga", "gb").alias("v"), ((F.col("idx") % 5) + 1).cast("double").alias("w"))


def state_graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """((graph, vertex, idx, weight), (graph, u, v, w)): units numbered in their state by geoid, and the lattice inside states.

    Ends are joined by idx: geoids keep six digits of a customer key, so beyond
    a million customers several units share one, and a join by geoid would
    link an edge to all of them, or a unit to itself.
    """
    place = F.row_number().over(Window.partitionBy("state").orderBy("geoid", "idx")) - 1
    v = units(spark, d).select(F.col("state").alias("graph"), place.alias("vertex"), "idx", F.col("pop").alias("weight"))
    end = lambda c, n: v.select(F.col("idx").alias(c), F.col("graph").alias(f"{n}g"), F.col("vertex").alias(n)).hint("merge")
    e = links(spark, d).join(end("idx", "u"), "idx").join(end("to", "v"), "to").where("ug = vg")
    return v, e.select(F.col("ug").alias("graph"), "u", "v", ((F.col("idx") % 5) + 1).cast("double").alias("w"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Chain traces: chain, step (from 1), value."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").cast("long").alias("chain"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), "value")


#: The same tables for DuckDB.
BASE = """
s AS (SELECT o_custkey, CAST(sum(l_quantity) AS BIGINT) AS pop, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS dem,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS rep, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS oth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
unit AS (SELECT c_custkey AS idx, lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS geoid,
  n_name AS place, coalesce(pop, 0) AS pop, coalesce(dem, 0) AS dem, coalesce(rep, 0) AS rep, coalesce(oth, 0) AS oth,
  CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(pop, 0) ELSE 0 END AS white, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN coalesce(pop, 0) ELSE 0 END AS black,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN coalesce(pop, 0) ELSE 0 END AS asian, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN coalesce(pop, 0) ELSE 0 END AS hispanic,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN coalesce(pop, 0) ELSE 0 END AS other
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON c_custkey = o_custkey),
plan_a AS (SELECT geoid, CAST(idx % 7 + 1 AS INTEGER) AS district FROM unit),
plan_b AS (SELECT geoid, CAST(idx * 7 // (SELECT count(*) FROM unit) + 1 AS INTEGER) AS district FROM unit),
link AS (SELECT idx, idx + 1 AS nx FROM unit WHERE idx % 30 <> 29 UNION ALL SELECT idx, idx + 30 FROM unit),
edge AS (SELECT least(a.geoid, b.geoid) AS u, greatest(a.geoid, b.geoid) AS v, CAST(l.idx % 5 + 1 AS DOUBLE) AS w FROM link l JOIN unit a ON a.idx = l.idx JOIN unit b ON b.idx = l.nx),
dist AS (SELECT p.district, CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(dem) AS BIGINT) AS dem, CAST(sum(rep) AS BIGINT) AS rep, CAST(sum(white) AS BIGINT) AS white, CAST(sum(black) AS BIGINT) AS black,
  CAST(sum(asian) AS BIGINT) AS asian, CAST(sum(hispanic) AS BIGINT) AS hispanic, CAST(sum(other) AS BIGINT) AS other, count(*) AS n FROM plan_a p JOIN unit USING (geoid) GROUP BY 1),
axis AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS district),
full_dist AS (SELECT a.district, coalesce(pop, 0) AS pop, coalesce(dem, 0) AS dem, coalesce(rep, 0) AS rep, coalesce(white, 0) AS white, coalesce(black, 0) AS black, coalesce(asian, 0) AS asian,
  coalesce(hispanic, 0) AS hispanic, coalesce(other, 0) AS other FROM axis a LEFT JOIN dist USING (district)),
trace AS (SELECT CAST(user_id AS BIGINT) AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events)
"""
