"""Mixing sources to target weights by weighted fair queueing.

Every pass over a source puts its documents in a seeded shuffled order.  A
document's virtual finish time is its source's cumulative words so far over the
source's target; all documents are range-sorted by it and taken until the total
budget is spent.  A document can be taken once per pass, three passes at most.

Cases: null text has size 0; a null source is a source of its own, ordered
last; repeated rows are copies that queue one by one; sources of size 0 get
target 0; very long texts are whole; equal finish times go by source, pass and key;
an empty table gives an empty result; other columns are left aside.
Bounded work: running sums go through 256 buckets of the shuffle key per
source and pass, so that a hot source spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words_of, parallelism

WEIGHTS = (1, 2, 3)
PASSES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: int = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, each at most ``limit`` times its size.

    Water filling in closed form: in the order of limit * size / weight, a
    source is at its limit if that ratio is no larger than the level that the
    budget left over would give to it and to those after it.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").asc())
    s = s.withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * limit).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_from": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in ``group`` by (bucket, order), with one small total per bucket in between."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    keys = [*group, bucket]
    before = before.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_before")
    joined = df.join(before, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]).drop(*[f"_k_{c}" for c in keys])
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inner)).drop("_before")


def mix(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, seed: int = 7) -> DataFrame:
    """One row per document row: doc_id, copy, source, size, source_size, target, taken, times."""
    sizes = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    sizes = sizes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size")) - 1)
    sizes = cut(sizes)
    targets = source_targets(sizes, weights, passes)
    s = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    s = s.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    s = s.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy", "pass")))
    s = s.withColumn("bucket", F.substring("key", 1, 2))
    s = _running(s, ["source", "pass"], "bucket", ["key", "doc_id", "copy"], "size", "within")
    s = s.withColumn("finish", ((F.col("pass") - 1) * F.col("source_size") + F.col("within")) / F.when(F.col("target") > 0, F.col("target")))
    order = ["finish", "source", "pass", "key", "doc_id", "copy"]
    ranged = cut(s.repartitionByRange(parallelism(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    queue = _running(ranged.where("finish is not null").withColumn("_all", F.lit(1)), ["_all"], "part", order, "size", "spent").drop("_all")
    queue = queue.join(F.broadcast(budget)).withColumn("got", F.col("spent") <= F.col("budget"))
    rest = ranged.where("finish is null").withColumn("got", F.lit(False))
    all_rows = queue.select(*ranged.columns, "got").union(rest.select(*ranged.columns, "got"))
    out = all_rows.groupBy("doc_id", "copy", "source", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("got"), F.col("size")).otherwise(0)).cast("long").alias("taken"), F.count_if("got").cast("int").alias("times"))
    return out.select("doc_id", "copy", "source", F.col("size").cast("long"), "source_size", "target", "taken", "times")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents taken, each as often as the mix takes it, in the columns of ``docs``, which may have any names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), n_words_of(F.col("row.text")).alias("size"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size")) - 1)
    plan = mix(docs, **how).where("times > 0").select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "times")
    out = rows.join(plan, rows["doc_id"].eqNullSafe(plan["d"]) & (rows["copy"] == plan["c"]))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS FIRST, size) - 1 AS copy FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CAST(i % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, cap <= level * weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE max(CASE WHEN NOT capped THEN level END) OVER () * weight END AS target FROM m),
p AS (SELECT c.*, t.source_size, t.target, pass, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy || ':' || pass) AS key
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([1, 2, 3]) AS pass)),
r AS (SELECT *, ((pass - 1) * source_size + sum(size) OVER (PARTITION BY source, pass ORDER BY key, doc_id, copy ROWS UNBOUNDED PRECEDING))
  / CASE WHEN target > 0 THEN target END AS finish FROM p),
q AS (SELECT *, finish IS NOT NULL AND sum(CASE WHEN finish IS NULL THEN 0 ELSE size END) OVER (ORDER BY finish NULLS LAST, source NULLS FIRST, pass, key, doc_id, copy ROWS UNBOUNDED PRECEDING)
  <= (SELECT sum(size) FROM d) AS got FROM r)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN got THEN size ELSE 0 END) AS BIGINT) AS taken FROM q GROUP BY doc_id, copy, source, size, source_size, target
"""
