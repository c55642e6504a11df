"""Helpers that the training-data operators share.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r; since
``bytes.split()`` splits on exactly these, the Python side works on UTF-8 bytes.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words without building the array: each run of non-space becomes one mark."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001"), SPACE, "")).cast("long")


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches hold no more than ``rows`` rows in this session: texts are long, and an executor buffers whole batches off-heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder.

    Where the session names none, a temporary folder serves a local master, as
    in tests; a cluster without one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/precinctlab-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Writes and checkpoints in here let their shuffle files go as soon as they end; for frames that are run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows as a bucketed Parquet table in the shared folder; the catalog keeps no entry, the folder's owner clears it."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}").bucketBy(n, *keys).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now: the relation stays when its external table's entry goes
    spark.sql(f"DROP TABLE {name}")
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with tidy(df.sparkSession):  # a frame takes the setting when it is made
        return df.select("*").checkpoint(eager=True)


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows, so that only these become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with component = smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star rounds on the edge table; every round
    is checkpointed.  A null end drops the edge; an empty table gives no rows;
    not to settle in ``max_rounds`` is an error.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    nodes_only = edges.where("a = b").select(F.col("a").cast("long").alias("node")).distinct()
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of a node points to the node's smallest neighbour (or itself)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: a node and its smaller neighbours point to the smallest of these
        big = big.where("a <> b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("t")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.union(roots).union(nodes_only.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
