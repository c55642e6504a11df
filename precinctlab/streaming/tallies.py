"""Vote and trace streams as Structured Streaming aggregations.

A query runs over all files present (``availableNow``) and its state is bounded
by the watermark; checkpoints and results lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch


def stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """New files at ``path``, a table that is one file or a folder (the last letter as a class makes the path a pattern, which may name files)."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def window_tallies(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, party, votes, total by tumbling window; rows later than the watermark are dropped by the engine.

    Clock times without zone count as UTC, whatever the session's zone.
    """
    seen = events.withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("party")).agg(F.count("*").alias("votes"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "party", "votes", "total")


def chain_moments(traces: DataFrame) -> DataFrame:
    """Length, mean and variance so far of each chain, the inputs of a running R-hat."""
    return traces.groupBy(F.col("user_id").cast("long").alias("chain")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def settle(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming result over all that is there and read what it wrote.

    Each batch overwrites the table of a complete result by one Spark job; the
    rows never pass through the driver.
    """
    spark = result.sparkSession
    base = scratch(spark, "stream")
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
