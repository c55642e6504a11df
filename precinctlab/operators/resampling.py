"""Bootstrap intervals: several statistics a draw, clusters by their counts, no row per drawn element.

Draw b takes element number md5(seed:b:j) mod n for each j, so draws don't
depend on partitions and can be recomputed anywhere.  What is drawn from (n
districts, or n clusters reduced to their sums) is one row of arrays beside
every block of draws; draws are spread over tasks by blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import r6
from .partisan import report

BLOCK = 250


def drawn(seed: int, first: int, last: int, n: int) -> np.ndarray:
    """Element numbers of the draws first..last-1, a row each."""
    return np.array([[int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)] for b in range(first, last)], dtype=np.int64).reshape(-1, n)


def resampled(elements: DataFrame, order: str, columns: list[str], statistic: Callable[..., list[np.ndarray]], names: list[str], draws: int, seed: int) -> DataFrame:
    """draw and ``names``: ``statistic(numbers, *columns)`` of every draw, a value each; no element gives no row."""
    one = elements.agg(*[F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).cast("double").alias("_v")))), lambda x: x["_v"]).alias(c) for c in columns]).where(F.size(columns[0]) > 0)
    blocks = elements.sparkSession.range(0, -(-draws // BLOCK), 1, min(64, -(-draws // BLOCK))).withColumnRenamed("id", "block").join(F.broadcast(one))  # one row

    def run(batches):
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                values = [np.array(batch.column(k + 1)[i].as_py(), dtype=float) for k in range(len(columns))]
                first, last = block * BLOCK, min(draws, (block + 1) * BLOCK)
                found = statistic(drawn(seed, first, last, len(values[0])), *values)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, last), pa.int64()), *(pa.array(np.asarray(x, dtype=float)) for x in found)], names=["draw", *names])

    return blocks.mapInArrow(run, "draw long, " + ", ".join(f"{n} double" for n in names))


def intervals(stats: DataFrame, names: list[str], level: float = 0.95) -> DataFrame:
    """name, low, high: by rank without interpolation; draws without a value (NaN) are left out."""
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*").where(~F.isnan("v"))
    s = long.groupBy("name").agg(F.array_sort(F.collect_list("v")).alias("s"))  # as many values as draws
    at = lambda q: F.element_at("s", F.least((F.floor(F.size("s") * F.lit(q)) + 1).cast("int"), F.size("s")))
    return s.select("name", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def partisan_intervals(e: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """metric, low, high of efficiency gap, mean-median and partisan bias over one set of draws of districts."""

    def metrics(i, dem, rep, total, share):
        d, r, t, p = dem[i], rep[i], total[i], share[i]
        won = d > r
        lost = np.where(won, d - t / 2, d).sum(axis=1), np.where(won, r, r - t / 2).sum(axis=1)
        votes = t.sum(axis=1)
        some = np.where(votes > 0, votes, 1)
        gap = np.where(votes > 0, (lost[1] - lost[0]) / some, 0.0)
        swing = 0.5 - d.sum(axis=1) / some
        bias = np.where(votes > 0, 0.5 - (p + swing[:, None] >= 0.5).mean(axis=1), 0.0)
        return [gap, p.mean(axis=1) - np.median(p, axis=1), bias]

    names = ["efficiency_gap", "mean_median", "partisan_bias"]
    return intervals(resampled(e, "district", ["dem", "rep", "total", "dem_pct"], metrics, names, draws, seed), names).withColumnRenamed("name", "metric")


def report_with_intervals(e: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """The partisan report with ci_low and ci_high of each metric, null under the least number of districts."""
    ci = partisan_intervals(e, draws, seed).select("metric", r6("low").alias("ci_low"), r6("high").alias("ci_high"))
    out = report(e).join(F.broadcast(ci), "metric", "left")  # three rows
    return out.withColumns({c: F.when(F.col("ci_available"), F.col(c)) for c in ("ci_low", "ci_high")})


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, x: str, draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """slope, low, high, n_clusters, n: slope of y on x with its interval over draws of whole clusters.

    Each cluster is reduced to five sums once; a draw is a row of counts of
    clusters, and all slopes of a block are one product of counts and sums.
    Rows with a null are left out; a draw of constant x gives no slope, and a
    constant x of all gives nulls; no row gives nulls and 0.
    """
    d = df.select(F.col(cluster).alias("cluster"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sums = d.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    columns = ["n", "sx", "sy", "sxx", "sxy"]

    def slopes(i, *stats):
        counts = np.stack([np.bincount(row, minlength=len(stats[0])) for row in i]) if len(i) else np.zeros((0, len(stats[0])))
        n, sx, sy, sxx, sxy = (counts @ np.stack(stats, axis=1)).T
        spread = n * sxx - sx * sx
        return [np.where(spread > 1e-9 * np.maximum(n * sxx, 1e-300), (n * sxy - sx * sy) / np.where(spread == 0, 1, spread), np.nan)]

    ci = intervals(resampled(sums, "cluster", columns, slopes, ["slope"], draws, seed), ["slope"], level)
    n, sx, sy, sxx, sxy = (F.sum(c) for c in columns)
    whole = sums.agg(r6(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)).alias("slope"), F.count("*").alias("n_clusters"), F.coalesce(n, F.lit(0)).alias("n"))
    return whole.join(F.broadcast(ci.select(r6("low").alias("low"), r6("high").alias("high"))), how="left").select("slope", "low", "high", "n_clusters", "n")
