"""Errors of linear fits that hold without equal variances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import r6


def hc3(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, its HC3 error and t of y on x: each squared residual is over (1 - leverage) squared.

    Two aggregations, the first of one row; fewer than three rows or a constant x give nulls.
    """
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    fit = d.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count("*")).alias("sxx"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"))
    fit = fit.withColumn("slope", F.when(F.col("n") > 2, F.try_divide("sxy", "sxx")))
    dx = F.col("x") - F.col("mx")
    residual = F.col("y") - F.col("my") - F.col("slope") * dx
    kept = 1 - (1 / F.col("n") + F.try_divide(dx * dx, F.col("sxx")))
    part = F.when(kept > 1e-12, F.try_divide(dx * dx * residual * residual, kept * kept))
    out = d.join(F.broadcast(fit)).groupBy("slope", "sxx", "n").agg(F.sum(part).alias("s"))
    error = F.try_divide(F.sqrt("s"), F.col("sxx"))
    return out.select(r6("slope").alias("slope"), r6(error).alias("hc3_error"), r6(F.try_divide(F.col("slope"), error)).alias("t"), "n")


def variance_inflation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Variance inflation of either of two regressors, 1 / (1 - r^2); null if they are collinear."""
    r2 = F.pow(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(2))
    return df.agg(r2.alias("r2")).select(r6(F.when(F.col("r2") < 1 - 1e-12, F.try_divide(F.lit(1.0), 1 - F.col("r2")))).alias("vif"))
