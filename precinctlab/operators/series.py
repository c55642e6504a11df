"""Ordered series, sampling diagnostics and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributes import r6
from .roll_ups import running


def trimmed(traces: DataFrame) -> DataFrame:
    """Every chain cut to the shortest one's length."""
    n = traces.groupBy("chain").agg(F.max("step").alias("n")).agg(F.min("n").alias("least"))
    return traces.join(F.broadcast(n)).where("step <= least").drop("least")


def r_hat(traces: DataFrame, threshold: float = 1.05) -> DataFrame:
    """Potential scale reduction of equally long chains; 1 if no chain varies; under four chains is an error."""
    c = traces.groupBy("chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    s = c.agg(F.count("*").alias("n_chains"), F.max("n").alias("n_per_chain"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    s = s.withColumn("_ok", F.assert_true(F.col("n_chains") >= 4, F.lit("at least four chains are needed")))
    n = F.col("n_per_chain")
    value = F.when(F.col("w") == 0, 1.0).otherwise(F.sqrt(((n - 1) / n * F.col("w") + F.col("b")) / F.col("w")))
    return s.where("_ok is null").select("n_chains", "n_per_chain", r6(value).alias("r_hat"), (value >= threshold).alias("above_threshold"))


def autocorrelation(traces: DataFrame, max_lag: int) -> DataFrame:
    """Mean over chains of the lagged autocorrelation."""
    w = Window.partitionBy("chain")
    c = traces.withColumn("x", F.col("value") - F.avg("value").over(w)).select("chain", "step", "x")
    later = c.select("chain", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), F.col("step"), F.col("x").alias("y")).withColumn("step", F.col("step") - F.col("lag"))
    p = c.join(later, ["chain", "step"]).groupBy("chain", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    z = c.groupBy("chain").agg(F.sum(F.col("x") * F.col("x")).alias("z"))
    return p.join(F.broadcast(z), "chain").where("z > 0").groupBy("lag").agg(r6(F.avg(F.col("p") / F.col("z"))).alias("rho"))


def ess(traces: DataFrame) -> DataFrame:
    """Effective sample size per chain by initial monotone pairs of autocorrelations, greatest lag n / 4."""
    import pandas as pd

    def one(key, pdf):
        x = pdf.sort_values("step")["value"].to_numpy(float)
        n = len(x)
        c = x - x.mean() if n else x
        var = float(c @ c)
        if n < 4 or var == 0:
            return pd.DataFrame({"chain": [key[0]], "ess": [float(n)], "n": [n]})
        total, last, k = 0.0, float("inf"), 0
        rho = lambda lag: float(c[: n - lag] @ c[lag:]) / var
        while 2 * k + 2 <= max(n // 4, 2):
            pair = min(rho(2 * k + 1) + rho(2 * k + 2), last)
            if pair <= 0:
                break
            total, last, k = total + pair, pair, k + 1
        return pd.DataFrame({"chain": [key[0]], "ess": [min(n, n / (1 + 2 * total))], "n": [n]})

    return traces.groupBy("chain").applyInPandas(one, "chain long, ess double, n long")


def percentile_rank(traces: DataFrame, at: float) -> DataFrame:
    return traces.agg(r6(F.avg(F.when(F.col("value") <= at, 1.0).otherwise(0.0))).alias("percentile_rank"))


def percentile_plan(traces: DataFrame, p: float) -> DataFrame:
    """The step of each chain at a percentile of value, lower rank, ties by step."""
    w = Window.partitionBy("chain").orderBy("value", "step")
    r = traces.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("chain")))
    return r.where(F.col("r") == F.floor((F.col("n") - 1) * p)).select("chain", F.col("step").cast("long").alias("step"), r6("value").alias("value"))


def hamming_by_lag(labels: DataFrame, max_lag: int) -> DataFrame:
    """Mean part of units whose label differs from ``lag`` steps on; labels: chain, unit, step, label."""
    later = labels.select("chain", "unit", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "step", F.col("label").alias("then")).withColumn("step", F.col("step") - F.col("lag"))
    return labels.join(later, ["chain", "unit", "step"]).groupBy("lag").agg(r6(F.avg(F.when(F.col("label") != F.col("then"), 1.0).otherwise(0.0))).alias("hamming"))


def cumulative_weights(weights: DataFrame) -> DataFrame:
    """Normalised running sum by id: id, weight."""
    total = weights.agg(F.sum("weight").alias("_t"))
    return running(weights, ["id"], {"_run": F.col("weight")}).join(F.broadcast(total)).select("id", r6(F.col("_run") / F.col("_t")).alias("cumulative"))


def lorenz(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Running shares of x and y by density x / y."""
    total = rows.agg(F.sum(x).alias("_x"), F.sum(y).alias("_y"))
    sums = running(rows.withColumn("_d", F.col(x) / F.col(y)), ["_d", key], {"_rx": F.col(x), "_ry": F.col(y)})
    return sums.join(F.broadcast(total)).select(key, r6(F.col("_rx") / F.col("_x")).alias("x_share"), r6(F.col("_ry") / F.col("_y")).alias("y_share"))


def trend(rows: DataFrame, y: str, x: str) -> DataFrame:
    y, x = F.col(y), F.col(x)
    return rows.agg(r6(F.regr_slope(y, x)).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


def correlation(rows: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    return rows.agg(F.when(F.count("*") >= least, r6(F.corr(a, b))).alias("r"), F.count("*").alias("n"))


def wls(rows: DataFrame, y: str, x: str, w: str) -> DataFrame:
    """Weighted line through the normal equations."""
    y, x, w = (F.col(c).cast("double") for c in (y, x, w))
    s = rows.agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    slope = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select(r6(slope).alias("slope"), r6((F.col("sy") - slope * F.col("sx")) / F.col("s")).alias("intercept"))


def holm(tests: DataFrame) -> DataFrame:
    """Holm-adjusted p-values; tests: name, p."""
    n = F.count("*").over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy("p", "name"))
    t = tests.withColumn("r", r).withColumn("m", F.least(F.lit(1.0), (n - F.col("r") + 1) * F.col("p")))
    return t.select("name", r6(F.max("m").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))).alias("p_adjusted"))


def national_rank(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Ranks in the group and among all, greatest first; equal values share a rank, and null values come last."""
    counted = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(-F.col("_v"), F.lit(float("inf"))))
    overall = running(counted, ["_o"], {"_upto": F.col("_n")}).select("_v", (F.col("_upto") - F.col("_n") + 1).cast("int").alias("rank_overall"))
    inside = F.rank().over(Window.partitionBy(group).orderBy(F.desc(value))).alias("rank_in_group")
    return rows.select(group, key, inside, F.col(value).alias("_w")).join(overall, F.col("_w").eqNullSafe(F.col("_v"))).select(group, key, "rank_in_group", "rank_overall")


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8, for x > 0."""
    z, shift = x + 8, sum(F.log(x + i) for i in range(8))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7))) - shift


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """Regularised incomplete beta function by its continued fraction, in the half where that converges fast.

    ``steps`` terms are enough for parameters up to some 20,000.
    """

    def fraction(a, b, x):
        tiny = F.lit(1e-300)
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

        def step(s, i):
            m = F.floor(i / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            n = F.when(i % 2 == 0, even).otherwise(odd)
            d, c = 1 / safe(1 + n * s["d"]), safe(1 + n / s["c"])
            return state(c, d, s["h"] * c * d)

        # term 1 is the odd one with m = 0
        d0 = 1 / safe(1 - (a + b) * x / (a + 1))
        return F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), state(F.lit(1.0), d0, d0), step)["h"]

    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * fraction(a, b, x) / a
    high = 1 - front * fraction(b, a, 1 - x) / b
    inside = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t; null without r and under 3 pairs."""
    df = (n - 2).cast("double")
    return F.when((n > 2) & r.isNotNull(), incomplete_beta(df / 2, F.lit(0.5), F.greatest(1 - r * r, F.lit(0.0))))


def sorting_index(df: DataFrame, by: str, a: str, b: str, least: int = 10) -> DataFrame:
    """by, r, p, n: correlation in each group with its p-value; null under ``least`` pairs or without variance."""
    c = df.select(by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(subset=["a", "b"])
    r = F.try_divide(F.covar_pop("a", "b"), F.sqrt(F.var_pop("a") * F.var_pop("b")))  # corr itself fails without variance
    g = c.groupBy(by).agg(r.alias("r"), F.count("*").alias("n"))
    g = g.withColumn("r", F.when((F.col("n") >= least) & F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))))
    g = g.withColumn("p", correlation_p(F.col("r"), F.col("n")))  # before r is rounded under its own name
    return g.select(by, r6("r").alias("r"), r6("p").alias("p"), "n")
