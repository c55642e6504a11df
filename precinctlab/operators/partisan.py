"""Partisan metrics over districts (district, dem, rep, total, dem_pct)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import r6


def efficiency_gap(e: DataFrame, legacy_sign: bool = False) -> DataFrame:
    """(wasted second party - wasted first party) / votes; ``legacy_sign`` turns it round."""
    half = F.col("total") / 2
    won = F.col("dem") > F.col("rep")
    wd, wr = F.when(won, F.col("dem") - half).otherwise(F.col("dem")), F.when(won, F.col("rep")).otherwise(F.col("rep") - half)
    gap = F.coalesce((F.sum(wr) - F.sum(wd)) / F.nullif(F.sum("total"), F.lit(0)), F.lit(0.0))
    return e.agg(r6(-gap if legacy_sign else gap).alias("efficiency_gap"))


def mean_median(e: DataFrame) -> DataFrame:
    return e.agg(r6(F.avg("dem_pct") - F.percentile("dem_pct", F.lit(0.5))).alias("mean_median"))


def statewide(e: DataFrame) -> DataFrame:
    return e.agg(r6(F.sum("dem") / F.sum("total")).alias("dem_vote_share"), r6(F.count_if(F.col("dem") > F.col("rep")) / F.count("*")).alias("dem_seat_share"))


def bias_uniform_swing(e: DataFrame) -> DataFrame:
    """0.5 less the seat share when all districts swing to an even vote."""
    swing = e.agg((0.5 - F.sum("dem") / F.sum("total")).alias("swing"))
    return e.join(F.broadcast(swing)).agg(r6(0.5 - F.avg(F.when(F.col("dem_pct") + F.col("swing") >= 0.5, 1.0).otherwise(0.0))).alias("partisan_bias"))


def bias_simple(e: DataFrame) -> DataFrame:
    return e.agg(r6(F.count_if(F.col("dem_pct") > 0.5) / F.count("*") - F.sum("dem") / F.sum("total")).alias("simple_bias"))


def seats_votes(e: DataFrame, reach: int = 10) -> DataFrame:
    """Seats of the first party at uniform swings of -reach..reach points."""
    swings = e.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("swing_points"))
    total = e.agg((F.sum("dem") / F.sum("total")).alias("share"))
    grid = e.crossJoin(F.broadcast(swings))  # districts times a fixed number of swings
    out = grid.groupBy("swing_points").agg(F.count_if(F.col("dem_pct") + F.col("swing_points") / 100 >= 0.5).alias("seats"))
    return out.join(F.broadcast(total)).select("swing_points", r6(F.col("share") + F.col("swing_points") / 100).alias("vote_share"), "seats")


def proportionality(e: DataFrame) -> DataFrame:
    """Vote and seat shares; a district without votes goes to the second party, one at half to the first."""
    share = F.when(F.col("total") > 0, F.col("dem") / F.col("total")).otherwise(0.0)
    s = e.withColumn("share", share)
    out = s.agg(F.sum("dem").alias("d"), F.sum("total").alias("t"), F.count_if(F.col("share") >= 0.5).alias("dem_seats"), F.count("*").alias("n"),
                F.count_if((F.col("dem") == 0) | (F.col("rep") == 0)).alias("n_uncontested"))
    votes, seats = F.col("d") / F.col("t"), F.col("dem_seats") / F.col("n")
    return out.select(r6(votes).alias("dem_vote_share"), "dem_seats", (F.col("n") - F.col("dem_seats")).alias("rep_seats"), r6(seats).alias("dem_seat_share"), "n_uncontested", r6(100 * (seats - votes)).alias("gap_pp"), (F.col("t") > 0).alias("available"))


def competitive(e: DataFrame, below: float = 0.05) -> DataFrame:
    margin = F.abs(F.col("dem") - F.col("rep")) / F.greatest("total", F.lit(1))
    return e.agg(F.count_if(margin < below).alias("n_competitive"), F.count("*").alias("n_districts"))


def bias_cubic(e: DataFrame) -> DataFrame:
    """cubic_bias, r_squared: least-squares cubic of the seat won (0 or 1) on the vote share, read at 50 %.

    Polynomials orthogonal on the shares are built one degree at a time, each
    from sums over the districts.  Districts without votes are left out; under
    three districts the bias is the seat share less 0.5.
    """
    won = F.when(F.col("dem") > F.col("rep"), 1.0).otherwise(0.0)
    seats = e.agg(F.avg(won).alias("seats"), F.count_if(F.col("total") > 0).alias("n"))
    p = e.where("total > 0").select((F.col("dem") / F.col("total") - 0.5).alias("x"), won.alias("y"), F.lit(0.0).alias("p0"), F.lit(1.0).alias("p1"), F.lit(0.0).alias("fit"), F.lit(0.0).alias("at0"), F.lit(1.0).alias("at1"), F.lit(0.0).alias("bias"), F.lit(1.0).alias("before"))
    for degree in range(4):
        sums = p.agg(F.sum(F.col("p1") * F.col("p1")).alias("pp"), F.sum(F.col("x") * F.col("p1") * F.col("p1")).alias("xpp"), F.sum(F.col("y") * F.col("p1")).alias("yp"))
        p = p.join(F.broadcast(sums))
        some = F.col("pp") > 1e-30
        c = F.when(some, F.col("yp") / F.col("pp")).otherwise(0.0)
        shift, back = F.when(some, F.col("xpp") / F.col("pp")).otherwise(0.0), F.col("pp") / F.col("before") if degree else F.lit(0.0)
        p = p.select("x", "y", F.col("p1").alias("p0"), ((F.col("x") - shift) * F.col("p1") - back * F.col("p0")).alias("p1"), (F.col("fit") + c * F.col("p1")).alias("fit"),
                     F.col("at1").alias("at0"), (-shift * F.col("at1") - back * F.col("at0")).alias("at1"), (F.col("bias") + c * F.col("at1")).alias("bias"), F.when(some, F.col("pp")).otherwise(1.0).alias("before"))
    out = p.agg(F.max("bias").alias("bias"), F.sum((F.col("y") - F.col("fit")) * (F.col("y") - F.col("fit"))).alias("rest"), F.var_pop("y").alias("v"), F.count("*").alias("m"))
    few = F.col("n") < 3
    r2 = F.when(F.col("v") > 0, 1 - F.col("rest") / (F.col("v") * F.col("m"))).otherwise(0.0)
    return seats.join(F.broadcast(out)).select(F.round(F.when(few, F.col("seats") - 0.5).otherwise(F.col("bias") - 0.5), 4).alias("cubic_bias"), F.round(F.when(few, 1.0).otherwise(r2), 4).alias("r_squared"))


def bootstrap(e: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean-median difference: seeded draws, by index without interpolation."""
    from pyspark.sql import Window

    rows = e.withColumn("i", F.row_number().over(Window.orderBy("district")) - 1).select("i", "dem_pct")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    draws = e.sparkSession.range(replicates).withColumnRenamed("id", "b").join(n).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "j")), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("i", (drawn % F.col("n")).cast("int"))
    stat = draws.join(F.broadcast(rows), "i").groupBy("b").agg((F.avg("dem_pct") - F.percentile("dem_pct", F.lit(0.5))).alias("m"))
    s = stat.agg(F.array_sort(F.collect_list("m")).alias("s"))
    at = lambda q: F.element_at("s", (F.floor(F.size("s") * F.lit(q)) + 1).cast("int"))
    return s.select(at(0.025).alias("low"), at(0.975).alias("high"))



#: Districts below which no interval is given.
LEAST_DISTRICTS = 10


def report(e: DataFrame) -> DataFrame:
    """metric, value, direction, ci_available, ci_reason, dem_vote_share, dem_seat_share: one row per partisan metric."""
    n = e.agg(F.count("*").alias("n"), r6(F.coalesce(F.sum("dem") / F.nullif(F.sum("total"), F.lit(0)), F.lit(0.0))).alias("dem_vote_share"), r6(F.count_if(F.col("dem") > F.col("rep")) / F.greatest(F.count("*"), F.lit(1))).alias("dem_seat_share"))
    parts = [f(e).select(F.lit(name).alias("metric"), F.col(name).alias("value")) for f, name in ((efficiency_gap, "efficiency_gap"), (mean_median, "mean_median"), (bias_uniform_swing, "partisan_bias"))]
    rows = parts[0].union(parts[1]).union(parts[2]).join(F.broadcast(n))
    enough = F.col("n") >= LEAST_DISTRICTS
    reason = F.when(~enough, F.concat(F.lit(f"at least {LEAST_DISTRICTS} districts are needed, found "), F.col("n").cast("string")))
    return rows.select("metric", "value", F.when(F.col("value") >= 0, "Democratic").otherwise("Republican").alias("direction"), enough.alias("ci_available"), reason.alias("ci_reason"), "dem_vote_share", "dem_seat_share")


def close_calls(e: DataFrame, threshold: float = 0.5, band: float = 0.02) -> DataFrame:
    """Districts whose share lies within the band around the threshold, and on which side."""
    near = e.where(F.col("dem_pct").between(threshold - band, threshold + band))
    return near.select("district", r6("dem_pct").alias("dem_share"), F.when(F.col("dem_pct") >= threshold, "above").otherwise("below").alias("side"))
