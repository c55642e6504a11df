"""Tables over many states, plans or years, and the weights of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributes import r6


def us_aggregate(districts: DataFrame, states: DataFrame) -> DataFrame:
    """state, district, population, state_mean, deviation_pct.  A state without district rows is one at-large district of its whole population."""
    have = districts.join(states.select("state"), "state").select("state", "district", "population")
    large = states.join(have.select("state").distinct(), "state", "left_anti").select("state", F.lit(1).alias("district"), "population")
    every = have.union(large)
    mean = every.groupBy("state").agg(F.avg("population").alias("m"))
    return every.join(F.broadcast(mean), "state").select("state", "district", "population", r6("m").alias("state_mean"), r6(F.when(F.col("m") > 0, 100 * (F.col("population") - F.col("m")) / F.col("m")).otherwise(0.0)).alias("deviation_pct"))


def config_metrics(rows: DataFrame) -> DataFrame:
    """Per configuration, from (config, lean, score): number, mean absolute lean, its deviation, safe districts at 10, 15 and 20 points, mean and median score."""
    safe = [c for t in (10, 15, 20) for c in (F.count_if(F.abs("lean") > t).alias(f"safe_{t}"), r6(100 * F.count_if(F.abs("lean") > t) / F.count("*")).alias(f"safe_{t}_pct"))]
    return rows.groupBy("config").agg(F.count("*").alias("n_districts"), r6(F.avg(F.abs("lean"))).alias("mean_abs_lean"), r6(F.stddev_samp("lean")).alias("std_lean"), *safe, r6(F.avg("score")).alias("mean_score"), r6(F.median("score")).alias("median_score"))


def pivoted(rows: DataFrame, by: str, across: str, names: list, value: str) -> DataFrame:
    """Mean value per ``by``, a column for each of ``names``."""
    return rows.groupBy(by).pivot(across, names).agg(r6(F.avg(value)))


def quantiles(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, median, q25, q75 with linear interpolation."""
    at = lambda q: r6(F.percentile(value, F.lit(q)))
    return rows.agg(F.count(value).alias("n"), r6(F.avg(value)).alias("mean"), at(0.5).alias("median"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def compare_sides(ours: DataFrame, theirs: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """key, then for each score ours_s, theirs_s and the improvement in percent, for keys in both tables."""
    joined = ours.select(key, *[F.col(s).alias(f"ours_{s}") for s in scores]).join(theirs.select(key, *[F.col(s).alias(f"theirs_{s}") for s in scores]), key)
    better = [r6(100 * (F.col(f"ours_{s}") - F.col(f"theirs_{s}")) / F.nullif(F.col(f"theirs_{s}"), F.lit(0.0))).alias(f"{s}_improvement_pct") for s in scores]
    return joined.select(key, *[r6(f"{side}_{s}").alias(f"{side}_{s}") for s in scores for side in ("ours", "theirs")], *better)


def extremes(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """side ('top' or 'bottom'), key, value of the n largest and the n smallest; ties by key."""
    top = rows.orderBy(F.desc(value), key).limit(n).select(F.lit("top").alias("side"), key, value)
    return top.union(rows.orderBy(F.asc(value), key).limit(n).select(F.lit("bottom"), key, value))


def reassigned(a: DataFrame, b: DataFrame, by: Column) -> DataFrame:
    """Units of each group in both plans, and how many changed their district."""
    both = a.withColumnRenamed("district", "da").join(b.withColumnRenamed("district", "db"), "geoid").withColumn("grp", by)
    moved = F.count_if(F.col("da") != F.col("db"))
    return both.groupBy("grp").agg(F.count("*").alias("n_units"), moved.alias("n_moved"), r6(1 - moved / F.count("*")).alias("stability"))


def urban_share(units: DataFrame, least: float = 1000.0) -> DataFrame:
    """state and the share of its people in units of more than ``least`` per area; units: state, pop, area."""
    dense = F.col("pop") / F.nullif(F.col("area"), F.lit(0.0)) > least
    return units.groupBy("state").agg(r6(F.coalesce(F.sum(F.when(dense, F.col("pop")).otherwise(0)) / F.nullif(F.sum("pop"), F.lit(0)), F.lit(0.0))).alias("urban_share"))


def cross_state(units: DataFrame, plan: DataFrame) -> DataFrame:
    """district, state, n_units, pop and the district's fraction that the state fills."""
    parts = units.join(plan, "geoid").groupBy("district", "state").agg(F.count("*").alias("n_units"), F.sum("pop").alias("pop"))
    whole = parts.groupBy("district").agg(F.sum("pop").alias("all"))
    return parts.join(F.broadcast(whole), "district").select("district", "state", "n_units", "pop", r6(F.col("pop") / F.nullif(F.col("all"), F.lit(0))).alias("seat_fraction"))


def shared_pairs(parts: DataFrame) -> DataFrame:
    """state_a < state_b and the number of districts that reach into both."""
    a, b = parts.select("district", F.col("state").alias("state_a")), parts.select("district", F.col("state").alias("state_b"))
    return a.join(b, "district").where("state_a < state_b").groupBy("state_a", "state_b").agg(F.count("*").alias("n_districts"))


def disaggregated(units: DataFrame, results: DataFrame) -> DataFrame:
    """geoid, dem_votes, rep_votes, dem_share: an area's votes split over its units by their people; 0.5 where the area has no result or people.

    units: geoid, area, vap; results: area, dem, rep.
    """
    total = units.groupBy("area").agg(F.sum("vap").alias("all"))
    u = units.join(total.join(results, "area", "left"), "area")
    part = F.coalesce(F.col("vap") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0))
    votes = F.col("dem") + F.col("rep")
    share = F.when(F.col("dem").isNull() | (F.col("all") <= 0) | (votes == 0), 0.5).otherwise(F.col("dem") / votes)
    return u.select("geoid", r6(F.coalesce(F.col("dem"), F.lit(0)) * part).alias("dem_votes"), r6(F.coalesce(F.col("rep"), F.lit(0)) * part).alias("rep_votes"), r6(share).alias("dem_share"))


def weight_summary(weights: DataFrame) -> DataFrame:
    """n, log_sum, ess of log weights (id, lw); no finite weight gives a log sum of -infinity and an ess of 0."""
    top = weights.agg(F.max("lw").alias("m"))
    s = weights.join(F.broadcast(top)).agg(F.count("*").alias("n"), F.max("m").alias("m"), F.sum(F.exp(F.col("lw") - F.col("m"))).alias("s"), F.sum(F.exp(2 * (F.col("lw") - F.col("m")))).alias("q"))
    return s.select("n", r6(F.coalesce(F.col("m") + F.ln("s"), F.lit(float("-inf")))).alias("log_sum"), r6(F.coalesce(F.col("s") * F.col("s") / F.col("q"), F.lit(0.0))).alias("ess"))


def softmax(weights: DataFrame) -> DataFrame:
    """id and its weight, all adding to 1."""
    top = weights.agg(F.max("lw").alias("m"))
    w = weights.join(F.broadcast(top)).withColumn("e", F.exp(F.col("lw") - F.col("m")))
    return w.join(F.broadcast(w.agg(F.sum("e").alias("s")))).select("id", (F.col("e") / F.col("s")).alias("weight"))


def running(df: DataFrame, order: list[str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Inclusive running sums over the whole table: range partitions, one total of each, and sums inside them."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from .graph import cut

    ranged = cut(df.withColumns({f"_v_{k}": v for k, v in values.items()}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in values])
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(base), "_part").withColumns({k: F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(inner) for k in values})
    return out.select(*df.columns, *values)


def systematic_resample(weights: DataFrame, n: int, start: float) -> DataFrame:
    """draw (0 to n - 1) and id: evenly spaced points start + draw / n, 0 <= start < 1 / n, on the running weights in the order of id."""
    sums = running(softmax(weights), ["id"], {"upto": F.col("weight")})
    # an interval (before, upto] holds the draws between its ends, so each id finds its own
    first, last = F.ceil((F.col("upto") - F.col("weight") - start) * n - 1e-9), F.ceil((F.col("upto") - start) * n - 1e-9) - 1
    held = sums.withColumns({"a": F.greatest(first, F.lit(0)), "z": F.least(last, F.lit(n - 1))}).where("a <= z")
    return held.select(F.explode(F.sequence("a", "z")).alias("draw"), "id")


def ensemble_report(traces: DataFrame, at: float, most: float = 1.05) -> DataFrame:
    """r_hat, percentile_rank, n_chains, n_steps and whether the chains pass."""
    from . import series

    even = series.trimmed(traces)
    rank = series.percentile_rank(even, at)
    r = series.r_hat(even, most)
    return r.join(F.broadcast(rank)).select("n_chains", (F.col("n_chains") * F.col("n_per_chain")).alias("n_steps"), "r_hat", "percentile_rank", (~F.col("above_threshold")).alias("passed"))


def integrated_time(lags: DataFrame) -> DataFrame:
    """tau: 1 + 2 times the sum of 1 - h over lags from 1 on, up to the first that is not positive; lags: lag, hamming."""
    stop = lags.where("lag >= 1 and hamming >= 1").agg(F.min("lag").alias("stop"))
    kept = lags.where("lag >= 1").join(F.broadcast(stop)).where("stop is null or lag < stop")
    return kept.agg(r6(1 + 2 * F.coalesce(F.sum(1 - F.col("hamming")), F.lit(0.0))).alias("tau"))


def greatest_divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor by 48 steps of Euclid, enough for 32-bit numbers."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).cast("long").alias("b")))
    return pair["a"]


def depth_for(k: Column) -> Column:
    """Halvings that k parts need, from the binary digits of k - 1."""
    return F.when(k <= 1, 0).otherwise(F.length(F.bin((k - 1).cast("long"))))


def tolerance_at(depth: Column, base: int) -> Column:
    """Allowed imbalance at a depth of halving: tight first, whole from depth 4 on."""
    part = F.when(depth <= 1, 0.2).when(depth == 2, 0.4).when(depth == 3, 0.6).otherwise(1.0)
    return 1 + base / 1000 * part


def density_class(density: Column, urban: float, suburban: float, sizes: tuple[int, ...]) -> Column:
    """Size of a unit's district: the largest size where it is densest; sizes ascend, one to three of them."""
    names = [f"{n}-member" for n in sizes]
    if len(names) == 1:
        return F.lit(names[0])
    if len(names) == 2:
        return F.when(density >= urban, names[1]).otherwise(names[0])
    return F.when(density >= urban, names[2]).when(density >= suburban, names[1]).otherwise(names[0])


def bound(lambda2: Column, n: Column, area_a: Column, area_b: Column, outer_a: Column, outer_b: Column) -> Column:
    """Greatest geometric mean of two halves' Polsby-Popper scores, from the least cut that an eigenvalue allows."""
    least = lambda2 * n / 4
    pp = lambda area, outer: F.when(least + outer > 0, 4 * F.pi() * area / ((least + outer) * (least + outer))).otherwise(0.0)
    return F.sqrt(pp(area_a, outer_a) * pp(area_b, outer_b))
