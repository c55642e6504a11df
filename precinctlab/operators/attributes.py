"""Attribute aggregates by district.  Inputs: units (geoid, ...), plan (geoid, district)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("white", "black", "asian", "hispanic", "other")


def ratio(a, b, default: float = 0.0) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def by_district(units: DataFrame, plan: DataFrame, sums: list[str], k: int | None = None) -> DataFrame:
    """Sums of units by district; with ``k``, every district of 1..k has a row, empty ones zeros.

    Units without a district are left out (see ``unmatched``)."""
    agg = units.join(plan, "geoid").groupBy("district").agg(*[F.sum(c).cast("long").alias(c) for c in sums], F.count("*").alias("n_units"))
    if k is None:
        return agg
    axis = units.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("district"))
    return axis.join(F.broadcast(agg), "district", "left").fillna(0)


def unmatched(units: DataFrame, plan: DataFrame) -> DataFrame:
    return units.join(plan, "geoid", "left_anti").agg(F.count("*").alias("n_unmatched"))


def demographics(units: DataFrame, plan: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """Population, shares and minority share; an empty district counts as all minority."""
    d = by_district(units, plan, ["pop", *GROUPS], k)
    minority = 1 - ratio("white", "pop")
    return d.select("district", F.col("pop").alias("total_pop"), *[r6(ratio(g, "pop")).alias(f"pct_{g}") for g in GROUPS], r6(minority).alias("pct_minority"), (minority >= threshold).alias("is_majority_minority"))


def majority_group(units: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    d = by_district(units, plan, ["pop", *GROUPS], k)
    top = F.array_max(F.array(*[F.struct(F.col(g).alias("n"), F.lit(g).alias("g")) for g in GROUPS]))
    return d.select("district", top["g"].alias("majority_group"), F.round(100 * ratio(top["n"], F.col("pop")), 2).alias("majority_pct"))


def political(units: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """Two-party votes, shares, signed margin; no votes lean to the first party by a margin of 0."""
    d = by_district(units, plan, ["dem", "rep"], k).withColumn("total_votes", F.col("dem") + F.col("rep"))
    dp, rp = ratio("dem", "total_votes"), ratio("rep", "total_votes")
    return d.select("district", "total_votes", F.col("dem").alias("dem_votes"), F.col("rep").alias("rep_votes"), r6(dp).alias("dem_pct"), r6(rp).alias("rep_pct"),
                    r6(dp - rp).alias("margin"), (dp - rp >= 0).alias("lean_dem"), ((F.col("dem") == 0) | (F.col("rep") == 0)).alias("is_uncontested"))


def elections(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Votes of districts that have units: dem, rep, total, dem_pct (0.5 without votes)."""
    d = by_district(units, plan, ["dem", "rep"])
    return d.select("district", "dem", "rep", (F.col("dem") + F.col("rep")).alias("total"), ratio(F.col("dem"), F.col("dem") + F.col("rep"), 0.5).alias("dem_pct"))


def partisan_districts(units: DataFrame, plan: DataFrame, competitive: float = 0.05) -> DataFrame:
    e = elections(units, plan)
    margin = F.abs(F.col("dem") - F.col("rep")) / F.greatest(F.col("total"), F.lit(1))
    return e.select("district", F.col("dem").alias("dem_votes"), F.col("rep").alias("rep_votes"), r6("dem_pct").alias("dem_pct"), r6(margin).alias("margin"),
                    (margin < competitive).alias("is_competitive"), ((F.col("dem") == 0) | (F.col("rep") == 0)).alias("is_uncontested"))


def urban(units: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """Largest place and number of place rows."""
    agg = units.join(plan, "geoid").groupBy("district").agg(F.count("*").alias("num_places"), F.max(F.struct("pop", "place")).alias("m"))
    axis = units.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("district"))
    return axis.join(F.broadcast(agg), "district", "left").select("district", F.nullif(F.col("m.place"), F.lit("")).alias("largest_city"), F.coalesce("m.pop", F.lit(0)).alias("largest_city_pop"), F.coalesce("num_places", F.lit(0)).alias("num_places"))


def minority_districts(units: DataFrame, plan: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Strictly above the threshold, unlike ``demographics``; only districts with units."""
    d = by_district(units, plan, ["pop", *GROUPS])
    minority = ratio(F.col("pop") - F.col("white"), F.col("pop"))
    return d.select("district", r6(minority).alias("pct_minority"), r6(ratio("black", "pop")).alias("pct_black"), r6(ratio("hispanic", "pop")).alias("pct_hispanic"), (minority > threshold).alias("is_mm"))


def population_balance(units: DataFrame, plan: DataFrame) -> DataFrame:
    d = by_district(units, plan, ["pop"])
    ideal = d.agg(F.avg("pop").alias("ideal"))
    return d.join(F.broadcast(ideal)).agg(r6(F.max(F.abs(F.col("pop") - F.col("ideal")) / F.col("ideal"))).alias("max_deviation"))


def summary(units: DataFrame, plan: DataFrame, k: int, tolerance: float = 0.05) -> DataFrame:
    """Ideal population by integer division; the deviation is a fraction."""
    d = by_district(units, plan, ["pop", "white", "dem", "rep"], k)
    total = d.agg(F.sum("pop").alias("all_pop"))
    d = d.join(F.broadcast(total)).withColumn("ideal_pop", F.expr(f"all_pop DIV {k}"))
    dev = F.abs(F.col("pop") - F.col("ideal_pop")) / F.col("ideal_pop")
    share = ratio(F.col("dem"), F.col("dem") + F.col("rep"))
    minority = 1 - ratio("white", "pop")
    out = d.select("district", F.col("pop").alias("total_pop"), "ideal_pop", r6(dev).alias("pop_deviation_pct"), (dev <= tolerance).alias("pop_balance_ok"), r6(minority).alias("pct_minority"),
                   (minority >= 0.5).alias("is_majority_minority"), r6(share).alias("dem_pct"), (2 * F.col("dem") >= F.col("dem") + F.col("rep")).alias("lean_dem"))
    return out.join(urban(units, plan, k).select("district", "largest_city"), "district")


def diversity(units: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """Shannon entropy of the five groups over ln 5."""
    d = by_district(units, plan, ["pop", *GROUPS], k)
    value = sum((F.when(F.col(g) > 0, -(F.col(g) / F.col("pop")) * F.log(F.col(g) / F.col("pop"))).otherwise(0.0) for g in GROUPS), F.lit(0.0)) / F.log(F.lit(5.0))
    return d.select("district", r6(value).alias("diversity"))


def lean_band(margin_points: Column) -> Column:
    out = F.when(margin_points.isNull(), "No Data")
    for least, name in ((20, "Strong D"), (10, "Lean D"), (5, "Tilt D"), (-5, "Tossup"), (-10, "Tilt R"), (-20, "Lean R")):
        out = out.when(margin_points >= least, name)
    return out.otherwise("Strong R")


def lean_bands(units: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    d = by_district(units, plan, ["dem", "rep"], k)
    return d.select("district", lean_band(F.when(F.col("dem") + F.col("rep") > 0, 100 * (F.col("dem") - F.col("rep")) / (F.col("dem") + F.col("rep")))).alias("lean"))


def splits(units: DataFrame, plan: DataFrame, area: str, key: str) -> DataFrame:
    """Areas that lie in more than one district."""
    s = units.join(plan, "geoid").groupBy(F.col(area).alias(key)).agg(F.count("*").alias("n_units"), F.array_sort(F.collect_set("district")).alias("d"))
    return s.where(F.size("d") > 1).select(key, "n_units", F.size("d").alias("split_severity"), F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("districts"))


def split_score(units: DataFrame, plan: DataFrame, area: str) -> DataFrame:
    s = units.join(plan, "geoid").groupBy(area).agg(F.count_distinct("district").alias("d"))
    return s.agg(F.count("*").alias("n_areas"), F.count_if(F.col("d") > 1).alias("n_split"), r6(F.coalesce(1 - F.count_if(F.col("d") > 1) / F.count("*"), F.lit(1.0))).alias("score"))


def weighted_turnout(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Turnout of the units, weighed by population."""
    u = units.join(plan, "geoid").where("pop > 0").groupBy("district").agg((F.sum(F.col("dem") + F.col("rep")) / F.sum("pop")).alias("t"))
    return u.select("district", r6("t").alias("turnout"))


def minority_status(units: DataFrame, plan: DataFrame) -> DataFrame:
    d = by_district(units, plan, ["pop", *GROUPS])
    over = lambda g: F.count_if(ratio(g, "pop") > 0.5)
    return d.agg(over("black").alias("black_mm"), over("hispanic").alias("hispanic_mm"), over("asian").alias("asian_mm"),
                 F.count_if((ratio("black", "pop") > 0.5) | (ratio("hispanic", "pop") > 0.5) | (ratio("asian", "pop") > 0.5)).alias("total_mm"))
