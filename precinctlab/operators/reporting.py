"""What reports say of plans: bands, checks of names and intervals, seat targets, statistics of districts and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributes import r6, ratio
from .graph import components, labelled
from .roll_ups import density_class

#: Upper ends of the bands of the disproportionality index, lower ends of those of compactness.
DISPROPORTION = [(1.0, "Exceptionally high proportionality"), (2.0, "Very high proportionality"), (3.0, "High proportionality"), (5.0, "Moderate proportionality"), (8.0, "Low proportionality"), (12.0, "Disproportional")]
COMPACT = [(0.6, "Highly compact"), (0.5, "Very compact"), (0.4, "Compact"), (0.3, "Moderately compact"), (0.2, "Somewhat compact")]
#: Names that no label may have.
RESERVED = ["runs", "analysis", "reports", ".redist", "configs"]


def disproportion_band(index: Column) -> Column:
    out = F.when(index.isNull(), F.lit(None).cast("string"))
    for below, name in DISPROPORTION:
        out = out.when(index < below, name)
    return out.otherwise("Highly disproportional")


def compact_band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in COMPACT:
        out = out.when(score >= least, name)
    return out.otherwise("Not compact")


def disproportion(seats: DataFrame, by: str) -> DataFrame:
    """Least-squares index in points, and its band, of each group of ``by`` from (by, party, votes, seats)."""
    one = Window.partitionBy(by)
    gap = 100 * (ratio(F.col("votes"), F.sum("votes").over(one)) - ratio(F.col("seats"), F.sum("seats").over(one)))
    index = F.sqrt(F.sum(F.col("gap") * F.col("gap")) / 2)
    return seats.withColumn("gap", gap).groupBy(by).agg(r6(index).alias("gallagher"), disproportion_band(index).alias("band"))


def label_check(labels: DataFrame, label: str) -> DataFrame:
    """The different labels and what is wrong with each: empty, leading dot, character, reserved, or null if nothing; the first rule that fails counts."""
    x = F.col("label")
    fault = F.when(x.isNull() | (x == ""), "empty").when(x.startswith("."), "leading dot").when(~x.rlike(r"^[a-zA-Z0-9_-]+\z"), "character").when(x.isin(RESERVED), "reserved")
    return labels.select(F.col(label).alias("label")).distinct().withColumn("fault", fault)


def indeterminate(shares: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n_districts, n_indeterminate (interval low < threshold < high) and n_majority (low at or above the threshold)."""
    return shares.agg(F.count("*").alias("n_districts"), F.count_if((F.col("low") < threshold) & (F.col("high") > threshold)).alias("n_indeterminate"), F.count_if(F.col("low") >= threshold).alias("n_majority"))


def claims(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether a claim of direction between (point, low, high) of two plans must go: of a monotone measure at ties and where bands meet, of another where they meet."""
    both = a.select(key, *[F.col(c).alias(f"{c}_a") for c in ("point", "low", "high")]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in ("point", "low", "high")]), key)
    diff = F.col("point_a") - F.col("point_b")
    safe = F.when(diff > 0, F.col("low_a") > F.col("high_b")).when(diff < 0, F.col("high_a") < F.col("low_b")).otherwise(False)
    meet = (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))
    return both.select(key, r6(diff).alias("difference"), (~safe).alias("monotone_suppressed"), meet.alias("other_suppressed"))


def seat_targets(units: DataFrame, sizes: tuple[int, ...], urban: float, suburban: float, seats: int = 435) -> DataFrame:
    """members, n_districts: seats by the population of the density classes, rounded to whole districts; the largest size takes up what is over or short.

    One size alone takes all seats, the last district included.  Units: pop, density."""
    if len(sizes) == 1:
        return units.agg(F.lit(sizes[0]).alias("members"), F.lit(-(-seats // sizes[0])).cast("long").alias("n_districts"))
    size = F.regexp_extract(density_class(F.col("density"), urban, suburban, sizes), r"^\d+", 0).cast("int")
    every = Window.partitionBy()  # a row per size
    c = units.groupBy(size.alias("members")).agg(F.sum("pop").alias("pop"))
    c = c.withColumn("n_districts", F.floor(F.bround(F.col("pop") / F.sum("pop").over(every) * seats) / F.col("members"))).where("n_districts > 0")
    short = seats - F.sum(F.col("n_districts") * F.col("members")).over(every)
    last = F.col("members") == F.max("members").over(every)
    return c.select("members", (F.col("n_districts") + F.when(last, F.floor(short / F.col("members"))).otherwise(0)).alias("n_districts"))


def stranded(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """geoid, district of the units outside the largest component of their district; of equal ones that with the least geoid counts as largest."""
    inside = labelled(edges, plan).where("du = dv").select("u", "v")
    comp = components(inside, plan.select(F.col("geoid").alias("node"))).join(plan.withColumnRenamed("geoid", "node"), "node")
    sizes = comp.groupBy("district", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("district").agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("main"))
    return comp.join(main, "district").where("component <> main").select(F.col("node").alias("geoid"), "district")


def induced(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges inside each group (geoid, grp) with the ends' numbers in it, counted from 0 by geoid."""
    at = groups.withColumn("local", F.row_number().over(Window.partitionBy("grp").orderBy("geoid")) - 1)
    u = at.select(F.col("geoid").alias("u"), "grp", F.col("local").alias("local_u"))
    v = at.select(F.col("geoid").alias("v"), F.col("grp").alias("gv"), F.col("local").alias("local_v"))
    return edges.join(u, "u").join(v, "v").where("grp = gv").select("grp", "local_u", "local_v", "w")


def district_statistics(units: DataFrame, plan: DataFrame, edges: DataFrame) -> DataFrame:
    """Population, units, population-weighted lean in points and compactness of districts of unit squares that share a side with each neighbour."""
    total = F.col("dem") + F.col("rep")
    lean = 100 * ratio(F.col("dem") - F.col("rep"), total)
    d = units.join(plan, "geoid").groupBy("district").agg(F.sum("pop").alias("population"), F.count("*").alias("n_units"), F.sum(lean * F.col("pop")).alias("s"))
    shared = labelled(edges, plan).where("du = dv").groupBy(F.col("du").alias("district")).agg(F.count("*").alias("n_shared"))
    d = d.join(shared, "district", "left").withColumn("perimeter", 4 * F.col("n_units") - 2 * F.coalesce("n_shared", F.lit(0)))
    return d.select("district", "population", "n_units", r6(ratio(F.col("s"), F.col("population"))).alias("lean"), "perimeter", r6(4 * F.pi() * F.col("n_units") / F.pow("perimeter", F.lit(2))).alias("polsby_popper"))


def unit_table(units: DataFrame, shapes: DataFrame, votes: DataFrame) -> DataFrame:
    """A row per shape: population, votes, share of the first party and density; what is missing is zero."""
    t = shapes.join(units.select("geoid", "pop"), "geoid", "left").join(votes.select("geoid", "dem", "rep"), "geoid", "left").fillna(0, ["pop", "dem", "rep"])
    total = F.col("dem") + F.col("rep")
    return t.select("geoid", F.col("pop").alias("total_population"), F.col("dem").alias("dem_votes"), F.col("rep").alias("rep_votes"), total.alias("total_votes"), r6(ratio(F.col("dem"), total)).alias("dem_vote_share"), r6(F.when(F.col("area") > 0, F.col("pop") / F.col("area")).otherwise(0.0)).alias("pop_density"))


def state_shapes(scores: DataFrame) -> DataFrame:
    """Number and mean scores of the districts of each state."""
    return scores.groupBy("state").agg(F.count("*").alias("num_districts"), *[r6(F.avg(c)).alias(n) for c, n in (("polsby_popper", "mean_pp"), ("reock", "mean_reock"), ("perimeter", "mean_perimeter"), ("area", "mean_area"))])


def years_compared(ours: DataFrame, theirs: DataFrame, by: str, score: str) -> DataFrame:
    """Number, mean and median of a score on both sides for each of ``by``, and by how many percent our mean is above theirs."""
    side = lambda rows, n: rows.groupBy(by).agg(F.count(score).alias(f"{n}_n"), F.avg(score).alias(f"{n}_mean"), F.median(score).alias(f"{n}_median"))
    both = side(ours, "ours").join(side(theirs, "theirs"), by)
    better = r6(100 * (F.col("ours_mean") / F.nullif(F.col("theirs_mean"), F.lit(0.0)) - 1)).alias("improvement_pct")
    return both.select(by, *[r6(c).alias(c) if not c.endswith("_n") else F.col(c) for n in ("ours", "theirs") for c in (f"{n}_n", f"{n}_mean", f"{n}_median")], better)


def party_weights(units: DataFrame) -> DataFrame:
    """Votes of each party as weights of units, 1 at least; 'other' is all of them but the two."""
    return units.select("geoid", *[F.greatest(F.col(c), F.lit(1)).alias(f"{n}_weight") for c, n in (("dem", "democratic"), ("rep", "republican"), ("oth", "other"))])


def chain_seeds(chains: DataFrame, base: int) -> DataFrame:
    """The 64-bit seed of each chain, as 16 hex digits: the first eight bytes, least first, of the digest of tag, chain and base."""
    turned = lambda x: F.concat(*[F.substring(x, i, 2) for i in range(15, 0, -2)])
    chain = F.unhex(turned(F.lpad(F.hex("chain"), 16, "0")))
    digest = F.sha2(F.concat(F.lit(b"ENSEMBLE_CHAIN_"), chain, F.lit(b"_"), F.lit(base.to_bytes(8, "little"))), 256)
    return chains.select("chain", turned(digest).alias("seed"))


def iso_time(seconds: Column) -> Column:
    """UTC time of seconds since 1970; earlier ones count as its start.  Years have four digits, after 9999 as many as they need and no sign."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.greatest(seconds, F.lit(0)) / 86400).cast("int"))
    rest = F.pmod(F.greatest(seconds, F.lit(0)), F.lit(86400)).cast("long")
    return F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", F.year(days), F.month(days), F.day(days), F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)


def ascii_safe(text: Column) -> Column:
    """Each character outside ASCII becomes a question mark."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")
