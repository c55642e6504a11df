"""Districts and the places in them: labels by cities, metropolitan areas by sets of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains

#: A place over HUGE gives its name to no district that has another over HUGE_NEXT among its first HUGE_LOOK.
HUGE, HUGE_NEXT, HUGE_LOOK = 1_000_000, 20_000, 10
#: A place over MAJOR names one district; others that it leads take the next over MAJOR_NEXT among their first MAJOR_LOOK.
MAJOR, MAJOR_NEXT, MAJOR_LOOK = 500_000, 10_000, 5


def places_in_districts(places: DataFrame, units: DataFrame, cell: float) -> DataFrame:
    """The places (geoid, name, population, x, y) with the district of the unit around them; units: district, polygons.

    Units spread over the grid cells of their boxes, places stand in one;
    a place in no unit is left out, one on a border goes to the smallest district.
    """
    corner = lambda f, c: f(F.transform(F.flatten(F.flatten("polygons")), lambda p: p[c]))
    span = lambda c: F.explode(F.sequence(F.floor(corner(F.array_min, c) / cell), F.floor(corner(F.array_max, c) / cell)))
    tiled = units.where(F.size(F.flatten(F.flatten("polygons"))) > 0).withColumn("cx", span("x")).withColumn("cy", span("y"))
    at = places.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    within = F.aggregate(F.flatten("polygons"), F.lit(False), lambda hit, r: hit != contains(r, F.col("x"), F.col("y")))
    met = at.join(tiled, ["cx", "cy"]).where(within).groupBy("geoid").agg(F.min("district").alias("district"))
    return places.join(met, "geoid")


def district_labels(placed: DataFrame, k: int) -> DataFrame:
    """district, largest_city, city_population, x, y for districts 1..k; placed: geoid, name, population, x, y, district.

    Places rank by population, then geoid.  A district without a place is
    called None, with 0 people and no point.
    """
    order = Window.partitionBy("district").orderBy(F.desc("population"), "geoid")
    row = F.struct("name", "population", "x", "y")
    ranked = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(HUGE_LOOK, MAJOR_LOOK))
    d = ranked.groupBy("district").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("p")))), lambda r: r["p"]).alias("p"))
    lead = F.col("p")[0]
    d = d.withColumn("class", F.when(lead["population"] > HUGE, "huge").when(lead["population"] > MAJOR, "major").otherwise("other")).withColumn("name", lead["name"])
    turn = F.row_number().over(Window.partitionBy("class", "name").orderBy("district"))
    after = lambda look, more: F.get(F.filter(F.slice("p", 2, look - 1), lambda q: (q["population"] > more) & (q["name"] != F.col("name"))), F.lit(0))
    best = F.when(F.col("class") == "huge", after(HUGE_LOOK, HUGE_NEXT)).when((F.col("class") == "major") & (turn > 1), after(MAJOR_LOOK, MAJOR_NEXT))
    d = d.withColumn("best", F.coalesce(best, lead)).select("district", F.col("best.name").alias("largest_city"), F.col("best.population").cast("long").alias("city_population"), "best.x", "best.y")
    axis = placed.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("district"))
    return axis.join(d, "district", "left").fillna({"largest_city": "None", "city_population": 0})


def metro_matches(parts: DataFrame, metros: DataFrame) -> DataFrame:
    """district, states, metro (null without a match) of districts that reach into several states.

    parts: district, state; metros: metro, place (its turn), state, core.  A
    district matches a metro that holds all its states and of whose core states
    it has one; the first metro by place wins.  Districts meet metros through
    the states they share, by counts: one row per district, metro and state.
    """
    own = parts.select("district", "state").dropna().distinct()
    sets = own.groupBy("district").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("state")).alias("states")).where("n > 1")
    m = metros.groupBy("metro", "place", "state").agg(F.max("core").alias("core"))
    met = own.join(m, "state").groupBy("district", "metro", "place").agg(F.count("*").alias("shared"), F.max("core").alias("core"))
    best = met.join(sets.select("district", "n"), "district").where("shared = n AND core").groupBy("district").agg(F.min_by("metro", F.struct("place", "metro")).alias("metro"))
    return sets.join(best, "district", "left").select("district", F.array_join("states", "-").alias("states"), "metro")


def metro_summary(matches: DataFrame) -> DataFrame:
    """metro, n_districts, share of all districts over several states; the row without a metro has those unmatched."""
    n = matches.groupBy("metro").agg(F.count("*").alias("n_districts"))
    return n.join(F.broadcast(matches.agg(F.count("*").alias("all")))).select("metro", "n_districts", F.round(F.col("n_districts") / F.col("all"), 6).alias("share"))
