"""Election files: results by tract, by party, and the presidential table of 2020."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attributes import lean_band
from .tables import pad

PARTIES = ("dem_votes", "rep_votes", "lib_votes", "grn_votes", "oth_votes")
# Columns of the presidential file and their names here.
PRESIDENTIAL = {
    "tract_GEOID": "geoid", "tract_state_fp": "state_fips", "tract_county_fp": "county_fips", "tract_population": "population", "tract_hh_population": "hh_population", "tract_land_area": "land_area",
    "tract_water_area": "water_area", "num_precincts_contributing": "num_precincts", "G20PRERTRU": "trump", "G20PREDBID": "biden", "G20PRELJOR": "jorgensen", "G20PREOWRI": "write_in",
}
BLOCK_GROUP = 12


def presidential(spark: SparkSession, path: str) -> DataFrame:
    """The presidential file's columns under their names here, with totals, percentages, margin, lean and turnout.

    Other columns are left out, a missing one is an error; a byte order mark is
    skipped; a total leaves out null votes, the two-party vote is null with
    either; percentages are null without votes, turnout without people.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := [c for c in PRESIDENTIAL if c not in raw.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    text = ("geoid", "state_fips", "county_fips")
    t = raw.select(*[(F.col(f"`{c}`") if n in text else F.col(f"`{c}`").cast("double")).alias(n) for c, n in PRESIDENTIAL.items()])
    all_votes = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("trump", "biden", "jorgensen", "write_in")), F.lit(0.0))
    t = t.withColumns({"geoid": pad(F.col("geoid")), "total_votes": all_votes, "two_party_votes": F.col("trump") + F.col("biden")})
    part = lambda n, of: F.when(F.col(of) > 0, F.round(n / F.col(of) * 100, 2))
    t = t.withColumns({
        **{f"{c}_pct": part(F.col(c), "total_votes") for c in ("trump", "biden")}, "other_pct": part(F.col("jorgensen") + F.col("write_in"), "total_votes"),
        **{f"{c}_two_party_pct": part(F.col(c), "two_party_votes") for c in ("trump", "biden")}, "turnout_rate": part(F.col("total_votes"), "population"),
    })
    t = t.withColumn("dem_margin", F.round(F.col("biden_two_party_pct") - F.col("trump_two_party_pct"), 2))
    return t.withColumn("lean", lean_band(F.col("dem_margin")))


def block_group_votes(districts: DataFrame, results: DataFrame, parties=PARTIES) -> tuple[DataFrame, DataFrame]:
    """(district and summed votes by party, block groups without results) of districts of block groups (geoid, district).

    A block group, of 12 digits, takes the results of its tract, the first 11;
    results: geoid, ``parties``.  Block groups whose tract has none are left out.
    """
    d = districts.select(F.lpad(F.col("geoid").cast("string"), BLOCK_GROUP, "0").alias("geoid"), "district")
    r = results.select(pad(F.col("geoid").cast("string")).alias("tract"), *parties)
    both = d.withColumn("tract", F.substring("geoid", 1, 11)).join(r, "tract", "left")
    first = F.col(parties[0])
    return both.where(first.isNotNull()).groupBy("district").agg(*[F.sum(p).alias(p) for p in parties]), both.where(first.isNull()).select("geoid", "district")
