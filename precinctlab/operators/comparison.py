"""Plans against plans: canonical labels, differences, set similarity, nesting, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attributes import r6


def canonical(plan: DataFrame) -> DataFrame:
    """Districts renumbered in the order of their smallest geoid."""
    first = plan.groupBy("district").agg(F.min("geoid").alias("_m"))
    names = first.select("district", F.row_number().over(Window.orderBy("_m")).alias("label"))
    return plan.join(names, "district").select("geoid", F.col("label").cast("int").alias("district"))


def assignment_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    j = canonical(a).withColumnRenamed("district", "da").join(canonical(b).withColumnRenamed("district", "db"), "geoid", "full_outer")
    return j.agg(F.count_if(F.col("da").isNull()).alias("missing_in_a"), F.count_if(F.col("db").isNull()).alias("missing_in_b"), F.count_if(F.col("da") != F.col("db")).alias("differing"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over the districts of a of the best set overlap with a district of b."""
    both = a.withColumnRenamed("district", "da").join(b.withColumnRenamed("district", "db"), "geoid").groupBy("da", "db").agg(F.count("*").alias("n"))
    na, nb = a.groupBy(F.col("district").alias("da")).agg(F.count("*").alias("na")), b.groupBy(F.col("district").alias("db")).agg(F.count("*").alias("nb"))
    best = both.join(na, "da").join(nb, "db").groupBy("da").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))
    return na.join(best, "da", "left").agg(r6(F.coalesce(F.avg(F.coalesce("j", F.lit(0.0))), F.lit(1.0))).alias("plan_jaccard"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units of equal label over the larger plan's size; 0 if a plan is empty."""
    j = a.withColumnRenamed("district", "da").join(b.withColumnRenamed("district", "db"), "geoid", "full_outer")
    s = j.agg(F.count_if(F.col("da") == F.col("db")).alias("same"), F.count("da").alias("na"), F.count("db").alias("nb"))
    return s.select(r6(F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("same") / F.greatest("na", "nb")).otherwise(0.0)).alias("plan_agreement"))


def diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.withColumnRenamed("district", "da").join(b.withColumnRenamed("district", "db"), "geoid").where("da <> db")
    touched = j.select(F.explode(F.array("da", "db")).alias("d")).agg(F.count_distinct("d").alias("districts_touched"))
    return j.agg(F.count("*").alias("units_changed")).join(F.broadcast(touched))


def nesting_violations(house: DataFrame, senate: DataFrame, ratio: int) -> DataFrame:
    """Upper districts that do not hold exactly ``ratio`` lower ones, or hold one that spans several."""
    pairs = house.withColumnRenamed("district", "h").join(senate.withColumnRenamed("district", "s"), "geoid").select("h", "s").distinct()
    span = pairs.groupBy("h").agg((F.count("*") > 1).alias("spans"))
    s = pairs.join(span, "h").groupBy("s").agg(F.count("*").alias("house_districts"), F.max("spans").alias("spans"))
    return s.where((F.col("house_districts") != ratio) | F.col("spans")).select(F.col("s").alias("senate_district"), "house_districts", F.lit(ratio).alias("expected_count"))


def validate(plan: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """Rule and number of violations."""
    p = plan.agg(F.count_if(~F.col("geoid").rlike("^[0-9]{11}$")).alias("geoid_format"), F.count_if(~F.col("district").between(1, k)).alias("district_range"),
                 (F.lit(k) - F.count_distinct("district")).alias("empty_districts"), (F.count("*") - F.count_distinct("geoid")).alias("repeated_units"))
    m = units.join(plan, "geoid", "left_anti").agg(F.count("*").alias("unassigned_units"))
    rules = ["district_range", "empty_districts", "geoid_format", "repeated_units", "unassigned_units"]
    return p.join(F.broadcast(m)).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("violations")) for r in rules])).alias("x")).select("x.*")


def exit_code(balance, contiguity, nesting, missing):
    """Bit field 1, 2, 4, 8."""
    return sum((F.when(c, bit).otherwise(0) for c, bit in ((balance, 1), (contiguity, 2), (nesting, 4), (missing, 8))), F.lit(0))


def national(states: list[DataFrame]) -> DataFrame:
    """Union of state tables; columns that one lacks are null."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
