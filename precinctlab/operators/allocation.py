"""Apportionment and proportional allocation: seats as the top quotients of a bounded explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributes import r6


def top_quotients(votes: DataFrame, name: str, value: str, seats: int, divisor: Column, within: list[str] | None = None) -> DataFrame:
    """Seats per name: the ``seats`` largest value / divisor(s), s = 1..seats; ties go to the smaller name.  ``divisor`` reads column s."""
    q = votes.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(seats)))).withColumn("q", F.col(value) / divisor)
    w = Window.partitionBy(*(within or [])).orderBy(F.desc("q"), name)
    won = q.withColumn("r", F.row_number().over(w)).where(F.col("r") <= seats).groupBy(*(within or []), name).agg(F.count("*").alias("seats"))
    keys = [*(within or []), name]
    return votes.select(*keys).join(won, keys, "left").fillna(0, ["seats"])


def huntington_hill(pops: DataFrame, name: str, pop: str, seats: int) -> DataFrame:
    """One seat each, then the highest pop / sqrt(n (n + 1)); fewer seats than names is an error."""
    n = pops.count()
    if seats < n:
        raise ValueError(f"{seats} seats for {n} names")
    if seats == n:
        return pops.select(name, F.lit(1).cast("long").alias("seats"))
    more = top_quotients(pops, name, pop, seats - n, F.sqrt(F.col("s") * (F.col("s") + 1)))
    return more.select(name, (F.col("seats") + 1).alias("seats"))


def dhondt(votes: DataFrame, name: str, value: str, seats: int, within: list[str] | None = None) -> DataFrame:
    return top_quotients(votes, name, value, seats, F.col("s").cast("double"), within)


def dhondt_threshold(votes: DataFrame, name: str, value: str, seats: int, threshold: float) -> DataFrame:
    """Names under the threshold of the vote get none; if all are under it, the largest takes every seat."""
    total = votes.agg(F.sum(value).alias("_t"))
    v = votes.join(F.broadcast(total)).withColumn("_in", F.col(value) >= threshold * F.col("_t"))
    v = v.withColumn("_any", F.max("_in").over(Window.partitionBy())).withColumn("_first", F.row_number().over(Window.orderBy(F.desc(value), name)) == 1)
    part = v.where(F.col("_in") | (~F.col("_any") & F.col("_first"))).select(name, value)
    return votes.select(name).join(dhondt(part, name, value, seats), name, "left").fillna(0, ["seats"])


def sainte_lague(votes: DataFrame, name: str, value: str, seats: int, within: list[str] | None = None) -> DataFrame:
    return top_quotients(votes, name, value, seats, (2 * F.col("s") - 1).cast("double"), within)


def gallagher(votes: DataFrame, allocation: DataFrame, name: str, value: str) -> DataFrame:
    """sqrt of half the squared differences of vote and seat percentages, and the sum of absolute share differences."""
    j = votes.join(allocation, name)
    t = j.agg(F.sum(value).alias("_v"), F.sum("seats").alias("_s"))
    d = F.col(value) / F.col("_v") - F.col("seats") / F.col("_s")
    return j.join(F.broadcast(t)).agg(r6(F.sqrt(F.sum(10000 * d * d) / 2)).alias("gallagher"), r6(F.sum(F.abs(d))).alias("deviation"))


def gallagher_band(index: Column) -> Column:
    return F.when(index < 2, "excellent").when(index < 5, "good").when(index < 10, "fair").otherwise("poor")


def prime_factors(numbers: DataFrame, column: str = "n") -> DataFrame:
    """Distinct prime factors in order, the largest, and whether the number is prime; a number under 2 has none."""
    top = numbers.agg(F.max(column)).first()[0] or 2
    f = prime_sequence(numbers.sparkSession, max(2, top)).select(F.col("n").alias("_n"), F.array_distinct("factors").cast("array<int>").alias("factors"))
    out = numbers.join(f, F.col(column) == F.col("_n"), "left").select(column, F.coalesce("factors", F.array().cast("array<int>")).alias("factors"))
    return out.withColumn("largest", F.array_max("factors")).withColumn("is_prime", F.coalesce(F.col("largest") == F.col(column), F.lit(False)))


def seat_sequence(pops: DataFrame, name: str, pop: str, seats: int, least: int = 1) -> DataFrame:
    """seat (place among all), name, nth (of its name), priority of the seats after the first ``least`` of each name; too few seats are an error."""
    n = pops.count()
    if least < 1 or seats < least * n:
        raise ValueError(f"{seats} seats for {n} names with {least} at least")
    given = pops.withColumn("i", F.explode(F.sequence(F.lit(least), F.lit(seats)))).withColumn("priority", F.col(pop) / F.sqrt(F.col("i") * (F.col("i") + 1)))
    top = given.orderBy(F.desc("priority"), name, "i").limit(seats - least * n)
    place = F.row_number().over(Window.orderBy(F.desc("priority"), name, "i"))  # of the few seats left
    return top.select((place + least * n).cast("long").alias("seat"), name, (F.col("i") + 1).cast("int").alias("nth"), r6("priority").alias("priority"))


def seat_differences(got: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """name, got, expected, difference where two allocations differ; a name that one lacks counts 0 there."""
    g, e = (t.select(name, F.col("seats").alias(c)) for t, c in ((got, "got"), (expected, "expected")))
    both = g.join(e, name, "full_outer").fillna(0, ["got", "expected"])
    return both.where("got <> expected").select(name, "got", "expected", (F.col("got") - F.col("expected")).alias("difference"))


def prime_sequence(spark, top: int) -> DataFrame:
    """n and its prime factors in order, for n = 2..top: each prime's powers meet their multiples."""
    n = spark.range(2, top + 1)
    composite = n.where(F.col("id") * F.col("id") <= top).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(top), F.col("id"))).alias("id")).distinct()
    primes = n.join(composite, "id", "left_anti")
    powers = primes.withColumn("e", F.explode(F.sequence(F.lit(1), F.floor(F.log(F.lit(top + 0.5)) / F.log("id")).cast("int")))).withColumn("step", F.pow("id", "e").cast("long"))
    held = powers.select("id", "e", F.explode(F.sequence("step", F.lit(top).cast("long"), "step")).alias("n"))
    return held.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "e"))), lambda x: x["id"]).alias("factors"))


def prime_divergence(spark, numbers: DataFrame, top: int) -> DataFrame:
    """k and the first place at which the prime factors of k and k + 1 differ."""
    f = prime_sequence(spark, top)
    pairs = numbers.join(f.select(F.col("n").cast("int").alias("k"), F.col("factors").alias("a")), "k").join(f.select((F.col("n") - 1).cast("int").alias("k"), F.col("factors").alias("b")), "k")
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    return pairs.select("k", F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int").alias("level"))


def against_single_member(votes: DataFrame, party: str, value: str, seats: int, within: str) -> DataFrame:
    """party, its share of all votes, of the seats in districts of ``seats`` members, and of those with one member."""
    share = lambda t, v, c: t.groupBy(party).agg(F.sum(v).alias(c))
    out = share(votes, value, "vote_share").join(share(dhondt(votes, party, value, seats, [within]), "seats", "multi_share"), party, "left").join(share(dhondt(votes, party, value, 1, [within]), "seats", "single_share"), party, "left").fillna(0)
    total = out.agg(*[F.sum(c).alias(f"_{c}") for c in ("vote_share", "multi_share", "single_share")])
    return out.join(F.broadcast(total)).select(party, *[r6(F.col(c) / F.col(f"_{c}")).alias(c) for c in ("vote_share", "multi_share", "single_share")])
