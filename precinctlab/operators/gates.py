"""Checks that decide: validation gates, certificates, ensembles, expected outputs, minority status, model sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributes import r6, ratio
from .roll_ups import bound, depth_for
from .series import ess, percentile_rank, r_hat

# The manifests' schema and modes.
CIVIC_SCHEMA, STRICT, LOOSE = "civic-coi v", "strict", ("lenient", "advisory")


def civic_manifests(manifests: DataFrame) -> DataFrame:
    """path, label, mode, strict of the civic manifests among (path, schema_version, validate_mode, label); others are left out.

    A mode that is none counts as not strict, as unknown.
    """
    m = F.coalesce("validate_mode", F.lit(""))
    mode = F.when(m.isin(STRICT, *LOOSE), m).otherwise(F.concat(F.lit("unknown:"), m))
    return manifests.where(F.col("schema_version").startswith(CIVIC_SCHEMA)).select("path", "label", mode.alias("mode"), (m == STRICT).alias("strict"))


def civic_gate(manifests: DataFrame, allow: bool = False) -> DataFrame:
    """outcome, n_strict, n_offending: none found, all strict, or not all and then allowed or refused."""
    n = civic_manifests(manifests).agg(F.count_if("strict").alias("n_strict"), F.count_if(~F.col("strict")).alias("n_offending"))
    outcome = F.when(F.col("n_strict") + F.col("n_offending") == 0, "none found").when(F.col("n_offending") == 0, "all strict").otherwise("allowed" if allow else "refused")
    return n.select(outcome.alias("outcome"), "n_strict", "n_offending")


def certificates(halves: DataFrame, key: str, delta: float = 0.05) -> DataFrame:
    """key, least_cut, bound, ratio, certified of halved graphs.

    halves: key, lambda2 (second eigenvalue), n, area_a, area_b, outer_a,
    outer_b, achieved (mean compactness of the halves).  The ratio is null
    without a bound, which certifies nothing.
    """
    h = halves.withColumn("bound", bound(F.col("lambda2"), F.col("n"), F.col("area_a"), F.col("area_b"), F.col("outer_a"), F.col("outer_b")))
    share = F.when(F.col("bound") > 1e-14, F.col("achieved") / F.col("bound"))
    return h.select(key, r6(F.col("lambda2") * F.col("n") / 4).alias("least_cut"), r6("bound").alias("bound"), r6(share).alias("ratio"), F.coalesce(share >= 1 - delta, F.lit(False)).alias("certified"))


def pooled(traces: DataFrame) -> DataFrame:
    """All chains one after the other as one chain."""
    n = traces.groupBy("chain").agg(F.count("*").alias("n"))
    before = n.select("chain", (F.sum("n").over(Window.orderBy("chain")) - F.col("n")).alias("before"))  # a row per chain
    place = F.row_number().over(Window.partitionBy("chain").orderBy("step"))
    return traces.withColumn("place", place).join(F.broadcast(before), "chain").select(F.lit(0).cast("long").alias("chain"), (F.col("before") + F.col("place")).alias("step"), "value")


def validated_ensemble(traces: DataFrame, at: float, most: float = 1.05, least: float = 100.0) -> DataFrame:
    """n_chains, n_per_chain, r_hat, ess, percentile_rank, passed of one metric's equally long chains (chain, step, value).

    Strict: chains of other lengths, empty values and fewer than four chains are errors.  The
    effective size is that of the pooled chains; a run passes with r_hat under
    ``most`` and an effective size of ``least`` or more.
    """
    n = traces.groupBy("chain").agg(F.count("*").alias("n"), F.count("value").alias("v")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum(F.col("n") - F.col("v")).alias("lost")).first()
    if n["low"] != n["high"]:
        raise ValueError(f"chains have {n['low']} to {n['high']} steps: trim them first")
    if n["lost"]:
        raise ValueError(f"{n['lost']} steps lack the metric")
    e = ess(pooled(traces)).select("ess")
    out = r_hat(traces, most).join(F.broadcast(e)).join(F.broadcast(percentile_rank(traces, at)))
    passed = ~F.col("above_threshold") & (F.col("ess") >= least)
    return out.select("n_chains", "n_per_chain", "r_hat", r6("ess").alias("ess"), "percentile_rank", passed.alias("passed"))


def expected_files(states: DataFrame, outputs: DataFrame) -> DataFrame:
    """state, script, file, required that a run must leave; states: state, k; outputs: script, pattern, required.

    ``{round_num}`` and ``{round_regions}`` in a pattern stand for each round of
    halvings and its regions, k at most; a state of one district has no rounds.
    """
    s = states.select("state", "k", F.explode(F.filter(F.sequence(F.lit(0), depth_for(F.col("k"))), lambda r: (r > 0) | (r == 0))).alias("round"))
    per_round = F.col("pattern").contains("{round_num}")
    both = s.join(outputs, (F.col("round") > 0) == per_round)
    regions = F.least(F.expr("shiftleft(1, round)"), F.col("k"))
    name = F.replace(F.replace("pattern", F.lit("{round_num}"), F.col("round").cast("string")), F.lit("{round_regions}"), regions.cast("string"))
    return both.select("state", "script", name.alias("file"), "required")


def output_gaps(expected: DataFrame, found: DataFrame) -> DataFrame:
    """state, n_expected, n_found, n_missing (required), missing (those files in order), status."""
    f = found.select("state", "file").distinct().withColumn("there", F.lit(True))
    e = expected.distinct().join(f, ["state", "file"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    lost = F.col("required") & ~F.col("there")
    g = e.groupBy("state").agg(F.count("*").alias("n_expected"), F.count_if("there").alias("n_found"), F.count_if(lost).alias("n_missing"), F.array_join(F.array_sort(F.collect_list(F.when(lost, F.col("file")))), ";").alias("missing"))
    return g.withColumn("status", F.when(F.col("n_found") == 0, "nothing").when(F.col("n_missing") > 0, "incomplete").when(F.col("n_found") < F.col("n_expected"), "optional files missing").otherwise("complete"))


def minority_counts(shares: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """by, black, hispanic, asian, coalition, total: districts in which a group, or all minorities together, are over the threshold.

    total counts districts of any one group; coalitions are no part of it.
    shares: by, pct_black, pct_hispanic, pct_asian, pct_white.
    """
    over = {g: F.col(f"pct_{g}") > threshold for g in ("black", "hispanic", "asian")}
    any_one: Column = over["black"] | over["hispanic"] | over["asian"]
    return shares.groupBy(by).agg(*[F.count_if(c).alias(g) for g, c in over.items()], F.count_if(1 - F.col("pct_white") > threshold).alias("coalition"), F.count_if(any_one).alias("total"))


def minority_status(enacted: DataFrame, drawn: DataFrame, by: str) -> DataFrame:
    """by, enacted, drawn, status of two tables of ``minority_counts``; what one lacks counts 0."""
    e, d = (t.select(by, F.col("total").alias(n)) for t, n in ((enacted, "enacted"), (drawn, "drawn")))
    both = e.join(d, by, "full_outer").fillna(0, ["enacted", "drawn"])
    lost = F.col("enacted") - F.col("drawn")
    return both.withColumn("status", F.when(F.col("enacted") == 0, "N/A").when(lost <= 0, "Compliant").when(lost == 1, "At Risk").otherwise("Non-compliant"))


def model_size(edges: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """name and n of the variables and constraints of the least-cut integer program of a graph and k districts."""
    n = units.agg(F.count("*").alias("n")).join(F.broadcast(edges.agg(F.count_if(F.col("u") != F.col("v")).alias("e"))))
    v, e = F.col("n"), F.col("e")
    parts = {
        "x_binary": v * k, "z_binary": e, "flow": 2 * e * k, "coverage": v, "balance": F.lit(2 * k), "cut": 2 * e * k,
        "flow_bounds": 2 * e * k, "flow_conservation": F.greatest(v - 1, F.lit(0)) * k, "flow_root": F.lit(k),
    }
    sums = {"variables": ("x_binary", "z_binary", "flow"), "constraints": ("coverage", "balance", "cut", "flow_bounds", "flow_conservation", "flow_root")}
    total = {name: sum((parts[p] for p in some[1:]), parts[some[0]]) for name, some in sums.items()}
    return n.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.cast("long").alias("n")) for name, c in (parts | total).items()])).alias("x")).select("x.*")


def party_votes(units: DataFrame, results: DataFrame, splits: dict[str, float]) -> DataFrame:
    """geoid, party, votes: an area's votes over its units by their people, its third-party votes by fixed shares.

    units: geoid, area, vap; results: area, dem, rep, oth.  ``splits`` names
    the parties of ``oth`` with their shares.  Without people an area's units
    have equal parts; an area without result has no rows.
    """
    one = Window.partitionBy("area")
    u = units.withColumn("part", F.coalesce(ratio(F.col("vap"), F.sum("vap").over(one), None), 1 / F.count("*").over(one)))
    votes = {"dem": F.col("dem"), "rep": F.col("rep")} | {p: F.col("oth") * s for p, s in splits.items()}
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("party"), v.cast("double").alias("v")) for p, v in votes.items()]))
    r = results.select("area", rows.alias("x")).select("area", "x.*")
    return u.select("geoid", "area", "part").join(r, "area").select("geoid", "party", r6(F.col("v") * F.col("part")).alias("votes"))


def coarse_units(units: DataFrame, edges: DataFrame, prefix: int = 5) -> tuple[DataFrame, DataFrame]:
    """((unit, population, n_units), (u, v, n_edges, w)) of the units that share the first ``prefix`` digits; units: geoid, pop.

    A code shorter than the prefix is an error.
    """
    whole = F.when(F.length("geoid") >= prefix, F.substring("geoid", 1, prefix)).otherwise(F.raise_error(F.concat(F.lit("no county in "), "geoid")))
    from .graph import coarsen

    return units.select(whole.alias("unit"), "pop").groupBy("unit").agg(F.sum("pop").alias("population"), F.count("*").alias("n_units")), coarsen(edges, units, prefix)
