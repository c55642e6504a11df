"""Graph operators over edge tables (u < v, w) and edge-weight transforms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .attributes import r6


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{base}/graph-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, for loops that join a table with itself.

    A checkpoint keeps the planner's estimate of its size, which such a loop
    squares each round until the estimate itself takes the time; a written
    table has its own size.
    """
    path = scratch(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """For joins with a table that grows with the units: the planner would pass one whose files are small, but not its rows, whole through the driver."""
    return df.hint("merge")


def labelled(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Edges with the districts of their ends."""
    ends = [merged(plan.select(F.col("geoid").alias(c), F.col("district").alias(f"d{c}"))) for c in "uv"]
    return edges.join(ends[0], "u").join(ends[1], "v")


def cut_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    e = labelled(edges, plan)
    return e.agg(F.count_if(F.col("du") != F.col("dv")).alias("n_cut"), F.coalesce(F.sum(F.when(F.col("du") != F.col("dv"), F.col("w"))), F.lit(0.0)).alias("weight_cut"), F.count("*").alias("n_edges"))


def adjacent_pairs(edges: DataFrame, plan: DataFrame) -> DataFrame:
    e = labelled(edges, plan).where("du <> dv")
    return e.groupBy(F.least("du", "dv").alias("d1"), F.greatest("du", "dv").alias("d2")).agg(F.count("*").alias("n_edges"))


def coarsen(edges: DataFrame, units: DataFrame, prefix: int = 5) -> DataFrame:
    """Distinct pairs of coarse units whose members touch."""
    cu, cv = F.substring("u", 1, prefix), F.substring("v", 1, prefix)
    return edges.select(F.least(cu, cv).alias("u"), F.greatest(cu, cv).alias("v"), "w").where("u <> v").groupBy("u", "v").agg(F.count("*").alias("n_edges"), F.sum("w").alias("w"))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node of each connected component, by contraction.

    In each round a node joins the one of least hash among itself and its
    neighbours, and the edges between those joined are the next round's graph.
    It shrinks by a part each time, so that all rounds cost a few times the
    first.  Labels then go back through the rounds.
    """
    e = written(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct())
    levels: list[DataFrame] = []  # of each round: node a, the node that it joins, smallest node that a stands for
    lows = lambda t: t.groupBy("to").agg(F.min("low").alias("low"))
    while not e.isEmpty():
        if len(levels) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["n"].alias("to"))
        low = F.col("a").alias("low")
        if levels:
            step, low = step.join(merged(lows(levels[-1]).withColumnRenamed("to", "a")), "a"), F.col("low")
        levels.append(written(step.select("a", "to", low)))
        end = lambda c: merged(levels[-1].select(F.col("a").alias(c), F.col("to").alias(f"to_{c}")))
        e = e.join(end("a"), "a").join(end("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        e = written(e.where("a <> b").distinct())
    found = None
    for i, step in reversed(list(enumerate(levels))):
        least = lows(step)
        if found is not None:  # what has no edge in the next round is whole
            least = least.join(merged(found.withColumnRenamed("node", "to")), "to", "left").select("to", F.coalesce("component", "low").alias("low"))
        found = step.select("a", "to").join(merged(least), "to").select(F.col("a").alias("node"), F.col("low").alias("component"))
        if i % 3 == 0:
            found = written(found)
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(merged(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def contiguity(edges: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """Components of each district; an empty district is contiguous; units outside the largest component are stranded."""
    inside = labelled(edges, plan).where("du = dv").select("u", "v")
    comp = components(inside, plan.select(F.col("geoid").alias("node"))).join(merged(plan.withColumnRenamed("geoid", "node")), "node")
    sizes = comp.groupBy("district", "component").agg(F.count("*").alias("n"))
    d = sizes.groupBy("district").agg(F.sum("n").alias("tract_count"), F.count("*").alias("component_count"), (F.sum("n") - F.max("n")).alias("disconnected"))
    axis = plan.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("district"))
    return axis.join(F.broadcast(d), "district", "left").fillna(0).select("district", (F.col("component_count") <= 1).alias("contiguous"), "tract_count", "component_count", "disconnected")


def subset_polsby_popper(edges: DataFrame, plan: DataFrame, units: DataFrame) -> DataFrame:
    """4 pi area / (outer boundary + crossing edges)^2 of each district; 0 without a perimeter."""
    area = units.join(plan, "geoid").groupBy("district").agg(F.sum("area").alias("area"), F.sum("outer").alias("outer"))
    e = labelled(edges, plan).where("du <> dv")
    crossing = e.select(F.explode(F.array("du", "dv")).alias("district"), "w").groupBy("district").agg(F.sum("w").alias("crossing"))
    per = F.col("outer") + F.coalesce("crossing", F.lit(0.0))
    return area.join(crossing, "district", "left").select("district", r6(F.when(per > 0, 4 * F.pi() * F.col("area") / (per * per)).otherwise(0.0)).alias("pp"))


def share_weights(edges: DataFrame, shares: DataFrame, threshold: float) -> DataFrame:
    """Edges with both ends at or over the threshold, alpha = max(3, 10 (1 - 0.7 f)), f the part of such units."""
    f = shares.agg(F.avg(F.when(F.col("share") >= threshold, 1.0).otherwise(0.0)).alias("f"))
    high = shares.where(F.col("share") >= threshold).select("geoid")
    kept = edges.join(high.withColumnRenamed("geoid", "u"), "u", "left_semi").join(high.withColumnRenamed("geoid", "v"), "v", "left_semi")
    return kept.join(F.broadcast(f)).select("u", "v", r6(F.greatest(F.lit(3.0), 10 * (1 - 0.7 * F.col("f")))).alias("alpha"))


def with_ends(edges: DataFrame, units: DataFrame, column: str) -> DataFrame:
    ends = [merged(units.select(F.col("geoid").alias(c), F.col(column).alias(f"x{c}"))) for c in "uv"]
    return edges.join(ends[0], "u", "left").join(ends[1], "v", "left")


def lean_weights(edges: DataFrame, shares: DataFrame, high: float = 0.55, low: float = 0.45) -> DataFrame:
    """Edges whose ends lean strongly to one side."""
    strong = (F.col("share") >= high) | (F.col("share") <= low)
    f = shares.agg(F.avg(F.when(strong, 1.0).otherwise(0.0)).alias("f"))
    e = with_ends(edges, shares, "share").where(((F.col("xu") >= high) & (F.col("xv") >= high)) | ((F.col("xu") <= low) & (F.col("xv") <= low)))
    return e.join(F.broadcast(f)).select("u", "v", r6(F.greatest(F.lit(3.0), 10 * (1 - 0.7 * F.col("f")))).alias("alpha"))


def similarity_weights(edges: DataFrame, shares: DataFrame, alpha: float, tau: float) -> DataFrame:
    return with_ends(edges, shares, "share").where(F.abs(F.col("xu") - F.col("xv")) < tau).select("u", "v", F.lit(alpha).alias("alpha"))


def subdivision_weights(edges: DataFrame, alphas: dict[int, float]) -> DataFrame:
    """w (1 + sum of alpha over geoid prefixes that both ends share)."""
    add = sum((F.when(F.substring("u", 1, n) == F.substring("v", 1, n), a).otherwise(0.0) for n, a in alphas.items()), F.lit(0.0))
    return edges.select("u", "v", r6(F.col("w") * (1 + add)).alias("w"))


def community_weights(edges: DataFrame, units: DataFrame, column: str) -> DataFrame:
    """w (1 + mean of the ends' scores), missing scores 0."""
    e = with_ends(edges, units, column)
    return e.select("u", "v", r6(F.col("w") * (1 + (F.coalesce("xu", F.lit(0.0)) + F.coalesce("xv", F.lit(0.0))) / 2)).alias("w"))


def cross_lean(edges: DataFrame, shares: DataFrame, factor: float = 0.1) -> DataFrame:
    e = with_ends(edges, shares, "share")
    return e.select("u", "v", r6(F.when((F.col("xu") >= 0.5) != (F.col("xv") >= 0.5), F.col("w") * factor).otherwise(F.col("w"))).alias("w"))


def boundary_penalty(edges: DataFrame, beta: float, prefix: int = 2) -> DataFrame:
    return edges.select("u", "v", r6(F.when(F.substring("u", 1, prefix) != F.substring("v", 1, prefix), F.col("w") * (1 + beta)).otherwise(F.col("w"))).alias("w"))


def graph_checks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    e = edges.agg(F.count_if(F.col("u") == F.col("v")).alias("loops"), (F.count("*") - F.count_distinct("u", "v")).alias("repeated"), F.count_if(F.col("w") <= 0).alias("non_positive"))
    lost = edges.select(F.explode(F.array("u", "v")).alias("node")).join(n, "node", "left_anti").agg(F.count("*").alias("unknown_ends"))
    return e.join(F.broadcast(lost))


def metis_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line 0 with nodes, edges and format, then a line per node: weight, 1-based neighbours and scaled edge weights.  ``nodes``: geoid, number (from 1), weight."""
    num = nodes.select("geoid", "number")
    e = edges.join(merged(num.select(F.col("geoid").alias("u"), F.col("number").alias("a"))), "u").join(merged(num.select(F.col("geoid").alias("v"), F.col("number").alias("b"))), "v")
    both = e.select("a", "b", "w").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    rows = both.groupBy(F.col("a").alias("number")).agg(F.array_sort(F.collect_list(F.struct("b", F.round(F.col("w") * 1000).cast("long").alias("w")))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: F.concat_ws(" ", x["b"].cast("string"), x["w"].cast("string"))), " ")
    lines = nodes.join(rows, "number", "left").select(F.col("number").cast("long").alias("number"), F.trim(F.concat_ws(" ", F.col("weight").cast("string"), text)).alias("line"))
    head = nodes.agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("m")))).select(F.lit(0).cast("long").alias("number"), F.concat_ws(" ", F.col("n").cast("string"), F.col("m").cast("string"), F.lit("011")).alias("line"))
    return head.union(lines)


def largest_components(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """geoid, district, component, size, main: the components of each district; main is its largest, ties to the one of least geoid."""
    inside = labelled(edges, plan).where("du = dv").select("u", "v")
    comp = components(inside, plan.select(F.col("geoid").alias("node"))).withColumnRenamed("node", "geoid").join(merged(plan), "geoid")
    sizes = comp.groupBy("district", "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy("district").agg(F.min(F.struct((-F.col("size")).alias("s"), "component"))["component"].alias("best"))
    return comp.join(merged(sizes), ["district", "component"]).join(F.broadcast(best), "district").select("geoid", "district", "component", "size", (F.col("component") == F.col("best")).alias("main"))


def chamber_adjacency(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """d1 < d2 of districts whose main components touch, with the number of edges between these."""
    main = largest_components(edges, plan).where("main").select("geoid", "district")
    return adjacent_pairs(edges, main)


def bridges(edges: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """u < v: each unit outside the largest component joins the nearest unit of that one, of its own county if there is any.  points: geoid, x, y."""
    whole = points.select("geoid", F.lit(1).alias("district"))
    comp = largest_components(edges, whole).select("geoid", "main")
    at = points.join(merged(comp), "geoid").select(F.col("geoid").alias("id"), "x", "y", F.substring("geoid", 1, 5).alias("county"), "main")
    at = written(at)
    main, rest = at.where("main"), at.where(~F.col("main"))
    from .spatial import nearest_points

    own = nearest_points(rest, main, cell, "county")
    other = nearest_points(rest.join(merged(own.select("id")), "id", "left_anti"), main, cell)
    return own.union(other).select(F.least("id", "to").alias("u"), F.greatest("id", "to").alias("v")).distinct()


def augment_by_class(edges: DataFrame, shares: DataFrame, threshold: float) -> DataFrame:
    """w times 2 if both ends or none are at or over the threshold, else times 0.5; a missing share is 0."""
    high = lambda c: F.coalesce(c, F.lit(0.0)) >= threshold
    e = with_ends(edges, shares, "share")
    return e.select("u", "v", r6(F.col("w") * F.when(high("xu") == high("xv"), 2.0).otherwise(0.5)).alias("w"))


def minor_axis(points: DataFrame) -> DataFrame:
    """angle: direction of least variance of (lat, lon); null under two points."""
    p = points.agg(F.var_pop("lat").alias("a"), F.covar_pop("lat", "lon").alias("c"), F.var_pop("lon").alias("b"), F.count("*").alias("n"))
    least = (F.col("a") + F.col("b")) / 2 - F.sqrt(((F.col("a") - F.col("b")) / 2) * ((F.col("a") - F.col("b")) / 2) + F.col("c") * F.col("c"))
    slanted = F.atan2("c", least - F.col("a"))
    angle = F.when(F.abs("c") > 1e-12, slanted).otherwise(F.when(F.col("a") < F.col("b"), F.pi() / 2).otherwise(0.0))
    return p.select(F.when(F.col("n") >= 2, angle).alias("angle"))


def directional_penalty(edges: DataFrame, points: DataFrame, strength: float) -> DataFrame:
    """w (1 + strength |sin|) of the angle between an edge and the minor axis of all points (geoid, lat, lon)."""
    for end in "uv":
        edges = edges.join(merged(points.select(F.col("geoid").alias(end), F.col("lat").alias(f"lat_{end}"), F.col("lon").alias(f"lon_{end}"))), end, "left")
    turn = F.atan2(F.col("lat_v") - F.col("lat_u"), F.col("lon_v") - F.col("lon_u")) - F.col("angle")
    return edges.join(F.broadcast(minor_axis(points))).select("u", "v", r6(F.col("w") * (1 + strength * F.abs(F.sin(F.coalesce(turn, F.lit(0.0)))))).alias("w"))


def composed(edges: DataFrame, *steps) -> DataFrame:
    """Edge transforms one after the other, each on the weights of the one before."""
    for step in steps:
        edges = step(edges)
    return edges


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of either set; of one in both, the greater weight."""
    return a.select("u", "v", "w").union(b.select("u", "v", "w")).groupBy("u", "v").agg(F.max("w").alias("w"))


def structure_checks(directed: DataFrame, nodes: DataFrame) -> DataFrame:
    """rule and number of violations of neighbour lists (u, v, w, each edge both ways) over ``nodes`` (node).

    asymmetric: pairs of which one way is missing or has another weight;
    loops; repeated; unknown_ends; isolated: nodes without a neighbour;
    components: connected parts beyond the first.
    """
    d = directed.select("u", "v", F.col("w").cast("double").alias("w"))
    one = written(d.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("w").alias("w")))  # each rule reads it
    both = one.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.col("u") < F.col("v")).alias("up"), "w")
    pairs = both.groupBy("a", "b").agg(F.count_distinct("up").alias("ways"), F.min("w").alias("low"), F.max("w").alias("high"))
    n = written(nodes.select("node").distinct())
    rules = {
        "asymmetric": pairs.where((F.col("ways") < 2) | (F.col("low") != F.col("high"))).agg(F.count("*").alias("n")),
        "loops": one.agg(F.count_if(F.col("u") == F.col("v")).alias("n")),
        "repeated": one.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")),
        "unknown_ends": one.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(merged(n), "node", "left_anti").agg(F.count("*").alias("n")),
        "isolated": n.join(merged(one.where("u <> v").select(F.explode(F.array("u", "v")).alias("node"))), "node", "left_anti").agg(F.count("*").alias("n")),
        "components": components(one.select("u", "v"), n).agg(F.greatest(F.count_distinct("component") - 1, F.lit(0)).alias("n")),
    }
    out = None
    for name, t in rules.items():
        row = t.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("violations"))
        out = row if out is None else out.union(row)
    return out
