"""Boundaries of polygons with holes: who touches whom along what length, and dissolve to polygons.

Polygons are arrays of polygons, each an array of an outer ring and its holes;
rings are arrays of (x, y) without the repeated last point.  Coordinates are
snapped to a grid of ``snap`` units; on it, lines and touching are exact, so
sides need not be equal: two units that share part of a line are neighbours
along that part, whatever vertices either has (T-junctions), and a side may have
three and more holders.  Grid numbers must stay under 2^30 (10,000 km at 1 cm).

Sides are cut at multiples of ``cell`` along their longer axis and meet by line
and cut, vertices meet sides by grid cell: joins on keys that hold what lies in
one place, with no step over all pairs.  A null or empty geometry touches
nothing; rings under three points are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contains, polygons_perimeter, signed_area
from .graph import cut, written
from .roll_ups import greatest_divisor

#: Length that stands for a contact at points, and for water without any land boundary.
POINT_LENGTH, NO_LAND = 0.1, 100.0


def sides(units: DataFrame, key: str, snap: float, closed: bool = False) -> DataFrame:
    """key, ax, ay, bx, by in grid numbers, of all rings; with ``closed``, the polygon lies to the left of a side."""
    at = lambda v: F.round(v / snap).cast("long")
    rings = units.select(key, F.explode("polygons").alias("p")).select(key, F.posexplode("p").alias("role", "r")).where(F.size("r") >= 3)
    turned = (F.col("role") == 0) != (signed_area(F.col("r")) > 0) if closed else F.lit(False)
    n = F.size("r")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("r", i).alias("p"), F.get("r", (i + 1) % n).alias("q")))
    s = rings.select(key, turned.alias("turned"), F.explode(pair).alias("s"))
    end = lambda first, c: F.when(F.col("turned"), at(F.col(f"s.{'q' if first else 'p'}.{c}"))).otherwise(at(F.col(f"s.{'p' if first else 'q'}.{c}")))
    return s.select(key, end(True, "x").alias("ax"), end(True, "y").alias("ay"), end(False, "x").alias("bx"), end(False, "y").alias("by")).where("ax <> bx OR ay <> by")


def _cut_along(s: DataFrame, cell: int) -> DataFrame:
    """Sides with line (px, py, c), steep, and one row per cut: k, lo, hi on the longer axis."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    g = greatest_divisor(F.abs(dx), F.abs(dy))
    flip = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1).otherwise(1)
    s = s.withColumn("g", g * flip).withColumns({"px": F.expr("(bx - ax) DIV g"), "py": F.expr("(by - ay) DIV g")})
    s = s.withColumns({"c": F.col("px") * F.col("ay") - F.col("py") * F.col("ax"), "steep": F.abs("py") > F.abs("px")})
    axis = lambda f: F.when(F.col("steep"), f("ay", "by")).otherwise(f("ax", "bx"))
    s = s.withColumns({"lo": axis(F.least), "hi": axis(F.greatest)})
    s = s.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    return s.withColumns({"lo": F.greatest("lo", F.col("k") * cell), "hi": F.least("hi", (F.col("k") + 1) * cell)}).drop("g")


def _placed(pieces: DataFrame, cell: int) -> DataFrame:
    """Pieces of sides by the grid cells (cx, cy) that they pass, with one number of margin."""
    line = lambda t: F.when(F.col("steep"), (F.col("px") * F.col(t) - F.col("c")) / F.col("py")).otherwise((F.col("c") + F.col("py") * F.col(t)) / F.col("px"))
    over = F.explode(F.sequence(F.floor((F.least(line("lo"), line("hi")) - 1) / cell), F.floor((F.greatest(line("lo"), line("hi")) + 1) / cell)))
    # the end of a cut belongs to the next cell as well
    p = pieces.withColumn("other", over).withColumn("k", F.explode(F.array_distinct(F.array("k", F.floor(F.col("hi") / cell)))))
    return p.withColumns({"cx": F.when(F.col("steep"), F.col("other")).otherwise(F.col("k")), "cy": F.when(F.col("steep"), F.col("k")).otherwise(F.col("other"))}).drop("other")


def _distance2() -> Column:
    """Squared distance in grid numbers of the point (x, y) to the side a-b; 0 exactly where it lies on it."""
    d = lambda c: F.col(c).cast("double")
    dx, dy, wx, wy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    dot, long2 = dx * wx + dy * wy, dx * dx + dy * dy
    cross = (dx * wy - dy * wx).cast("double")
    end = (d("x") - d("bx")) * (d("x") - d("bx")) + (d("y") - d("by")) * (d("y") - d("by"))
    return F.when(dot <= 0, (wx * wx + wy * wy).cast("double")).when(dot >= long2, end).otherwise(cross * cross / long2)


def contacts(units: DataFrame, snap: float = 0.01, cell: float = 1000.0, reach: float = 0.0) -> DataFrame:
    """u < v, length of the shared boundary (0 if they touch at points or not at all), gap between them; units: geoid, polygons.

    Pairs farther apart than ``reach`` are left out.  Units whose interiors
    overlap are told by the boundaries only.
    """
    far = round(reach / snap)
    size = max(round(cell / snap), far, 4)
    pieces = cut(_cut_along(sides(units, "geoid", snap), size))
    of = pieces.select("px", "py", "c", "k", "lo", "hi", "geoid")
    a, b = of.alias("a"), of.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("px", "py", "c", "k")]
    both = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    scale = F.hypot("a.px", "a.py") / F.greatest(F.abs("a.px"), F.abs("a.py")) * snap
    land = a.join(b, [*same, F.col("a.geoid") < F.col("b.geoid")]).where(both > 0).groupBy(F.col("a.geoid").alias("u"), F.col("b.geoid").alias("v")).agg(F.sum(both * scale).alias("length"))
    near = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor((F.col("t") + i * far) / size))))
    points = pieces.select("geoid", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("geoid", "p.*").distinct()
    points = points.withColumn("t", F.col("x")).withColumn("cx", near).withColumn("t", F.col("y")).withColumn("cy", near).drop("t")
    there = _placed(pieces, size).select(F.col("geoid").alias("other"), "ax", "ay", "bx", "by", "cx", "cy")
    met = points.join(there, ["cx", "cy"]).where("geoid <> other").select(F.least("geoid", "other").alias("u"), F.greatest("geoid", "other").alias("v"), _distance2().alias("d2"))
    gaps = met.where(F.col("d2") <= float(far) ** 2).groupBy("u", "v").agg(F.min("d2").alias("d2"))
    return gaps.join(land, ["u", "v"], "left").select("u", "v", F.coalesce("length", F.lit(0.0)).alias("length"), (F.sqrt("d2") * snap).alias("gap"))


def median(df: DataFrame, column: str) -> float | None:
    """Exact median; starts jobs.  A sketch bounds the rank to a ten-thousandth, and only values between are counted."""
    x = df.select(F.col(column).cast("double").alias("x")).dropna()
    n, ends = x.agg(F.count("*"), F.percentile_approx("x", [0.499, 0.501], F.lit(10_000))).first()
    if not n:
        return None
    lo, hi = ends
    below = x.where(F.col("x") < lo).count()
    band = sorted((r["x"], r["count"]) for r in x.where(F.col("x").between(lo, hi)).groupBy("x").count().collect())  # a five-hundredth of the values
    at, found = below, []
    for value, count in band:
        found += [value for rank in ((n - 1) // 2, n // 2) if at <= rank < at + count]
        at += count
    return sum(found) / 2


def boundary_graph(units: DataFrame, least: float = 10.0, **where) -> DataFrame:
    """u, v, kind, w: neighbours along a boundary, at points and over water; units: geoid, polygons, projected in metres.

    w is the shared length (land), 0.1 (point) or the median of the land
    lengths (water); edges under ``least`` are left out.  Coordinates that all
    look like degrees are an error.
    """
    p = lambda c: F.max(F.array_max(F.transform(F.flatten(F.flatten("polygons")), lambda q: F.abs(q[c]))))
    x, y = units.agg(p("x"), p("y")).first()
    if x is not None and x <= 180 and y <= 90:
        raise ValueError(f"coordinates up to {x}, {y} look like degrees: project them first")
    c = cut(contacts(units, **where))
    return _weighed(c, median(c.where("length > 0"), "length")).where(F.col("w") >= least)


def _weighed(c: DataFrame, middle: float | None) -> DataFrame:
    kind = F.when(F.col("length") > 0, "land").when(F.col("gap") == 0, "point").when(F.col("gap").isNotNull(), "water").otherwise("error")
    c = c.withColumn("kind", kind)
    w = F.when(F.col("kind") == "land", F.col("length")).when(F.col("kind") == "point", POINT_LENGTH).otherwise(NO_LAND if middle is None else middle)
    return c.select("u", "v", "kind", w.alias("w"))


def edge_lengths(edges: DataFrame, units: DataFrame, **where) -> DataFrame:
    """u, v, kind, w of given edges, for instance of queen contiguity with bridges.

    Edges without contact are water however far; edges of a unit without
    geometry are errors; both get the median of the land lengths.
    """
    have = units.where(F.size(F.coalesce("polygons", F.array())) > 0).select("geoid")
    c = cut(edges.select("u", "v").join(contacts(units, **where), ["u", "v"], "left"))
    for end in ("u", "v"):
        c = c.join(have.select(F.col("geoid").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    apart = F.when(F.col("has_u") & F.col("has_v"), F.coalesce("gap", F.lit(float("inf"))))
    c = c.select("u", "v", F.coalesce("length", F.lit(0.0)).alias("length"), apart.alias("gap"))
    return _weighed(c, median(c.where("length > 0"), "length"))


def external_perimeters(units: DataFrame, graph: DataFrame) -> DataFrame:
    """geoid, external: all rings' length less the weights of a unit's edges, 0 at least."""
    shared = graph.select(F.explode(F.array("u", "v")).alias("geoid"), "w").groupBy("geoid").agg(F.sum("w").alias("shared"))
    whole = units.select("geoid", F.coalesce(polygons_perimeter(F.col("polygons")), F.lit(0.0)).alias("whole"))
    return whole.join(shared, "geoid", "left").select("geoid", F.greatest(F.col("whole") - F.coalesce("shared", F.lit(0.0)), F.lit(0.0)).alias("external"))


def _uncancelled(s: DataFrame) -> DataFrame:
    """Directed sides of a district that no other of its sides undoes; two in one direction mean that units overlap."""
    first = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pick = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    n = s.select("district", pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"), F.when(first, 1).otherwise(-1).alias("n"))
    n = n.groupBy("district", "ax", "ay", "bx", "by").agg(F.sum("n").alias("n")).where("n <> 0")
    turn = lambda yes, no: F.when(F.col("n") > 0, F.col(yes)).otherwise(F.col(no)).alias(yes)
    checked = F.when(F.abs("n") == 1, F.col("district")).otherwise(F.raise_error(F.concat(F.lit("units overlap in district "), F.col("district").cast("string"))).cast("int"))
    return n.select(checked.alias("district"), turn("ax", "bx"), turn("ay", "by"), turn("bx", "ax"), turn("by", "ay"))


def outlines(units: DataFrame, snap: float = 0.01, cell: float = 1000.0) -> DataFrame:
    """Directed boundary sides (district, ax, ay, bx, by) of the union of a district's units, the union to their left.

    Sides are first cancelled whole, then cut at every vertex that lies on
    them, then cancelled again.
    """
    s = cut(_uncancelled(sides(units, "district", snap, closed=True)))
    size = max(round(cell / snap), 4)
    ends = s.select("district", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("district", "p.*").distinct()
    ends = ends.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    key = ["district", "ax", "ay", "bx", "by"]
    placed = _placed(_cut_along(s, size), size).select(*key, "cx", "cy")
    inner = ((F.col("x") != F.col("ax")) | (F.col("y") != F.col("ay"))) & ((F.col("x") != F.col("bx")) | (F.col("y") != F.col("by")))
    on = placed.join(ends.hint("merge"), ["district", "cx", "cy"]).where(inner & (_distance2() == 0)).select(*key, F.struct(F.abs(F.col("x") - F.col("ax")) + F.abs(F.col("y") - F.col("ay")), "x", "y").alias("p"))
    cuts = on.groupBy(*key).agg(F.sort_array(F.collect_set("p")).alias("p"))
    at = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), F.coalesce(F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))), F.array()), F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    parts = s.join(cuts.hint("merge"), key, "left").select("district", at.alias("q"))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.size("q") - 2), lambda i: F.struct(F.get("q", i).alias("a"), F.get("q", i + 1).alias("b"))))
    parts = parts.select("district", steps.alias("s")).select("district", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    return _uncancelled(parts)


def traced(half: DataFrame) -> DataFrame:
    """district, ring (its smallest side), place, x, y: sides linked to rings by pointer doubling.

    A side goes on with the outgoing side that is first clockwise from the way
    back, so that polygons which meet at a point get rings of their own.  Both
    loops need as many rounds as the longest ring has binary digits.  Rounds ask
    for merge joins: numbers pack so well that a table of many sides would pass
    for small by its file, and go to the driver and back each round.
    """
    h = written(half.withColumn("id", F.monotonically_increasing_id()))
    out = h.select("district", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("to"), F.col("id").alias("next"))
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    turn = F.pmod(back - F.col("to"), F.lit(6.283185307179586))
    linked = h.join(out.hint("merge"), ["district", "bx", "by"]).groupBy("id").agg(F.min_by("next", F.when(turn > 1e-12, turn).otherwise(7.0)).alias("next"))
    low = written(linked.select("id", "next", F.col("next").alias("ptr"), F.least("id", "next").alias("low")))
    follow = lambda t, *more: t.select(F.col("id").alias("ptr"), F.col("ptr").alias("onward"), *more).hint("merge")
    while True:
        after = low.join(follow(low, F.col("low").alias("seen")), "ptr").select("id", "next", F.col("onward").alias("ptr"), F.least("low", "seen").alias("low"), (F.col("seen") < F.col("low")).alias("moved"))
        low = written(after)
        if low.where("moved").isEmpty():
            break
    root = F.col("id") == F.col("low")
    far = written(low.select("id", "low", F.when(root, F.col("id")).otherwise(F.col("next")).alias("ptr"), F.when(root, 0).otherwise(1).alias("steps")))
    while not far.where("ptr <> low").isEmpty():
        far = written(far.join(follow(far, F.col("steps").alias("more")), "ptr").select("id", "low", F.col("onward").alias("ptr"), (F.col("steps") + F.col("more")).alias("steps")))
    place = F.when(F.col("steps") == 0, -(1 << 60)).otherwise(-F.col("steps"))
    return h.join(far.hint("merge"), "id").select("district", F.col("low").alias("ring"), place.alias("place"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def dissolve(units: DataFrame, snap: float = 0.01, cell: float = 1000.0) -> DataFrame:
    """district, polygons: the union of each district's units (district int, polygons) as polygons with holes, largest first.

    Rings hold no vertex on a straight line; counterclockwise ones are outer,
    and a hole goes to the smallest outer ring around it.  One district's
    rings are one row, as the result wants.
    """
    t = traced(outlines(units, snap, cell)).groupBy("district", "ring").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    n = F.size("r")
    bent = lambda p, i: (F.get("r", (i + n - 1) % n)["x"] - p["x"]) * (F.get("r", (i + 1) % n)["y"] - p["y"]) != (F.get("r", (i + n - 1) % n)["y"] - p["y"]) * (F.get("r", (i + 1) % n)["x"] - p["x"])
    t = t.withColumn("r", F.filter("r", bent)).withColumn("r", F.transform("r", lambda p: F.struct((p["x"] * snap).alias("x"), (p["y"] * snap).alias("y"))))
    t = cut(t.withColumn("area", signed_area(F.col("r"))))
    side = lambda f, c: f(F.transform("r", lambda p: p[c]))
    outer = t.where("area > 0").select("district", "ring", "r", "area", side(F.array_min, "x").alias("x0"), side(F.array_max, "x").alias("x1"), side(F.array_min, "y").alias("y0"), side(F.array_max, "y").alias("y1"))
    middle = lambda c: (F.col("r")[0][c] + F.col("r")[1][c]) / 2
    holes = t.where("area < 0").select("district", F.col("ring").alias("hole"), F.col("r").alias("inner"), middle("x").alias("x"), middle("y").alias("y"))
    home = holes.join(outer, "district").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").where(contains(F.col("r"), F.col("x"), F.col("y")))
    home = home.groupBy("district", "hole").agg(F.min_by("ring", F.struct("area", "ring")).alias("ring"), F.first("inner").alias("inner"))
    owned = home.groupBy("district", "ring").agg(F.sort_array(F.collect_list("inner")).alias("holes"))
    whole = outer.join(owned, ["district", "ring"], "left").select("district", F.struct((-F.col("area")).alias("a"), F.concat(F.array("r"), F.coalesce("holes", F.array())).alias("p")).alias("s"))
    return whole.groupBy("district").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"]).alias("polygons"))
