"""Joins on places: grid-binned box join, point in polygon with nearest fallback, and dissolve by cancelling shared sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, merged
from ..functions.geometry import contains, distance2


def _cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    return df.withColumn("cx", span(x0, x1)).withColumn("cy", span(y0, y1))


def overlapping_boxes(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs a < b of closed boxes (id, x0, y0, x1, y1) that meet.

    A box has the level at which it covers four cells at most, cells of level n
    being ``cell`` times 2 ** n wide, and meets others in the cells of the
    higher of two levels: it lies in its own level's cells, and in those of
    every higher level that some box has.  A pair counts in the one cell that
    holds the lower left corner of its overlap.  A box with a null bound meets
    nothing.
    """
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / cell
    level = F.when(span > 1, F.ceil(F.log2(F.greatest(span, F.lit(1.0))))).otherwise(0).cast("int")
    own = cut(boxes.dropna().withColumn("level", level))
    levels = sorted(r["level"] for r in own.select("level").distinct().collect())  # one per doubling of size
    wide = lambda: F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("at"))
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / wide()), F.floor(F.col(b) / wide())))
    tile = lambda d: d.withColumn("cx", reach("x0", "x1")).withColumn("cy", reach("y0", "y1"))
    big = tile(own.withColumn("at", F.col("level"))).alias("a")
    small = tile(own.withColumn("at", F.explode(F.filter(F.array(*[F.lit(n) for n in levels]) if levels else F.array(F.lit(0)), lambda n: n >= F.col("level"))))).alias("b")
    once = (F.col("b.level") < F.col("a.level")) | (F.col("a.id") < F.col("b.id"))
    pairs = big.join(small, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("at", "cx", "cy")]).where(once & (F.col("a.id") != F.col("b.id")))
    left, low = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    meets = (left <= F.least("a.x1", "b.x1")) & (low <= F.least("a.y1", "b.y1"))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("a.at"))
    home = (F.floor(left / size) == F.col("a.cx")) & (F.floor(low / size) == F.col("a.cy"))
    return pairs.where(meets & home).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def _around(df: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) once in each of the nine cells around them."""
    step = F.sequence(F.lit(-1), F.lit(1))
    d = df.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    return d.withColumns({"cx": F.floor(F.col("x") / cell) + F.col("dx"), "cy": F.floor(F.col("y") / cell) + F.col("dy")}).drop("dx", "dy")


def _extent(*tables: DataFrame) -> float:
    """The larger side of the box around points (x, y); 0 without any."""
    box = None
    for t in tables:
        b = t.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        box = b if box is None else box.union(b)
    b = box.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    return 0.0 if b[0] is None else float(max(b[1] - b[0], b[3] - b[2]))


def _widening(points: DataFrame, key: str, cell: float, widest: float, search) -> DataFrame:
    """``search(points in nine cells, cell)`` gives (key, d2, ...) of the best met; cells double until all is sure or the cells are as wide as everything.

    What lies within one cell's width can't be missed by nine cells.  Starts
    jobs, one round per doubling.
    """
    left, done = points, None
    while True:
        found = search(_around(left, cell), cell)
        if cell >= widest:
            return found if done is None else done.union(found)
        sure = cut(found.where(F.col("d2") <= cell**2))
        done = sure if done is None else done.union(sure)
        left = cut(left.join(merged(sure.select(key)), key, "left_anti"))
        if left.isEmpty():
            return done
        cell *= 2


def locate(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """geoid, district: the smallest district whose ring holds the point, else the one of the nearest ring.

    Points: geoid, x, y. Polygons: district, ring. Rings spread over the grid
    cells of their boxes and points join on their cell; points outside every
    ring look in nine cells, which double until the nearest ring is sure.  A
    point without coordinates has no district.
    """
    over = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    tiles = lambda c: _cells(polygons, over(F.array_min, "x"), over(F.array_min, "y"), over(F.array_max, "x"), over(F.array_max, "y"), c)
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    inside = at.join(tiles(cell), ["cx", "cy"]).where(contains(F.col("ring"), F.col("x"), F.col("y"))).groupBy("geoid").agg(F.min("district").alias("district"))
    rest = cut(points.dropna(subset=["x", "y"]).join(inside, "geoid", "left_anti"))
    if rest.isEmpty():
        return inside

    def search(looking: DataFrame, c: float) -> DataFrame:
        met = looking.join(tiles(c), ["cx", "cy"]).select("geoid", F.struct(distance2(F.col("ring"), F.col("x"), F.col("y")).alias("d"), "district").alias("m"))
        return met.groupBy("geoid").agg(F.min("m").alias("m")).select("geoid", F.col("m.d").alias("d2"), F.col("m.district").alias("district"))

    corners = polygons.select(F.explode("ring").alias("p")).select("p.x", "p.y")
    near = _widening(rest, "geoid", cell, _extent(rest.select("x", "y"), corners), search)
    return inside.union(near.select("geoid", "district"))


def nearest_points(points: DataFrame, among: DataFrame, cell: float, by: str | None = None) -> DataFrame:
    """(id, to, d2): for each point (id, x, y) the nearest of ``among`` (id, x, y), of the same ``by`` if given; ties go to the smaller id.

    Points look in the nine cells around them, which double in each round,
    until one lies no farther than a cell's width; points of no ``by`` partner
    stay out.
    """
    keys = ["cx", "cy", *([by] if by else [])]
    left = points.join(among.select(by).distinct(), by, "left_semi") if by else points

    def search(looking: DataFrame, c: float) -> DataFrame:
        there = among.select(F.col("id").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("x") / c).alias("cx"), F.floor(F.col("y") / c).alias("cy"), *([by] if by else []))
        d2 = (F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")) + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y"))
        return looking.join(merged(there), keys).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), "to")).alias("m")).select("id", F.col("m.to").alias("to"), F.col("m.d2").alias("d2"))

    return _widening(left, "id", cell, _extent(points.select("x", "y"), among.select("x", "y")), search)


def shared_sides(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, v, length, n_sides) of neighbours along whole sides, (geoid, external, n_external) of sides without a neighbour); units: geoid, ring (open)."""
    n = F.size("ring")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_sort(F.array(F.get("ring", i), F.get("ring", (i + 1) % n))))
    flat = units.select("geoid", F.explode(sides).alias("s"))
    length = F.hypot(F.col("s")[1]["x"] - F.col("s")[0]["x"], F.col("s")[1]["y"] - F.col("s")[0]["y"])
    several = F.when(F.count("*") <= 2, F.min("geoid")).otherwise(F.raise_error(F.lit("a side has more than two holders: use boundaries.contacts")).cast("string"))
    held = flat.groupBy("s").agg(several.alias("u"), F.max("geoid").alias("v"), F.count("*").alias("n")).withColumn("length", length)
    edges = held.where("u <> v").groupBy("u", "v").agg(F.sum("length").alias("length"), F.count("*").alias("n_sides"))
    outer = held.where("n = 1").groupBy(F.col("u").alias("geoid")).agg(F.sum("length").alias("external"), F.count("*").alias("n_external"))
    return edges, outer


def boundary_sides(units: DataFrame) -> DataFrame:
    """district and the sides (px, py, qx, qy) that only one of its units has; units: district, ring (open).

    A side that two units of a district share cancels, which is the dissolve of
    polygons that meet along whole sides.
    """
    n = F.size("ring")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_sort(F.array(F.get("ring", i), F.get("ring", (i + 1) % n))))
    flat = units.select("district", F.explode(sides).alias("s")).select("district", *[F.col("s")[i][c].alias(f"{e}{c}") for i, e in enumerate("pq") for c in "xy"])
    return flat.groupBy("district", "px", "py", "qx", "qy").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def dissolved_perimeter(units: DataFrame) -> DataFrame:
    length = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))
    return boundary_sides(units).groupBy("district").agg(F.round(F.sum(length), 6).alias("perimeter"), F.count("*").alias("n_sides"))
