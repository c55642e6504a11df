"""Shape scores of rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .attributes import r6
from .reporting import compact_band


def shape_scores(units: DataFrame) -> DataFrame:
    """Area, perimeter, Polsby-Popper and Reock of a rectangle per unit."""
    a, b = (F.col("idx") % 4 + 1).cast("double"), (F.col("idx") % 6 + 1).cast("double")
    zero = F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (a, zero), (a, b), (zero, b))])
    m = units.select("geoid", geometry.measures(ring).alias("m"))
    return m.select("geoid", r6("m.area").alias("area"), r6("m.perimeter").alias("perimeter"), r6(geometry.compact(F.col("m.area"), F.col("m.perimeter"))).alias("polsby_popper"), r6(geometry.rounded(F.col("m.area"), F.col("m.far"))).alias("reock"))


def ell_ring(a, b):
    """A rectangle of sides a and b without its upper right quarter."""
    zero = F.lit(0.0)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (a, zero), (a, b / 2), (a / 2, b / 2), (a / 2, b), (zero, b))])


def compactness(rings: DataFrame, key: str) -> DataFrame:
    """key, area, perimeter, polsby_popper, reock, hull_ratio, band; rings: key, ring."""
    m = rings.select(key, "ring", geometry.measures(F.col("ring")).alias("m"))
    a, p, far = (F.col(f"m.{c}") for c in ("area", "perimeter", "far"))
    s = m.select(key, a.alias("area"), p.alias("perimeter"), geometry.compact(a, p).alias("pp"), geometry.rounded(a, far).alias("reock"), geometry.hull_ratio(F.col("ring"), a).alias("hull"))
    return s.select(key, r6("area").alias("area"), r6("perimeter").alias("perimeter"), r6("pp").alias("polsby_popper"), r6("reock").alias("reock"), r6("hull").alias("hull_ratio"), compact_band(F.col("pp")).alias("band"))


def enclosing_circles(units: DataFrame) -> DataFrame:
    """district, x, y, r, reock: the smallest circle around each district's units and the share of it that they fill; units: district, polygons.

    Units give the corners of their hulls, districts the circle around these.
    """
    corners = units.select("district", geometry.polygons_area(F.col("polygons")).alias("a"), geometry.hull_points(F.flatten(F.flatten("polygons"))).alias("p"))
    d = corners.groupBy("district").agg(F.sum("a").alias("a"), F.flatten(F.collect_list("p")).alias("p"))
    d = d.select("district", "a", geometry.smallest_circle(F.col("p")).alias("c"))
    return d.select("district", r6("c.x").alias("x"), r6("c.y").alias("y"), r6("c.r").alias("r"), r6(F.when(F.col("c.r") > 0, F.least(F.lit(1.0), F.col("a") / (F.pi() * F.col("c.r") * F.col("c.r"))))).alias("reock"))
