"""State tables and graphs as national ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members of a state's record that a national table leaves out.
LEFT_OUT = ("analyzer", "per_district_dem_share_sorted")


def merged_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((number, state, geoid, weight), (u, v, w) by national numbers) of state graphs numbered from 0 each.

    vertices: state, vertex, geoid, weight; edges: state, u, v, w.  States come
    in the order of their codes, each after all vertices of those before; the
    numbers before a state are one sum over a row per state.  An edge with an
    end that its state lacks is left out.
    """
    sizes = vertices.groupBy("state").agg(F.count("*").alias("n"))
    before = sizes.select("state", (F.sum("n").over(Window.orderBy("state")) - F.col("n")).alias("before"))
    place = Window.partitionBy("state").orderBy("vertex")
    v = vertices.withColumn("place", F.row_number().over(place) - 1).join(before, "state").withColumn("number", F.col("before") + F.col("place"))
    ends = v.select("state", "vertex", "number")
    e = edges.join(ends.select("state", F.col("vertex").alias("u"), F.col("number").alias("nu")), ["state", "u"]).join(ends.select("state", F.col("vertex").alias("v"), F.col("number").alias("nv")), ["state", "v"])
    return v.select("number", "state", "geoid", "weight"), e.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "w")


def state_records(documents: DataFrame, year: str) -> DataFrame:
    """state, year, name, value (JSON) of the members of state documents (state, content); a document that is no object is left out."""
    members = F.from_json("content", "map<string, string>")
    kept = F.map_filter(members, lambda k, v: ~k.isin(*LEFT_OUT, "state", "year"))
    return documents.where(F.col("content").rlike(r"^\s*\{")).select("state", F.lit(year).alias("year"), F.explode(kept).alias("name", "value"))


def state_table(documents: DataFrame, year: str) -> DataFrame:
    """One row per state: state, year and a column per member of the first state's document, by name; what a state lacks is empty."""
    r = state_records(documents, year)
    first = r.agg(F.min("state")).first()[0]
    names = sorted(x["name"] for x in r.where(F.col("state") == first).select("name").distinct().collect()) if first is not None else []
    wide = r.groupBy("state", "year").pivot("name", names).agg(F.first("value")) if names else r.select("state", "year").distinct()
    return wide.select("state", "year", *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def district_records(documents: DataFrame) -> DataFrame:
    """state, district, name, value of all districts in state documents with a ``districts`` array."""
    rows = F.from_json("content", "districts array<map<string, string>>")["districts"]
    d = documents.select("state", F.explode(rows).alias("m"))
    return d.select("state", F.col("m")["district"].cast("int").alias("district"), F.explode(F.map_filter("m", lambda k, v: k != "district")).alias("name", "value"))
