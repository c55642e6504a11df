"""Nearest neighbours through low-dimensional stable projections and kd-trees.

Vectors, scaled to unit length, are projected by a seeded Gaussian matrix to
``DIMS`` dimensions; the squared projected distance over the squared true
distance then follows a chi-square law.  The top of a kd-tree, fitted on a
bounded sample, deals rows to cells; each cell builds the rest of its tree.  A
query visits leaves in the order of their projected distance and verifies, by
exact cosine, the rows whose own projected distance passes the chi-square test:
beyond ``quantile(confidence)`` times the distance reached, a nearer row would
have shown up before with that probability, and the search stops.  A first
round searches the query's own cell; a second those other cells that the test
cannot rule out.  A cell of more rows than ``CELL_ROWS`` is dealt to blocks by a
hash of its rows, and its queries go to each block, so that no group is large.

Cases: vectors null, zero, or holding null or non-finite components take no
part; vectors of unlike lengths are never neighbours; components of any finite
size are scaled by a power of two first, which changes no cosine; equal vectors
are indexed once, with the smallest ids that could be returned; repeated ids
with equal vectors count once; ties go to the smaller id; fewer candidates than
asked give all; a null id takes no part; an empty table gives an empty result;
extra columns are left aside.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIMS = 16
SAMPLE = 20_000
CELL_ROWS = 8192
#: Cells of the fitted tree top; larger cells than ``CELL_ROWS`` are dealt to blocks.
MAX_CELLS = 1 << 12
LEAF = 64
CONFIDENCE = 0.97


def chi2_quantile(p: float, dims: int = DIMS) -> float:
    """Quantile of the chi-square law for an even number of dimensions, by bisection."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    t = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return t.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows brought to a largest component of 0.5 to 1 by powers of two."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


@cache
def _matrix(length: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, DIMS))


def projected(vectors, seed: int) -> np.ndarray:
    """Projections of unit vectors, of any lengths."""
    out = np.zeros((len(vectors), DIMS))
    lengths = np.array([len(x) for x in vectors])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        v = scaled(np.stack([vectors[i] for i in at]).astype(float))
        out[at] = (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ _matrix(int(n), seed)
    return out


def _planes(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Top of the kd-tree as a heap of dimensions and cuts, by medians of a sample."""
    dims, cuts, level = [], [], [points]
    while len(level) < cells:
        below = []
        for p in level:
            d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            at = float(np.median(p[:, d])) if len(p) else 0.0
            dims.append(d)
            cuts.append(at)
            below += [p[p[:, d] < at], p[p[:, d] >= at]]
        level = below
    return np.array(dims, dtype=np.int64), np.array(cuts)


def _cell_of(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node - len(dims)


def _boxes(dims: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = [np.full(DIMS, -np.inf)], [np.full(DIMS, np.inf)]
    for i, (d, at) in enumerate(zip(dims.tolist(), cuts.tolist())):
        left, right = hi[i].copy(), lo[i].copy()
        left[d], right[d] = min(left[d], at), max(right[d], at)
        lo += [lo[i], right]
        hi += [left, hi[i]]
    return np.array(lo[len(dims) :]), np.array(hi[len(dims) :])


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        p = points[rows]
        order = rows[np.argsort(p[:, int(np.argmax(np.ptp(p, axis=0)))], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def _gap2(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of a projected query to each box."""
    return (np.maximum(0, np.maximum(lo - q, q - hi)) ** 2).sum(axis=1)


class Cell:
    """The kd-tree of one block of a cell."""

    def __init__(self, vectors, ids: np.ndarray, seed: int):
        points = projected(vectors, seed)
        leaves = _leaves(points)
        order = np.concatenate(leaves)
        self.v = scaled(np.stack(vectors).astype(float))[order]
        self.points, self.ids = points[order], ids[order]
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        ends = np.cumsum([len(x) for x in leaves])
        self.rows = [np.arange(z - len(x), z) for x, z in zip(leaves, ends.tolist())]
        self.lo, self.hi = np.array([self.points[r].min(axis=0) for r in self.rows]), np.array([self.points[r].max(axis=0) for r in self.rows])
        self.verified = 0

    def search(self, q: np.ndarray, point: np.ndarray, reach: float, keep: int, limit: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows of the ``keep`` best, their scores, and the squared distance reached."""
        norm, gap, kth = math.sqrt(float((q * q).sum())), _gap2(self.lo, self.hi, point), reach
        order = np.argsort(gap, kind="stable")
        best, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 2
        while at < len(order):
            take = order[at : at + step]
            take = take[gap[take] <= kth * limit]
            if not len(take):  # chi-square stopping test
                break
            rows = np.concatenate([self.rows[x] for x in take])
            rows = rows[((self.points[rows] - point) ** 2).sum(axis=1) <= kth * limit]
            self.verified += len(rows)
            best, score = np.concatenate([best, rows]), np.concatenate([score, (self.v[rows] * q).sum(axis=1) / (self.norm[rows] * norm)])
            top = np.lexsort((self.ids[best], -score))[:keep]
            best, score = best[top], score[top]
            if len(best) == keep:
                kth = min(kth, max(0.0, 2 - 2 * float(score[-1])))
            at, step = at + step, step * 2
        return best, score, kth


FOUND = "qv long, rep long, score double, d2 double"


def search_cell(index: pd.DataFrame, queries: pd.DataFrame, seed: int, keep: int, limit: float) -> pd.DataFrame:
    """The ``keep`` best groups of equal vectors of one block for each query vector."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    if len(index) and len(queries):
        cell = Cell(index["v"].to_list(), index["rep"].to_numpy(), seed)
        asked = queries["v"].to_list()
        for qv, q, point, reach in zip(queries["qv"].to_list(), scaled(np.stack(asked).astype(float)), projected(asked, seed), queries["d2"].to_list()):
            best, score, kth = cell.search(q, point, reach, keep, limit)
            out.append((np.full(len(best), qv), cell.ids[best], score, np.full(len(best), kth)))
    return pd.DataFrame(dict(zip(("qv", "rep", "score", "d2"), (np.concatenate(x) for x in zip(*out)))))


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, confidence: float = CONFIDENCE, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose key is divisible by ``every``."""
    keep, limit = k + 1, chi2_quantile(confidence)
    rows = usable(table, key, vector)
    # equal vectors: one entry, with the smallest ids that any query could be given; the first step is salted
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.col("id"), F.lit(64)))
    part = rows.select("id", "v", "h", "salt").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= keep)
    groups = part.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_set("id")), 1, keep).alias("ids"))
    groups = cut(groups.select(F.col("ids")[0].alias("rep"), "v", "ids"))
    total, cells = groups.count(), 1
    while cells < MAX_CELLS and cells * cell_rows < total:
        cells *= 2
    sample = groups.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toPandas()["v"].to_list() if cells > 1 else []
    dims, cuts = _planes(projected(sample, seed), cells) if sample else (np.zeros(0, np.int64), np.zeros(0))
    lo, hi = _boxes(dims, cuts)

    def place(frames):
        for f in frames:
            if len(f):
                yield f.assign(cell=_cell_of(projected(f["v"].to_list(), seed), dims, cuts))

    placed_rows = groups.select("rep", "v").mapInPandas(place, "rep long, v array<double>, cell long")
    sizes = np.zeros(len(lo), np.int64)
    for r in placed_rows.groupBy("cell").count().collect():  # one row a cell of the fitted top
        sizes[r["cell"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // cell_rows))
    n_blocks = F.element_at(F.lit([int(x) for x in blocks]), F.col("cell").cast("int") + 1)
    index = placed_rows.withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks)).withColumn("size", F.size("v"))
    asked = rows.where(F.col("id") % every == 0).select("id", "h", "v").distinct()
    vectors = asked.groupBy("h", "v").agg(F.min("id").alias("qv"))
    infinite = F.lit(4.0)  # no two unit vectors are farther apart, squared
    placed = cut(vectors.select("qv", "v", infinite.alias("d2")).mapInPandas(place, "qv long, v array<double>, d2 double, cell long"))

    def searched(queries: DataFrame) -> DataFrame:
        by = ["cell", "block", "size"]
        spread = queries.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)), "size": F.size("v")})
        return spread.groupBy(*by).cogroup(index.groupBy(*by)).applyInPandas(lambda q, i: search_cell(i, q, seed, keep, limit), FOUND)

    found = cut(searched(placed))
    if cells > 1:
        reached = found.groupBy("qv").agg(F.min("d2").alias("d2"))

        def others(frames):
            for f in frames:
                if not len(f):
                    continue
                points = projected(f["v"].to_list(), seed)
                hits = [np.flatnonzero((_gap2(lo, hi, x) <= d * limit) & (np.arange(len(lo)) != c)) for x, d, c in zip(points, f["d2"], f["cell"])]
                yield f.loc[np.repeat(f.index.to_numpy(), [len(h) for h in hits])].assign(cell=np.concatenate(hits))

        more = placed.drop("d2").join(reached, "qv", "left").withColumn("d2", F.coalesce("d2", infinite)).select("qv", "v", "d2", "cell")
        found = found.union(searched(more.mapInPandas(others, "qv long, v array<double>, d2 double, cell long")))
    # back from groups of equal vectors to rows, and from query vectors to queries
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qv").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= keep)
    opened = best.join(groups.select("rep", "ids"), "rep").select("qv", "score", F.explode("ids").alias("vec_id"))
    opened = opened.withColumn("r", F.row_number().over(Window.partitionBy("qv").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= keep).drop("r")
    ask = asked.join(vectors.select("h", "v", "qv"), ["h", "v"]).select(F.col("id").alias("query_id"), "qv")
    out = ask.join(opened, "qv").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
