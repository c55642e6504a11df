"""What five filters remove alone, together and in every order.

Copies of texts are found in two passes.  First every task counts the hashes
of its texts in a sparse counting Bloom sketch; sketches merge slice by slice,
and a text of which some cell counts 1 is surely the only one of its kind.  In
the second pass only texts that the merged sketch can't clear are shuffled, in
full, for the smallest id of each.  Filters A to D are functions of the text
and known in that pass; failures of E change the count of a mask by one, so all
that meets in the end are counts by part and mask of failed filters, from which
every order follows.

Bounds: a sketch has 16 cells a row in powers of two, ``MAX_CELLS`` at most
(16 MB as bits); with more rows than it can tell apart it clears fewer
texts, and the exact way takes the others.  A task's partial sketches hold ``FLUSH`` cells at a time.

Cases: a null text is empty, and empty texts are equal like others; a null
doc_id comes after all ids, so its row fails E where the text has any other id;
rows that share text and doc_id don't fail each other; a row without label
has neither; repeated labels count once; an empty table gives no parts; long
texts are whole; other columns are left aside.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices

FILTERS = "ABCDE"
HASHES = 3
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
#: Cells of a slice: the unit that sketches are merged by.
SLICE = 1 << 16
FLUSH = 1 << 18
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"


def cells_for(rows: int) -> int:
    return min(MAX_CELLS, max(MIN_CELLS, 1 << max(0, 16 * rows - 1).bit_length()))


def cells_of(digests: np.ndarray, cells: int) -> np.ndarray:
    """The cells (rows x HASHES) of digests (rows x 2, 64 bits each); ``cells`` is a power of two."""
    low, step = digests[:, 0], digests[:, 1] | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(HASHES)], axis=1)


def digests_of(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in texts]), "<u8").reshape(-1, 2)


def fails(text: bytes) -> int:
    """Bits 0 to 3: filters A to D fail."""
    words = text.split()  # at runs of space, \t, \n, \v, \f and \r
    characters = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 3 * characters
    return a | b << 1 | c << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def _sparse(cells: np.ndarray, counts: np.ndarray, salt: int) -> pa.RecordBatch:
    """Rows (slice, salt, cells): sorted places in a slice, the highest bit set where the count is over 1."""
    at = (cells // SLICE).astype(np.int64)
    packed = (cells % SLICE).astype("<u4") | (counts > 1).astype("<u4") << 31
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    blobs = [x.tobytes() for x in np.split(packed, starts[1:])] if len(starts) else []
    return pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(np.full(len(starts), salt, dtype=np.int64)), pa.array(blobs, pa.binary())], names=["slice", "salt", "cells"])


def _merged(table: pa.Table) -> np.ndarray:
    counts = np.zeros(SLICE, dtype=np.uint8)
    for blob in table.column("cells"):
        x = np.frombuffer(blob.as_buffer(), "<u4")
        at = x & 0x7FFFFFFF
        counts[at] = np.minimum(2, counts[at] + 1 + (x >> 31))
    return counts


def sketch(docs: DataFrame, cells: int) -> dict[int, bytes]:
    """Bits of the cells counted more than once, by slice."""

    def count(batches):
        salt, held, size = TaskContext.get().partitionId() % 64, [], 0
        for b in slices(batches):
            digests = digests_of([t or b"" for t in b.column(0).to_pylist()])
            held.append(cells_of(digests, cells).ravel())
            size += held[-1].size
            if size >= FLUSH:
                yield _sparse(*np.unique(np.concatenate(held), return_counts=True), salt)
                held, size = [], 0
        if held:
            yield _sparse(*np.unique(np.concatenate(held), return_counts=True), salt)

    def merge(table: pa.Table) -> pa.Table:
        counts = _merged(table)
        at = np.flatnonzero(counts)
        one = _sparse(at, counts[at], 0)
        return pa.Table.from_arrays([table.column("slice")[:1], table.column("salt")[:1], pa.chunked_array([one.column(2)])], names=["slice", "salt", "cells"])

    def bits(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([table.column("slice")[:1], pa.array([np.packbits(_merged(table) > 1, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "slice long, salt long, cells binary")
    parts = parts.groupBy("slice", "salt").applyInArrow(merge, "slice long, salt long, cells binary")
    merged = parts.groupBy("slice").applyInArrow(bits, "slice long, bits binary")
    return {r["slice"]: bytes(r["bits"]) for r in merged.collect()}  # MAX_CELLS bits at most


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, digest, and the text where the sketch can't clear it (else null); written once."""
    spark = docs.sparkSession
    cells = cells_for(docs.count())
    shared = spark.sparkContext.broadcast(sketch(docs, cells))

    def run(batches):
        seen = np.zeros(cells // 8, dtype=np.uint8)
        for at, bits in shared.value.items():
            seen[at * SLICE // 8 : (at + 1) * SLICE // 8] = np.frombuffer(bits, np.uint8)
        for b in slices(batches):
            texts = [t or b"" for t in b.column(2).to_pylist()]
            digests = digests_of(texts)
            at = cells_of(digests, cells)
            again = ((seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            known: dict[bytes, int] = {}
            mask = []
            for t in texts:
                if t not in known:
                    known[t] = fails(t)
                mask.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mask, pa.int32()), pa.array([d.tobytes() for d in digests], pa.binary()), pa.array([t if x else None for t, x in zip(texts, again)], pa.binary())], names=["doc_id", "part", "mask", "digest", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    path = f"{shared_dir(spark)}/flagged"
    rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary, text binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def repeats(found: DataFrame) -> DataFrame:
    """doc_id, part, mask of the rows that fail E: those that are not the first of their whole text; (doc_id, digest) names a row's text."""
    possible = found.where("text is not null")
    first = possible.groupBy("text").agg(F.min("doc_id").alias("d"), F.first("digest").alias("g")).drop("text")
    return possible.join(first, possible["doc_id"].eqNullSafe(first["d"]) & (possible["digest"] == first["g"]), "left_anti").select("doc_id", "part", "mask")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: the filter of letter i fails), n, good and toxic: rows, and those with quality 1 and toxic 1."""
    found = flagged(docs)
    e = 1 << FILTERS.index("E")
    each = found.select("doc_id", "part", "mask", F.lit(1).alias("n"))
    moved = repeats(found).select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct((F.col("mask") + e).alias("mask"), F.lit(1).alias("n")))).alias("x")).select("doc_id", "part", "x.*")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = each.unionByName(moved).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(known, "doc_id", "left")
    n = F.col("n")
    return rows.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    order, step = F.col("filter_order"), F.col("step")
    bit_at = lambda i: F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {i}, 1)) - 1)")
    c = mask_counts(docs, labels).withColumn("filter_order", F.explode(F.lit(["".join(p) for p in itertools.permutations(FILTERS)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.length(order))))
    c = c.withColumns({"bit": bit_at("step"), "before": sum(F.when(step > i, bit_at(i)).otherwise(0) for i in range(1, len(FILTERS)))})
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    hit, clear = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0))
    out = c.groupBy("part", "filter_order", "step", "bit").agg(
        total(mask.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total(hit & clear).alias("removed"), total(hit & ~clear).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(hit & clear, "good").alias("good_lost"), total(hit & clear, "toxic").alias("toxic_lost"))
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN least < doc_id OR (doc_id IS NULL AND least IS NOT NULL) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT '' AS o, 0 AS used, 0 AS k UNION ALL SELECT o || f, used + bit, k + 1 FROM o, f WHERE used & bit = 0),
s AS (SELECT o.o AS filter_order, i AS step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(substr(o.o, 1, i - 1), g.f) > 0) AS before FROM o, range(1, 6) r(i), f WHERE k = 5 AND f.f = substr(o.o, i, 1)),
x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | CAST(before AS INTEGER)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""
