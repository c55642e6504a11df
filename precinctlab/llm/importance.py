"""Target-distribution importance resampling with Arrow kernels.

Texts are lowered (``ascii_lower``), split (``split_pattern_regex``), flattened
(``list_flatten``) and dictionary-encoded; n-grams are pairs of shifted
dictionary indices, of which only distinct ones get a CRC; gains of buckets are
taken by index and summed by document over the list offsets.  Corpus and target
are counted in the same buckets, gains are rounded log ratios, and documents
are drawn by weight plus Gumbel noise of their id, which is sampling without
replacement; the draw is ranked through range partitions.

Cases: a null or empty text has no feature and weight 0; a null doc_id takes
part as "null" in the noise and comes last among ties; rows with equal doc_id
draw the same noise and rank one by one; repeated rows are rows of their own;
an empty corpus gives no rows, an empty target flat gains; long texts are whole
(batches are cut by bytes, never texts); other columns are left aside.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parallelism

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Bytes of text, at least one text, that are turned to words at once.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch, column: int):
    """Slices of a batch with some ``PIECE`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Dictionary index of each word, the dictionary, and the offsets of the texts' words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), BETWEEN)
    flat, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)  # a split leaves empty strings at the ends
    of = of[real.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(pc.filter(flat, real))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return index, coded.dictionary, np.searchsorted(of, np.arange(len(lists) + 1))


def feature_buckets(texts: pa.Array, longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram up to ``longest`` words, its text's number, and the number of words of each text."""
    index, words, offsets = word_lists(texts)
    raw = [w.as_py().encode() for w in words]
    n_words = np.diff(offsets)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    grams, crcs = index, np.array([zlib.crc32(w) for w in raw], dtype=np.int64)
    found, owners = [crcs[grams] % buckets], [owner]
    for n in range(2, longest + 1):
        same = owner[: len(owner) - n + 1] == owner[n - 1 :]  # the run stays in one text
        pair = grams[: len(same)][same] * len(raw) + index[n - 1 :][same]
        distinct, numbers = np.unique(pair, return_inverse=True)
        crcs = np.array([zlib.crc32(b" " + raw[p % len(raw)], int(crcs[p // len(raw)])) for p in distinct.tolist()], dtype=np.int64)
        grams = np.zeros(len(same), dtype=np.int64)
        grams[same] = numbers
        found.append(crcs[numbers] % buckets)
        owners.append(owner[: len(same)][same])
    return np.concatenate(found), np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all rows; a task sends each bucket once."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in pieces(batch, 0):
                total += np.bincount(feature_buckets(b.column(0), longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Rounded log ratio of each bucket; two tables of ``buckets`` rows at most come to the driver."""

    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in bucket_counts(texts, longest, buckets).collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(docs), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a text's features."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                bucket, owner, n_words = feature_buckets(b.column(1), longest, len(gain))
                order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
                sums = np.concatenate([[0], np.cumsum(gain[bucket][order])])
                n = np.bincount(owner, minlength=b.num_rows)
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null where the draw leaves it out."""
    w = weights(docs, gains(docs, target, longest, buckets), longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    w = cut(w.withColumn("score", F.col("weight") + noise.cast("long")))
    may = w.where(F.col("n_words") >= min_words)
    drawn = may.count() * percent // 100
    # rows equal in the first three are equal in all that is returned, so a spread of them changes no result
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("spread")]
    ranged = cut(may.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parallelism(docs.sparkSession), *by).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ranged.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*by)))
    out = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return out.unionByName(w.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


ORACLE = r"""
WITH RECURSIVE step AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bytes AS (SELECT w, hex(encode(w)) AS h FROM words),
k AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT))),
  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, floor(sum(CAST(gain AS BIGINT)) / count(*)) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
y AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (ORDER BY n < 20, score DESC, doc_id NULLS LAST, n) END AS p FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN p <= (SELECT count(*) FROM x WHERE n >= 20) * 10 // 100 THEN p END AS rank FROM y
"""
