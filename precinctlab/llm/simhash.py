"""SimHash fingerprints and the binary-trie self-join over them; near duplicates by fingerprints and, for what these miss, shingle prefixes.

Fingerprints within the Hamming budget agree in at least ``blocks - budget`` of
the blocks the bits are cut into, so each choice of that many blocks becomes a
shuffle key.  A task lays its fingerprints out as a binary trie, key bits
first, and walks pairs of trie nodes together level by level: key bits must
agree, the others add their differing bits, and a pair over budget is pruned.

Cases: a null or empty text has no words and gets fingerprint zero, which links
like any other; shorter texts than a shingle give one shingle of all words;
rows with equal fingerprints collapse before the join and come back by an
equi-join; a null doc_id takes part but never names a component; extra columns
are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, connected_components, cut, parallelism, slices, text_batches

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 64
SAMPLE = 5000
OFTEN = 5
#: Pairs whose texts are sent in one turn, for each text of the table.
TURN = 0.5


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> list[int]:
    """XXH64 of each ``width``-word shingle of a lower-cased text, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    starts = [0, *ends]
    return [xxhash.xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(h))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(shingle_hashes(t, width, seed)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cuts(blocks: int) -> list[list[int]]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def _choices(budget: int, blocks: int) -> list[tuple[list[int], list[int]]]:
    """(key bits, other bits) of each choice of blocks that must agree."""
    cut_bits = _cuts(blocks)
    out = []
    for chosen in combinations(range(blocks), blocks - budget):
        key = [b for i in chosen for b in cut_bits[i]]
        out.append((key, [b for b in range(BITS) if b not in set(key)]))
    return out


def _permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Bits of ``fp`` in the given order, first bit highest."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for b in order:
        out = (out << np.uint64(1)) | ((fp >> np.uint64(b)) & np.uint64(1))
    return out


def trie_pairs(sorted_keys: np.ndarray, n_key: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i < j) of distinct sorted 64-bit keys that agree in the first ``n_key`` bits and differ in ``budget`` bits at most.

    A trie node is a range of the sorted array.  The frontier holds pairs of
    nodes of one depth with their differing bits so far; a node with itself
    stands for the pairs inside it.
    """
    top = sorted_keys >> np.uint64(BITS - n_key)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends = np.r_[starts[1:], len(sorted_keys)]
    many = ends - starts > 1
    a0, a1 = starts[many], ends[many]
    b0, b1, dist = a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int8)
    for depth in range(n_key, BITS):
        if not len(a0):
            break
        shift = np.uint64(BITS - 1 - depth)

        def middle(lo, hi):
            # first index in [lo, hi) whose bit at this depth is 1: the prefix of the node with this bit set
            mask = ~((np.uint64(1) << (shift + np.uint64(1))) - np.uint64(1)) if shift < 63 else np.uint64(0)
            want = (sorted_keys[lo] & mask) | (np.uint64(1) << shift)
            return np.clip(np.searchsorted(sorted_keys, want), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        own = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, dist), (am, a1, bm, b1, dist), (a0, am, bm, b1, dist + np.int8(1)), (am, a1, b0, bm, dist + np.int8(1))]
        # of a node with itself only one of the two mixed pairs is new
        keep = [np.ones(len(a0), bool), np.ones(len(a0), bool), np.ones(len(a0), bool), ~own]
        sides = []
        for (x0, x1, y0, y1, d), k in zip(parts, keep):
            same = (x0 == y0) & (x1 == y1)
            ok = k & (x1 > x0) & (y1 > y0) & (d <= budget) & (~same | (x1 - x0 > 1))
            sides.append([v[ok] for v in (x0, x1, y0, y1, d)])
        a0, a1, b0, b1, dist = (np.concatenate([s[i] for s in sides]) for i in range(5))
    done = a0 != b0
    i, j = np.minimum(a0[done], b0[done]), np.maximum(a0[done], b0[done])
    return i, j, dist[done]


def similar_pairs(fps: DataFrame, budget: int = 2, blocks: int | None = None) -> DataFrame:
    """(fp_a, fp_b) of all distinct fingerprints within the budget; ``fps`` has distinct non-null ``fp``."""
    blocks = blocks or budget + 2
    choices = _choices(budget, blocks)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for c, (key, rest) in enumerate(choices):
                k = _permuted(fp, key + rest)
                group = (k >> np.uint64(BITS - len(key))) * np.uint64(len(choices)) + np.uint64(c)
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(np.full(len(k), c, np.int32)), pa.array(k.view(np.int64))], names=["grp", "c", "k"])

    def join(batches):
        held: list[list[np.ndarray]] = [[] for _ in choices]
        for b in batches:
            c, k = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for x in np.unique(c):
                held[x].append(k[c == x])
        for x, chunks in enumerate(held):
            if not chunks:
                continue
            key, rest = choices[x]
            k = np.sort(np.concatenate(chunks))
            i, j, _ = trie_pairs(k, len(key), budget)
            back = np.argsort(np.array((key + rest)))  # bit b stands at place back[b]
            order = [BITS - 1 - int(p) for p in back][::-1]
            for at in range(0, len(i), 1 << 18):
                a, b2 = (_permuted(k[v[at : at + (1 << 18)]], order) for v in (i, j))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b2.view(np.int64))], names=["fp_a", "fp_b"])

    n = parallelism(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(spread, "grp long, c int, k long").repartition(n, "grp").select("c", "k")
    return keyed.mapInArrow(join, "fp_a long, fp_b long").select(F.least("fp_a", "fp_b").alias("fp_a"), F.greatest("fp_a", "fp_b").alias("fp_b")).distinct()


def components(fps: DataFrame, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): components of fingerprints within the budget, named by the smallest doc_id."""
    fps = cut(fps)
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    pairs = similar_pairs(nodes, budget)
    ends = pairs.join(nodes.select(F.col("fp").alias("fp_a"), F.col("node").alias("a")), "fp_a").join(nodes.select(F.col("fp").alias("fp_b"), F.col("node").alias("b")), "fp_b")
    comp = connected_components(ends.select("a", "b"))
    by_fp = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint as 16 hex digits, component_id."""
    found = components(fingerprints(docs, width), budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verified(batches, width: int, similarity: float):
    last, x = None, set()  # pairs of one text follow each other
    for b in slices(batches, 64):
        keep = []
        for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if ta != last:
                last, x = ta, set(shingle_hashes(ta, width))
            y = set(shingle_hashes(tb, width))
            both = len(x & y)
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame, n_texts: int, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar.  b's text goes to a's; pairs take turns, so that the texts of one turn go before the next."""
    turns = max(1, math.ceil(pairs.count() / max(1.0, TURN * n_texts)))
    side = lambda i: texts.select(F.col("node").alias(i), F.col("text").alias("t" + i))
    links = []
    for i in range(turns):
        mine = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == i)
        both = mine.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
        links.append(cut(both.mapInArrow(lambda it: _verified(it, width, similarity), "a long, b long")))
    return functools.reduce(DataFrame.union, links)


def _frequent(texts: DataFrame, n_texts: int, width: int) -> np.ndarray:
    """Sorted shingles that several texts of a small sample hold; they only change the order of prefixes, never a result."""

    def run(batches):
        for b in slices(batches):
            sets = [np.unique(np.array(shingle_hashes(t, width), dtype=np.uint64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    every = max(1, n_texts // SAMPLE)
    found = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("node", "text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(np.array([r.h for r in found.select("h").collect()], dtype=np.int64).view(np.uint64))


def _prefixes(batches, width: int, similarity: float, frequent: np.ndarray):
    """Of n shingles, ordered alike in all texts, the first n - ceil(similarity * n) + 1: similar texts have one of these in common."""
    for b in slices(batches):
        nodes, keys, sizes = [], [], []
        for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))
            n = len(h)
            if n:
                often = np.isin(h, frequent)
                h = np.concatenate([h[~often], h[often]])[: n - math.ceil(similarity * n - 1e-9) + 1]
            else:
                h = np.zeros(1, np.uint64)  # texts without words are alike
            nodes.append(np.full(len(h), node, np.int64))
            keys.append(h)
            sizes.append(np.full(len(h), n, np.int32))
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["h", "node", "n"])


def fingerprint_candidates(texts: DataFrame, width: int, budget: int) -> DataFrame:
    """a < b of texts (node, text): the least nodes of fingerprints within the budget, and each text with the least node of its own fingerprint."""
    fps = cut(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    ends = similar_pairs(nodes, budget).join(nodes.select(F.col("fp").alias("fp_a"), F.col("node").alias("x")), "fp_a").join(nodes.select(F.col("fp").alias("fp_b"), F.col("node").alias("y")), "fp_b")
    same = fps.join(nodes, "fp").where("doc_id <> node").select(F.col("node").alias("x"), F.col("doc_id").alias("y"))
    return ends.select("x", "y").union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """(node, component): documents, one for each different text, that have a near duplicate.

    Texts are linked if the Jaccard similarity of their shingle sets holds.
    Pairs of SimHash fingerprints within the budget are checked first.  All
    other such texts come together as well: similar sets have a shingle of their
    prefixes in common.  Holders of a shingle are paired with two others each;
    then those that are still in different components with each other.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("t", F.md5("text"))
    parts = parallelism(docs.sparkSession)
    # texts by node and shingles by hash are written once: joins and windows then send no text and no shingle again
    texts = own.groupBy("t").agg(F.min("doc_id").alias("node"), F.first("text").alias("text")).select("node", "text")
    texts = bucketed(texts.repartition(parts, "node"), parts, "node")
    n_texts = texts.count()
    frequent = _frequent(texts, n_texts, width)
    keys = texts.mapInArrow(lambda it: _prefixes(it, width, similarity, frequent), "h long, node long, n int")
    one = Window.partitionBy("h")
    held = keys.repartition(parts, "h").withColumns({"least": F.min("node").over(one), "most": F.max("node").over(one)}).where("least <> most")
    held = bucketed(held.select("h", "node", "n"), parts, "h")
    linked = functools.partial(_linked, texts=texts, n_texts=n_texts, width=width, similarity=similarity)

    simhashed = cut(fingerprint_candidates(texts, width, budget))
    links = linked(simhashed)
    order = one.orderBy("n", "node")
    first = F.first(F.struct("node", "n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = held.select("node", "n", first.alias("one"), F.lag(F.struct("node", "n")).over(order).alias("two"))
    near = near.select("node", "n", F.explode(F.array("one", "two")).alias("o"))
    near = near.where((F.col("node") != F.col("o.node")) & (F.col("o.n") >= similarity * F.col("n") - 1e-9))
    near = near.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct().join(simhashed, ["a", "b"], "left_anti")
    # pairs that links have brought together already add nothing to a group
    met = connected_components(links)
    for end in ("a", "b"):
        near = near.join(met.select(F.col("node").alias(end), F.col("component").alias("c" + end)), end, "left")
    near = cut(near.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b"))
    tried, links = simhashed.union(near), links.union(linked(near))
    known = held.join(connected_components(links), "node", "left").select("h", "node", "n", F.coalesce("component", "node").alias("c"))
    apart = known.withColumns({"least": F.min("c").over(one), "most": F.max("c").over(one)}).where("least <> most").drop("least", "most")
    apart = cut(apart)
    x, y = (apart.select("h", *[F.col(c).alias(c + i) for c in ("node", "n", "c")]) for i in "xy")
    rest = x.join(y, "h").where((F.col("cx") != F.col("cy")) & (F.col("nodex") < F.col("nodey")) & (F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-9))
    rest = cut(rest.select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    return connected_components(links.union(linked(rest)))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id; of equal texts and repeated doc_ids also one.  Rows with null doc_id stay.

    Null and empty texts and those without a word are one group; very long texts
    are whole; columns of any name pass through; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.where("row.doc_id is not null").select("row", F.col("row.doc_id").cast("long").alias("node"), F.md5(F.coalesce("row.text", F.lit(""))).alias("t"))
    first = named.groupBy("t").agg(F.min("node").alias("node")).select("node").distinct()
    gone = groups(docs, **how).where("node <> component").select("node")
    out = named.join(first.join(gone, "node", "left_anti"), "node", "left_semi").dropDuplicates(["node"]).select("row")
    return out.union(rows.where("row.doc_id is null")).select("row.*")
