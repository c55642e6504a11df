"""Exact substring deduplication by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Sorting every suffix of the corpus would move hundreds of bytes for each
byte, so suffixes are sampled without loss: each ``LENGTH``-byte window picks
as its anchor the leftmost least hash among the ``SEED``-byte strings it holds,
equal windows pick equal anchors, and only anchors whose hash occurs twice can
belong to a repeated window.

1. Distinct texts go to a bucketed table (copies of a text repeat as a whole).
2. Anchor hashes are counted, summed per task first, and single ones dropped.
3. Each task sorts the suffixes at its anchors (hash, then the bytes after the
   anchor, then the bytes before it backwards) and front-codes them: a run.
   Equal suffixes of a run are settled there, and one goes on.  Runs are
   exchanged by hash range.
4. A loser tree merges the runs.  It keeps, for each run's head, the length of
   the prefix shared with the last string put out and never compares that
   prefix again; the merged order comes with all common prefix lengths.
5. A window d bytes before its anchor is repeated if another one shares
   LENGTH - d bytes after the anchor (a block of the merged order) and d bytes
   before it (a block of the order of the backward strings).  This is exact.

Cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; repeated
rows (even with equal or null doc_id) are copies of each other; very long texts
are whole; extra columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, parallelism, slices, text_batches

LENGTH = 200
SEED = 100
#: Starts of SEED-byte strings in a window.
REACH = LENGTH - SEED + 1
WIDTH = 8 + LENGTH + REACH - 1
CHUNK = 1 << 19
RUN = 30_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK), base, dtype=np.uint64)
        p[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(p)
    return have[:n]


def seed_hashes(t: np.ndarray) -> np.ndarray:
    """Hash of the SEED-byte string at each place of a byte array."""
    c = np.zeros(len(t) + 1, dtype=np.uint64)
    np.cumsum(t.astype(np.uint64) * _powers("inverse", _INVERSE, len(t)), out=c[1:])
    h = (c[SEED:] - c[:-SEED]) * _powers("base", _BASE, len(t) - SEED + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, anchor place, hash, least d, greatest d) of all windows of some texts, joined to one array."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    t = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    if len(t) < LENGTH:
        return none
    h = seed_hashes(t)
    place_bits = np.uint64(max(1, int(len(t)).bit_length()))
    mask = (np.uint64(1) << place_bits) - np.uint64(1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= REACH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(key) - REACH + 1], low[REACH - span : REACH - span + len(key) - REACH + 1])
    ok = np.ones(len(low), dtype=bool)
    for a, z in zip((ends - sizes).tolist(), ends.tolist()):
        ok[max(a, z - LENGTH + 1) : z] = False
    p = np.flatnonzero(ok)
    if not len(p):
        return none
    a = (low[p] & mask).astype(np.int64)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    last = np.r_[first[1:] - 1, len(a) - 1]
    a0 = a[first]
    doc = np.searchsorted(ends, a0, side="right")
    kept = h[a0] * np.uint64(0xC2B2AE3D27D4EB4F)  # the least hashes lie close together; spread them over the range again
    kept ^= kept >> np.uint64(31)
    kept *= np.uint64(0x9FB21C651E98DF25)
    return doc, a0 - (ends - sizes)[doc], kept, a0 - p[last], a0 - p[first]


def _chunks(column, limit: int = CHUNK):
    """Slices of a column of texts, of about ``limit`` bytes."""
    at, size = 0, 0
    texts: list[bytes] = []
    for i, t in enumerate(column.to_pylist()):
        texts.append(t or b"")
        size += len(texts[-1])
        if size >= limit:
            yield at, texts
            at, size, texts = i + 1, 0, []
    if texts:
        yield at, texts


def _count(batches):
    for b in slices(batches):
        for _, texts in _chunks(b.column(0)):
            h, n = np.unique(anchors(texts)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])


def _places(batches):
    for b in slices(batches):
        k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        for at, texts in _chunks(b.column(2)):
            doc, place, h, near, far = anchors(texts)
            yield pa.RecordBatch.from_arrays([pa.array(k1[at + doc]), pa.array(k2[at + doc]), pa.array(h.view(np.int64)), pa.array(place * 65536 + near * 256 + far)], names=["k1", "k2", "h", "at"])


PAYLOAD = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("place", "<i8"), ("near", "u1"), ("far", "u1"), ("many", "u1")])


def _shared(x: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring rows; the first row's is 0."""
    out = np.zeros(len(x), dtype=np.int64)
    for at in range(1, len(x), 1 << 15):
        d = x[at : at + (1 << 15)] != x[at - 1 : at - 1 + len(x[at : at + (1 << 15)])]
        out[at : at + len(d)] = np.where(d.any(axis=1), d.argmax(axis=1), x.shape[1])
    return out


def _order(x: np.ndarray) -> np.ndarray:
    data, w = x.tobytes(), x.shape[1]
    keys = [data[i : i + w] for i in range(0, len(data), w)]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)


def front_code(rows: np.ndarray, payload: np.ndarray) -> bytes:
    """A sorted run of fixed-width rows: prefix lengths, remaining bytes, payload."""
    lcp = _shared(rows)
    keep = np.arange(rows.shape[1]) >= lcp[:, None]
    parts = [lcp.astype("<u2").tobytes(), rows[keep].tobytes(), payload.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<QQ", len(rows), rows.shape[1]) + b"".join(parts))


def front_decode(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, w = struct.unpack_from("<QQ", data)
    lcp = np.frombuffer(data, "<u2", n, 16).tolist()
    at, out, last = 16 + 2 * n, [], b""
    for c in lcp:
        last = last[:c] + data[at : at + w - c]
        at += w - c
        out.append(last)
    return out, lcp, np.frombuffer(data, PAYLOAD, n, at)


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a <= b, and their common prefix length; the first ``known`` bytes are equal and not looked at."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    if not x:
        return True, len(a)
    same = len(a) - (x.bit_length() + 7) // 8
    return a[same] < b[same], same


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of front-coded sorted runs: (run, index) in order, and each string's prefix shared with the one before.

    A node holds the loser of its match with the prefix it shares with that
    match's winner.  After a string is put out, its run's next one comes with
    its front-coded prefix length, and all losers on its way up hold theirs
    against the same string: a longer shared prefix wins unseen, and equal
    lengths are compared from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    over = [i >= len(runs) or not runs[i][0] for i in range(k)]
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (k - len(runs))
    loser: list[tuple[int, int]] = [(0, 0)] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if over[b]:
            loser[node] = (b, 0)
            return a
        if over[a]:
            loser[node] = (a, 0)
            return b
        less, same = _compare(strings[a][at[a]], strings[b][at[b]], 0)
        loser[node] = (b, same) if less else (a, same)
        return a if less else b

    winner, shared = play(1), 0
    order, lcps = [], []
    while not over[winner]:
        order.append((winner, at[winner]))
        lcps.append(shared)
        w = winner
        at[w] += 1
        if at[w] < len(strings[w]):
            c, node = prefixes[w][at[w]], (w + k) >> 1
        else:
            over[w], c, node = True, -1, (w + k) >> 1
        while node:
            r, rc = loser[node]
            if over[r]:
                pass
            elif c < rc:
                loser[node], w, c = (w, c), r, rc
            elif c == rc:
                less, same = _compare(strings[w][at[w]], strings[r][at[r]], c)
                if less:
                    loser[node] = (r, same)
                else:
                    loser[node], w = (w, same), r
            node >>= 1
        winner, shared = w, c
    return order, lcps


def _merged(k1, k2, lo, hi) -> np.ndarray:
    """Rows (k1, k2, lo, hi), overlapping ones of a text merged."""
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    o = np.lexsort((lo, k2, k1))
    k1, k2, lo, hi = k1[o], k2[o], lo[o], hi[o]
    other = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][: len(lo)]
    # texts are laid out one after the other, so that one running maximum serves all
    shift = np.cumsum(other) << 40
    reach = np.maximum.accumulate(hi + shift) if len(hi) else hi
    start = np.flatnonzero(np.r_[True, (lo + shift)[1:] > reach[:-1]][: len(lo)])
    end = np.r_[start[1:] - 1, len(lo) - 1][: len(start)]
    return np.stack([k1[start], k2[start], lo[start], (reach - shift)[end]], axis=1).astype("<i8") if len(start) else np.zeros((0, 4), "<i8")


def _runs(parts: int):
    """Sorted front-coded runs of the suffixes at the kept anchors, by hash range."""

    def flush(rows, payload):
        x, p = np.concatenate(rows), np.concatenate(payload)
        o = _order(x)
        x, p = x[o], p[o]
        # equal rows stand for each other's partner: all their windows repeat, and one of them goes on
        new = _shared(x) < WIDTH
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(x)])
        twice = np.repeat(size > 1, size) | (p["many"] > 0)
        known = _merged(p["k1"][twice], p["k2"][twice], p["place"][twice] - p["far"][twice], p["place"][twice] - p["near"][twice] + LENGTH)
        x, p = x[first], p[first]
        p["many"] |= size > 1
        top = x[:, 0].astype(np.int64) * 65536 + x[:, 1].astype(np.int64) * 256 + x[:, 2]
        part = top * parts >> 24
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        runs = [front_code(x[a:z], p[a:z]) for a, z in zip(cuts, cuts[1:])]
        shares = np.array_split(known, len(runs))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(runs, pa.binary()), pa.array([k.tobytes() for k in shares], pa.binary())], names=["part", "run", "known"])

    def run(batches):
        rows, payload, held = [], [], 0
        around = np.r_[np.arange(LENGTH), -np.arange(1, REACH)]
        for b in slices(batches, 32):
            for k1, k2, n, text, found in zip(*(b.column(i).to_pylist() for i in range(5))):
                t = np.full(len(text) + LENGTH + REACH, 0xFF, dtype=np.uint8)  # no UTF-8 text holds this byte
                t[REACH : REACH + len(text)] = np.frombuffer(text, np.uint8)
                at = np.array([f["at"] for f in found], dtype=np.int64)
                h = np.array([f["h"] for f in found], dtype=np.int64)
                for lo in range(0, len(at), RUN):
                    a = at[lo : lo + RUN]
                    x = np.empty((len(a), WIDTH), dtype=np.uint8)
                    x[:, :8] = h[lo : lo + RUN].astype(">i8").view(np.uint8).reshape(-1, 8)
                    x[:, 8:] = t[(a // 65536 + REACH)[:, None] + around]
                    p = np.zeros(len(a), PAYLOAD)
                    p["k1"], p["k2"], p["place"], p["near"], p["far"], p["many"] = k1, k2, a // 65536, a // 256 % 256, a % 256, n > 1
                    rows.append(x)
                    payload.append(p)
                    held += len(a)
                    if held >= RUN:
                        yield flush(rows, payload)
                        rows, payload, held = [], [], 0
        if rows:
            yield flush(rows, payload)

    return run


def repeated_spans(frame: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one hash range; (k1, k2, lo, hi) of the bytes that repeated windows cover."""
    runs, payload = [], []
    for blob in frame["run"]:
        s, c, p = front_decode(blob)
        runs.append((s, c))
        payload.append(p)
    base = np.cumsum([0, *map(len, payload)])
    order, lcps = merge_runs(runs)
    p = np.concatenate(payload)[[base[r] + i for r, i in order]]
    backward = np.frombuffer(b"".join([runs[r][0][i][8 + LENGTH :] for r, i in order]), np.uint8).reshape(len(p), REACH - 1)
    del runs, payload
    lcp = np.array(lcps)
    back_order = _order(backward)
    back_lcp = _shared(backward[back_order])
    least, most = np.full(len(p), 10_000), np.full(len(p), -1)
    near, far = p["near"].astype(np.int64), p["far"].astype(np.int64)
    many = p["many"] > 0
    least[many], most[many] = near[many], far[many]
    group = np.empty(len(p), dtype=np.int64)
    for d in range(REACH):
        rows = np.flatnonzero((near <= d) & (d <= far))
        if len(rows) < 2:
            continue
        group[back_order] = np.cumsum(back_lcp < d)
        key = np.cumsum(lcp < 8 + LENGTH - d)[rows] * (len(p) + 1) + group[rows]
        o = np.argsort(key, kind="stable")
        same = key[o][1:] == key[o][:-1]
        hit = np.zeros(len(rows), dtype=bool)
        hit[o[1:]] |= same
        hit[o[:-1]] |= same
        hit = rows[hit]
        least[hit], most[hit] = np.minimum(least[hit], d), np.maximum(most[hit], d)
    got = most >= 0
    found = np.stack([p["k1"][got], p["k2"][got], p["place"][got] - most[got], p["place"][got] - least[got] + LENGTH], axis=1)
    known = np.concatenate([np.frombuffer(k, "<i8").reshape(-1, 4) for k in frame["known"]])
    return pd.DataFrame(_merged(*np.concatenate([found, known]).T), columns=["k1", "k2", "lo", "hi"])


def _cut_texts(batches):
    for b in slices(batches):
        out = []
        for k1, k2, n, text, spans in zip(*(b.column(i).to_pylist() for i in range(5))):
            text, merged = text or b"", []
            if n > 1 and len(text) >= LENGTH:
                merged = [[0, len(text)]]
            else:
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
            ends = [0, *(x for s in merged for x in s), len(text)]
            rest = b"".join(text[a:z] for a, z in zip(ends[::2], ends[1::2]))
            out.append((k1, k2, len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [{"lo": a, "hi": z} for a, z in merged]))
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of lo, hi in bytes)."""
    n = parallelism(docs.sparkSession)
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    texts = keyed.repartition(n, "k1", "k2").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    texts = bucketed(texts, n, "k1", "k2")
    counted = texts.select("text").mapInArrow(_count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    places = texts.select("k1", "k2", "text").mapInArrow(_places, "k1 long, k2 long, h long, at long")
    kept = places.join(counted, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "at")).alias("found"))
    runs = texts.join(kept, ["k1", "k2"]).select("k1", "k2", "n", "text", "found").mapInArrow(_runs(n), "part long, run binary, known binary")
    spans = runs.groupBy("part").applyInPandas(repeated_spans, "k1 long, k2 long, lo long, hi long")
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    result = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "n", "text", "spans")
    result = result.mapInArrow(_cut_texts, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: bigint, hi: bigint>>")
    return keyed.select("doc_id", "k1", "k2").join(result, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
