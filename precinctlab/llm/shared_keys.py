"""Keys that two sources hold, found from packed sorted lists.

A source (the texts of one bucket) gives its different hash keys as sorted
lists, cut by key range and packed: differences of neighbours in byte planes,
compressed.  A range's lists meet in one task, and each source gets back those
of its keys that another one holds too.  A key costs some two bytes of shuffle
instead of a row, so every key of a corpus can take part.  Keys keep ``bits``
leading bits of their hash; a match by chance only lets a key go on for nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "part int, src int, keys binary"
#: Bytes of text of a source: a task holds this much at once.
SOURCE = 24 << 20


def plan(docs: DataFrame, text: str, least: int, source: int = SOURCE) -> tuple[int, int]:
    """(number of sources, bits of a key) for the bytes of a text column."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-size // source)), min(64, max(32, math.ceil(math.log2(size + 2)) + 8))


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def different(keys: np.ndarray) -> np.ndarray:
    """Sorted keys once each; np.unique would hash them, in several times the time and memory."""
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def parts_of(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Key ranges of keys of ``bits`` bits."""
    return ((keys >> np.uint64(max(0, bits - 32))) * np.uint64(parts) >> np.uint64(min(32, bits))).astype(np.int64)


def pack_parts(keys: np.ndarray, src: int, parts: int, bits: int) -> pa.Table:
    """Rows of ``SHAPE`` from a source's 64-bit keys."""
    keys = different(np.sort(keys >> np.uint64(64 - bits)))
    top = parts_of(keys, parts, bits)
    cuts = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    blobs = [pack(keys[a:z]) for a, z in zip(cuts, cuts[1:])]
    return pa.table({"part": pa.array(top[cuts[:-1]], pa.int32()), "src": pa.array([src] * len(blobs), pa.int32()), "keys": pa.array(blobs, pa.binary())})


def _meet(table: pa.Table) -> pa.Table:
    src, lists = table["src"].to_pylist(), [unpack(x) for x in table["keys"].to_pylist()]
    every = np.sort(np.concatenate(lists))
    twice = different(every[1:][every[1:] == every[:-1]])
    back = [x[member(x, twice)] for x in lists]
    rows = [(s, pack(x)) for s, x in zip(src, back) if len(x)]
    return pa.table({"src": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted list."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def shared(keys: DataFrame) -> DataFrame:
    """(src, keys) of the keys that several sources hold, from rows of ``SHAPE``."""
    return keys.groupBy("part").applyInArrow(_meet, "src int, keys binary")


def held(table: pa.Table) -> np.ndarray:
    """Sorted keys of one source from its rows of ``shared``."""
    lists = [unpack(x) for x in table["keys"].to_pylist()]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *lists]))
