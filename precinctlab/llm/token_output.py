"""Token-id output in bit- or byte-plane blocks.

Ids are written in ascending doc_id order.  A segment holds whole documents; its
ids, as 32-bit integers, are cut into blocks of a fixed number of ids, each
block is transposed into byte planes (or bit planes), each plane is compressed
with zstandard, and a chunk index gives every plane's place.  Segments are rows
of a Parquet dataset, so that Spark's commit protocol and any store it can
write serve as the file system; the reader decodes segments in parallel.

Segment layout, little endian (fixed values of this format):
  magic "PLN1", plane kind (1 byte: 8 byte planes of 4, 1 bit planes of 32),
  ids per block (u32), number of ids (u64), number of planes stored (u32),
  then per plane its offset (u64) and length (u32), then the planes.

Cases: a null text is empty and has the end id alone; rows with equal or null
doc_id all stay (nulls first, ties in any fixed order); very long texts make a
long segment; an empty table writes no segment; extra columns are left aside.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, shared_dir

MAGIC = b"PLN1"
HEAD = struct.Struct("<4sBIQI")
PLACE = struct.Struct("<QI")
BLOCK = 1 << 14
SEGMENT_IDS = 1 << 20
END_ID = 0
#: Bytes of chunks and ids that a worker remembers; beyond it, it forgets them all.  Chunks over LONG characters are not remembered.
MEMORY = 192 << 20
LONG = 64


def _planes(block: np.ndarray, bit: bool) -> list[bytes]:
    if bit:
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    return [np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4)[:, i]).tobytes() for i in range(4)]


def pack(ids: np.ndarray, planes: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    """One segment from an array of ids."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    z, bit = zstandard.ZstdCompressor(level=level), planes == "bit"
    parts = [z.compress(p) for at in range(0, len(ids), block) for p in _planes(ids[at : at + block], bit)]
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    return b"".join([HEAD.pack(MAGIC, 1 if bit else 8, block, len(ids), len(parts)), *(PLACE.pack(a, len(p)) for a, p in zip(ends, parts)), *parts])


def unpack(blob: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks by way of the chunk index."""
    magic, kind, block, n, n_parts = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a segment")
    per, base, z = (32 if kind == 1 else 4), HEAD.size + n_parts * PLACE.size, zstandard.ZstdDecompressor()
    total = n_parts // per
    out = [np.zeros(0, "<u4")]
    for b in range(first_block, total if n_blocks is None else min(total, first_block + n_blocks)):
        size = min(block, n - b * block)
        parts = []
        for i in range(b * per, (b + 1) * per):
            at, length = PLACE.unpack_from(blob, HEAD.size + i * PLACE.size)
            parts.append(np.frombuffer(z.decompress(blob[base + at : base + at + length]), np.uint8))
        if kind == 1:
            bits = np.stack([np.unpackbits(p, count=size, bitorder="little") for p in parts], axis=1)
            out.append(np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4"))
        else:
            out.append(np.ascontiguousarray(np.stack(parts, axis=1)).reshape(-1).view("<u4"))
    return np.concatenate(out)


class Encoder:
    """Byte-level BPE through the tokenizers library, remembering the ids of chunks.

    A space between two non-space characters always starts a new pre-token, so
    texts cut there encode piecewise; other texts (a space stands beside white
    space or at an end) go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.known, self.held = Tokenizer.from_file(path), {}, 0
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that follow a space: many are encoded as one text, and cut where a token begins with a space."""
        known, long = self.known, {}
        for at in range(0, len(chunks), 2048):
            part = chunks[at : at + 2048]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                raise ValueError("chunk boundaries do not match")
            data, ends = ids.tobytes(), (4 * starts).tolist() + [4 * len(ids)]
            known.update(zip(part, [data[a:z] for a, z in zip(ends, ends[1:])]))
            self.held += sum(map(len, part)) + len(data) + 160 * len(part)
            for x in [x for x in part if len(x) > LONG]:
                long[x] = known.pop(x)
                self.held -= len(x) + len(long[x]) + 160
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.held > MEMORY:
            self.known.clear()
            self.held = 0
        known = self.known
        pieces: list[list[str] | None] = [t.split(" ") for t in texts]
        after = [p[1:] for p in pieces]
        new = set().union(*after).difference(known)
        # a chunk with white space at an end is never known, so only new ones are looked at
        odd = {x for x in new if not x or x[0].isspace() or x[-1].isspace()}
        for i, (p, rest) in enumerate(zip(pieces, after)):
            if rest and (not p[0] or p[0][-1].isspace() or odd and not odd.isdisjoint(rest)):
                pieces[i] = None
        if odd:
            new = set().union(*(rest for p, rest in zip(pieces, after) if p)).difference(known)
        long = self._learn(list(new))
        get = (lambda x: known[x] if x in known else long[x]) if long else known.__getitem__
        whole = iter(self.library.encode_batch_fast([p[0] if p else t for t, p in zip(texts, pieces)], add_special_tokens=False))
        return [np.array(next(whole).ids, dtype="<u4").tobytes() + (b"".join(map(get, rest)) if p else b"") for p, rest in zip(pieces, after)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, planes: str = "byte", block: int = BLOCK) -> None:
    """Write the ids of all texts, each with the end id appended, in ascending doc_id order under ``path``."""

    def run(batches):
        shard, segment = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids = [], [], []
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            nonlocal segment
            every = np.frombuffer(b"".join(ids), "<u4")
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(every)], pa.int64()),
                                              pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack(every, planes, block)], pa.binary())],
                                             names=["shard", "segment", "n_ids", "doc_ids", "lengths", "planes"])
            segment += 1
            for x in (doc_ids, lengths, ids):
                x.clear()
            return row

        held = 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for at in range(0, len(keys), 512):
                texts = [x or "" for x in b.column(1).slice(at, 512).to_pylist()]
                for k, data in zip(keys[at : at + 512], encoder(tokenizer).encode(texts)):
                    doc_ids.append(k)
                    lengths.append(len(data) // 4 + 1)
                    ids += [data, end]
                    held += len(data) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        held = 0
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, "shard int, segment int, n_ids long, doc_ids array<bigint>, lengths array<int>, planes binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, ids (array), shard, segment and place in the segment."""

    def run(batches):
        for b in batches:
            for shard, segment, doc_ids, lengths, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "segment", "doc_ids", "lengths", "planes"))):
                ids, ends = unpack(blob), np.cumsum([0, *lengths])
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64))),
                                                  pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(ends[:-1], pa.int64())], names=["doc_id", "ids", "shard", "segment", "place"])

    return spark.read.parquet(path).mapInArrow(run, "doc_id long, ids array<bigint>, shard int, segment int, place long")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for shard, segment, doc_ids, lengths, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "segment", "doc_ids", "lengths", "planes"))):
                ids, ends = memoryview(unpack(blob).tobytes()), np.cumsum([0, *lengths])
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                                                  pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32())], names=["doc_id", "place", "n_tokens", "ids_crc32", "shard", "segment"])

    files = spark.read.parquet(path)
    sizes = files.select("shard", "segment", "n_ids")
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    before = shards.select("shard", F.coalesce(F.sum("all_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_base"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0))).join(before, "shard").select("shard", "segment", (F.col("base") + F.col("shard_base")).alias("base"))
    docs = files.mapInArrow(run, "doc_id long, place long, n_tokens long, ids_crc32 long, shard int, segment int")
    return docs.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_digest(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    write_ids(docs, path, tokenizer, **how)
    return digest(docs.sparkSession, path)
