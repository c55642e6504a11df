"""Shapefiles as a Spark data source, read by record ranges and written one file per task and block of rows.

``spark.read.format("shapefile").load(path)`` takes a file or a folder of them.
A partition is a range of records: its places come from the .shx offsets, its
attributes from the fixed-length rows of the .dbf, so a file of any number of
records is read in parallel and only in pieces.  Columns are the .dbf fields and
``polygons``: an array of polygons, each an outer ring and its holes, rings
without their repeated last point.  Rings are outer or inner by orientation
(outer: clockwise) and a hole belongs to the smallest outer ring around it.
Files are opened through pyarrow's file systems, so paths may be local, HDFS or
object-store addresses that all executors reach.

Null shapes and shapes without a ring give null polygons; deleted .dbf rows are
left out; Z and M values are dropped; other shape types, a cut file and record
counts that disagree are errors; an empty folder is an error without a schema.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values of the format.
FILE_CODE, FORMAT_VERSION = 9994, 1000
NULL_SHAPE, POLYGON, POLYGON_Z, POLYGON_M = 0, 5, 15, 25
HEADER = 100
GEOID_LENGTH = 11

POINT = T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())
POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))
#: Records of a partition, and rows of a written file.
RANGE = 20_000
#: Bytes of records that a task decodes at once.
BLOCK = 16 << 20
ARROW_POLYGONS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def signed_area(ring: np.ndarray) -> float:
    """Twice the area of an open ring, positive where it runs counterclockwise."""
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))


def inside(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[spans], b[spans]
    return bool((p[0] < a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)


def nested_places(rings: list[np.ndarray]) -> list[list[int]]:
    """Places of the polygons' rings (outer ring, holes) among open rings; a hole without a ring around it becomes a polygon of its own."""
    areas = [signed_area(r) for r in rings]
    outer = sorted((i for i, a in enumerate(areas) if a < 0), key=lambda i: -areas[i])
    found = {i: [i] for i in sorted(outer)}
    for i, a in enumerate(areas):
        if a > 0:
            middle = (rings[i][0] + rings[i][1]) / 2  # no other ring passes through the middle of a side
            home = next((o for o in outer if inside(rings[o], middle)), None)
            if home is None:
                found[i] = [i]
            else:
                found[home].append(i)
    return list(found.values())


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    return [[rings[i] for i in p] for p in nested_places(rings)]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each group of the given sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _values(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Values that begin at any bytes."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(np.dtype(kind).itemsize)]).view(kind).ravel()


def _put(data: np.ndarray, at: np.ndarray, values: np.ndarray, kind: str) -> None:
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(at), -1)
    data[at[:, None] + np.arange(raw.shape[1])] = raw


def _areas(x: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Twice the areas of open rings of three points or more, which stand in x and y from ``first`` on."""
    own = np.repeat(first, size)
    place = _within(size)
    here = own + place
    after = own + np.where(place + 1 < np.repeat(size, size), place + 1, 0)
    cross = (x[here] - x[own]) * (y[after] - y[own]) - (x[after] - x[own]) * (y[here] - y[own])
    return np.add.reduceat(cross, np.cumsum(size) - size) if len(size) else np.zeros(0)


def decode_shapes(data: np.ndarray, at: np.ndarray, size: np.ndarray, number: np.ndarray) -> pa.Array:
    """Polygons of the records whose contents, of the given sizes, begin at the given bytes."""

    def broken(bad, why):
        for i in np.flatnonzero(bad)[:1]:
            raise ValueError(f"record {number[i]}: {why}")

    broken(size < 4, "is cut short")
    kind = _values(data, at, "<i4")
    for i in np.flatnonzero(~np.isin(kind, (NULL_SHAPE, POLYGON, POLYGON_Z, POLYGON_M)))[:1]:
        raise ValueError(f"record {number[i]}: shape type {kind[i]} is no polygon")
    some = kind != NULL_SHAPE
    broken(some & (size < 44), "is cut short")
    n_parts, n_points = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n_parts[some], n_points[some] = _values(data, at[some] + 36, "<i4"), _values(data, at[some] + 40, "<i4")
    broken(some & ((n_parts < 0) | (n_points < 0) | (44 + 4 * n_parts + 16 * n_points > size)), "is cut short")
    # rings of all records, one after the other
    rec, place = np.repeat(np.arange(len(at)), n_parts), _within(n_parts)
    start = np.where(place == 0, 0, _values(data, at[rec] + 44 + 4 * place, "<i4").astype(np.int64))
    last = place + 1 == n_parts[rec]
    length = np.where(last, n_points[rec], np.r_[start[1:], 0]) - start
    broken(np.bincount(rec[(length < 0) | (start < 0)], minlength=len(at)) > 0, "has parts out of order")
    points = np.repeat(at + 44 + 4 * n_parts, n_points) + 16 * _within(n_points)
    x, y = _values(data, points, "<f8"), _values(data, points + 8, "<f8")
    first = (np.cumsum(n_points) - n_points)[rec] + start
    several = length > 1
    end = first[several] + length[several] - 1
    length[several] -= (x[first[several]] == x[end]) & (y[first[several]] == y[end])
    keep = length >= 3
    rec, first, length = rec[keep], first[keep], length[keep]
    area = _areas(x, y, first, length)
    # without a hole, each ring is a polygon; other records are nested one by one
    use, polygon, role = area < 0, np.arange(len(rec)), np.zeros(len(rec), np.int64)
    for i in np.unique(rec[area >= 0]):
        lo, hi = np.searchsorted(rec, [i, i + 1])
        use[lo:hi] = False
        for p, members in enumerate(nested_places([np.stack([x[f : f + n], y[f : f + n]], 1) for f, n in zip(first[lo:hi], length[lo:hi])])):
            for k, ring in enumerate(members):
                use[lo + ring], polygon[lo + ring], role[lo + ring] = True, lo + p, k
    order = np.lexsort((role[use], polygon[use]))
    rec, first, length, polygon = (v[use][order] for v in (rec, first, length, polygon))
    new = np.r_[True, polygon[1:] != polygon[:-1]] if len(rec) else np.zeros(0, bool)
    offsets = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    spots = np.repeat(first, length) + _within(length)
    n_polygons = np.bincount(rec[new], minlength=len(at))
    ring = pa.ListArray.from_arrays(offsets(length), pa.StructArray.from_arrays([pa.array(x[spots]), pa.array(y[spots])], ["x", "y"]))
    polygons = pa.ListArray.from_arrays(offsets(np.diff(np.r_[np.flatnonzero(new), len(rec)])), ring)
    return pa.ListArray.from_arrays(offsets(n_polygons), polygons, mask=pa.array(n_polygons == 0)).cast(ARROW_POLYGONS)


def decode_shape(content: bytes, number: int) -> list[list[np.ndarray]] | None:
    found = decode_shapes(np.frombuffer(content, np.uint8), np.zeros(1, np.int64), np.array([len(content)]), np.array([number]))[0].as_py()
    return found and [[np.array([(q["x"], q["y"]) for q in r]) for r in p] for p in found]


def encode_shapes(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contents of records one after the other, their sizes, boxes (x, y least, x, y greatest) and which have one."""
    sizes = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    by_record = sizes(polygons)
    whole = polygons.flatten()
    by_polygon = sizes(whole)
    rings = whole.flatten()
    length, point = sizes(rings), rings.flatten()
    x, y = (point.field(i) for i in range(2))
    if point.null_count or x.null_count or y.null_count:
        raise ValueError("a point without coordinates")
    x, y = x.to_numpy(), y.to_numpy()
    rec = np.repeat(np.repeat(np.arange(len(polygons)), by_record), by_polygon)
    outer, first, keep = _within(by_polygon) == 0, np.cumsum(length) - length, length >= 3
    rec, outer, first, length = (v[keep] for v in (rec, outer, first, length))
    forth = (_areas(x, y, first, length) < 0) == outer
    # closed rings, turned where they run the wrong way
    place = _within(length + 1)
    n = np.repeat(length, length + 1)
    place = np.where(place == n, 0, place)
    spots = np.repeat(first, length + 1) + np.where(np.repeat(forth, length + 1), place, n - 1 - place)
    x, y = x[spots], y[spots]
    n_rings = np.bincount(rec, minlength=len(polygons))
    n_points = np.bincount(rec, length + 1, len(polygons)).astype(np.int64)
    some = n_rings > 0
    size = np.where(some, 44 + 4 * n_rings + 16 * n_points, 4)
    at, data = np.cumsum(size) - size, np.zeros(size.sum(), np.uint8)
    boxes = np.zeros((len(polygons), 4))
    begin = (np.cumsum(n_points) - n_points)[some]
    if len(begin):
        boxes[some] = np.stack([np.minimum.reduceat(x, begin), np.minimum.reduceat(y, begin), np.maximum.reduceat(x, begin), np.maximum.reduceat(y, begin)], 1)
    _put(data, at[some], np.full(some.sum(), POLYGON), "<i4")
    _put(data, at[some] + 4, boxes[some], "<f8")
    _put(data, at[some] + 36, np.stack([n_rings[some], n_points[some]], 1), "<i4")
    starts = np.cumsum(length + 1) - (length + 1)
    _put(data, at[rec] + 44 + 4 * _within(n_rings), starts - (np.cumsum(n_points) - n_points)[rec], "<i4")
    _put(data, np.repeat(at + 44 + 4 * n_rings, n_points) + 16 * _within(n_points), np.stack([x, y], 1), "<f8")
    return data, size, boxes, some


@dataclass
class Field:
    name: str
    kind: str
    length: int
    decimals: int
    at: int

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.length <= 20 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def read(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").strip(" \0")
        if self.kind in "NF":
            return None if not text or text[0] == "*" else int(text) if self.type == T.LongType() else float(text)
        if self.kind == "D":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if text.isdigit() else None
        if self.kind == "L":
            return True if text in "YyTt" and text else False if text in "NnFf" and text else None
        return text or None


def table_layout(head: bytes) -> tuple[int, int, int, list[Field]]:
    """Rows, header length, row length and fields of a .dbf."""
    n, start, width = struct.unpack_from("<IHH", head, 4)
    fields, at = [], 1
    for place in range(32, start - 1, 32):
        if head[place] == 0x0D:
            break
        name = head[place : place + 11].split(b"\0")[0].decode("latin-1")
        fields.append(Field(name, chr(head[place + 11]), head[place + 16], head[place + 17], at))
        at += head[place + 16]
    return n, start, width, fields


class Files:
    """A file system and the .shp files of a path; names that begin with an underscore are unfinished."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)

    def shapes(self) -> list[str]:
        info = self.fs.get_file_info(self.path)
        if info.type == fs.FileType.File:
            return [self.path]
        found = self.fs.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True))
        return sorted(i.path for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".shp") and not i.base_name.startswith("_"))

    def beside(self, shape: str, ending: str) -> str:
        return shape[:-4] + (ending.upper() if shape.endswith(".SHP") else ending)

    def read(self, path: str, at: int, size: int | None) -> bytes:
        with self.fs.open_input_file(path) as f:
            size = f.size() - at if size is None else size
            data = f.read_at(size, at)
        if len(data) < size:
            raise ValueError(f"{path} is cut short")
        return data

    def layout(self, shape: str) -> tuple[int, int, int, list[Field]]:
        path = self.beside(shape, ".dbf")
        (start,) = struct.unpack("<H", self.read(path, 8, 2))
        return table_layout(self.read(path, 0, start))

    def encoding(self, shape: str) -> str:
        path = self.beside(shape, ".cpg")
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return "utf-8"
        return self.read(path, 0, None).decode("ascii").strip() or "utf-8"


@dataclass
class Range(InputPartition):
    shape: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, step: int):
        self.path, self.schema, self.step = path, schema, step

    def partitions(self) -> list[Range]:
        files, out = Files(self.path), []
        for shape in files.shapes():
            head = files.read(files.beside(shape, ".shx"), 0, HEADER)
            if struct.unpack_from(">i", head)[0] != FILE_CODE:
                raise ValueError(f"{shape} has no index of a shapefile")
            n = (2 * struct.unpack_from(">i", head, 24)[0] - HEADER) // 8
            if (rows := files.layout(shape)[0]) != n:
                raise ValueError(f"{shape} has {n} shapes and {rows} rows")
            out += [Range(shape, i, min(n, i + self.step)) for i in range(0, n, self.step)]
        return out

    def read(self, part: Range):
        files = Files(self.path)
        _, start, width, fields = files.layout(part.shape)
        encoding = files.encoding(part.shape)
        n = part.last - part.first
        index = np.frombuffer(files.read(files.beside(part.shape, ".shx"), HEADER + 8 * part.first, 8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows = np.frombuffer(files.read(files.beside(part.shape, ".dbf"), start + width * part.first, width * n), np.uint8).reshape(n, width)
        there = np.flatnonzero(rows[:, 0] != ord("*"))
        at, size, rows = index[there, 0] + 8, index[there, 1], rows[there]
        known = {f.name.lower(): f for f in fields}
        types = [to_arrow_type(f.dataType) for f in self.schema.fields]
        block = np.cumsum(size + 8) // BLOCK
        for k in np.unique(block):
            lo, hi = np.searchsorted(block, [k, k + 1])
            a, own = at[lo:hi], size[lo:hi]
            if a.max(initial=0) + own.max(initial=0) - a.min() > 2 * BLOCK + 2 * own.sum():  # far apart: each by itself
                data = b"".join(files.read(part.shape, int(x), int(y)) for x, y in zip(a, own))
                a = np.cumsum(own) - own
            else:
                begin = int(a.min())
                data = files.read(part.shape, begin, int((a + own).max()) - begin)
                a = a - begin
            columns = []
            for c, kind in zip(self.schema.names, types):
                if c.lower() == "polygons":
                    columns.append(decode_shapes(np.frombuffer(data, np.uint8), a, own, part.first + 1 + there[lo:hi]).cast(kind))
                elif f := known.get(c.lower()):
                    raw = rows[lo:hi, f.at : f.at + f.length].tobytes()
                    columns.append(pa.array([f.read(raw[i : i + f.length], encoding) for i in range(0, len(raw), f.length)], kind))
                else:
                    columns.append(pa.nulls(hi - lo, kind))
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Each task writes unfinished files, one per ``RANGE`` rows, which the commit renames."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, batches) -> Written:
        files, names, held, n = Files(self.path), [], [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= RANGE:
                t = pa.Table.from_batches(held)
                names.append(self._file(files, t.slice(0, RANGE)))
                held, n = t.slice(RANGE).to_batches(), n - RANGE
        if n:
            names.append(self._file(files, pa.Table.from_batches(held)))
        return Written(names)

    def _file(self, files: Files, rows: pa.Table) -> str:
        name = f"part-{uuid.uuid4().hex}"
        content, size, boxes, some = encode_shapes(rows["polygons"].cast(ARROW_POLYGONS).combine_chunks())
        at = HEADER + np.cumsum(size + 8) - (size + 8)
        shapes = np.zeros((size + 8).sum(), np.uint8)
        _put(shapes, at - HEADER, np.stack([np.arange(1, len(size) + 1), size // 2], 1), ">i4")
        shapes[np.repeat(at - HEADER + 8, size) + _within(size)] = content
        index = np.stack([at // 2, size // 2], 1).astype(">i4").tobytes()
        boxes = boxes[some].tolist()
        b = np.array(boxes or [(0.0,) * 4])
        box = (*b[:, :2].min(axis=0).tolist(), *b[:, 2:].max(axis=0).tolist(), 0.0, 0.0, 0.0, 0.0)
        head = lambda words: struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", FORMAT_VERSION, POLYGON, *box)
        parts = {".shp": [head((HEADER + len(shapes)) // 2), shapes.tobytes()], ".shx": [head(HEADER // 2 + 4 * len(size)), index], ".dbf": [self._table(rows)], ".cpg": [b"UTF-8"]}
        files.fs.create_dir(files.path, recursive=True)
        for ending, content in parts.items():
            with files.fs.open_output_stream(f"{files.path}/_{name}{ending}") as f:
                f.write(b"".join(content))
        return name

    def _table(self, rows: pa.Table) -> bytes:
        columns = [f for f in self.schema.fields if f.name != "polygons"]
        cells, heads = [], []
        for f in columns:
            kind = {T.LongType: "N", T.IntegerType: "N", T.DoubleType: "F", T.BooleanType: "L", T.DateType: "D"}.get(type(f.dataType), "C")
            say = {"N": str, "F": lambda v: f"{v:.17g}", "L": lambda v: "T" if v else "F", "D": lambda v: v.strftime("%Y%m%d"), "C": str}[kind]
            raw = [b"" if v is None else say(v).encode() for v in rows[f.name].to_pylist()]
            width = {"N": 20, "F": 25, "L": 1, "D": 8, "C": max([1, *map(len, raw)])}[kind]
            if width > 254 or len(f.name) > 10:
                raise ValueError(f"{f.name}: names hold 10 characters, texts 254 bytes")
            cells.append([x.rjust(width) if kind in "NF" else x.ljust(width) for x in raw])
            heads.append(struct.pack("<11sc4xBB14x", f.name.encode(), kind.encode(), width, 0 if kind != "F" else 15) + b"")
        width = 1 + sum(len(c[0]) for c in cells)
        head = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(columns), width)
        return head + b"".join(heads) + b"\r" + b"".join(b" " + b"".join(x) for x in zip(*cells)) + b"\x1a"

    def commit(self, messages) -> None:
        files = Files(self.path)
        kept = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for shape in files.shapes():
                for ending in (".shp", ".shx", ".dbf", ".cpg"):
                    path = files.beside(shape, ending)
                    if files.fs.get_file_info(path).type == fs.FileType.File:
                        files.fs.delete_file(path)
        for n in sorted(kept):
            for ending in (".shx", ".dbf", ".cpg", ".shp"):
                files.fs.move(f"{files.path}/_{n}{ending}", f"{files.path}/{n}{ending}")

    def abort(self, messages) -> None:
        files = Files(self.path)
        for n in (n for m in messages if m for n in m.names):
            for ending in (".shp", ".shx", ".dbf", ".cpg"):
                files.fs.delete_file(f"{files.path}/_{n}{ending}")


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        files = Files(self.options["path"])
        shapes = files.shapes()
        if not shapes:
            raise ValueError(f"no shapefile in {self.options['path']}")
        out = T.StructType()
        for f in files.layout(shapes[0])[3]:
            out.add(f.name, f.type)
        return out.add("polygons", POLYGONS)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("records", RANGE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def tracts(spark: SparkSession, path: str) -> DataFrame:
    """geoid, polygons, aland, awater, population (0: it comes from the census) of tract files, by geoid.

    A file without GEOID and a code of another length are errors; null areas
    count 0; tracts without geometry are left out.
    """
    register(spark)
    t = spark.read.format("shapefile").load(path)
    known = {c.lower(): c for c in t.columns}
    if "geoid" not in known:
        raise ValueError(f"{path} has no field GEOID")
    code = F.trim(F.coalesce(F.col(known["geoid"]), F.lit("")))
    checked = F.when(F.length(code) == GEOID_LENGTH, code).otherwise(F.raise_error(F.concat(F.lit(f"no code of {GEOID_LENGTH} characters: "), code)))
    area = lambda c: (F.coalesce(F.col(known[c]).cast("long"), F.lit(0)) if c in known else F.lit(0).cast("long")).alias(c)
    return t.select(checked.alias("geoid"), "polygons", area("aland"), area("awater"), F.lit(0).cast("long").alias("population")).where("polygons is not null").orderBy("geoid")
