"""Polygon layers (.shp, .shx, .dbf) as a data source that Spark splits.

The driver reads the index files only, eight bytes a record, and cuts each layer into ranges of records; a task reads its range of
shapes and rows.  A box lets records go by their bounds, before their points are unpacked.  Layers are written by tasks, one layer to a
partition under a name that a repeated task overwrites.  Files are reached through Arrow's file systems, so that a path may be a folder
that all nodes share or a store's address.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_COLUMNS = [("file", pa.string()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("minx", "miny", "maxx", "maxy")], ("parts", pa.list_(pa.list_(_POINT))), ("fields", pa.map_(pa.string(), pa.string()))]
SCHEMA = "file string, n long, minx double, miny double, maxx double, maxy double, parts array<array<struct<x:double,y:double>>>, fields map<string,string>"
#: Bytes of shapes in one range of records.
RANGE_BYTES = 32 << 20
_BATCH = 1000


def _reversed(xy: np.ndarray) -> list[dict[str, float]]:
    """A ring's points the other way round: files turn outer rings with the clock, tables against it."""
    return [{"x": x, "y": y} for x, y in xy[::-1].tolist()]


def record(number: int, rings: list[list[tuple[float, float]]]) -> bytes:
    """One polygon record, big-endian number (from 1) and length in 16-bit words before little-endian shape; no rings make a null shape."""
    if not rings:
        return struct.pack(">ii", number, 2) + struct.pack("<i", 0)
    points = np.concatenate([np.array(r[::-1], "<f8").reshape(-1, 2) for r in rings])
    starts = np.cumsum([0] + [len(r) for r in rings[:-1]]).astype("<i4")
    bounds = np.concatenate([points.min(axis=0), points.max(axis=0)]).astype("<f8")
    body = struct.pack("<i", 5) + bounds.tobytes() + struct.pack("<2i", len(rings), len(points)) + starts.tobytes() + points.tobytes()
    return struct.pack(">ii", number, len(body) // 2) + body


def shapes(content: bytes, box: tuple[float, float, float, float] | None = None) -> Iterator[tuple[int, tuple[float, ...], list[list[dict[str, float]]]]]:
    """Position, bounds and rings of the polygon records in a range of a .shp file; null shapes and those whose bounds miss the box are passed over."""
    at, place = 0, -1
    while at + 12 <= len(content):
        words = struct.unpack_from(">i", content, at + 4)[0]
        body, place = at + 8, place + 1
        at = body + 2 * words
        if struct.unpack_from("<i", content, body)[0] != 5:
            continue
        bounds = struct.unpack_from("<4d", content, body + 4)
        if box and (bounds[0] > box[2] or bounds[2] < box[0] or bounds[1] > box[3] or bounds[3] < box[1]):
            continue
        rings, points = struct.unpack_from("<2i", content, body + 36)
        starts = np.frombuffer(content, "<i4", rings, body + 44)
        xy = np.frombuffer(content, "<f8", 2 * points, body + 44 + 4 * rings).reshape(-1, 2)
        yield place, bounds, [_reversed(part) for part in np.split(xy, starts[1:])]


class Attributes:
    """Rows of a .dbf file by number, as text without padding; empty fields are null."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        self.rows, self.header, self.width = struct.unpack_from("<IHH", file.read_at(12, 0), 4)
        head = file.read_at(self.header, 0)
        self.fields: list[tuple[str, int]] = []
        at = 32
        while at < self.header - 1 and head[at] != 0x0D:
            self.fields.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), head[at + 16]))
            at += 32

    def range(self, first: int, count: int) -> list[list[tuple[str, str | None]]]:
        count = max(0, min(count, self.rows - first))
        raw = self.file.read_at(count * self.width, self.header + first * self.width)
        out = []
        for row in range(count):
            place, fields = row * self.width + 1, []
            for name, size in self.fields:
                fields.append((name, raw[place : place + size].decode("utf-8", "replace").strip() or None))
                place += size
            out.append(fields)
        return out


@dataclass
class RecordRange(InputPartition):
    """Records ``first`` to ``first + count`` of a file, in its bytes from ``start`` to ``stop``."""

    file: str
    first: int
    count: int
    start: int
    stop: int


class LayerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        given = options.get("box")
        self.box = tuple(float(v) for v in given.split(",")) if given else None

    def partitions(self) -> list[RecordRange]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith(".shx")]
        out: list[RecordRange] = []
        for path in sorted(found):
            with system.open_input_file(path) as file:
                index = np.frombuffer(file.read()[100:], ">i4").reshape(-1, 2).astype(np.int64) * 2
            if len(index):
                begins, ends = index[:, 0], index[:, 0] + index[:, 1] + 8
                cuts = np.flatnonzero(np.diff((begins - begins[0]) // self.bytes, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(index)]):
                    out.append(RecordRange(path[:-4], a, b - a, int(begins[a]), int(ends[b - 1])))
        return out

    def read(self, partition: RecordRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no layer has records
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{partition.file}.shp") as file:
            content = file.read_at(partition.stop - partition.start, partition.start)
        with system.open_input_file(f"{partition.file}.dbf") as file:
            attributes = Attributes(file)
            rows: list[tuple] = []
            for place, bounds, rings in shapes(content, self.box):
                rows.append((partition.file.rsplit("/", 1)[-1], partition.first + place, *bounds, rings, place))
                if len(rows) == _BATCH:
                    yield self._batch(rows, attributes, partition.first)
                    rows = []
            if rows:
                yield self._batch(rows, attributes, partition.first)

    def _batch(self, rows: list[tuple], attributes: Attributes, first: int) -> pa.RecordBatch:
        low, high = rows[0][-1], rows[-1][-1]
        fields = attributes.range(first + low, high - low + 1)
        columns = [*zip(*rows)][:-1]
        kept = [fields[r[-1] - low] if r[-1] - low < len(fields) else None for r in rows]
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip([*columns, kept], _COLUMNS)], names=[n for n, _ in _COLUMNS])


class PolygonLayers(DataSource):
    """``spark.read.format("polygon_layers").option("box", "minx,miny,maxx,maxy").load(folder)``; ``rangeBytes`` bounds a range."""

    @classmethod
    def name(cls) -> str:
        return "polygon_layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayerReader:
        return LayerReader(dict(self.options))


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, n, minx, miny, maxx, maxy, parts, fields`` of all polygons of the layers under a folder; n is the record's place in its file, from 0.

    With a box only polygons whose bounds meet it.  Outer rings turn against the clock.  Null shapes are left out.
    """
    spark.dataSource.register(PolygonLayers)
    reader = spark.read.format("polygon_layers").option("rangeBytes", str(range_bytes))
    return (reader.option("box", ",".join(repr(float(v)) for v in box)) if box else reader).load(path)


def write_layer(polygons: DataFrame, path: str, fields: dict[str, int], parts: str = "parts") -> int:
    """Writes polygons and the columns ``fields`` (name of at most ten letters to width in bytes) as text, one layer for each partition; returns their number of records.

    Longer values are an error, nulls are blank, polygons without rings are null shapes.  A task that is repeated overwrites what it wrote.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = fs.FileSystem.from_uri(path)
        stem = f"{root}/part-{context.partitionId() if context else 0:05d}"
        index, low, high, n, at = [], np.full(2, np.inf), np.full(2, -np.inf), 0, 100
        with system.open_output_stream(f"{stem}.body") as body, system.open_output_stream(f"{stem}.rows") as table:
            for batch in batches:
                for rings, *values in zip(*(c.to_pylist() for c in batch.columns)):
                    whole = [[(p["x"], p["y"]) for p in r] for r in rings or []]
                    n += 1
                    raw = record(n, whole)
                    for r in whole:
                        low, high = np.minimum(low, np.min(r, axis=0)), np.maximum(high, np.max(r, axis=0))
                    index.append((at // 2, len(raw) // 2 - 4))
                    at += len(raw)
                    body.write(raw)
                    texts = [(v or "").encode() for v in values]
                    if any(len(t) > w for t, w in zip(texts, fields.values())):
                        raise ValueError("a value is longer than its field")
                    table.write(b" " + b"".join(t.ljust(w) for t, w in zip(texts, fields.values())))
        ends = np.concatenate([low, high]) if n and np.isfinite(low).all() else np.zeros(4)
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, 5) + ends.astype("<f8").tobytes() + bytes(32)
        described = b"".join(name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for name, width in fields.items())
        first = struct.pack("<B3BIHH", 3, 95, 7, 26, n, 33 + len(described), 1 + sum(fields.values())) + bytes(20) + described + b"\r"
        for kind, start, rest in (("shp", head(at), "body"), ("dbf", first, "rows")):
            with system.open_output_stream(f"{stem}.{kind}") as out, system.open_input_stream(f"{stem}.{rest}") as source:
                out.write(start)
                while block := source.read(8 << 20):
                    out.write(block)
            system.delete_file(f"{stem}.{rest}")
        # the index last: without it a layer is not seen
        with system.open_output_stream(f"{stem}.shx") as out:
            out.write(head(100 + 8 * n) + np.array(index, ">i4").reshape(-1, 2).tobytes())
        yield pa.record_batch([pa.array([n])], names=["n"])

    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    columns = [F.col(c).cast("string").alias(c) for c in fields]
    return polygons.select(parts, *columns).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
