"""A reader and a small writer of the binary map dump format (PBF) as a Python data source.

A dump is a row of blobs, each with a length, a header and compressed groups of objects. The driver walks the headers
only; each blob is a partition, read and decoded by a task on its own. ``spark.read.format("mapdump").option("path", ...)``
gives (kind, id, lat, lon, tags, refs, members) of every object; :func:`read` makes a dataset of them. Files are opened by
pyarrow, so that any file system it knows will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellatlas.sources.osm import NODE, RELATION, TAGS, WAY, Dataset

SCHEMA = f"kind int, id long, lat double, lon double, tags {TAGS}, refs array<long>, members array<struct<member_id:long,member_type:int,role:string>>"
#: Objects of a group when writing.
GROUP = 8000
# The number that the format gives each type of member.
MEMBER_TYPES = {0: NODE, 1: WAY, 2: RELATION}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: numbers as they are, anything with a length as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown kind of field: {kind}")
        yield key >> 3, value


def numbers(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append((value >> 1) ^ -(value & 1) if signed else value)
    return out


def running(steps: list[int]) -> list[int]:
    total, out = 0, []
    for s in steps:
        total += s
        out.append(total)
    return out


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tags(strings: list[str], keys: list[int], values: list[int]) -> list[tuple[str, str]]:
    return [(strings[k], strings[v]) for k, v in zip(keys, values)]


def _group(data: bytes, strings: list[str], place) -> Iterator[tuple]:
    for number, value in fields(data):
        f: dict[int, int | bytes] = dict(fields(value))
        if number == 1:  # a single node
            lat, lon = (place(k, numbers_of_one(f[n])) for k, n in ((0, 8), (1, 9)))
            yield NODE, numbers_of_one(f[1]), lat, lon, _tags(strings, numbers(f.get(2, b"")), numbers(f.get(3, b""))), None, None
        elif number == 2:  # many nodes, in columns
            ids, lats, lons = (running(numbers(f.get(n, b""), signed=True)) for n in (1, 8, 9))
            marks = iter(numbers(f.get(10, b"")))
            for i, lat, lon in zip(ids, lats, lons):
                own = []
                while key := next(marks, 0):
                    own.append((strings[key], strings[next(marks)]))
                yield NODE, i, place(0, lat), place(1, lon), own, None, None
        elif number == 3:
            yield WAY, _long(f[1]), None, None, _tags(strings, numbers(f.get(2, b"")), numbers(f.get(3, b""))), running(numbers(f.get(8, b""), signed=True)), None
        elif number == 4:
            members = zip(running(numbers(f.get(9, b""), signed=True)), numbers(f.get(10, b"")), numbers(f.get(8, b"")))
            yield RELATION, _long(f[1]), None, None, _tags(strings, numbers(f.get(2, b"")), numbers(f.get(3, b""))), None, [(m, MEMBER_TYPES[t], strings[r]) for m, t, r in members]


def numbers_of_one(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def unpack(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise ValueError("only plain and zlib blobs are supported")


def decode(blob: bytes) -> Iterator[tuple]:
    """The objects of a data blob."""
    strings, groups, grain, offsets = [], [], 100, [0, 0]
    for number, value in fields(unpack(blob)):
        if number == 1:
            strings = [v.decode() for _, v in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number in (19, 20):
            offsets[number - 19] = _long(value)
    for g in groups:
        yield from _group(g, strings, lambda axis, v: (offsets[axis] + grain * v) / 1_000_000_000)


class Blob(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def blobs(path: str) -> list[Blob]:
    """The data blobs of a dump, from their headers alone."""
    out = []
    with _open(path) as f:
        size, at = f.size(), 0
        while at < size:
            f.seek(at)
            (length,) = struct.unpack(">I", f.read(4))
            head = dict(fields(f.read(length)))
            if head[1] == b"OSMData":
                out.append(Blob(at + 4 + length, head[3]))
            at += 4 + length + head[3]
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blob]:
        return blobs(self.path) or [Blob(0, 0)]

    def read(self, partition: Blob) -> Iterator[tuple]:
        if partition.size:
            with _open(self.path) as f:
                f.seek(partition.offset)
                yield from decode(f.read(partition.size))


class MapDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mapdump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def scan(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MapDump)
    return spark.read.format("mapdump").option("path", path if "://" in path else f"file://{path}").load()


def read(spark: SparkSession, path: str) -> Dataset:
    """A dataset from a dump; way points and members keep their order in ``seq``."""
    rows = scan(spark, path)
    of = lambda kind: rows.where(F.col("kind") == kind)
    way_nodes = of(WAY).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id")).select("way_id", (F.col("seq") + 1).alias("seq"), "node_id")
    members = of(RELATION).select(F.col("id").alias("parent_id"), F.posexplode("members").alias("seq", "m"))
    members = members.select("parent_id", (F.col("seq") + 1).alias("seq"), "m.member_id", "m.member_type", "m.role")
    return Dataset(of(NODE).select("id", "lat", "lon", "tags"), of(WAY).select("id", "tags"), way_nodes, of(RELATION).select("id", "tags"), members)


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes((*out, value))


def _field(number: int, value: int | bytes) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _packed(values: list[int], signed: bool = False) -> bytes:
    return b"".join(_varint((v << 1) ^ (v >> 63) if signed else v) for v in values)


def _steps(values: list[int]) -> bytes:
    return _packed([b - a for a, b in zip([0, *values], values)], signed=True)


def encode(objects: list[tuple]) -> bytes:
    """A data blob of objects (rows of ``SCHEMA``), as :func:`decode` reads it."""
    known: dict[str, int] = {"": 0}
    index = lambda s: known.setdefault(s, len(known))
    numbers_back = {v: k for k, v in MEMBER_TYPES.items()}
    groups = []
    nodes = [o for o in objects if o[0] == NODE]
    if nodes:
        marks = [n for o in nodes for n in (*(index(s) for t in o[4] for s in t), 0)]
        lats, lons = ([round(o[i] * 1e7) for o in nodes] for i in (2, 3))
        groups.append(_field(2, _field(1, _steps([o[1] for o in nodes])) + _field(8, _steps(lats)) + _field(9, _steps(lons)) + _field(10, _packed(marks))))
    for kind, i, _, _, tags, refs, members in objects:
        if kind == NODE:
            continue
        head = _field(1, i) + _field(2, _packed([index(k) for k, _ in tags])) + _field(3, _packed([index(v) for _, v in tags]))
        if kind == WAY:
            groups.append(_field(3, head + _field(8, _steps(refs))))
        else:
            rest = _field(8, _packed([index(r) for *_, r in members])) + _field(9, _steps([m for m, *_ in members])) + _field(10, _packed([numbers_back[t] for _, t, _ in members]))
            groups.append(_field(4, head + rest))
    block = _field(1, b"".join(_field(1, s.encode()) for s in known)) + b"".join(_field(2, g) for g in groups)
    return _field(2, len(block)) + _field(3, zlib.compress(block))


def framed(kind: bytes, blob: bytes) -> bytes:
    head = _field(1, kind) + _field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob
