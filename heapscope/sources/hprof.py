"""A Spark data source for HPROF heap dumps.

    register(spark)
    spark.read.format("hprof").load("heap.hprof")

One row a record or heap sub-record, in any order; `pos` is the offset of its tag byte. The record headers are read once on the driver (bodies are skipped), and each heap
segment and each run of other records is a partition. Option `payload` (default true): whether instance and array contents are
read. Paths are opened by every task, so they lie on storage that all executors share: a mounted folder, or a URI of a file system that Arrow
knows (hdfs, s3, gs).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.staging import ship

#: Record and sub-record tags and element sizes (fixed values of the format).
STRING, LOAD_CLASS, UNLOAD_CLASS, FRAME, TRACE, DUMP, DUMP_SEGMENT = 0x01, 0x02, 0x03, 0x04, 0x05, 0x0C, 0x1C
SUB = 0x100
CLASS_DUMP, INSTANCE, OBJECT_ARRAY, PRIMITIVE_ARRAY = SUB + 0x20, SUB + 0x21, SUB + 0x22, SUB + 0x23
ROOT_UNKNOWN, ROOT_JNI_GLOBAL, ROOT_JNI_LOCAL, ROOT_FRAME, ROOT_NATIVE_STACK, ROOT_STICKY, ROOT_BLOCK, ROOT_MONITOR, ROOT_THREAD = (SUB + t for t in (0xFF, 1, 2, 3, 4, 5, 6, 7, 8))
OBJECT = 2
ELEMENT_BYTES = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}

SCHEMA = (
    "pos bigint, tag int, id bigint, ref bigint, serial bigint, trace bigint, n bigint, type int, text string, data binary, ids array<bigint>, super_id bigint, loader_id bigint, "
    "statics array<struct<name_id: bigint, type: int, value: bigint, bits: binary>>, fields array<struct<name_id: bigint, type: int>>"
)
_TYPES = pa.schema([
    ("pos", pa.int64()), ("tag", pa.int32()), ("id", pa.int64()), ("ref", pa.int64()), ("serial", pa.int64()), ("trace", pa.int64()), ("n", pa.int64()), ("type", pa.int32()),
    ("text", pa.string()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("super_id", pa.int64()), ("loader_id", pa.int64()),
    ("statics", pa.list_(pa.struct([("name_id", pa.int64()), ("type", pa.int32()), ("value", pa.int64()), ("bits", pa.binary())]))),
    ("fields", pa.list_(pa.struct([("name_id", pa.int64()), ("type", pa.int32())]))),
])
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20
#: Records outside heap segments that make up one partition.
RUN_BYTES = 64 << 20


class HprofError(ValueError):
    pass


@dataclass
class Header:
    version: str
    id_size: int
    created_ms: int
    length: int


def read_header(f) -> Header:
    version = bytearray()
    while (c := f.read(1)) != b"\0":
        if not c:
            raise HprofError("the file ends in its header")
        version += c
        if len(version) > 128:
            raise HprofError("not a heap dump: no end of the version in 128 characters")
    rest = f.read(12)
    if len(rest) < 12:
        raise HprofError("the file ends in its header")
    id_size, created = struct.unpack(">IQ", rest)
    if id_size not in (4, 8):
        raise HprofError(f"identifier size {id_size}")
    return Header(version.decode("utf-8", "replace"), id_size, created, len(version) + 13)


def opened(path: str, mode: str = "rb"):
    """A local path, a file: URI or a URI of one of Arrow's file systems, opened to read by position or to write."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        return store.open_output_stream(inside) if "w" in mode else store.open_input_file(inside)
    return open(path, mode, buffering=1 << 20)


def checked_path(path: str) -> str:
    if path.endswith(".gz"):
        raise HprofError("compressed heap dumps cannot be read by position; decompress it first")
    return path


@dataclass
class Segment(InputPartition):
    start: int
    end: int
    heap: bool


def segments(path: str) -> tuple[Header, list[Segment]]:
    """The partitions of a file, from its record headers alone."""
    out: list[Segment] = []
    with opened(path) as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(0)
        header = read_header(f)
        at, run = header.length, None
        while at + 9 <= size:
            f.seek(at)
            tag, _, length = struct.unpack(">BII", f.read(9))
            end = at + 9 + length
            if end > size:
                raise HprofError(f"record at {at} reaches past the end of the file")
            if tag in (DUMP, DUMP_SEGMENT):
                if run is not None:
                    out.append(Segment(run, at, False))
                    run = None
                if length:
                    out.append(Segment(at + 9, end, True))
            else:
                run = at if run is None else run
                if end - run > RUN_BYTES:
                    out.append(Segment(run, end, False))
                    run = None
            at = end
        if run is not None:
            out.append(Segment(run, at, False))
    return header, out


class Cursor:
    """Big-endian reads at a running position."""

    def __init__(self, f, pos: int, end: int, id_size: int):
        f.seek(pos)
        self.f, self.pos, self.end, self.id_size = f, pos, end, id_size
        self.id_code = ">Q" if id_size == 8 else ">I"

    def take(self, n: int) -> bytes:
        raw = self.f.read(n) if self.pos + n <= self.end else b""
        if len(raw) < n:
            raise HprofError(f"record content at {self.pos} is cut off")
        self.pos += n
        return raw

    def skip(self, n: int) -> None:
        if self.pos + n > self.end:
            raise HprofError(f"record content at {self.pos} is cut off")
        self.pos += n
        self.f.seek(self.pos)

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return struct.unpack(">H", self.take(2))[0]

    def u4(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def i4(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def id(self) -> int:
        value = struct.unpack(self.id_code, self.take(self.id_size))[0]
        if value >= 1 << 63:
            raise HprofError(f"address {value:#x} at {self.pos - self.id_size} does not fit 63 bits")
        return value

    def value(self, kind: int) -> tuple[int | None, bytes]:
        if kind == OBJECT:
            return self.id(), b""
        if kind not in ELEMENT_BYTES:
            raise HprofError(f"type {kind} at {self.pos}")
        return None, self.take(ELEMENT_BYTES[kind])


def top_records(c: Cursor) -> Iterator[dict]:
    while c.pos < c.end:
        pos, tag = c.pos, c.u1()
        c.u4()
        length = c.u4()
        end = c.pos + length
        row = {"pos": pos, "tag": tag}
        if tag == STRING:
            row |= {"id": c.id(), "text": c.take(length - c.id_size).decode("utf-8", "replace")}
        elif tag == LOAD_CLASS:
            row |= {"serial": c.u4(), "id": c.id(), "trace": c.u4(), "ref": c.id()}
        elif tag == UNLOAD_CLASS:
            row |= {"serial": c.u4()}
        elif tag == FRAME:
            row |= {"id": c.id(), "ids": [c.id(), c.id(), c.id()], "serial": c.u4(), "n": c.i4()}
        elif tag == TRACE:
            row |= {"trace": c.u4(), "serial": c.u4()}
            row["ids"] = [c.id() for _ in range(c.u4())]
        else:
            row = {}
        c.skip(end - c.pos)
        if row:
            yield row


def heap_records(c: Cursor, payload: bool) -> Iterator[dict]:
    while c.pos < c.end:
        pos, tag = c.pos, SUB + c.u1()
        row = {"pos": pos, "tag": tag}
        if tag in (ROOT_UNKNOWN, ROOT_STICKY, ROOT_MONITOR):
            row["id"] = c.id()
        elif tag == ROOT_JNI_GLOBAL:
            row["id"] = c.id()
            c.skip(c.id_size)
        elif tag in (ROOT_JNI_LOCAL, ROOT_FRAME):
            row |= {"id": c.id(), "serial": c.u4(), "n": c.i4()}
        elif tag in (ROOT_NATIVE_STACK, ROOT_BLOCK):
            row |= {"id": c.id(), "serial": c.u4()}
        elif tag == ROOT_THREAD:
            row |= {"id": c.id(), "serial": c.u4(), "trace": c.u4()}
        elif tag == CLASS_DUMP:
            row |= {"id": c.id(), "trace": c.u4(), "super_id": c.id(), "loader_id": c.id()}
            c.skip(4 * c.id_size)
            row["n"] = c.i4()
            for _ in range(c.u2()):
                c.u2()
                c.value(c.u1())
            statics, fields = [], []
            for _ in range(c.u2()):
                name, kind = c.id(), c.u1()
                value, bits = c.value(kind)
                statics.append({"name_id": name, "type": kind, "value": value, "bits": bits})
            for _ in range(c.u2()):
                fields.append({"name_id": c.id(), "type": c.u1()})
            row |= {"statics": statics, "fields": fields}
        elif tag == INSTANCE:
            row |= {"id": c.id(), "trace": c.u4(), "ref": c.id(), "n": c.i4()}
            if payload:
                row["data"] = c.take(row["n"])
            else:
                c.skip(row["n"])
        elif tag == OBJECT_ARRAY:
            row |= {"id": c.id(), "trace": c.u4(), "n": c.i4(), "ref": c.id()}
            if payload:
                code = f">{row['n']}{'Q' if c.id_size == 8 else 'I'}"
                row["ids"] = list(struct.unpack(code, c.take(row["n"] * c.id_size)))
            else:
                c.skip(row["n"] * c.id_size)
        elif tag == PRIMITIVE_ARRAY:
            row |= {"id": c.id(), "trace": c.u4(), "n": c.i4(), "type": c.u1()}
            if row["type"] not in ELEMENT_BYTES:
                raise HprofError(f"element type {row['type']} at {pos}")
            size = row["n"] * ELEMENT_BYTES[row["type"]]
            if payload:
                row["data"] = c.take(size)
            else:
                c.skip(size)
        else:
            raise HprofError(f"heap sub-record {tag - SUB:#x} at {pos}")
        yield row


class HprofReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = checked_path(path), payload

    def partitions(self) -> list[Segment]:
        return segments(self.path)[1] or [Segment(0, 0, False)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            header = read_header(f)
            cursor = Cursor(f, partition.start, partition.end, header.id_size)
            rows, held = [], 0
            for row in heap_records(cursor, self.payload) if partition.heap else top_records(cursor):
                rows.append(row)
                held += len(row.get("data") or b"") + 8 * len(row.get("ids") or ())
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)


class HprofSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hprof"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HprofReader:
        return HprofReader(self.options["path"], self.options.get("payload", "true").lower() != "false")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and the package to its executors."""
    ship(spark)
    spark.dataSource.register(HprofSource)
