"""Archives of JSON lines as a data source: plain files are read by byte ranges, zstandard files by frames, many tasks to a file.

``spark.read.format("json_line_archive")`` gives (source_id, source_kind, unit, place, value): a unit is a range of a file, place
numbers its lines from 0, value is a line's bytes. A line belongs to the unit in which it begins; one that begins just at a
unit's end is the unit's too, and every unit but a file's first passes over what stands before its first line feed. So units don't look
at each other's bytes but for the rest of a last line. ``spark.read.format("json_line_archive").writer`` side: ordered partitions become
frames, see ArchiveWriter. Files are opened by pyarrow's file systems from their URI, in the tasks.

A broken or cut frame is an error. Lines of more than four times MAX_LINE bytes are cut to MAX_LINE + 1, by which they still count as too long.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a line, with its end.
MAX_LINE = 8 << 20

#: Bytes of a unit, about, and of one read.
UNIT_BYTES, BLOCK = 128 << 20, 1 << 18

FORMAT = "json_line_archive"
SCHEMA = "source_id string, source_kind string, unit int, place bigint, value binary"
_ARROW = pa.schema([("source_id", pa.string()), ("source_kind", pa.string()), ("unit", pa.int32()), ("place", pa.int64()), ("value", pa.binary())])

#: Fixed values of the zstandard format: magic numbers of a frame, of skippable frames (without the last four bits), and of a seek table's end.
FRAME, SKIPPABLE, SEEKABLE = 0xFD2FB528, 0x184D2A50, 0x8F92EAB1


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and its name there; a path without a scheme is local."""
    local = re.sub("^file:/+", "/", path)
    return (arrow_fs.LocalFileSystem(), local) if local.startswith("/") else arrow_fs.FileSystem.from_uri(path)


def frames(f: IO[bytes], size: int) -> list[tuple[int, int]]:
    """(begin, end) of the zstandard frames of a file: by its seek table where it has one, else by the lengths in the heads of frames and blocks."""
    if size > 17:
        f.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", f.read(9))
        each = 12 if flags & 0x80 else 8
        if magic == SEEKABLE and 8 + count * each + 9 <= size:
            f.seek(size - 9 - count * each)
            table, out, at = f.read(count * each), [], 0
            for k in range(count):
                length = struct.unpack_from("<I", table, k * each)[0]
                out.append((at, at + length))
                at += length
            return out
    out, at = [], 0
    while at < size:
        f.seek(at)
        head = f.read(18)
        magic = int.from_bytes(head[:4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if magic != FRAME:
            raise ValueError(f"no zstandard frame at byte {at}")
        facts = zstandard.get_frame_parameters(head)
        to, last = at + zstandard.frame_header_size(head), False
        while not last:
            f.seek(to)
            block = f.read(3)
            if len(block) < 3:
                raise ValueError(f"the zstandard frame at byte {at} is cut")
            told = int.from_bytes(block, "little")
            last, kind, length = bool(told & 1), told >> 1 & 3, told >> 3
            to += 3 + (1 if kind == 1 else length)
        to += 4 if facts.has_checksum else 0
        if to > size:
            raise ValueError(f"the zstandard frame at byte {at} is cut")
        out.append((at, to))
        at = to
    return out


def ranges(path: str, unit_bytes: int = UNIT_BYTES) -> list[tuple[int, int]]:
    """(begin, end) of a file's units, in order; whole frames for zstandard files."""
    system, name = located(path)
    info = system.get_file_info(name)
    if info.type != arrow_fs.FileType.File:
        raise FileNotFoundError(path)
    if not name.endswith(".zst"):
        return [(a, min(a + unit_bytes, info.size)) for a in range(0, info.size, unit_bytes)]
    with system.open_input_file(name) as f:
        out: list[tuple[int, int]] = []
        for a, b in frames(f, info.size):
            if out and b - out[-1][0] <= unit_bytes:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def _blocks(f: IO[bytes], begin: int, end: int, packed: bool) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they are of the unit) from begin to the file's end; callers stop when they have their last line."""
    f.seek(begin)
    if not packed:
        at = begin
        while data := f.read(min(BLOCK, end - at) if at < end else BLOCK):
            yield data, at < end
            at += len(data)
        return
    read = frame = begin
    unpack, data, open_frame = zstandard.ZstdDecompressor().decompressobj(), b"", False
    while True:
        if not data:
            data = f.read(BLOCK)
            read += len(data)
            if not data:
                break
        open_frame = True
        yield unpack.decompress(data), frame < end
        data = b""
        if unpack.eof:
            data, open_frame = unpack.unused_data, False
            frame = read - len(data)
            unpack = zstandard.ZstdDecompressor().decompressobj()
    if open_frame:
        raise ValueError(f"the zstandard frame at byte {frame} is cut")


def lines_of(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines of a unit, without their line feeds."""
    system, name = located(path)
    with system.open_input_file(name) as f:
        rest, held, start, own_end, offset, skipping = [], 0, 0, 0, 0, begin > 0
        for chunk, own in _blocks(f, begin, end, name.endswith(".zst")):
            if own:
                own_end = offset + len(chunk)
            elif skipping or start > own_end:
                return
            first, *more = chunk.split(b"\n")
            if not skipping and held <= 4 * MAX_LINE:
                rest.append(first)
            held += len(first)
            at = offset + len(first)
            offset += len(chunk)
            for piece in more:
                if skipping:
                    skipping = False
                elif start > own_end:
                    return
                else:
                    line = b"".join(rest)
                    yield line if held <= 4 * MAX_LINE else line[: MAX_LINE + 1]
                rest, held, start = [piece], len(piece), at + 1
                at += 1 + len(piece)
        if held and not skipping and start <= own_end:
            line = b"".join(rest)
            yield line if held <= 4 * MAX_LINE else line[: MAX_LINE + 1]


def batches_of(source_id: str, kind: str, unit: int, path: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """The lines of a unit as rows of SCHEMA, a few megabytes at a time."""
    some: list[bytes] = []
    size = place = 0

    def batch() -> pa.RecordBatch:
        n = len(some)
        columns = [pa.array([source_id] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array([unit] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(some, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for line in lines_of(path, begin, end):
        some.append(line)
        size += len(line)
        if size >= 4 << 20 or len(some) >= 10_000:
            yield batch()
            place, size, some = place + len(some), 0, []
    if some:
        yield batch()


@dataclass
class Unit(InputPartition):
    source_id: str
    source_kind: str
    unit: int
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, sources: list[dict], unit_bytes: int) -> None:
        self.sources, self.unit_bytes = sources, unit_bytes

    def partitions(self) -> list[Unit]:
        return [Unit(s["source_id"], s["source_kind"], k, s["path"], a, b) for s in self.sources for k, (a, b) in enumerate(ranges(s["path"], self.unit_bytes))]

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no unit at all
            return iter(())
        return batches_of(partition.source_id, partition.source_kind, partition.unit, partition.path, partition.begin, partition.end)


class ArchiveSource(DataSource):
    """Options: sources, a JSON list of {source_id, source_kind, path}; unitBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["sources"]), int(self.options.get("unitbytes", self.options.get("unitBytes", UNIT_BYTES))))


def read_units(spark: SparkSession, sources: list[dict], unit_bytes: int | None = None) -> DataFrame:
    """Rows of SCHEMA of sources (source_id, source_kind, path), by the data source."""
    spark.dataSource.register(ArchiveSource)
    facts = json.dumps([{k: s[k] for k in ("source_id", "source_kind", "path")} for s in sources])
    return spark.read.format(FORMAT).option("sources", facts).option("unitBytes", str(unit_bytes or UNIT_BYTES)).load()


UNITS = "source_id string, source_kind string, source_role string, unit int, path string, begin bigint, end bigint"


def list_units(spark: SparkSession, sources: list[dict], unit_bytes: int | None = None) -> DataFrame:
    """The units of sources as a table UNITS; each file is looked at by a task of its own."""

    def listed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for s in batch.to_pylist():
                rows = [(s["source_id"], s["source_kind"], s["source_role"], k, s["path"], a, b) for k, (a, b) in enumerate(ranges(s["path"], unit_bytes or UNIT_BYTES))]
                kinds = pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in UNITS.split(", ")])

    files = spark.createDataFrame([(s["source_id"], s["source_kind"], s.get("source_role"), s["path"]) for s in sources], "source_id string, source_kind string, source_role string, path string")
    return files.repartition(max(1, min(len(sources), 10_000)), "source_id").mapInArrow(listed, UNITS)


def lines_in(units: DataFrame) -> DataFrame:
    """Rows of SCHEMA of a table of units, a task for each few of them."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for u in batch.to_pylist():
                yield from batches_of(u["source_id"], u["source_kind"], u["unit"], u["path"], u["begin"], u["end"])

    return units.select("source_id", "source_kind", "unit", "path", "begin", "end").mapInArrow(read, SCHEMA)
