"""Shards of JSON lines, written by tasks under a commit protocol.

Each task writes its rows as one frame (or one plain piece) to a file of its own, named by partition and attempt, and tells its
name, rows and bytes in its commit message. The commit lists the files of the attempts that count, in order of partition; files
of lost or repeated attempts are never listed. One task then joins the listed frames, as bytes, and names the shard when it is whole.
A failed write leaves no shard, and an older one of that name stays until the new one is whole. A table without rows gives an empty shard.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.publish import canonical_json
from .units import located

FORMAT, LISTED = "json_line_shard", "_frames.json"

#: Bytes that are joined at a time.
BLOCK = 8 << 20


@dataclass
class Frame(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, compress: bool) -> None:
        self.folder, self.compress = folder, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Frame:
        at = TaskContext.get()
        system, folder = located(self.folder)
        name = f"frame-{at.partitionId():06d}-{at.taskAttemptId()}"
        rows = size = 0
        packer = zstandard.ZstdCompressor().compressobj() if self.compress else None
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                data = b"".join(canonical_json(row) + b"\n" for row in batch.to_pylist(maps_as_pydicts="strict"))
                rows += batch.num_rows
                size += out.write(packer.compress(data) if packer else data) or 0
            if packer and rows:
                size += out.write(packer.flush()) or 0
        return Frame(at.partitionId(), name, rows, size)

    def commit(self, messages: list[Frame | None]) -> None:
        system, folder = located(self.folder)
        listed = [m.name for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.rows]
        with system.open_output_stream(f"{folder}/{LISTED}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Frame | None]) -> None:
        system, folder = located(self.folder)
        system.delete_dir_contents(folder, missing_dir_ok=True)


class ShardSink(DataSource):
    """Options: path, a folder for the frames; compress."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("compress", "true") == "true")


def _join(folder: str, path: str, compress: bool) -> str:
    """Joins the listed frames to a file and returns its SHA-256."""
    system, source = located(folder)
    target = located(path)[1]
    with system.open_input_file(f"{source}/{LISTED}") as f:
        listed = json.loads(f.read())
    digest = hashlib.sha256()
    with system.open_output_stream(f"{target}.tmp", compression=None) as out:
        for name in listed:
            with system.open_input_file(f"{source}/{name}") as f:
                while data := f.read(BLOCK):
                    digest.update(data)
                    out.write(data)
        if not listed and compress:
            data = zstandard.ZstdCompressor().compress(b"")
            digest.update(data)
            out.write(data)
    system.move(f"{target}.tmp", target)
    system.delete_dir(source)
    return digest.hexdigest()


def write_shard(df: DataFrame, path: str, compress: bool = True) -> str:
    """Writes df, in the order of its partitions and their rows, as one file, and returns its SHA-256."""
    spark = df.sparkSession
    folder = f"{path}.frames-{uuid.uuid4().hex}"
    system, local = located(folder)
    system.create_dir(local)
    spark.dataSource.register(ShardSink)
    df.write.format(FORMAT).mode("append").option("path", folder).option("compress", str(compress).lower()).save()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"digest": pa.array([_join(folder, path, compress)])})

    return spark.range(0, 1, 1, 1).mapInArrow(joined, "digest string").first()["digest"]
