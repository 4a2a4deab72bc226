"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where all run on one machine, and none is set, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, few: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: it cuts the lineage and outlives executors.

    few: for tables that are small beside the input. What makes them runs at full width; the rows then go to a file for each
    eight shuffle partitions, or two a core if that is more.
    """
    spark = df.sparkSession
    if few:
        df = df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table with such columns; a null text becomes the empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column's values; null: empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def map_rows(df: DataFrame, one: Callable, schema: str) -> DataFrame:
    """mapInArrow with `one`: record batch -> dict of columns, in the order of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(one(part))

    return df.mapInArrow(lean(run), schema)


def lean(run: Callable) -> Callable:
    """run, after which a worker gives the memory that it has freed back to the system; workers live on between tasks."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries do it by themselves
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return trimmed


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into pieces of about `most` bytes (a row is never cut), so that memory doesn't follow the rows' length."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


#: Bits of a bitmap for each hash, and in all at most (32 MB).
BITS_EACH, MAX_BITS = 32, 1 << 28


def bitmap(hashes: DataFrame, column: str) -> np.ndarray | None:
    """A bitmap in which two bits are set for each 64-bit hash of a column; None if MAX_BITS don't serve that many."""
    bits = max(1 << 20, 1 << (BITS_EACH * hashes.count()).bit_length())
    if bits > MAX_BITS:
        return None
    places = F.array(F.pmod(column, F.lit(bits)), F.pmod(F.shiftrightunsigned(column, 32), F.lit(bits)))
    rows = hashes.select(F.explode(places).alias("p")).select((F.col("p") / 32768).cast("int").alias("part"), (F.col("p") % 32768).alias("p"))
    out = np.zeros(bits // 8, np.uint8)
    for part, b in rows.groupBy("part").agg(F.bitmap_construct_agg("p")).toLocalIterator():  # bits / 32768 rows of 4 kB
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(b), np.uint8)
    return out


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits set: all that the bitmap was made of, and few others."""
    mask = len(marks) * 8 - 1
    a, b = hashes & mask, (hashes >> 32 & 0xFFFFFFFF) & mask
    return ((marks[a >> 3] >> (a & 7)) & (marks[b >> 3] >> (b & 7)) & 1).astype(bool)


def in_bitmap(marks: np.ndarray | None, column: Column) -> Column:
    """marked() of a column; true without a bitmap. Only the hashes go to Python."""
    if marks is None:
        return F.lit(True)

    @F.arrow_udf("boolean")
    def of(hashes: pa.Array) -> pa.Array:
        return pa.array(marked(marks, hashes.to_numpy(zero_copy_only=False).astype(np.int64)))

    return of(column)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
