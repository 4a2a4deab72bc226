"""Media columns: texts as 8-bit sound, cut by content into chunks, deduplicated by digest and rebuilt from ordered chunk lists.

A payload is a text's bytes with spaces up to a positive multiple of 192. The stored form is a RIFF/WAVE file with one
channel of unsigned 8-bit samples, a sample a byte. A rolling gear hash over the samples (a window of 32 bytes) sets the
cuts, so that equal passages give equal chunks wherever they stand. Chunks are keyed by SHA-256 and deduplicated by a Spark
aggregation; a manifest lists each medium's digests in order. To rebuild a medium, manifest and chunks are joined by digest,
streamed in order of row and sequence, concatenated and checked against the digest of the whole. Digests that many rows refer
to are counted first and get salts, so that their references are dealt to several tasks.

In transit, chunks are compressed with zstandard and a small dictionary made from a bounded sample of chunks; the dictionary
changes no result. Null and empty texts give a payload of 192 spaces. Very long texts are cut and stored whole. Repeated rows, and texts that tie, give a row each. A null id stays null.
Columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, map_rows, texts, utf8, written

BLOCK = 192
RATE = 8000

#: Chunk lengths: the least, the mean beyond it (a power of two) and the largest.
LEAST, MEAN, MOST = 2048, 8192, 65536

#: References that a digest has at least before it is salted.
HOT = 64

#: 256 pseudo-random words, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def payload(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))


def wav(samples: bytes) -> bytes:
    """The header of a WAVE file of unsigned 8-bit samples (an even number of them)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))


def samples_of(media: bytes) -> bytes:
    """The samples of a file that wav() began; an error if anything is not as declared."""
    riff, size, wave, fmt, n, kind, channels, rate, _, _, bits, data, length = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (n, kind, channels, rate, bits) != (16, 1, 1, RATE, 8) or length != len(media) - 44 or size != length + 36:
        raise ValueError("not a medium of this store")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, by a gear hash of the 32 bytes before each place."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i]: sum of gear[b[i - j]] << j over the last 2k bytes
        if len(h) > k:
            more = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += more
    marks = np.flatnonzero(h >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1
    ends, start = [], 0
    while len(data) - start > LEAST:
        k = np.searchsorted(marks, start + LEAST)
        end = min(int(marks[k]) if k < len(marks) else len(data), start + MOST, len(data))
        ends.append(end)
        start = end
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 1500, size: int = 1 << 17) -> bytes:
    """A zstandard dictionary from the first 4,096 bytes of at most `rows` texts, all that comes to the driver; empty where there are too few."""
    heads = texts(docs, id_col, text_col).select(F.substring(F.col("text").cast("binary"), 1, 4096).alias("head"))
    some = [payload(bytes(r[0]))[:4096] for r in heads.limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, some).as_bytes() if len(some) > 64 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary_of(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def manifests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, seq, n_chunks, digest, n_bytes, media_sha, header): a row for each chunk; the last three on a medium's first chunk only.

    row names the row of docs; rows of one id, and repeated ones, are media of their own.
    """

    def one(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in range(8)]
        for r, i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            samples = payload(data)
            header, start = wav(samples), 0
            whole, ends = hashlib.sha256(header + samples).digest(), cuts(samples)
            for seq, end in enumerate(ends):
                first = (None, None, None) if seq else (len(data), whole, header)
                for column, value in zip(out, (r, i, seq, len(ends), hashlib.sha256(samples[start:end]).digest(), *first), strict=True):
                    column.append(value)
                start = end
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()
        return {n: pa.array(c, k) for n, c, k in zip(("row", "doc_id", "seq", "n_chunks", "digest", "n_bytes", "media_sha", "header"), out, kinds, strict=True)}

    named = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_rows(named, one, "row long, doc_id long, seq int, n_chunks int, digest binary, n_bytes long, media_sha binary, header binary")


def hot_digests(manifest: DataFrame) -> DataFrame:
    """(digest, salts): digests with more references than half of an even share of a shuffle partition, and by how many tasks to serve them.

    That are at most twice as many rows as there are shuffle partitions, whatever the input.
    """
    even = manifest.count() // (2 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(HOT, even)
    counts = manifest.groupBy("digest").count().where(F.col("count") > limit)
    return written(counts.select("digest", F.ceil(F.col("count") / limit).cast("int").alias("salts")), few=True)


def chunk_store(docs: DataFrame, words: bytes = b"", hot: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, salt, chunk): each different chunk once, compressed with the dictionary `words`; a hot one once for each of its salts, others under salt 0."""

    def one(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=9, write_checksum=False, **_dictionary_of(words))
        made: dict[bytes, bytes] = {}
        for data in utf8(batch.column(0)):
            samples, start = payload(data), 0
            for end in cuts(samples):
                digest = hashlib.sha256(samples[start:end]).digest()
                if digest not in made:
                    made[digest] = pack.compress(samples[start:end])
                start = end
        return {"digest": pa.array(list(made), pa.binary()), "chunk": pa.array(list(made.values()), pa.binary())}

    found = map_rows(texts(docs, id_col, text_col).select("text"), one, "digest binary, chunk binary")
    if hot is None:
        return found.dropDuplicates(["digest"]).select("digest", F.lit(0).alias("salt"), "chunk")
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return found.join(F.broadcast(hot), "digest", "left").select("digest", F.explode(salts).alias("salt"), "chunk").dropDuplicates(["digest", "salt"])


def _verified(doc_id: int | None, head: tuple, parts: list[bytes]) -> tuple:
    """(doc_id, n_bytes, media) of a medium's first manifest row (n_bytes, media_sha, header) and its chunks."""
    media = head[2] + b"".join(parts)
    if hashlib.sha256(media).digest() != head[1]:
        raise ValueError(f"the chunks of document {doc_id} don't give its medium")
    return doc_id, head[0], media


def rebuild(manifest: DataFrame, store: DataFrame, words: bytes, row, schema: str, hot: DataFrame | None = None) -> DataFrame:
    """row(doc_id, n_bytes, media) -> values of schema, for each medium that the manifest lists, rebuilt and verified.

    An error if the store lacks a chunk. Media of one chunk are done where the chunk is found, and only their finished values move on; chunks of the others meet by row.
    """
    names, kinds = zip(*((f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")), strict=True)
    carried = ("row", "doc_id", "seq", "n_chunks", "n_bytes", "media_sha", "header", "chunk")
    carried_kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
    done_kind = pa.struct(list(zip(names, kinds, strict=True)))

    def single(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor(**_dictionary_of(words))
        out, done = [], []
        for r, i, seq, n, *head, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk is None:
                raise ValueError(f"the store lacks a chunk of document {i}")
            if n == 1:
                done.append(dict(zip(names, row(*_verified(i, head, [unpack.decompress(chunk)])), strict=True)))
                out.append((r, None, 0, 1, None, None, None, None))
            else:
                done.append(None)
                out.append((r, i, seq, n, *head, chunk))
        columns = {c: pa.array([x[k] for x in out], kind) for k, (c, kind) in enumerate(zip(carried, carried_kinds, strict=True))}
        return columns | {"done": pa.array(done, done_kind)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_dictionary_of(words))
        parts: list[bytes] = []
        first: tuple = ()

        def listed(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal parts, first
            for _, i, seq, n, *head, chunk, made in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if made is not None:
                    yield tuple(made.values())
                    continue
                if seq == 0:
                    parts, first = [], tuple(head)
                parts.append(unpack.decompress(chunk))
                if seq == n - 1:
                    yield row(*_verified(i, first, parts))
                    parts = []

        for batch in batches:
            rows = listed(batch)
            while some := list(islice(rows, 500)):
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in some], kind) for k, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    salt = F.lit(0)
    if hot is not None:
        manifest = manifest.join(F.broadcast(hot), "digest", "left")
        salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")
    found = manifest.withColumn("salt", salt).join(store, ["digest", "salt"], "left").select(*carried)
    done = map_rows(found, single, f"row long, doc_id long, seq int, n_chunks int, n_bytes long, media_sha binary, header binary, chunk binary, done struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    return done.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(lean(run), schema)


def features(samples: bytes) -> str:
    """Sound statistics: level and loudness about the middle, 128; crossings of the mean level."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    above = x * len(x) >= x.sum()
    energy, crossings = int((x * x).sum()), int((above[1:] != above[:-1]).sum())
    return f"wav8;seconds={len(x) / RATE:.3f};level={x.sum() / len(x):.4f};rms={(energy / len(x)) ** 0.5:.4f};zcr={crossings / len(x):.5f};peak={int(np.abs(x).max())};chunks={len(cuts(samples))}"


def described(doc_id: int | None, n_bytes: int, media: bytes) -> tuple:
    samples = samples_of(media)
    return doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a medium in chunks, rebuilds it from the store and describes it: the columns DESCRIBED."""
    words = dictionary(docs, id_col, text_col)
    manifest = written(manifests(docs, id_col, text_col))
    hot = hot_digests(manifest)
    return rebuild(manifest, chunk_store(docs, words, hot, id_col, text_col), words, described, DESCRIBED, hot)
