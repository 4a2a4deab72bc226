"""SimHash near duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight positional bytes, and so at least
two of the four pairs of neighbouring bytes. A list for each single byte would hold a 256th of all fingerprints and its pairs
would grow with their square, so the index posts each distinct fingerprint under the six choices of two byte pairs (32 bits),
and the tally over the eight positional bytes is worked out for the pairs that meet there. In a list of at most `list_limit` fingerprints, shared positional bytes are tallied for its pairs, those
with the guaranteed six are kept and verified bit by bit. A longer list is posted again under the six choices of two more
bytes; such a list has at most 65,536 different fingerprints, and there each fingerprint is linked with its neighbours at
one or two bits through a table of the 16 free bits, so that the work is linear and no pair is left out. Only a spanning
forest of each of those lists is passed on.

Texts: A-Z lower-cased, words are runs of other bytes than ASCII white space. Very long texts are taken whole. Null and empty texts have fingerprint 0 and
are linked with all others that have it. Equal fingerprints are one node, so repeated rows and ties cost one posting. A row
with a null id gets a fingerprint and its group's smallest id, but never names a group; component_id is null where a group
has no id at all.

A distance in bits says little about a stated similarity of shingles: texts of Jaccard 0.8 differ in each bit with a
probability of 0.15, so in 10 of 64 bits on average, at which no byte need be shared, and keys of the 30 bits that large
inputs need agree in one pair of 137. thin() takes fingerprints of five-word shingles through the same index with wider bounds, verifies what
meets there by the Jaccard similarity, and completes the links from min-hashes (see near_copies).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import map_rows, texts, utf8, written
from .components import components

#: Hashes of a document that are counted at once.
BLOCK = 1 << 15


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's bytes."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts, at = [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:], strict=False)]
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        block = np.array(hashes[k : k + BLOCK], ">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint's bits in a signed long."""

    def one(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x, shingle) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64())}

    return map_rows(texts(docs, id_col, text_col), one, "doc_id long, fp long")


def _byte(c: str, k: int):
    return F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(0xFF))


def _post(fps: DataFrame, keys: list) -> DataFrame:
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _pair_keys() -> list:
    """Keys of the six choices of two byte pairs: the choice, then the fingerprint without the other bytes."""
    out = []
    for n, kept in enumerate(combinations(range(4), 2)):
        mask = sum(0xFFFF << (16 * k) for k in kept)
        out.append(F.struct(F.lit(n).alias("choice"), F.lit(0).alias("more"), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long")).alias("bits")))
    return out


def _longer_keys() -> list:
    """For a fingerprint posted under `choice`: the six choices of two of the four other bytes."""
    out = []
    for m, more in enumerate(combinations(range(4), 2), 1):
        mask = F.lit(0).cast("long")
        for n, kept in enumerate(combinations(range(4), 2)):
            free = [b for k in range(4) if k not in kept for b in (2 * k, 2 * k + 1)]
            whole = sum(0xFFFF << (16 * k) for k in kept) + sum(0xFF << (8 * free[i]) for i in more)
            mask = F.when(F.col("choice") == n, F.lit(whole - (whole >> 63 << 64)).cast("long")).otherwise(mask)
        out.append(F.struct(F.col("choice"), F.lit(m).alias("more"), F.col("fp").bitwiseAND(mask).alias("bits")))
    return out


def _free_bits(fps: np.ndarray, choice: int, more: int) -> np.ndarray:
    """The 16 bits that a longer list leaves free, as 0..65535."""
    kept = list(combinations(range(4), 2))[choice]
    free = [b for k in range(4) if k not in kept for b in (2 * k, 2 * k + 1)]
    chosen = list(combinations(range(4), 2))[more - 1]
    lo, hi = (free[i] for i in range(4) if i not in chosen)
    x = fps.view(np.uint64)
    return (((x >> np.uint64(8 * lo)) & np.uint64(255)) | (((x >> np.uint64(8 * hi)) & np.uint64(255)) << np.uint64(8))).astype(np.int64)


def _forest(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Links within a list in which only 16 bits vary: each fingerprint with the least one that it reaches in the list."""
    fps = np.unique(group["fp"].to_numpy(np.int64))
    slot = _free_bits(fps, int(key[0]), int(key[1]))
    label = np.full(65536, -1, np.int64)
    label[slot] = np.arange(len(fps))  # sorted: a smaller label is a smaller fingerprint
    flips = [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]
    while True:
        new = label[slot]
        for f in flips:
            other = label[slot ^ f]
            new = np.where((other >= 0) & (other < new), other, new)
        new = new[new]
        if np.array_equal(new, label[slot]):
            break
        label[slot] = new
    linked = new != np.arange(len(fps))
    return pd.DataFrame({"a": fps[new[linked]], "b": fps[linked]})


def links(fps: DataFrame, list_limit: int = 64, shared_bytes: int = 6, bits: int = 2) -> DataFrame:
    """(a, b): links among the distinct fingerprints of column fp that span all links of two or fewer differing bits.

    Wider bounds (fewer shared bytes, more bits) add the pairs within them that meet in a list of at most list_limit; beyond two bits not all pairs meet.
    """
    posts = _post(fps.select("fp").distinct(), _pair_keys())
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = written(posts.join(sizes, "key"))
    short, long = posts.where(F.col("n") <= list_limit), posts.where(F.col("n") > list_limit)
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    shared = sum(F.when(_byte("a", k) == _byte("b", k), 1).otherwise(0) for k in range(8))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (shared >= shared_bytes) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
    again = _post(long.select("fp", F.col("key.choice").alias("choice")), _longer_keys())
    forest = again.groupBy(F.col("key.choice").alias("choice"), F.col("key.more").alias("more"), F.col("key.bits").alias("bits")).applyInPandas(_forest, "a long, b long")
    return pairs.select("a", "b").union(forest).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, list_limit: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprints at two or fewer differing bits are linked; component_id is the smallest id reached."""
    fps = written(fingerprints(docs, shingle, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes, list_limit)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named)
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")))  # tables: so Spark can split the joins at a large group
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def thin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts that are linked by a similarity of 0.8 or more over five-word shingles; see near_copies."""
    return near_copies.first_of_each(docs, id_col, text_col, lambda fps: links(fps, shared_bytes=4, bits=near_copies.BITS))
