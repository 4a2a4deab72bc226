"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash: each text's 64-bit fingerprint over its five-word shingles is posted by byte positions,
shared bytes are counted, pairs that share four bytes and differ in at most BITS bits are verified by the Jaccard
similarity, and what they link is one group from then on. Fingerprints guarantee two bits only, and texts of a similarity
of 0.8 differ in ten on average, so the links are completed from min-hashes, for texts that are not in one group yet.

There candidates are texts that share a band of min-hashes: BANDS bands of ROWS hashes each, so that a pair at a similarity of 0.8
shares no band with a probability of 1.3e-7, and a closer pair with less. No list of a band is cut. Every candidate
that counts is verified by the Jaccard similarity of the whole sets.

A list's members are first held against its least one, which costs no more pairs than postings. Only lists whose other
members are then still in different groups are searched for further pairs, and there pairs of one group are left out: they
change nothing. So a group of near copies costs pairs in proportion to its size. Lists of more than BLOCK such members, texts
that share a band without being alike, are dealt out in pairs of blocks, so that no task gets a list that grows.

Texts: A-Z lower-cased, words are runs of other bytes than ASCII white space. A text of fewer than SHINGLE words is one
shingle. Null and empty texts have no shingles and are copies of each other. Texts of the same shingles are one node, so
repeated rows and ties cost one. Very long texts are taken whole; further columns, whatever their names, are not looked at. A row
with a null id is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, free_name, in_bitmap, map_rows, slices, utf8, written
from .components import components
from .words import BLANKS, mixed, windows, word_hashes

SHINGLE, JACCARD = 5, 0.8

#: Bits in which fingerprints of candidates may differ.
BITS = 11

#: Min-hashes that make a band's key, and bands.
ROWS, BANDS = 5, 40

#: Members of a list that a task compares pair by pair.
BLOCK = 400

#: Byte table of words: ASCII white space becomes a space, A-Z become a-z.
LOWER = BLANKS.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))

_DRAWN = np.random.default_rng(42)
_FACTOR = _DRAWN.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) | np.uint32(1)
_SHIFT = _DRAWN.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32)


def shingle_sets(batch: list[bytes]) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted as signed numbers."""
    h, text, *_ = word_hashes(batch, LOWER)
    edges = np.searchsorted(text, np.arange(len(batch) + 1))
    return [np.unique(windows(h[lo:hi], min(SHINGLE, hi - lo)).view(np.int64)) if lo < hi else np.zeros(0, np.int64) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of a set; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    x = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1 << 12):
        np.minimum(least, (x[at : at + (1 << 12)] * _FACTOR + _SHIFT).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key ^ mixed(row.astype(np.uint64) + key))
    return key.view(np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles: a bit is set if it is in over half the hashes; 0 for the empty set."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        set_bits += np.unpackbits(shingles[at : at + (1 << 12)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(shingles)).tobytes(), "big", signed=True)


def text_hash(c: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, n, fp, keys): node names the set of n shingles, fp is its fingerprint."""

    def one(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[], [], [], []]
        for part in slices(batch, 1 << 20):
            for s in shingle_sets(utf8(part.column(2))):
                for column, value in zip(out, (_signed(xxhash.xxh64_intdigest(s.tobytes())), len(s), fingerprint(s), band_keys(s)), strict=True):
                    column.append(value)
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "node": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "fp": pa.array(out[2], pa.int64()), "keys": pa.array(out[3], pa.list_(pa.int64()))}

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_rows(rows, one, "doc_id long, text_hash long, node long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the texts of wanted (node, text_hash)."""

    def one(batch: pa.RecordBatch) -> dict:
        found = [s for part in slices(batch, 1 << 20) for s in shingle_sets(utf8(part.column(1)))]
        return {"node": batch.column(0), "shingles": pa.array(found, pa.list_(pa.int64()))}

    wanted = written(wanted)
    own = docs.select(text_hash(text_col).alias("text_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = own.where(in_bitmap(bitmap(wanted, "text_hash"), F.col("text_hash"))).join(wanted, "text_hash").dropDuplicates(["node"]).select("node", "text")
    return map_rows(rows, one, "node long, shingles array<long>")


def _rest_of_list(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b): links that join a list's groups (root) as far as they can be joined within the list."""
    group = group.sort_values(["n", "node"])
    node, n = group["node"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    root = np.unique(group["root"].to_numpy(np.int64), return_inverse=True)[1]
    flat, start = np.concatenate(group["shingles"].to_list()), np.concatenate(([0], np.cumsum(n)))
    a, b = [], []
    for i in range(len(node)):
        end = int(np.searchsorted(n, int(n[i] / JACCARD + 1e-9), side="right"))
        if end <= i + 1 or (root[i + 1 : end] == root[i]).all():
            continue
        at = np.searchsorted(own := flat[start[i] : start[i + 1]], others := flat[start[i + 1] : start[end]])
        common = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == others).astype(np.int64), start[i + 1 : end] - start[i + 1])
        for j in (i + 1 + np.flatnonzero(common / (n[i] + n[i + 1 : end] - common) >= JACCARD)).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                a.append(node[i])
                b.append(node[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    alike = common / (F.size("s_a") + F.size("s_b") - common) >= JACCARD
    return pairs.join(b, "b").join(a, "a").where(alike).select("a", "b")


def _blocks(lists: DataFrame) -> DataFrame:
    """(key, node, n, root, i, j) of members (key, node, n, root) of lists: each pair of a list meets in a pair of blocks (i, j) at least once."""
    sizes = lists.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = lists.join(sizes, "key").withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.where("blocks = 1 OR own <> other").select("key", "node", "n", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def fingerprint_pairs(nodes: DataFrame, by_fingerprint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): candidates among nodes (node, fp) by their fingerprints: a node with the least one of its fingerprint, and those of linked fingerprints."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda x: least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x))
    linked = by_fingerprint(nodes.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.union(linked.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b"))


def links(docs: DataFrame, signed: DataFrame, by_fingerprint: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """(a, b): nodes of near copies; the links span all groups of near copies. by_fingerprint links fingerprints (column fp)."""
    nodes = written(signed.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    near = written(fingerprint_pairs(nodes.where("n > 0").select("node", "fp"), by_fingerprint), few=True)
    posts = nodes.select("node", F.explode("keys").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1")
    posts = written(posts.join(lists, "key"))
    asked = posts.select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = written(_sets(docs, nodes.select("node", "text_hash").join(asked, "node"), text_col))
    by_bits = written(_alike(near, sets), few=True)

    told = components(by_bits)
    of = lambda x: told.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    stars = posts.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    apart = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select("a", "b")
    first = written(by_bits.union(_alike(written(apart), sets)), few=True)

    roots = components(first)
    members = posts.where("size > 2 AND node <> leader").select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    uneven = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = _blocks(written(members.join(uneven, "key").join(nodes.select("node", "n"), "node"), few=True)).join(sets, "node")
    return first.union(rest.groupBy("key", "i", "j").applyInPandas(_rest_of_list, "a long, b long")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_fingerprint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_hash, root) of every row with an id: rows of near copies, and of copies of those, have one root.

    by_fingerprint links fingerprints; without it only equal ones are linked.
    """
    signed = written(signatures(docs, id_col, text_col))
    equal = lambda fps: fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    roots = components(links(docs, signed, by_fingerprint or equal, text_col)).withColumnRenamed("node", "__node")
    return signed.join(roots, F.col("node") == F.col("__node"), "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_fingerprint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of docs that have the smallest id of their group of near copies; all rows without an id.

    Where the id repeats within the group, the row of the text of least hash; of rows that repeat id and text, one. Texts of rows
    that a bitmap of the rows to look at doesn't hold stay where they are; the others are joined by id and text hash.
    """
    own = {c: free_name(docs, f"__{c}") for c in ("id", "hash", "key", "first")}
    named = written(near_copies(docs, id_col, text_col, by_fingerprint))
    least = written(named.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")))
    rows = named.groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("n")).join(least, "root")
    first = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    key = lambda i, h: F.xxhash64(i, h)
    looked_at = rows.where(~first | (F.col("n") > 1)).select(F.col("doc_id").alias(own["id"]), F.col("text_hash").alias(own["hash"]), first.alias(own["first"]), key("doc_id", "text_hash").alias(own["key"]))
    looked_at = written(looked_at, few=True)
    marks = bitmap(looked_at, own["key"])
    whole = docs.where(F.col(id_col).isNotNull()).select("*", F.col(id_col).cast("long").alias(own["id"]), text_hash(text_col).alias(own["hash"]))
    maybe = in_bitmap(marks, key(own["id"], own["hash"]))
    joined = whole.where(maybe).join(looked_at.drop(own["key"]), [own["id"], own["hash"]], "left")
    once = joined.where(F.col(own["first"])).dropDuplicates([own["id"], own["hash"]])
    kept = whole.where(~maybe).select(*docs.columns).union(joined.where(F.col(own["first"]).isNull()).select(*docs.columns)).union(once.select(*docs.columns))
    return kept.union(docs.where(F.col(id_col).isNull()))
