"""Merkle dataset manifest: a sparse forest of digests, built by merging fragments, with a proof for every row.

Rows are leaves; those of one tree value, in order, form a tree in which each run of ARITY neighbours becomes the digest of
their digests (as hexadecimal text); the trees' roots form one more tree. Leaves are hashed by Spark and range-partitioned by
tree and order into pieces, so that every leaf gets its number and every tree its number of leaves, and with it the length of
each run of siblings, the last one's too. A piece keeps the nodes that it can't resolve, keyed by level and index: at most
2 * (ARITY - 1) a level. These fragments form a commutative monoid: nodes are united, and whenever a run of siblings is
complete its parent takes its place. They are reduced as a tree of which each step merges FAN neighbouring pieces; it runs over
written tables, not through the driver, and keeps the runs that cross pieces (at most one a level for each border), since proofs
need them. At last each piece is built again with those runs beside it, which gives the siblings of its leaves up to the root.

A null tree value is a tree of its own, before all others; trees are in the order of their UTF-8 bytes. Leaves with a null
order value come first; leaves that tie are in the order of their digests; equal rows are leaves of their own. Null fields are hashed as
``-``, empty ones as ``0:``. Very long texts are hashed as one value by Spark. An empty table has no leaves, no root and no rows. Columns that aren't named fields are neither hashed nor looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS

#: Leaves of a piece, about, at most and at least, and pieces that a step of the reduction merges.
PIECE, SMALL, FAN = 1 << 16, 512, 16

#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest (binary) of a row: each field as the number of its UTF-8 bytes, a colon and the field; ``-`` for null."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in fields)]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def height(n: int) -> int:
    """Levels of a tree of n leaves above which it has but one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    return -(-n // (1 << ARITY_BITS * level))


class Fragment:
    """The unresolved nodes of some leaves of a tree of n, keyed by level and index."""

    def __init__(self, n: int, nodes: dict[tuple[int, int], bytes]) -> None:
        self.n, self.nodes = n, dict(nodes)
        self.runs: list[tuple[int, int, list[bytes]]] = []  # (level of the children, index of the parent, the children's digests)
        self._settle()

    def merge(self, other: Fragment) -> Fragment:
        return Fragment(self.n, self.nodes | other.nodes)

    def _settle(self) -> None:
        """Puts the parent in the place of each complete run of siblings, level by level."""
        by_level: dict[int, dict[int, bytes]] = {}
        for (level, index), digest in self.nodes.items():
            by_level.setdefault(level, {})[index] = digest
        for level in range(height(self.n)):
            here, total = by_level.get(level, {}), width(self.n, level)
            for parent in sorted({index >> ARITY_BITS for index in here}):
                own = range(parent << ARITY_BITS, min((parent + 1) << ARITY_BITS, total))
                if all(i in here for i in own):
                    run = [here.pop(i) for i in own]
                    self.runs.append((level, parent, run))
                    by_level.setdefault(level + 1, {})[parent] = digest_of(run)
        self.nodes = {(level, i): d for level, nodes in by_level.items() for i, d in nodes.items()}

    @property
    def root(self) -> bytes | None:
        return self.nodes.get((height(self.n), 0))


NODES = "part int, tree string, n long, kind string, level int, idx long, digests array<binary>"


def _rows(part: int, tree: str, of: Fragment, runs: bool) -> pa.Table:
    """A fragment as rows of NODES: its root, or its unresolved nodes; and the runs that it completed, if asked for."""
    kind = "root" if of.root else "node"
    told = [(kind, level, i, [d]) for (level, i), d in of.nodes.items()] + [("run", *run) for run in of.runs if runs]
    columns = [[part] * len(told), [tree] * len(told), [of.n] * len(told), *[[t[k] for t in told] for k in range(4)]]
    columns[-1] = [[bytes.fromhex(d.decode()) for d in ds] for ds in columns[-1]]
    kinds = pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.binary())
    return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(NODES.split(", "), columns, kinds, strict=True)})


def numbered(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """leaves (tree, digest and others) as (pieces, segments): pieces have a column part; segments are (part, tree, n_own, start, n).

    A segment is what a piece holds of a tree; start is the number of its first leaf, n the tree's number of leaves.
    """
    n = leaves.count()
    parts = max(1, min(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SMALL), n // PIECE)
    pieces = written(leaves.repartitionByRange(parts, "tree", *order, "digest", "tie").withColumn("part", F.spark_partition_id()).drop("tie"))
    tree = Window.partitionBy("tree")
    counts = written(pieces.groupBy("part", "tree").agg(F.count("*").alias("n_own")), few=True)  # a row for each piece, and for each further tree in it
    return pieces, counts.withColumn("start", F.sum("n_own").over(tree.orderBy("part")) - F.col("n_own")).withColumn("n", F.sum("n_own").over(tree))


def _ordered(piece: pa.Table, order: list[str]) -> pa.Table:
    keys = [(c, "ascending") for c in [*order, "digest"]]
    return piece.take(pc.sort_indices(piece, sort_keys=keys, null_placement="at_start"))


def fragments(pieces: DataFrame, segments: DataFrame, order: list[str]) -> DataFrame:
    """The fragments of all segments, as NODES."""

    def one(piece: pa.Table, segment: pa.Table) -> pa.Table:
        s = segment.to_pylist()[0]
        digests = _ordered(piece, order)["digest"].to_pylist()
        return _rows(s["part"], s["tree"], Fragment(s["n"], {(0, s["start"] + k): d.hex().encode() for k, d in enumerate(digests)}), runs=False)

    return pieces.groupBy("part", "tree").cogroup(segments.groupBy("part", "tree")).applyInArrow(one, NODES)


def tree_reduce(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges fragments, FAN neighbours at a time, until each tree has its root: (roots, runs), as NODES; runs are those that merging completed."""

    def merged(key: tuple, nodes: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        whole = Fragment(rows[0]["n"], {(r["level"], r["idx"]): r["digests"][0].hex().encode() for r in rows})
        return _rows(key[0].as_py(), key[1].as_py(), whole, runs=True)

    now = written(found, few=True)
    roots, runs, parts = now.where("kind = 'root'"), now.where("kind = 'run'"), now.agg(F.max("part")).first()[0] or 0
    while parts > 0:
        near = now.where("kind = 'node'").withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        now, parts = written(near.groupBy("part", "tree").applyInArrow(merged, NODES), few=True), parts // FAN
        roots, runs = roots.union(now.where("kind = 'root'")), runs.union(now.where("kind = 'run'"))
    return roots, runs


def borders(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """segments with crossing array<struct<level, parent, digests>>: the runs across pieces above a segment's leaves, at most two a level."""
    above = F.explode(F.expr(f"filter(sequence(0, 20), l -> shiftright(n - 1, {ARITY_BITS} * l) > 0)")).alias("level")
    ends = segments.select("part", "tree", "start", "n_own", above)
    first, last = (F.expr(f"shiftright({x}, {ARITY_BITS} * (level + 1))") for x in ("start", "start + n_own - 1"))
    wanted = ends.select("part", "tree", "level", F.explode(F.array_distinct(F.array(first, last))).alias("idx"))
    crossing = wanted.join(runs.select("tree", "level", "idx", "digests"), ["tree", "level", "idx"])
    listed = crossing.groupBy("part", "tree").agg(F.collect_list(F.struct("level", F.col("idx").alias("parent"), "digests")).alias("crossing"))
    return segments.join(listed, ["part", "tree"], "left")


Path = list[tuple[bytes, bytes]]  # (digests before, digests after) of a node on each level from below, joined


def paths(n: int, start: int, digests: list[bytes], crossing: list[dict]) -> list[tuple[tuple[bytes, bytes], Path]]:
    """For each leaf of a segment its siblings (before, after) and the path from its parent to the root; ("", "") and [] for a lone leaf."""
    levels: list[dict[int, bytes]] = [{start + k: d for k, d in enumerate(digests)}]
    for level in range(height(n)):
        here = levels[level]
        for run in crossing:
            if run["level"] == level:
                here.update({(run["parent"] << ARITY_BITS) + k: d.hex().encode() for k, d in enumerate(run["digests"])})
        total = width(n, level)
        above = {}
        for parent in {i >> ARITY_BITS for i in here}:
            run = [here.get(i) for i in range(parent << ARITY_BITS, min((parent + 1) << ARITY_BITS, total))]
            if None not in run:
                above[parent] = digest_of(run)
        levels.append(above)

    def around(level: int, i: int) -> tuple[bytes, bytes]:
        here, first = levels[level], i >> ARITY_BITS << ARITY_BITS
        return b"".join(here[k] for k in range(first, i)), b"".join(here[k] for k in range(i + 1, min(first + ARITY, width(n, level))))

    known: dict[tuple[int, int], Path] = {}

    def up(level: int, i: int) -> Path:
        if level >= height(n):
            return []
        if (level, i) not in known:
            known[level, i] = [around(level, i), *up(level + 1, i >> ARITY_BITS)]
        return known[level, i]

    if n == 1:
        return [((b"", b""), [])]
    return [(around(0, start + k), up(1, (start + k) >> ARITY_BITS)) for k in range(len(digests))]


def folded(digest: bytes, path: Path) -> bytes:
    """The root that a leaf's digest and the siblings on its path give; a level without siblings hashes the node alone."""
    for before, after in path:
        digest = digest_of([before, digest, after])
    return digest


def _with_paths(pieces: DataFrame, segments: DataFrame, order: list[str], told: Callable, schema: str, kinds: list) -> DataFrame:
    """told(row, segment, path from the leaf) -> values, for each leaf."""
    names = [f.split()[0] for f in schema.split(", ")]

    def one(piece: pa.Table, segment: pa.Table) -> pa.Table:
        rows, s = _ordered(piece, order).to_pylist(), segment.to_pylist()[0]
        siblings = paths(s["n"], s["start"], [r["digest"].hex().encode() for r in rows], s["crossing"] or [])
        out = [told(r, s, [own, *up] if s["n"] > 1 else []) for r, (own, up) in zip(rows, siblings, strict=True)]
        return pa.table({name: pa.array([o[k] for o in out], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    return pieces.groupBy("part", "tree").cogroup(segments.groupBy("part", "tree")).applyInArrow(one, schema)


def top(roots: DataFrame) -> DataFrame:
    """(tree, subroot, root, upper array<struct<before, after>>): the tree over the roots of all trees, and each one's path in it."""
    leaves = roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("digests")[0].alias("digest"), F.lit(0).alias("tie"))
    pieces, segments = numbered(leaves, ["of"])
    tops, runs = tree_reduce(fragments(pieces, segments, ["of"]))
    root = tops.select("tree", F.col("digests")[0].alias("root"))
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))]

    def told(row: dict, segment: dict, path: Path) -> tuple:
        return row["of"], row["digest"], segment["root"], [{"before": b, "after": a} for b, a in path]

    return _with_paths(pieces, borders(segments, runs).join(root, "tree"), ["of"], told, "tree string, subroot binary, root binary, upper array<struct<before:binary,after:binary>>", kinds)


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of docs.

    changed: the text as it is found when proofs are checked (docs' own by default); folded_root is made of the leaf with that
    text and the proof's siblings, and verified says whether it is the root.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    later = [F.col(f"`{c}`") if c != text_col or changed is None else changed for c in fields]
    found = F.lit(None).cast("binary") if changed is None else F.when(~changed.eqNullSafe(F.col(f"`{text_col}`")), leaf_digest(later))
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{tree_col}`").cast("string")), F.lit("0"))  # null first
    leaves = written(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf_digest(columns).alias("digest"), found.alias("later"), F.rand(1).alias("tie")))
    pieces, segments = numbered(leaves, ["doc_id"])
    segments = written(segments, few=True)
    roots, runs = tree_reduce(fragments(pieces, segments, ["doc_id"]))
    whole = borders(segments, runs).join(written(top(roots), few=True), "tree")
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def told(row: dict, s: dict, path: Path) -> tuple:
        path = path + [(u["before"], u["after"]) for u in s["upper"]]
        root = s["root"].hex()
        got = folded((row["later"] or row["digest"]).hex().encode(), path).decode()
        return row["doc_id"], row["digest"].hex(), s["subroot"].hex(), root, digest_of([x for pair in path for x in pair]).decode(), got, got == root

    return _with_paths(pieces, whole, ["doc_id"], told, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", kinds)


def tampered(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, with A-Z in lower case where 3 divides the CRC-32 of the id in decimal; as it is where the id is null."""
    letters = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, letters).otherwise(F.col(text_col))
