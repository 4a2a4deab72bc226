"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut at every `size` tokens. Only the histogram of piece lengths (at most `size` bins) comes
to the driver. There, lengths are placed longest first, each into the shortest packs that have room, which updates counts of
packing patterns; a pattern is a list of (length, copies) with the number of sequences that have it. There are at most two
more patterns after each bin. The patterns' slots become ranges of ranks within a length, and each piece finds its slot by
its rank, which is worked out with salted windows so that a common length isn't ranked by one task.

A null text is the empty one, which is a single end token. A null id stays null; rows that repeat are packed each. An empty
table gives an empty result. Very long texts are cut into pieces. Pieces of equal length tie;
they are ranked by salt and then by document and start. Columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_rows, slices, texts, utf8, written
from .token_counts import byte_letters

#: Words of which a worker keeps the ids; beyond it the cache starts anew.
CACHE = 700_000

#: A-Z in lower case, as the tokenizer has them.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Runs of ASCII punctuation between ASCII letters, digits and white space; apostrophes may begin a contraction and stay where they are.
BORDER = re.compile(rb"(?<![^a-z0-9\s])[!-&(-/:-@\[-`{-~]++(?![^a-z0-9\s])")

#: Lower-case letters without, or with Latin-1, diacritics.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")

#: Bytes as the letters that stand for them in byte-level vocabularies.
LETTERS = {b: c for c, b in byte_letters().items()}

#: Salts of a length at least, and pieces for each further one.
SALTS, SALT_PIECES = 64, 1 << 20

_workers: dict[str, tuple] = {}


def _ids_of_words(path: str):
    """The tokenizer at path and a worker's cache of words (runs without ASCII white space) and their ids' bytes."""
    if path not in _workers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        _workers[path] = (Tokenizer.from_file(path), {})
    return _workers[path]


def token_ids(batch: list[bytes], path: str) -> list[bytes]:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer must be one that lower-cases, drops white space, and lets no token span white space or the border of letters
    or digits and punctuation: then a text's ids are those of its parts, and a worker asks for each part once. Texts with
    a special token's string are cut at white space only. Parts of PLAIN letters are as the normaliser leaves them and one piece,
    so that the tokenizer's model gets them at once, in the letters that stand for their bytes.
    """
    tokenizer, cache = _ids_of_words(path)
    words = [(data if b"<|" in data else BORDER.sub(rb" \g<0> ", data.translate(LOWER))).split() for data in batch]
    different: set[bytes] = set()
    for w in words:
        different.update(w)
    missing = list(different.difference(cache))
    if len(cache) + len(missing) > CACHE:
        cache.clear()
        missing = list(different)
    odd = []
    for m in missing:
        if PLAIN.fullmatch(m):
            cache[m] = array("I", [t.id for t in tokenizer.model.tokenize(m.decode("latin-1").translate(LETTERS))]).tobytes()
        else:
            odd.append(m)
    for m, e in zip(odd, tokenizer.encode_batch_fast([m.decode() for m in odd], add_special_tokens=False), strict=True):
        cache[m] = array("I", e.ids).tobytes()
    return [b"".join(map(cache.__getitem__, w)) for w in words]


def pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, length, ids_crc32, doc_tokens): each document's ids with end_id, cut at every `size`."""
    end = np.array([end_id], "<u4").tobytes()

    def one(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in range(6)]
        for part in slices(batch, 2 << 20):
            for i, h, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), token_ids(utf8(part.column(2)), path), strict=True):
                ids += end
                for start in range(0, len(ids) // 4, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (i, h, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
        return {n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens"), out, strict=True)}

    keyed = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(keyed, one, "doc_id long, text_hash long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, copies), ...]) that hold every length of the histogram as often as it says."""
    by_space: dict[int, list] = {}
    spaces: list[int] = []  # a heap of negated spaces that by_space has or had

    def put(space: int, count: int, pattern: list) -> None:
        if space not in by_space:
            by_space[space] = []
            heapq.heappush(spaces, -space)
        by_space[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"a length of {length} doesn't go into {size}")
        while todo:
            while spaces and not by_space.get(-spaces[0]):
                by_space.pop(-heapq.heappop(spaces), None)
            if spaces and -spaces[0] >= length:
                space = -spaces[0]
                count, pattern = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space]
                    heapq.heappop(spaces)
                below = -spaces[0] if spaces else 0
                copies = max(1, min((space - max(below, 0)) // length, todo // count))  # until another pack is shorter
                if todo < count:
                    put(space, count - todo, pattern)
                    count, copies = todo, 1
            else:
                space, pattern = size, []
                copies = min(size // length, todo)
                count = todo // copies
            put(space - copies * length, count, [*pattern, (length, copies)])
            todo -= count * copies
    return sorted(((count, pattern) for packs in by_space.values() for count, pattern in packs), key=lambda p: (p[1], p[0]))


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted by length and rank, for the lookup of a rank's place."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in found:
        offset = 0
        for length, copies in pattern:
            rows.append((length, rank.get(length, 0), copies, sequence, offset))
            rank[length] = rank.get(length, 0) + count * copies
            offset += length * copies
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(lengths: DataFrame, size: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to rows with a column `length` (1 to size). Rows of a length are ranked by `order`. An error if lengths has such columns."""
    names = list(lengths.columns)
    if taken := {"sequence_id", "offset"} & {c.lower() for c in names}:
        raise ValueError(f"the table has columns of these names: {sorted(taken)}")
    salt, first, rank, count = (free_name(lengths, f"__{c}") for c in ("salt", "before", "rank", "count"))
    histogram = {r[0]: r[1] for r in lengths.groupBy("length").agg(F.count("*")).collect()}  # at most `size` bins
    table = slots(patterns(histogram, size))
    keys = (table[:, 0] << 44) | table[:, 1]
    salts = max(SALTS, sum(histogram.values()) // SALT_PIECES)
    salted = lengths.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy("length", salt).agg(F.count("*").alias(count))
    running = F.sum(count).over(Window.partitionBy("length").orderBy(salt))
    counts = counts.select("length", salt, (running - F.col(count)).alias(first))
    own = F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1
    ranked = salted.withColumn(rank, own).join(counts, ["length", salt]).select(*[F.col(f"`{c}`") for c in names], (F.col(rank) + F.col(first)).alias(rank))
    n, at = len(names), names.index("length")

    def one(batch: pa.RecordBatch) -> dict:
        length, place = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (at, n))
        row = table[np.searchsorted(keys, (length << 44) | place, side="right") - 1]
        sequence, copy = np.divmod(place - row[:, 1], row[:, 2])
        return {c: batch.column(k) for k, c in enumerate(names)} | {"sequence_id": pa.array(row[:, 3] + sequence), "offset": pa.array(row[:, 4] + copy * length)}

    return map_rows(ranked, one, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, path, end_id, size, id_col, text_col))
    return pack(cut, size, ("doc_id", "text_hash", "start")).drop("text_hash")
