"""Substring dedup: passages that stand in an earlier document too, found with a compressed FM-index per shard.

Documents are streamed three times. First, each window of `size` words names the least hash among its runs of SEED words (its
minimiser); equal windows name equal ones, so only windows whose minimiser stands in two documents matter. These minimisers
go into a bitmap of bounded size, or, if there are too many for it, are joined with the documents. Second, the
windows left are cut into segments of neighbours with the same minimiser, at most size - SEED + 1 windows each. A segment's
minimiser is its route: equal windows meet in one shard whatever documents they come from. A shard's different segments, each
with the smallest document id that holds it, are indexed in parts: ranks of words, the suffix array by doubling, and the
Burrows-Wheeler transform in a wavelet matrix of bit-packed levels with counts. Then the segments, as their first documents
have them, are streamed through the index: backward search from each place narrows an interval word by word, as long as the
least document id in it, by a table of range minima, is smaller than the segment's own. The words read are the place's
matching statistic, and matches of `size` words or more are reported. A later document that holds the same segment has all of
it repeated. Third, each document drops the words that its matches cover.

Routes with more than ROUTE different segments are cut finer, by the three least hashes of a window, so that a shard's part
stays small however common a passage is. What is then still too common is dealt by the windows themselves, and there, as all
of a route's windows are equal, the smallest id needs no index.

Words are runs of bytes other than ASCII white space, unchanged. Null and empty texts have no words; very long ones are worked on whole. Texts of fewer than
`size` words lose nothing. Rows with a null id neither lose words nor make others lose any; rows of the same id don't count as
earlier for each other. Words are compared by 64-bit hashes. Matches end where segments end; those whose windows follow on each
other are joined at last, so a repeated passage is reported whole, as long as it is: a stretch of which every window stands in some earlier document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, lean, map_rows, marked, slices, texts, utf8, written
from .words import mixed, windows, word_hashes

#: Words of a window, and of the runs from which its minimiser is chosen.
SIZE, SEED = 13, 5

#: Different segments of a route, and of an index.
ROUTE, PART = 1000, 12_000

#: Least hashes by which common routes are cut finer.
FINER = 3

#: Bytes of words after which a task indexes what it holds, at the end of a route.
PART_BYTES = 8 << 20

#: Places that are searched at once.
LANES = 1 << 16

#: Words that backward search reads before it looks at document ids.
BLIND = 3

#: Segments that a task remembers as already sent with their words.
SENT = 100_000


class FMIndex:
    """Sequences of word ids (1 and up), each with a number, for backward search."""

    def __init__(self, sequences: list[np.ndarray], numbers: np.ndarray) -> None:
        sizes = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(sizes.sum()), np.int64)
        ends = np.cumsum(sizes)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = np.concatenate(sequences)
        n = len(text)
        rank, h = text, 1
        while h < sizes.max() and rank.max() < n - 1:  # the order by 2, 4, 8 ... words, up to a whole sequence
            key = rank * (n + 2) + np.concatenate([rank[h:] + 1, np.zeros(min(h, n), np.int64)])[:n]
            rank = np.unique(key, return_inverse=True)[1]
            h *= 2
        order = np.argsort(rank, kind="stable")
        self.n, self.letters = n, int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.letters))))  # letters smaller than each
        transform = text[order - 1]
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # words of 64 bits, ones before each, zeros in all
        for bit in range(max(1, int(self.letters - 1).bit_length()) - 1, -1, -1):
            ones = (transform >> bit & 1).astype(bool)
            padded = np.zeros((n + 64) // 64 * 64, bool)
            padded[:n] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)
            self.levels.append((packed, counts, int(n - ones.sum())))
            transform = np.concatenate([transform[~ones], transform[ones]])
        every = np.arange(self.letters)
        self.origin = self._descend(every, np.zeros(self.letters, np.int64))
        owner = np.repeat(np.arange(len(sequences)), sizes)
        self.numbers, ranks = np.unique(numbers, return_inverse=True)
        self.least = [ranks[owner[order]].astype(np.int32)]  # ranks of numbers: minima over 2^k places from each on

    def _descend(self, letter: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, (packed, counts, zeros) in enumerate(self.levels):
            word = place >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where(letter >> (len(self.levels) - 1 - k) & 1, zeros + ones, place - ones)
        return place

    def extend(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the words that letter and then those of [lo, hi) begin with: a step of backward search."""
        both = self._descend(np.concatenate([letter, letter]), np.concatenate([lo, hi])) - np.concatenate([self.origin[letter]] * 2)
        return self.before[letter] + both[: len(letter)], self.before[letter] + both[len(letter) :]

    def minima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rank of the least number in each interval (none is empty)."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in range(len(self.least), int(level.max(initial=0)) + 1):
            last, half = self.least[-1], 1 << (k - 1)
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.least[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out

    def longest(self, text: np.ndarray, end: np.ndarray, begin: np.ndarray, below: np.ndarray) -> np.ndarray:
        """For each place `end` of text (word ids): how many words up to it, none before `begin`, stand together in a sequence of a number below `below`; BLIND or fewer count as none."""
        length, limit = np.zeros(len(end), np.int64), np.searchsorted(self.numbers, below)
        lane, lo, hi = np.arange(len(end)), np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        read = 0
        while len(lane):
            lo, hi = self.extend(text[end[lane] - read], lo, hi)
            read += 1
            found = hi > lo
            if read > BLIND:
                found[found] = self.minima(lo[found], hi[found]) < limit[lane[found]]
            lane, lo, hi = lane[found], lo[found], hi[found]
            length[lane] = read
            more = end[lane] - read >= begin[lane]
            lane, lo, hi = lane[more], lo[more], hi[more]
        return np.where(length > BLIND, length, 0)


def _minimisers(h: np.ndarray, text: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimiser of the window that starts at each word, whether there is such a window within a text)."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least, width, span = windows(h, seed), 1, size - seed + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return least, text[: len(least)] == text[size - 1 :]


def minimisers(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(m, doc_id): the different minimisers of each row of (doc_id, text)."""

    def one(batch: pa.RecordBatch) -> dict:
        found, ids = [], []
        for part in slices(batch, 1 << 20):
            h, text, *_ = word_hashes(utf8(part.column(1)))
            least, inside = _minimisers(h, text, size, seed)
            least, owner = least[inside], text[: len(least)][inside]
            if len(least):
                new = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
                found.append(least[new].view(np.int64))
                ids.append(part.column(0).to_numpy(zero_copy_only=False)[owner[new]].astype(np.int64))
        return {"m": pa.array(np.concatenate(found) if found else [], pa.int64()), "doc_id": pa.array(np.concatenate(ids) if ids else [], pa.int64())}

    return map_rows(docs, one, "m long, doc_id long")


_SEGMENT = "doc_id long, text_hash long, start int, length int, route long, key long, words string"


def _segments(rows: DataFrame, marks: np.ndarray | None, size: int, seed: int) -> DataFrame:
    """Segments of rows (doc_id, text_hash, text[, shared array<long>]): runs of windows with one shared minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                h, text, begin, end, data = word_hashes(utf8(part.column(2)))
                least, inside = _minimisers(h, text, size, seed)
                m = least.view(np.int64)
                if marks is not None:
                    inside = inside & marked(marks, m)
                else:
                    for k, own in enumerate(part.column(3).to_pylist()):
                        lo, hi = np.searchsorted(text[: len(m)], [k, k + 1])
                        inside[lo:hi] &= np.isin(m[lo:hi], np.array(own or [], np.int64))
                if not inside.any():
                    continue
                near = np.concatenate(([False], inside[1:] & inside[:-1] & (m[1:] == m[:-1]) & (text[1 : len(m)] == text[: len(m) - 1])))
                first = np.flatnonzero(inside & ~near)
                last = np.flatnonzero(inside & ~np.append(near[1:], False))
                runs = [(i + k, min(j, i + k + size - seed)) for i, j in zip(first.tolist(), last.tolist(), strict=True) for k in range(0, j - i + 1, size - seed + 1)]
                i, j = np.array(runs).T
                key = _keys(h, i, j + size)
                ids, hashes = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                where = text[i]
                heads = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
                number = np.zeros(int(text[-1]) + 1, np.int64)
                number[text[heads]] = heads
                words: list[str | None] = []
                for r, k, x, y in zip(m[i].tolist(), key.tolist(), begin[i].tolist(), end[j + size - 1].tolist(), strict=True):
                    if (r, k) in sent:
                        words.append(None)
                        continue
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add((r, k))
                    words.append(data[x:y].decode())
                columns = (ids[where], hashes[where], (i - number[where]).astype(np.int32), (j - i + size).astype(np.int32), m[i], key)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.string())], ["doc_id", "text_hash", "start", "length", "route", "key", "words"])

    return rows.mapInArrow(lean(run), _SEGMENT)


def _keys(h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A hash of the words i to j (exclusive) for each pair; of the words alone, wherever they stand."""
    out = (j - i).astype(np.uint64)
    for k in range(int((j - i).max(initial=0))):
        live = i + k < j
        out[live] = mixed(out[live] * np.uint64(0xA24BAED4963EE407) + h[i[live] + k])
    return out.view(np.int64)


_MATCHED = "route long, key long, least long, most long, length int, matches array<struct<start:int,length:int>>"


def matching_statistics(segments: DataFrame, size: int = SIZE) -> DataFrame:
    """_MATCHED for segments (route, key, least, most, length, words): where `size` words or more also stand in segments of a smaller `least`.

    matches are the longest such runs, none within another; segments without any, and with one document only, are left out.
    Each route must have few different segments: a shard is a partition of routes, indexed in parts of about PART segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = 0

        def search() -> pa.RecordBatch:
            route, key, least, most, length, words = zip(*kept, strict=True)
            least, length = np.array(least, np.int64), np.array(length, np.int64)
            h, text, *_ = word_hashes([w.encode() for w in words])
            ids = np.unique(h, return_inverse=True)[1].astype(np.int64) + 1
            cut = np.cumsum(length) - length
            index = FMIndex([ids[a : a + n] for a, n in zip(cut.tolist(), length.tolist(), strict=True)], least)
            end = np.flatnonzero(np.arange(len(ids)) - cut[text] >= size - 1)
            found = np.concatenate([index.longest(ids, e, cut[text[e]], least[text[e]]) for e in (end[k : k + LANES] for k in range(0, len(end), LANES))])
            start = end - found + 1
            within = np.append((start[1:] <= start[:-1]) & (text[end[1:]] == text[end[:-1]]), False)  # the next match holds this one
            hit = (found >= size) & ~within
            owner = text[end[hit]]
            count = np.bincount(owner, minlength=len(words))
            told = np.flatnonzero((count > 0) | (np.array(most) > least))
            matches = pa.StructArray.from_arrays([pa.array((start[hit] - cut[owner]).astype(np.int32)), pa.array(found[hit].astype(np.int32))], ["start", "length"])
            offsets = np.concatenate(([0], np.cumsum(count[told]))).astype(np.int32)  # what is left out has no matches
            columns = [pa.array(np.array(x, np.int64)[told]) for x in (route, key, least, most)]
            kept.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(length[told].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), matches)], ["route", "key", "least", "most", "length", "matches"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (len(kept) >= PART or held >= PART_BYTES) and kept[-1][0] != row[0]:
                    yield search()
                    held = 0
                kept.append(row)
                held += len(row[5])
        if kept:
            yield search()

    sharded = segments.select("route", "key", "least", "most", "length", "words").repartition("route").sortWithinPartitions("route")
    return sharded.mapInArrow(lean(run), _MATCHED)


def _finer(segments: DataFrame, size: int, seed: int, least: int) -> DataFrame:
    """(seg_route, seg_key, place, first, route, key, length, words): segments cut into runs of windows with the same `least` least hashes; 0: into windows."""
    names = ("seg_route", "seg_key", "first")

    def one(batch: pa.RecordBatch) -> dict:
        h, text, begin, end, data = word_hashes(utf8(batch.column(3)))
        start = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
        if least:
            seeds = np.sort(np.lib.stride_tricks.sliding_window_view(windows(h, seed), size - seed + 1)[start], axis=1)[:, :least]
            route = np.full(len(start), least, np.uint64)
            for column in seeds.T:
                route = mixed(route ^ mixed(column + route))
            near = np.concatenate(([False], (route[1:] == route[:-1]) & (start[1:] == start[:-1] + 1) & (text[start[1:]] == text[start[:-1]])))
            i, j = start[~near], start[np.append(~near[1:], True)]
            route = route[~near].view(np.int64)
        else:
            i, j = start, start
            route = _keys(h, i, j + size)
        owner = text[i]
        picked = {n: batch.column(k).take(pa.array(owner)) for k, n in enumerate(names)}
        words = pa.array([data[x:y].decode() for x, y in zip(begin[i].tolist(), end[j + size - 1].tolist(), strict=True)] if least else [None] * len(i), pa.string())
        place, length = ((i - np.searchsorted(text, owner)).astype(np.int32), (j - i + size).astype(np.int32))
        return picked | {"place": pa.array(place), "route": pa.array(route), "key": pa.array(_keys(h, i, j + size)), "length": pa.array(length), "words": words}

    return map_rows(segments.select("route", "key", "least", "words"), one, "seg_route long, seg_key long, first long, place int, route long, key long, length int, words string")


def _one_sequence(segments: DataFrame) -> DataFrame:
    """_MATCHED for segments of which a route has only one: none stands in another."""
    return segments.where("most > least").select("route", "key", "least", "most", "length", F.expr("cast(array() AS array<struct<start:int,length:int>>)").alias("matches"))


def _matched(segments: DataFrame, size: int, seed: int, cuts: tuple[int, ...] = (FINER, 0)) -> DataFrame:
    """_MATCHED for segments (route, key, least, most, length, words) of any routes; common ones are cut by the first of `cuts`, and so on."""
    common = written(segments.groupBy("route").count().where(F.col("count") > ROUTE).select("route"), few=True)  # its size is known from here on: segments need no shuffle to meet a few routes
    done = matching_statistics(segments.join(common, "route", "left_anti"), size)
    if common.isEmpty():
        return done
    whole = segments.join(common, "route")
    cut = written(_finer(whole, size, seed, cuts[0]))
    once = written(cut.groupBy("route", "key").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.first("length").alias("length"), F.first("words").alias("words")))
    found = (_matched(once, size, seed, cuts[1:]) if cuts[0] else _one_sequence(once)).select("route", "key", "least", "matches")
    own = F.when(F.col("first") > F.col("least"), F.array(F.struct(F.lit(0).alias("start"), "length"))).otherwise(F.col("matches"))
    placed = F.transform(own, lambda m: F.struct((m["start"] + F.col("place")).alias("start"), m["length"].alias("length")))
    back = cut.join(found, ["route", "key"]).select("seg_route", "seg_key", placed.alias("m")).where(F.size("m") > 0)
    back = back.groupBy(F.col("seg_route").alias("route"), F.col("seg_key").alias("key")).agg(F.flatten(F.collect_list("m")).alias("matches"))
    told = whole.drop("words").join(back, ["route", "key"], "left").where("most > least OR matches IS NOT NULL")
    return done.union(told.select("route", "key", "least", "most", "length", F.coalesce("matches", F.expr("cast(array() AS array<struct<start:int,length:int>>)"))))


def repeated_passages(docs: DataFrame, size: int = SIZE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, matches array<struct<start, length>>): the longest stretches, from word start on, of which every window of `size` words also stands in a document with a smaller id."""
    return joined_pieces(repeated_pieces(docs, size, seed, id_col, text_col), size)


def repeated_pieces(docs: DataFrame, size: int = SIZE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeated_passages in pieces that end where segments end, in no order: what without_repeats needs, as they cover the same words."""
    if not seed < size:
        raise ValueError("a passage must have more words than a seed")
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    named = minimisers(rows.select("doc_id", "text"), size, seed)
    shared = written(named.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"), few=True)
    marks = bitmap(shared, "m")
    if marks is not None:
        found = _segments(rows, marks, size, seed)
    else:
        own = named.join(shared, "m").groupBy("doc_id").agg(F.collect_set("m").alias("shared"))
        found = _segments(rows.join(own, "doc_id").select("doc_id", "text_hash", "text", "shared"), None, size, seed)
    found = written(found)
    different = found.groupBy("route", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("length").alias("length"), F.first("words", ignorenulls=True).alias("words"))
    matched = _matched(written(different), size, seed).select("route", "key", "least", "length", "matches")
    own = F.when(F.col("doc_id") > F.col("least"), F.array(F.struct(F.lit(0).alias("start"), "length"))).otherwise(F.col("matches"))
    placed = F.transform(own, lambda m: F.struct((m["start"] + F.col("begin")).alias("start"), m["length"].alias("length")))
    hit = found.select("doc_id", "text_hash", F.col("start").alias("begin"), "route", "key").join(matched, ["route", "key"]).select("doc_id", "text_hash", placed.alias("m")).where(F.size("m") > 0)
    return hit.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("m")).alias("matches"))  # a document's own pieces


def joined_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (doc_id, text_hash, matches) with matches in order, and as one where the windows of one follow on those of another."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def one(batch: pa.RecordBatch) -> dict:
        out = []
        for matches in batch.column(2).to_pylist():
            at = np.array([(m["start"], m["start"] + m["length"]) for m in matches], np.int64)
            at = at[np.argsort(at[:, 0], kind="stable")]
            reach = np.maximum.accumulate(at[:, 1])
            first = np.flatnonzero(np.concatenate(([True], at[1:, 0] > reach[:-1] - size + 1)))
            last = np.append(first[1:], len(at)) - 1
            out.append([{"start": a, "length": b - a} for a, b in zip(at[first, 0].tolist(), reach[last].tolist(), strict=True)])
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "matches": pa.array(out, kind)}

    return map_rows(pieces, one, "doc_id long, text_hash long, matches array<struct<start:int,length:int>>")


def without_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's words that no repeated passage covers, joined by one space."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def small(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "packed": pa.array([pack.compress(x) for x in utf8(batch.column(2))], pa.binary())}

    packed = map_rows(rows, small, "doc_id long, text_hash long, packed binary")  # texts cross the network once, compressed
    joined = packed.join(repeats, ["doc_id", "text_hash"], "left").select("doc_id", "packed", "matches.start", "matches.length")

    def one(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[], [], []]
        unpack = zstandard.ZstdDecompressor()
        for data, start, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            words = unpack.decompress(data).split()
            kept = words
            if start:
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array(start)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + np.array(length), -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            out[0].append(len(words))
            out[1].append(len(words) - len(kept))
            out[2].append(b" ".join(kept).decode())
        return {"doc_id": batch.column(0), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "text": pa.array(out[2], pa.string())}

    return map_rows(joined, one, "doc_id long, n_words long, n_removed long, text string")
