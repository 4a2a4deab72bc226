"""Benchmark decontamination by greedy string tiling.

Words of documents and items (ASCII letters in lower case) are hashed; runs of MATCH words are seeds. A bitmap of fixed size,
made from the items' seeds, drops documents without any seed while they are read; those left are written. A pair can leak only
if the seeds that it shares can cover enough of the item: a tile of k words has at least k / MATCH seeds. So Spark joins the
documents' seeds with the rarest of each item's alone, as many as it takes that the commoner ones left out couldn't suffice by
themselves; a phrase that stands everywhere makes no pairs but of items that hold little else. The seeds that such a pair
shares are then counted, and pairs with too few go. For those left, tiles are found greedily: the longest matches of words that no tile has
yet are marked on both sides, until none of MATCH words is left. The longest length is found by bisection over hashes of runs,
which running Karp-Rabin gives for any length from one pass of sums; matches of that length are marked in order of item and
document place, equal ones of a document through one pointer, so that repeated phrases cost no pair of places each. An item
counts as leaked if tiles cover at least `coverage` of its words, in whatever order they stand in the document.

Items with fewer than MATCH words (null and empty ones too) have no seed and never leak; documents with null or empty texts
never hold any. Repeated documents and items give a row for each pair of ids once; where an id repeats with different texts,
each pair of texts is judged by itself and the largest values are reported. Rows with a null id are not reported. Further columns, whatever their names, are not looked at. Very long
texts are worked on whole; only the runs that they share with an item count towards the work on a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, slices, texts, utf8, written
from .license_scan import WORD_BYTES
from .words import Rolling, windows, word_hashes

#: Words of a seed, and of the shortest tile.
MATCH = 5

#: Share of an item's words that tiles cover in a leak.
COVERAGE = 0.5

#: Bits of the bitmap of seeds (2 MB).
BITS = 1 << 24


def _seeds(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, its text) in order, and the number of words of each text."""
    h, text, *_ = word_hashes(batch, WORD_BYTES)
    g = windows(h, MATCH)
    inside = text[: len(g)] == text[MATCH - 1 :]
    return g[inside].view(np.int64), text[: len(g)][inside], np.bincount(text, minlength=len(batch))


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item_hash, item): different items with an id."""
    named = texts(items, id_col, text_col).where("doc_id IS NOT NULL").distinct()
    return named.select(F.col("doc_id").alias("item_id"), F.xxhash64("text").alias("item_hash"), F.col("text").alias("item"))


def item_seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(seed, item_id, item_hash, times, n_words): an item's seeds, how often each stands in it, and its words."""

    def one(batch: pa.RecordBatch) -> dict:
        seeds, text, words = _seeds(utf8(batch.column(2)))
        of = pa.array(text)
        return {"seed": pa.array(seeds), "item_id": batch.column(0).take(of), "item_hash": batch.column(1).take(of), "n_words": pa.array(words[text])}

    rows = map_rows(_items(items, id_col, text_col), one, "seed long, item_id long, item_hash long, n_words long")
    return rows.groupBy("seed", "item_id", "item_hash").agg(F.count("*").alias("times"), F.max("n_words").alias("n_words"))


def _places(c):
    """The two bits of a seed in the bitmap."""
    return F.array(F.pmod(c, F.lit(BITS)), F.pmod(F.shiftright(c, 24), F.lit(BITS)))


def bitmap(seeds: DataFrame) -> np.ndarray:
    """BITS bits as bytes, with the two bits of each seed set."""
    bits = seeds.select(F.explode(_places(F.col("seed"))).alias("p")).select((F.col("p") / 32768).cast("int").alias("part"), (F.col("p") % 32768).alias("p"))
    out = np.zeros(BITS // 8, np.uint8)
    for part, b in bits.groupBy("part").agg(F.bitmap_construct_agg("p")).collect():  # at most BITS / 32768 rows
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(b), np.uint8)
    return out


def seeded_documents(docs: DataFrame, marks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, seeds): documents with seeds in the bitmap."""

    def one(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[], [], []]
        for part in slices(batch, 2 << 20):
            data = utf8(part.column(1))
            seeds, text, _ = _seeds(data)
            a, b = seeds & (BITS - 1), (seeds >> 24) & (BITS - 1)
            hit = np.flatnonzero(((marks[a >> 3] >> (a & 7)) & (marks[b >> 3] >> (b & 7)) & 1) != 0)
            ids = part.column(0).to_pylist()
            for t in np.unique(text[hit]):
                lo, hi = np.searchsorted(text[hit], [t, t + 1])
                for column, value in zip(out, (ids[t], data[t].decode(), np.unique(seeds[hit[lo:hi]]).tolist()), strict=True):
                    column.append(value)
        return {"doc_id": pa.array(out[0], pa.int64()), "text": pa.array(out[1], pa.string()), "seeds": pa.array(out[2], pa.list_(pa.int64()))}

    return map_rows(texts(docs, id_col, text_col).where("doc_id IS NOT NULL"), one, "doc_id long, text string, seeds array<long>")


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy tiling of two arrays of word hashes, longest first, ties by item and document place."""
    shared = np.isin(windows(doc, least), windows(item, least))
    covered = np.zeros(len(doc) + 1, np.int64)  # places of doc within a run that the item has too: tiles lie there
    starts = np.flatnonzero(shared)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + least, -1)
    kept = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    cut = np.flatnonzero(np.diff(kept) > 1) + 1
    kept = np.insert(kept, cut, -1)  # a place that is never free between runs that aren't neighbours
    doc = np.where(kept >= 0, doc[kept], np.uint64(0))
    free_i, free_d = np.ones(len(item), bool), kept >= 0
    rolling_i, rolling_d = Rolling(item), Rolling(doc)
    found: list[tuple[int, int, int]] = []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, hashes) in the item, and in doc, of free runs that both have."""
        places, hashes = [], []
        for rolling, free in ((rolling_i, free_i), (rolling_d, free_d)):
            at = np.flatnonzero(windows_free(free, length))
            places.append(at)
            hashes.append(rolling.windows(length)[at])
        both = [np.isin(hashes[0], hashes[1]), np.isin(hashes[1], hashes[0])]
        return places[0][both[0]], hashes[0][both[0]], places[1][both[1]], hashes[1][both[1]]

    longest = min(len(item), len(doc))
    while longest >= least:
        low, high = least - 1, longest  # a common run of `low` words exists, or low is too short; none beyond high does
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        places_i, hashes_i, places_d, hashes_d = common(low)
        order = np.argsort(hashes_d, kind="stable")
        groups, begin = np.unique(hashes_d[order], return_index=True)
        end = np.append(begin[1:], len(order))
        queue = places_d[order]
        for i, g in zip(places_i.tolist(), np.searchsorted(groups, hashes_i).tolist(), strict=True):
            if not free_i[i : i + low].all():
                continue
            while begin[g] < end[g]:
                d = int(queue[begin[g]])
                begin[g] += 1  # taken, or not free and never free again
                if free_d[d : d + low].all() and np.array_equal(item[i : i + low], doc[d : d + low]):
                    free_i[i : i + low] = free_d[d : d + low] = False
                    found.append((i, int(kept[d]), low))
                    break
        longest = low - 1
    return found


def windows_free(free: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n places is free."""
    total = np.concatenate(([0], np.cumsum(free)))
    return total[n:] - total[: max(0, len(total) - n)] == n


def likely_pairs(found: DataFrame, seeds: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash) of the pairs that share enough seeds (found: doc_id, text_hash, seeds; seeds: item_seeds)."""
    held = found.select("doc_id", "text_hash", F.explode("seeds").alias("seed")).distinct()
    told = seeds.join(held.groupBy("seed").agg(F.count("*").alias("held")), "seed")  # a seed that no document holds can't be shared
    least = F.ceil(F.ceil(F.col("n_words") * coverage) / MATCH)
    commoner = Window.partitionBy("item_id", "item_hash").orderBy(F.desc("held"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = written(told.withColumn("least", least).withColumn("rare", F.sum("times").over(commoner) >= F.col("least")), few=True)
    met = held.join(told.where("rare").select("seed", "item_id", "item_hash"), "seed").select("doc_id", "text_hash", "item_id", "item_hash").distinct()
    shared = met.join(told.select("item_id", "item_hash", "seed", "times", "least"), ["item_id", "item_hash"]).join(held, ["doc_id", "text_hash", "seed"])
    counted = shared.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.sum("times").alias("shared"), F.max("least").alias("least"))
    return counted.where("shared >= least").select("doc_id", "text_hash", "item_id", "item_hash")


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage, n_tiles, longest) of the pairs whose tiles cover enough of the item."""
    seeds = written(item_seeds(items, item_id_col, item_text_col), few=True)
    found = written(seeded_documents(docs, bitmap(seeds), id_col, text_col).withColumn("text_hash", F.xxhash64("text")))
    pairs = likely_pairs(found, seeds, coverage)
    doc_texts = found.drop("seeds").dropDuplicates(["doc_id", "text_hash"])
    item_texts = _items(items, item_id_col, item_text_col).dropDuplicates(["item_id", "item_hash"])
    both = pairs.join(doc_texts, ["doc_id", "text_hash"]).join(item_texts, ["item_id", "item_hash"]).select("doc_id", "item_id", "text", "item")

    def one(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in range(7)]
        for i, k, doc, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
            words = word_hashes([item], WORD_BYTES)[0]
            t = tiles(words, word_hashes([doc], WORD_BYTES)[0])
            covered = sum(n for *_, n in t)
            if t and covered >= coverage * len(words):
                for column, value in zip(out, (i, k, len(words), covered, covered / len(words), len(t), t[0][2]), strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
        return {n: pa.array(c, kind) for n, c, kind in zip(("doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", "longest"), out, kinds, strict=True)}

    rows = map_rows(both, one, "doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles long, longest long")
    return rows.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in rows.columns[2:]])
