"""Periodic runs of words, by the linear-time method of Gusfield and Stoye for tandem repeats.

A run is a stretch with smallest period q that holds at least 2 * q words (and at least a given number) and that no neighbouring
word extends with that period. Texts are worked on in the tasks that read them, many at a time:

1. Every word of a run of 12 words lies in a repeated sequence of six words of its text (the run less its last period is found
   again one period on, and both cover it). Only the stretches of such words go on, with a separator of its own after each;
   a match across separators can't be. Shorter least lengths take shorter sequences.
2. Ranks by prefix doubling, forwards and backwards, give a suffix array and the longest common extensions of any two places.
   Longest earlier factors give the blocks of the Lempel-Ziv decomposition, and extensions around the blocks' borders the
   leftmost-covering squares: at most one for each block and period. Squares of squares are left out.
3. The suffix tree (intervals of common prefixes) has a place for each square. Walking along suffix links, and down by the first
   word of the square, turns a square by a word at a time, until the turned one doesn't occur or is known. That completes the vocabulary.
4. The leaves below a square's place are its occurrences. Occurrences of one period at neighbouring places belong to one run.

Null and empty texts have no words and no runs. Repeated rows are worked on one by one, a null id stays null, an empty table
gives an empty result, and columns besides the id and the text are not looked at. Runs that tie in start are in order of their
period. Very long texts are worked on whole; memory is about 500 bytes for each word of a text's repetitive stretches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, texts, utf8
from .words import MIX, mixed, windows, word_hashes

#: Least words of a run.
LEAST = 12

#: Words of stretches that one suffix tree holds, about; a stretch is never cut.
TREE = 1 << 16


def prefix_ranks(x: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: the rank of x[i : i + 2^k] among all such; the last ones are all different. A place beyond the end has rank -1."""
    n, out = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int32)]
    while n > 1 and out[-1].max() < n - 1:
        step = 1 << (len(out) - 1)
        second = np.zeros(n, np.int64)
        if step < n:
            second[: n - step] = out[-1][step:].astype(np.int64) + 1
        out.append(np.unique(out[-1].astype(np.int64) * (n + 1) + second, return_inverse=True)[1].astype(np.int32))
    return [np.append(r, np.int32(-1)) for r in out]


def extensions(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and j on are the same; i and j differ."""
    i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][i] == ranks[k][j]).astype(np.int64) << k
        i += step
        j += step
        total += step
    return total


def earlier_factors(ranks: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """For each place, the length of its longest factor that also begins at an earlier place: that of a neighbour in the suffix array among earlier places."""
    n = len(suffixes)
    before, after = np.full(n + 1, n), np.full(n + 1, n)  # n: none
    before[suffixes[1:]], after[suffixes[:-1]] = suffixes[:-1], suffixes[1:]
    left, right = before.tolist(), after.tolist()
    for i in range(n - 1, -1, -1):  # place i leaves the list, in which only earlier places are left
        a, b = left[i], right[i]
        right[a], left[b] = b, a
    longest, at = np.zeros(n, np.int64), np.arange(n)
    for side in (left, right):
        other = np.array(side[:n], np.int64)
        longest = np.maximum(longest, extensions(ranks, at, other))
    return longest


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place in 0..counts[k] - 1) for all k."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering_squares(n: int, ranks: list[np.ndarray], back: list[np.ndarray], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of a leftmost-covering set of squares, from the blocks of the Lempel-Ziv decomposition."""
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += max(1, int(factors[at]))
    h = np.array(starts, np.int64)
    end = np.append(h[1:], n)
    size = end - h

    def around(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extensions of places p and q to the right, and of the places before them to the left."""
        return extensions(ranks, p, q), extensions(back, n - p, n - q)

    block, k = _expand(size)  # halves whose right one crosses the block's end
    k, p = k + 1, end[block]
    q = p - k
    right, left = around(p, q)
    good = (right + left >= k) & (right > 0)
    found = [(np.maximum(q - left, q - k + 1)[good], k[good])]
    block, k = _expand(size + np.append(size[1:], 0))  # halves whose left one crosses the block's start
    k, p = k + 1, h[block]
    good = p + k < n
    block, k, p = block[good], k[good], p[good]
    right, left = around(p, p + k)
    start = np.maximum(p - left, p - k + 1)
    good = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= end[block])
    found.append((start[good], k[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def primitive(ranks: list[np.ndarray], start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Which squares have no shorter period that divides their half."""
    if not len(half):
        return np.zeros(0, bool)
    least = np.zeros(int(half.max()) + 1, np.int64)  # least prime factors
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == 0:
            multiples = least[p * p :: p]
            multiples[multiples == 0] = p
    least = np.where(least == 0, np.arange(len(least)), least)
    good, rest = np.ones(len(half), bool), half.copy()
    while (todo := np.flatnonzero((rest > 1) & good)).size:
        period = half[todo] // least[rest[todo]]
        good[todo] = extensions(ranks, start[todo], start[todo] + period) < 2 * half[todo] - period
        rest[todo] //= least[rest[todo]]
    return good


class SuffixTree:
    """The suffix tree of x, whose last value occurs once, as intervals of the suffix array. Node 0 is the root; leaves come after the inner nodes."""

    def __init__(self, x: np.ndarray, ranks: list[np.ndarray], suffixes: np.ndarray) -> None:
        n = self.n = len(x)
        self.suffixes, self.rank_of = suffixes, ranks[-1][:n].astype(np.int64)
        common = np.zeros(n, np.int64)
        common[1:] = extensions(ranks, suffixes[:-1], suffixes[1:])
        self.least = [common]  # least[j][r]: the least of common[r : r + 2^j]
        while (step := 1 << (len(self.least) - 1)) * 2 <= n:
            self.least.append(np.minimum(self.least[-1][: n - 2 * step + 1], self.least[-1][step : n - step + 1]))
        depth, lo, hi, parent, stack, node = [0], [0], [n - 1], [0], [0], [0] * (n + 1)
        for r, c in enumerate(common.tolist()):
            if r == 0:
                continue
            left, open_child = r - 1, -1
            while depth[stack[-1]] > c:
                u = stack.pop()
                hi[u], left = r - 1, lo[u]
                open_child = -1
                if depth[stack[-1]] >= c:
                    parent[u] = stack[-1]
                else:
                    open_child = u
            if depth[stack[-1]] < c:
                depth.append(c)
                lo.append(left)
                hi.append(n - 1)
                parent.append(stack[-1])
                stack.append(len(depth) - 1)
                if open_child >= 0:
                    parent[open_child] = stack[-1]
            node[r] = stack[-1]
        for a, b in zip(stack[1:], stack, strict=False):
            parent[a] = b
        inner = self.inner = len(depth)
        depths, nodes = np.array(depth), np.array(node)
        above = np.where(depths[nodes[:-1]] >= depths[nodes[1:]], nodes[:-1], nodes[1:])  # a leaf hangs on the deeper of the nodes beside it
        self.depth, self.lo, self.hi = (np.concatenate((np.array(a), b)) for a, b in ((depth, n - suffixes), (lo, np.arange(n)), (hi, np.arange(n))))
        self.parent = np.concatenate((np.array(parent), above))
        self.keys = np.argsort(self.lo[:inner] * n + self.hi[:inner])
        every = np.arange(1, inner + n)
        edge = self.parent[every] * (int(x.max()) + 1) + x[suffixes[self.lo[every]] + self.depth[self.parent[every]]]
        self.child, self.wide = dict(zip(edge.tolist(), every.tolist(), strict=True)), int(x.max()) + 1
        some = np.arange(1, inner)
        self.link = np.concatenate(([0], self.places(suffixes[self.lo[some]] + 1, self.depth[some] - 1)))

    def places(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The node at or below which the words x[start : start + length] end."""
        lo = self.rank_of[start]
        hi = lo.copy()
        for j in range(len(self.least) - 1, -1, -1):
            step, least = 1 << j, self.least[j]
            ok = (lo >= step) & (least[np.maximum(lo - step + 1, 0)] >= length)
            lo = np.where(ok, lo - step, lo)
            ok = (hi + step < self.n) & (least[np.minimum(hi + 1, len(least) - 1)] >= length)
            hi = np.where(ok, hi + step, hi)
        keys = self.lo[: self.inner] * self.n + self.hi[: self.inner]
        at = np.searchsorted(keys, lo * self.n + hi, sorter=self.keys)
        return np.where(lo == hi, self.inner + lo, self.keys[np.minimum(at, self.inner - 1)])

    def vocabulary(self, start: np.ndarray, half: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, half) of all squares that turning the given ones a word at a time reaches."""
        depth, lo, parent, link, suffixes, words = self.depth.tolist(), self.lo.tolist(), self.parent.tolist(), self.link.tolist(), self.suffixes.tolist(), x.tolist()
        child, wide, seen = self.child, self.wide, set()
        for c, length in zip(self.places(start, 2 * half).tolist(), (2 * half).tolist(), strict=True):
            while (c, length) not in seen:
                seen.add((c, length))
                i = suffixes[lo[c]]
                u, rest = link[parent[c]], length - 1
                while depth[u] < rest:
                    u = child[u * wide + words[i + 1 + depth[u]]]
                if depth[u] == rest:
                    c = child.get(u * wide + words[i], -1)
                    if c < 0:
                        break
                elif words[suffixes[lo[u]] + rest] == words[i]:
                    c = u
                else:
                    break
        nodes, lengths = zip(*seen, strict=True) if seen else ((), ())
        return np.array(nodes, np.int64), np.array(lengths, np.int64) // 2


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period."""
    if len(x) < 2:
        return []
    x = np.append(np.unique(x, return_inverse=True)[1].astype(np.int64) + 1, 0)  # the end is a value of its own
    n, ranks, back = len(x), prefix_ranks(x), prefix_ranks(x[::-1])
    suffixes = np.empty(n, np.int64)
    suffixes[ranks[-1][:n]] = np.arange(n)
    start, half = covering_squares(n, ranks, back, earlier_factors(ranks, suffixes))
    good = primitive(ranks, start, half)
    if not good.any():
        return []
    tree = SuffixTree(x, ranks, suffixes)
    nodes, halves = tree.vocabulary(start[good], half[good], x)
    of, k = _expand(tree.hi[nodes] - tree.lo[nodes] + 1)
    at, period = suffixes[tree.lo[nodes][of] + k], halves[of]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(period) != 0))))
    last = np.append(first[1:], len(at)) - 1
    return sorted(zip(at[first].tolist(), (at[last] - at[first] + 2 * period[first]).tolist(), period[first].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def stretches(h: np.ndarray, text: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words of which each lies in a sequence of n words that its text repeats."""
    g = windows(h, n)
    at = np.flatnonzero(text[: len(g)] == text[n - 1 :])
    key = mixed(g[at] ^ mixed(text[at].astype(np.uint64) + MIX))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(at) else at
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    covered = np.cumsum(edge)[:-1] > 0
    new = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
    first = np.flatnonzero(covered & (new | ~np.concatenate(([False], covered[:-1]))))
    last = np.flatnonzero(covered & np.concatenate((new[1:] | ~covered[1:], [True]))) if len(text) else first
    return list(zip(first.tolist(), (last + 1).tolist(), strict=True))


def runs_in_texts(h: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words in words of many texts, in order; text is that of each word."""
    found: list[tuple[int, int, int]] = []
    group: list[tuple[int, int]] = []

    def settle() -> None:
        if not group:
            return
        where = np.concatenate([np.append(np.arange(a, b), -1 - k) for k, (a, b) in enumerate(group)])
        ids = np.unique(h[where[where >= 0]], return_inverse=True)[1]
        x = where.copy()
        x[where >= 0] = ids
        found.extend((int(where[s]), n, q) for s, n, q in runs_of(x) if n >= max(least, 2 * q))
        group.clear()

    held = 0
    for a, b in stretches(h, text, max(1, least // 2)):
        if b - a < least:
            continue
        group.append((a, b))
        held += b - a
        if held >= TREE:
            settle()
            held = 0
    settle()
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, least: int = LEAST, reorder: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed binary) of each row, runs by start and period.

    collapsed is the text's words, joined by one space, without those that a run holds after its first period.
    reorder(doc_id, n) may give the words to put in the place of the text's n words, by number; None leaves them.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(whole: pa.RecordBatch) -> dict:
        out: list[list] = [[], [], []]
        for batch in slices(whole, 4 << 20):
            h, text, start, end, data = word_hashes(utf8(batch.column(1)))
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            order = np.arange(len(h))
            for k, i in enumerate(batch.column(0).to_pylist()):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if reorder is not None and (new := reorder(i, b - a)) is not None:
                    order[a:b] = a + new
            runs = runs_in_texts(h[order], text, least)
            gone = np.zeros(len(h) + 1, np.int64)
            for s, n, q in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = np.cumsum(gone)[:-1] == 0
            of: list[list] = [[] for _ in range(batch.num_rows)]
            for s, n, q in runs:
                of[int(text[s])].append({"start": s - int(bounds[text[s]]), "length": n, "period": q})
            for k in range(batch.num_rows):
                own = order[bounds[k] : bounds[k + 1]][kept[bounds[k] : bounds[k + 1]]]
                out[0].append(int(bounds[k + 1] - bounds[k]))
                out[1].append(of[k])
                out[2].append(b" ".join([data[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]))
        return {"doc_id": whole.column(0), "n_words": pa.array(out[0], pa.int64()), "runs": pa.array(out[1], kind), "collapsed": pa.array(out[2], pa.binary())}

    return map_rows(texts(docs, id_col, text_col), one, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def longest_run(runs: str = "runs"):
    """The run of the greatest length (ties: the smallest start, then period) as struct<length, start, period> with the last two negative; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
