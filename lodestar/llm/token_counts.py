"""Token counts by a byte-level BPE tokenizer compiled into a deterministic transducer.

The tokenizer's vocabulary and merges become a finite-state machine over the bytes of a piece (what the tokenizer's pattern
splits a text into). Its states hold, for each suffix of what was read that some token begins with, the last token before
that suffix and how many tokens more the whole has; a transition reads a byte and is annotated with the change of the token
count. States and transitions are made as texts need them. They rest on two properties of BPE: dropping the last token of an
encoding leaves the encoding of the rest, and a token may follow another exactly if no merge at their border comes before
both are complete; of all tokens that end at a place exactly one fits.

Texts are read in chunks, all chunks of a batch in lockstep. A chunk's state map goes from the state before it to the state
after it and the tokens between. Where a piece begins within the chunk, the map is a constant but for the bytes before that
border (the head). A chunk that lies within a piece gets its map for the states that can come in: these are found by reading
the chunk before it from each of its first places on, as a token of the encoding ends at one of them; equal states are one
from then on, which soon leaves one or, in repetitive text, a few. Maps of neighbouring chunks are composed in log steps, and
the compositions applied to the state before the piece give all chunks' states (a parallel prefix scan). A state that a map
turns out to lack is added to it, and the scan done again. Heads are read last, all at once.

Null and empty texts have no tokens. Special tokens' strings in a text count as one token each, and the text between them is
counted by itself, as the library does. A null id stays null; repeated rows, and so texts that tie, are counted one by one.
Very long texts are counted whole. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, slices, texts, utf8

#: Bytes of a chunk; states of the machine in a worker, beyond which it starts anew between batches.
CHUNK, STATES = 1024, 200_000

#: The state of a chunk that hasn't met a border.
WAIT = 1


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The machine over the bytes of a piece. State 0: nothing read yet; state WAIT reads all and counts nothing."""

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        self.rank = {a + b: k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.halves = {t: merges[k] for t, k in self.rank.items()}
        self.tokens = {bytes([b]) for b in range(256)} | set(self.rank)
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t))}  # what a longer token begins with
        self.order = {pair: k for k, pair in reversed(list(enumerate(merges)))}
        self.spines: dict[bytes, tuple[list, list]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = [(), ()]  # entries (suffix that a token begins with, last token before it, tokens of the whole less those before the suffix)
        self.lasts = [b"", b""]
        self.columns = np.full(256, -1, np.int64)
        self.width = 0
        self.table = np.zeros((0, 0), np.int32)  # the next state above 8 bits of change + 128; -1: not made yet

    def see(self, data: np.ndarray) -> None:
        """Gives a column to each byte of data, and rows to all states."""
        new = np.setdiff1d(np.unique(data), np.flatnonzero(self.columns >= 0))
        self.columns[new] = self.columns.max() + 1 + np.arange(len(new))
        width = -(-(int(self.columns.max()) + 1) // 32) * 32
        rows = max(len(self.table), -(-(len(self.states) + 1) // 16384) * 16384)
        if (rows, width) != self.table.shape:
            table = np.full((rows, width), -1, np.int32)
            table[: len(self.table), : self.width] = self.table
            table[WAIT] = WAIT << 8 | 128
            self.table, self.width = table, width

    def read(self, state: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Packed transitions of states by bytes; what is missing is made."""
        v = self.table.ravel().take(state * self.width + self.columns[data])
        if v.min(initial=0) < 0:
            for pair in np.unique((state << 8 | data)[v < 0]).tolist():
                packed = self.step(pair >> 8, pair & 255)
                if len(self.states) > len(self.table):
                    self.see(data[:0])
                self.table[pair >> 8, self.columns[pair & 255]] = packed
            v = self.table.ravel().take(state * self.width + self.columns[data])
        return v

    def spine(self, t: bytes) -> tuple[list, list]:
        """What stands at the token's right and left border while it is merged: (part, rank of the merge that ends it)."""
        if t not in self.spines:
            found: tuple[list, list] = ([], [])
            for side in (1, 0):
                part, until = t, len(self.order) + 1
                while True:
                    found[1 - side].append((part, until))
                    if part not in self.halves:
                        break
                    until, part = self.rank[part], self.halves[part][side]
            self.spines[t] = found
        return self.spines[t]

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b stand as they are in the encoding of a + b."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            order, ok = self.order, True
            for x, x_until in self.spine(a)[0]:
                for y, y_until in self.spine(b)[1]:
                    k = order.get((x, y))
                    if k is not None and k < x_until and k <= y_until:
                        ok = False
                        break
                if not ok:
                    break
            self.fits[key] = ok
        return self.fits[key]

    def step(self, state: int, byte: int) -> int:
        """The packed transition of a state by a byte."""
        b = bytes([byte])
        entries = (*self.states[state], (b"", self.lasts[state], 0))
        for suffix, before, extra in entries:
            last = suffix + b
            if last in self.tokens and (not before or self.follows(before, last)):
                more = 1 - extra  # the tokens before the suffix, and this one
                break
        else:
            raise ValueError("no token fits: not the vocabulary of a byte-level BPE")
        new = tuple((suffix + b, before, extra + more) for suffix, before, extra in entries if suffix + b in self.starts)
        at = self.ids.get((new, last))
        if at is None:
            at = self.ids[new, last] = len(self.states)
            self.states.append(new)
            self.lasts.append(last)
        return at << 8 | more + 128


def char_classes() -> np.ndarray:
    """A class for each code point: 0 letter, 1 number, 2 other, 3 white space."""
    category = {"L": 0, "N": 1}
    classes = np.array([category.get(unicodedata.category(chr(c))[0], 2) for c in range(0x110000)], np.uint8)
    classes[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return classes


def piece_starts(c: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin among code points c, of which `first` begin texts.

    The pattern is the public one of byte-level BPE: contractions, then an optional space with a run of letters, of numbers or
    of others, then white space, of which a run leaves its last character to what follows.
    """
    k, n = classes[c], len(c)
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | first[1:]
    white = k == 3
    after_space = np.zeros(n, bool)
    after_space[1:] = (c[:-1] == 32) & ~first[1:]
    next_new = np.append(first[1:], True)  # the next code point belongs to another text
    next_black = np.append(~white[1:], False) & ~next_new
    start = np.where(white, new | next_black, new & ~after_space)
    at = np.flatnonzero(start & (c == 39) & ~next_new)
    if len(at):
        one = c[at + 1]
        far = at + 2 < n
        two = np.where(far, c[np.minimum(at + 2, n - 1)], 0)
        two[far & first[np.minimum(at + 2, n - 1)]] = 0
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[at[short | long] + 1] = False
        rest = np.concatenate([at[short] + 2, at[long] + 3])
        start[rest[rest < n]] = True
    return start


class Counter:
    """Counts the tokens of batches of texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in kept["model"]["merges"]]
        self.machine = Transducer([tuple(bytes(letters[c] for c in half) for half in m) for m in merges])
        self.longest = max(map(len, self.machine.tokens))
        self.special = sorted((t["content"] for t in kept["added_tokens"]), key=len, reverse=True)
        self.classes = char_classes()

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            rest = [text]
            for s in self.special:
                if s in text:
                    split = [x.split(s) for x in rest]
                    total[i] += sum(len(x) - 1 for x in split)
                    rest = [y for x in split for y in x]
            for x in rest:
                if x:
                    parts.append(x)
                    owner.append(i)
        if parts:
            if len(self.machine.states) > STATES:
                self.machine.clear()
            np.add.at(total, owner, self._count(parts))
        return total

    def _count(self, texts: list[str]) -> np.ndarray:
        c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts])
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(len(c), bool)
        first[begins] = True
        width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        place = np.cumsum(width) - width  # of a code point's first byte
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        border = np.zeros(len(data), bool)
        border[place[piece_starts(c, first, self.classes)]] = True
        change = self._changes(data, border)
        return np.add.reduceat(change, place[begins])

    def _changes(self, data: np.ndarray, border: np.ndarray) -> np.ndarray:
        """The change of the token count with each byte of a stream of pieces that begin at the borders."""
        machine, n = self.machine, len(data)
        machine.see(data)
        chunks = -(-n // CHUNK)
        grid = np.concatenate([data, np.full(chunks * CHUNK - n, data[-1])]).reshape(chunks, CHUNK).T.astype(np.int64, order="C")
        edge = np.concatenate([border, np.ones(chunks * CHUNK - n, bool)]).reshape(chunks, CHUNK).T.copy()
        change = np.zeros((CHUNK, chunks), np.int64)
        state = np.full(chunks, WAIT, np.int64)
        for p in range(CHUNK):  # all chunks in lockstep, each from its first border on
            state[edge[p]] = 0
            v = machine.read(state, grid[p]).astype(np.int64)
            change[p] = (v & 255) - 128
            state = v >> 8
        within = ~edge.any(axis=0)
        if within.any():
            self._scan(grid, within, state, change)
        head = np.where(within, 0, edge.argmax(axis=0))
        lanes = np.flatnonzero(head)
        now = state[lanes - 1]
        for p in range(int(head.max(initial=0))):
            live = head[lanes] > p
            lanes, now = lanes[live], now[live]
            v = machine.read(now, grid[p, lanes]).astype(np.int64)
            change[p, lanes] = (v & 255) - 128
            now = v >> 8
        return change.T.ravel()[:n]

    def _scan(self, grid: np.ndarray, within: np.ndarray, state: np.ndarray, change: np.ndarray) -> None:
        """Sets the states after, and the changes by, the chunks that lie within a piece. The stream's first chunk is none of them."""
        chunk = np.flatnonzero(within)
        first = chunk[~within[chunk - 1]]
        depth = np.zeros(len(within), np.int64)  # place of a chunk in its run
        depth[chunk] = chunk - first[np.searchsorted(first, chunk, side="right") - 1]
        later = self._entering(grid, chunk[depth[chunk] > 0])
        nodes = self._mapped(grid, np.concatenate([first, later[0]]), np.concatenate([state[first - 1], later[1]]))
        while True:
            key, into, out, total = nodes  # of each chunk's map: (chunk, state before) -> state after, change
            none = len(key)
            jump = np.append(self._node(key, into, key + 1, out), none)  # the next chunk's node
            at = np.full(len(within), none)
            at[first] = self._node(key, into, first, state[first - 1])
            span = 1
            while span <= depth.max():
                to = chunk[(depth[chunk] >= span) & (depth[chunk] < 2 * span)]
                at[to] = jump[at[to - span]]
                jump, span = jump[jump], 2 * span
            lost = chunk[(at[chunk] == none) & (depth[chunk] > 0)]
            lost = lost[at[lost - 1] < none]
            if not len(lost):
                break
            more = self._mapped(grid, lost, out[at[lost - 1]])
            both = [np.concatenate(x) for x in zip(nodes, more, strict=True)]
            order = np.lexsort((both[1], both[0]))
            nodes = tuple(x[order] for x in both)
        state[chunk] = out[at[chunk]]
        change[0, chunk] = total[at[chunk]]

    @staticmethod
    def _node(key: np.ndarray, into: np.ndarray, chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The place of each (chunk, state) among the sorted (key, into); their number where it isn't there."""
        of, wanted = key << 32 | into, chunk << 32 | state
        k = np.searchsorted(of, wanted)
        return np.where(of[np.minimum(k, len(of) - 1)] == wanted, k, len(of))

    def _entering(self, grid: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, state): states in which chunks may begin, by reading the chunk before each from all places where a token can begin."""
        lane, state = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in range(CHUNK if len(chunk) else 0):
            if p < self.longest:
                lane, state = np.concatenate([lane, chunk]), np.concatenate([state, np.zeros(len(chunk), np.int64)])
            state = self.machine.read(state, grid[p, lane - 1]).astype(np.int64) >> 8
            if p % 16 == 15 or p == CHUNK - 1:
                once = np.unique(lane << 32 | state)
                lane, state = once >> 32, once & 0xFFFFFFFF
        return lane, state

    def _mapped(self, grid: np.ndarray, chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """(chunk, state before, state after, change), sorted: chunks read from states."""
        once = np.unique(chunk << 32 | state)
        chunk, state = once >> 32, once & 0xFFFFFFFF
        now, total = state, np.zeros(len(chunk), np.int64)
        for p in range(CHUNK):
            v = self.machine.read(now, grid[p, chunk]).astype(np.int64)
            total += (v & 255) - 128
            now = v >> 8
        return chunk, state, now, total


_workers: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, for the byte-level BPE tokenizer whose file lies at path on every machine."""

    def one(batch: pa.RecordBatch) -> dict:
        if path not in _workers:
            _workers[path] = Counter(path)
        sizes, counts = [], []
        for part in slices(batch, 2 << 20):
            data = utf8(part.column(1))
            sizes += map(len, data)
            counts.append(_workers[path].count([x.decode() for x in data]))
        return {"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(np.concatenate(counts), pa.int64())}

    return map_rows(texts(docs, id_col, text_col), one, "doc_id long, n_bytes long, n_tokens long")
