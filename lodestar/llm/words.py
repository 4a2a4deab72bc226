"""Words of many texts at once as 64-bit hashes, and rolling hashes over them; all work is done by numpy on whole batches."""

from __future__ import annotations

import numpy as np

#: Odd multipliers (fixed values; any odd 64-bit numbers do).
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

#: Byte table: ASCII white space becomes a space, all else stays.
BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which all bits depend on all."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[bytes], table: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash of each word, the text it stands in, its start, its end, the translated bytes). Words are runs of bytes that `table` doesn't make a space."""
    data = b" ".join(t.translate(table) for t in texts) + b" " * 8
    b = np.frombuffer(data, np.uint8)
    full = np.concatenate(([False], b != 32, [False]))
    edges = np.flatnonzero(full[1:] != full[:-1])
    start, end = edges[::2], edges[1::2]
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    length = end - start
    h = np.full(len(start), MIX, np.uint64) + length.astype(np.uint64)
    todo, k = np.arange(len(start)), 0
    while len(todo):
        h[todo] = mixed(h[todo] * STEP ^ (eight[start[todo] + k] & _KEEP[np.minimum(length[todo] - k, 8)]))
        k += 8
        todo = todo[length[todo] > k]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, start, side="right"), start, end, data


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes (Karp-Rabin: a polynomial in STEP, then mixed), in n steps; empty if there are fewer. For short runs."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * STEP + h[k : len(h) - n + 1 + k]
    return mixed(total)


class Rolling:
    """Hashes of runs of any length over one array of hashes, running Karp-Rabin: a run's hash is the difference of two sums.

    Sums of h[i] * STEP^i modulo 2^64 are made once; STEP is odd, so it has an inverse, which takes the run's place out again.
    """

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(STEP, n), dtype=np.uint64)))
        self.back = _powers(inverse, n)

    def windows(self, n: int) -> np.ndarray:
        """The hash of each run of n; empty if there are fewer."""
        if not 0 < n < len(self.sums):
            return np.zeros(0, np.uint64)
        return mixed((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64."""
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base))), dtype=np.uint64)[:n]
