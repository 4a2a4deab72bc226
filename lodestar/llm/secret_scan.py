"""Secret scans: patterns of known kinds, and a battery of randomness tests under control of false discoveries.

Base kinds are regular expressions over the bytes of a text. Further tokens are runs of at least LEAST letters of the widest alphabet here
(with up to two = after them). A token's encoding is the smallest alphabet that holds all its letters; its letters become the
numbers of that alphabet. Three statistics are taken in the one pass over the texts: chi-squared of the letters against a
uniform alphabet, runs of letters in the lower and the upper half of the alphabet, and serial correlation of neighbours.

Each is tested twice. Against a uniform source: a token that any test rejects at SCREEN is not random (its p is 1). Against
ordinary writing: letters and pairs of letters of all shorter words of the corpus, restricted to the encoding; p is how likely
these statistics are there: the normal law of the number of equal pairs with its exact moments, a Chernoff bound for the
changes of side, the normal law for the correlation. The least of the three, times three, is the token's p. Tokens of one
encoding and one power of two of length are a family; in each the Benjamini-Hochberg procedure holds the share of false
discoveries at RATE. So short tokens, on which the tests have no power, don't spend what long ones gain. p-values are rounded up to
quarter powers of two, so the procedure needs only counts of fixed number, which Spark makes over the whole corpus.

Null and empty texts have no spans. Repeated rows are scanned one by one, and each counts. A null id stays null, an empty table
gives an empty result, and columns besides the id and the text are not looked at. Spans that tie in start are in the order of their kinds. Very long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, texts, utf8, written

#: Kinds of the base, in order, their patterns and the least lengths (of group 2, of the whole, of the whole).
BASE = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 8),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 16),
    "hex": (re.compile(rb"[0-9a-f]+"), 32),
}
KINDS = [*BASE, "random"]

#: One of these stands in lower case in every text with an assignment.
ASSIGNED = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Alphabets by size; the last holds all letters of tokens.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + _LOWER[:6], "HEX": _DIGITS + _UPPER[:6], "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + _DIGITS[2:8], "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
LETTERS = ALPHABETS["mixed"]
WIDE = len(LETTERS)

#: Letters of a token, and of a word that counts as ordinary writing, at least.
LEAST, WORD = 20, 4

#: Bytes in which letters are counted at a time.
STEP = 1 << 20

#: Level of the screens against a uniform source; share of false discoveries.
SCREEN, RATE = 0.001, 0.01

#: p is rounded up to 2^(-bin / 4), and isn't told apart below the last.
BINS = 400

_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(WIDE)
#: Per alphabet: the number of each letter of LETTERS in it, or -1.
_IN = {name: np.array([letters.find(c) for c in LETTERS]) for name, letters in ALPHABETS.items()}
_MASK = {name: sum(1 << int(k) for k in np.flatnonzero(x >= 0)) for name, x in _IN.items()}


@dataclass(frozen=True)
class Source:
    """A source of letters: the sums of their squared and cubed shares, how often neighbours change sides, their correlation."""

    squares: float
    cubes: float
    change: float
    correlation: float


def encoding_of(codes: np.ndarray) -> str:
    """The first alphabet that holds all these letters of LETTERS."""
    own = sum(1 << int(k) for k in np.unique(codes))
    return next(name for name, mask in _MASK.items() if own & ~mask == 0)


def statistics(codes: np.ndarray, encoding: str) -> tuple[int, int, float]:
    """(pairs of equal letters, changes of side, lag-one correlation) of a token."""
    x = _IN[encoding][codes]
    counts = np.bincount(x)
    upper = x >= len(ALPHABETS[encoding]) // 2
    y = x - x.mean()
    spread = float((y * y).sum())
    return int((counts * (counts - 1)).sum()) // 2, int((upper[1:] != upper[:-1]).sum()), float((y[1:] * y[:-1]).sum()) / spread if spread else 1.0


def source_of(letters: np.ndarray, pairs: np.ndarray, encoding: str) -> Source:
    """The source of which letters (WIDE counts) and pairs (WIDE x WIDE) were counted, restricted to an encoding; one more of each counts, so none is 0."""
    own = np.flatnonzero(_IN[encoding] >= 0)
    share = letters[own] + 1.0
    share /= share.sum()
    both = pairs[np.ix_(own, own)] + 1.0
    both /= both.sum()
    x = _IN[encoding][own].astype(float)
    upper = x >= len(own) // 2
    a, b = both.sum(1), both.sum(0)
    mean = (a * x).sum(), (b * x).sum()
    spread = math.sqrt((a * (x - mean[0]) ** 2).sum() * (b * (x - mean[1]) ** 2).sum())
    together = float(((x - mean[0])[:, None] * (x - mean[1])[None, :] * both).sum())
    return Source(float((share**2).sum()), float((share**3).sum()), float(both[upper[:, None] != upper[None, :]].sum()), together / spread)


def _law_of_pairs(n: int, s: Source) -> tuple[float, float]:
    """Mean and standard deviation of the number of equal pairs among n independent letters."""
    two = n * (n - 1) / 2
    return two * s.squares, math.sqrt(max(two * (s.squares - s.squares**2) + n * (n - 1) * (n - 2) * (s.cubes - s.squares**2), 1e-9))


def looks_uniform(n: int, k: int, pairs: int, changes: int, serial: float) -> bool:
    """Whether no test rejects a uniform source of k letters at SCREEN, two-sided."""
    bound = 3.2905  # of the standard normal law at SCREEN
    mean, deviation = _law_of_pairs(n, Source(1 / k, 1 / k**2, 0, 0))
    low = (k // 2) / k
    theta, third = 2 * low * (1 - low), low * (1 - low)
    spread = math.sqrt((n - 1) * theta * (1 - theta) + 2 * (n - 2) * (third - theta**2))
    return abs(pairs - mean) <= bound * deviation + 1 and abs(changes - (n - 1) * theta) <= bound * spread + 1 and abs(serial + 1 / n) * math.sqrt(n) <= bound


def natural_p(n: int, pairs: int, changes: int, serial: float, s: Source) -> float:
    """How likely ordinary writing gives so few equal pairs, so many changes of side, or a correlation so far off; Bonferroni's bound over the three."""
    mean, deviation = _law_of_pairs(n, s)
    uniform = 0.5 * math.erfc((mean - pairs) / deviation / math.sqrt(2))
    r = changes / (n - 1)
    runs = 1.0
    if r > s.change:
        rest = (1 - r) * math.log((1 - r) / (1 - s.change)) if r < 1 else 0.0
        runs = math.exp(-(n - 1) * (r * math.log(r / s.change) + rest))
    serial_p = math.erfc(abs(serial - s.correlation) * math.sqrt(n - 1) / math.sqrt(2))
    return min(1.0, 3 * min(uniform, runs, serial_p))


def bin_of(p: float) -> int:
    return BINS if p < 2.0 ** (-BINS / 4) else int(-4 * math.log2(p) + 1e-9)


def least_bin(counts: dict[int, int], rate: float = RATE) -> int | None:
    """Benjamini and Hochberg over binned p-values: the least bin whose tokens are discoveries; None if there is none."""
    total, so_far, found = sum(counts.values()), 0, None
    for b in sorted(counts, reverse=True):
        so_far += counts[b]
        if 2.0 ** (-b / 4) * total <= rate * so_far:
            found = b
    return found


SPAN = "array<struct<kind:string,start:long,end:long>>"
TOKEN = "array<struct<start:long,end:long,encoding:string,n:long,pairs:long,changes:long,serial:double>>"


def base_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes; runs: those of token letters, of 16 or more, among which access keys and hex numbers lie."""
    found = []
    pattern, least = BASE["assign"]
    if (b"=" in data or b":" in data) and any(w in (lower := data.lower()) for w in ASSIGNED):
        found += [("assign", *m.span()) for m in pattern.finditer(data) if len(m[2]) >= least]
    for kind in ("access", "hex"):
        pattern, least = BASE[kind]
        found += [(kind, *m.span()) for a, b in runs if b - a >= least for m in pattern.finditer(data, a, b) if len(m[0]) >= least]
    return found


def _scan(batch: pa.RecordBatch) -> tuple[list, list, np.ndarray]:
    """(base spans, tokens) of each row in code points, and the counts of letters and pairs of ordinary words in all."""
    rows = utf8(batch.column(1))
    data = b" ".join(rows) + b" "
    b = np.frombuffer(data, np.uint8)
    code = _CODE[b]
    inside = np.concatenate(([False], code < WIDE, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    length = end - first
    ordinary = (length >= WORD) & (length < LEAST)
    mark = np.zeros(len(b) + 1, np.int8)
    mark[first[ordinary]] += 1
    mark[end[ordinary]] -= 1
    word = np.cumsum(mark, dtype=np.int8).astype(bool)
    letters, pairs = np.zeros(WIDE, np.int64), np.zeros(WIDE * WIDE, np.int64)
    for s in range(0, len(b), STEP):  # so that a very long text doesn't take eight bytes for each of its own
        own, after, c = word[s : s + STEP][: len(b) - s], word[s + 1 : s + 1 + STEP], code[s : s + STEP + 1]
        letters += np.bincount(c[: len(own)][own], minlength=WIDE)
        both = np.flatnonzero(own & after[: len(own)])
        pairs += np.bincount(c[both].astype(np.int64) * WIDE + c[both + 1], minlength=WIDE * WIDE)
    starts = np.cumsum([0] + [len(r) + 1 for r in rows])
    long = length >= 16
    first, end = first[long], end[long]
    of = np.searchsorted(starts, first, side="right") - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in rows]
    for k, s, e in zip(of.tolist(), first.tolist(), end.tolist(), strict=True):
        runs[k].append((s - int(starts[k]), e - int(starts[k])))
    spans, tokens = [], []
    for k, row in enumerate(rows):
        base = base_spans(row, runs[k])
        if not base and not runs[k]:
            spans.append([])
            tokens.append([])
            continue
        points = np.concatenate(([0], np.cumsum((np.frombuffer(row, np.uint8) & 0xC0) != 0x80)))
        spans.append([{"kind": kind, "start": int(points[s]), "end": int(points[e])} for kind, s, e in base])
        own = []
        for s, e in runs[k]:
            if e - s >= LEAST:
                codes = code[starts[k] + s : starts[k] + e]
                name = encoding_of(codes)
                equal, changes, serial = statistics(codes, name)
                padded = e + (len(row[e : e + 3]) - len(row[e : e + 3].lstrip(b"=")))
                if padded > e + 2:
                    padded = e
                own.append({"start": int(points[s]), "end": int(points[padded]), "encoding": name, "n": e - s, "pairs": equal, "changes": changes, "serial": serial})
        tokens.append(own)
    return spans, tokens, np.concatenate((letters, pairs))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, tokens, counts): a row for each text, and rows with nothing but the counts of the ordinary words of many texts."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int64()), ("pairs", pa.int64()), ("changes", pa.int64()), ("serial", pa.float64())]))

    def one(batch: pa.RecordBatch) -> dict:
        ids: list = []
        spans: list = []
        tokens: list = []
        total = np.zeros(WIDE * (WIDE + 1), np.int64)
        for part in slices(batch, 2 << 20):
            found = _scan(part)
            ids += part.column(0).to_pylist()
            spans += found[0]
            tokens += found[1]
            total += found[2]
        counts = [None] * len(ids) + [total.tolist()]
        return {"doc_id": pa.array([*ids, None], pa.int64()), "base": pa.array([*spans, None], span), "tokens": pa.array([*tokens, None], token), "counts": pa.array(counts, pa.list_(pa.int64()))}

    return map_rows(texts(docs, id_col, text_col), one, f"doc_id long, base {SPAN}, tokens {TOKEN}, counts array<long>")


def natural_sources(found: DataFrame) -> dict[str, Source]:
    """Per encoding, the source that the corpus' ordinary words are like; WIDE * (WIDE + 1) sums come to the driver."""
    total = np.zeros(WIDE * (WIDE + 1))
    counted = found.where("counts IS NOT NULL").select(F.posexplode("counts").alias("k", "n")).where("n > 0")
    for k, n in counted.groupBy("k").agg(F.sum("n")).collect():
        total[k] = n
    return {name: source_of(total[:WIDE], total[WIDE:].reshape(WIDE, WIDE), name) for name in ALPHABETS}


def tested(found: DataFrame, sources: dict[str, Source]) -> DataFrame:
    """(doc_id, base, tokens array<struct<start, end, family, bin>>): the tokens' p-values in bins, by family."""
    token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("bin", pa.int32())]))

    def one(batch: pa.RecordBatch) -> dict:
        out = []
        for tokens in batch.column(2).to_pylist():
            own = []
            for t in tokens:
                told = t["n"], t["pairs"], t["changes"], t["serial"]
                uniform = looks_uniform(t["n"], len(ALPHABETS[t["encoding"]]), *told[1:])
                p = natural_p(*told, sources[t["encoding"]]) if uniform else 1.0
                own.append({"start": t["start"], "end": t["end"], "family": f"{t['encoding']}:{t['n'].bit_length()}", "bin": bin_of(p)})
            out.append(own)
        return {"doc_id": batch.column(0), "base": batch.column(1), "tokens": pa.array(out, token)}

    rows = found.where("counts IS NULL").select("doc_id", "base", "tokens")
    return map_rows(rows, one, f"doc_id long, base {SPAN}, tokens array<struct<start:long,end:long,family:string,bin:int>>")


def scan_secrets(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found) of each row: spans array<struct<kind, start, end>> in code points, ends exclusive, by start and then kind.

    found holds the base spans and those of tokens that the tests discover, kind random; a token within a base span isn't told again.
    """
    scanned = written(candidates(docs, id_col, text_col))
    judged = written(tested(scanned, natural_sources(scanned)))
    counts: dict[str, dict[int, int]] = {}
    tokens = judged.select(F.explode("tokens").alias("t"))
    for family, b, n in tokens.groupBy("t.family", "t.bin").count().collect():  # alphabets x powers of two x bins at most
        counts.setdefault(family, {})[b] = n
    least = {family: b for family, c in counts.items() if (b := least_bin(c, rate)) is not None}
    bounds = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<string,int>")
    fresh = F.filter("tokens", lambda t: F.coalesce(t["bin"] >= bounds[t["family"]], F.lit(False)) & ~F.exists("base", lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])))
    more = F.transform(fresh, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return judged.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.concat("base", more)).alias("found"))


def in_order(spans: Column) -> Column:
    """Spans by start, then by kind in the order of KINDS."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def told(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
