import random
import re

import numpy as np
import pytest

from lodestar.llm import common
from lodestar.llm import substring_dedup as sd


def brute(rows, size=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - size + 1):
                x = tuple(w[k : k + size])
                least[x] = min(least.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if least[tuple(w[k : k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])


def run(docs):
    return sorted((tuple(r) for r in sd.without_repeats(docs, sd.repeated_passages(docs)).collect()), key=key)


def test_against_brute_force(docs, rows):
    want = sorted(brute(rows), key=key)
    assert sum(r[2] for r in want) > 200
    assert run(docs) == want


def near_copies():
    r = random.Random(9)
    base = [f"w{r.randint(0, 40)}" for _ in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(4):
            w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        rows.append((i, " ".join(w[r.randint(0, 20) :])))
    return rows


@pytest.mark.parametrize("change", [{"MAX_BITS": 0}, {"ROUTE": 2}, {"ROUTE": 0, "PART": 5}, {"ROUTE": 9, "PART": 50}, {"SENT": 3, "PART": 20, "LANES": 7, "BLIND": 0}])
def test_every_path_gives_the_same(spark, monkeypatch, change):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for name, value in change.items():
        monkeypatch.setattr(common if name == "MAX_BITS" else sd, name, value)
    assert run(docs) == sorted(brute(rows), key=key)


def holds(sequence, words):
    return any(list(sequence[k : k + len(words)]) == list(words) for k in range(len(sequence) - len(words) + 1))


def test_matching_statistics_against_scanning(monkeypatch):
    monkeypatch.setattr(sd, "BLIND", 0)
    r = np.random.default_rng(4)
    seqs = [r.integers(1, 4, r.integers(1, 40)) for _ in range(60)]
    numbers = r.integers(0, 1000, 60)
    index = sd.FMIndex(seqs, numbers)
    text = np.concatenate(seqs)
    cut = np.cumsum([0, *map(len, seqs)])
    end = np.arange(len(text))
    owner = np.searchsorted(cut, end, side="right") - 1
    below = numbers[owner]
    found = index.longest(text, end, cut[owner], below)
    for e, o, n in zip(end.tolist(), owner.tolist(), found.tolist(), strict=True):
        earlier = [s for s, k in zip(seqs, numbers, strict=True) if k < numbers[o]]
        want = max((n for n in range(1, e - cut[o] + 2) if any(holds(s, text[e - n + 1 : e + 1]) for s in earlier)), default=0)
        assert n == want
    assert found.max() > 5


def test_matches_of_segments(spark):
    """Match lengths beyond the threshold, not windows: (start, length) of the longest runs that earlier segments hold."""
    w = [f"w{k}" for k in range(30)]
    rows = [(1, 10, 5, 5, " ".join(w[:21])), (1, 11, 7, 9, " ".join(["x"] + w[2:19] + ["y"])), (1, 12, 6, 6, " ".join(w[8:21] + ["z"])), (2, 13, 8, 8, " ".join(w[5:18])), (1, 14, 9, 9, " ".join(w[3:17] + ["q"] + w[:6]))]
    table = spark.createDataFrame([(a, b, c, d, len(t.split()), t) for a, b, c, d, t in rows], "route long, key long, least long, most long, length int, words string")
    got = {r["key"]: [tuple(m) for m in r["matches"]] for r in sd.matching_statistics(table.coalesce(1)).collect()}
    assert got[11] == [(1, 17)] and got[12] == [(0, 13)] and got[14] == [(0, 14)] and 10 not in got


def test_longer_passages(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(10**6)}"
    shared, rows = [word() for _ in range(60)], []
    for i in range(30):
        k = r.randint(15, 60)
        rows.append((i, " ".join([word() for _ in range(9)] + shared[60 - k :] + [word() for _ in range(9)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in sd.without_repeats(docs, sd.repeated_passages(docs, 40, 10)).collect()), key=key)
    assert got == sorted(brute(rows, 40), key=key) and sum(x[2] for x in got) > 200
    with pytest.raises(ValueError):
        sd.repeated_passages(docs, 5, 5)


def test_empty_table(empty):
    assert run(empty) == []


@pytest.mark.parametrize("change", [{}, {"ROUTE": 2}, {"ROUTE": 0, "PART": 5, "PART_BYTES": 40}])
def test_repeats_are_reported_whole(spark, monkeypatch, change):
    """The stretches of windows that stand earlier, each as one match, however long; plainly from all windows."""
    for name, value in change.items():
        monkeypatch.setattr(sd, name, value)
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 10**6)}"
    long = [word() for _ in range(400)]
    rows = [(0, " ".join(long)), (1, " ".join([word(), *long[50:390], word()])), (2, " ".join([*long[:100], word(), *long[100:140], *long[7:60]])), (3, " ".join(long[:12])), *[(i + 10, t) for i, t in near_copies()]]
    least = {}
    split = {i: t.split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, i), i)
    want = {}
    for i, w in split.items():
        starts = [k for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i]
        runs = []
        for k in starts:
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        if runs:
            want[i] = [(a, b - a + 13) for a, b in runs]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: [tuple(m) for m in x["matches"]] for x in sd.repeated_passages(docs).collect()}
    assert got == want and want[1] == [(1, 340)] and want[2][0] == (0, 100)
