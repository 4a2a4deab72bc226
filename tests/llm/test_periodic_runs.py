import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import periodic_runs as pr


def brute(x, least=2):
    """All runs by trying each period at each place."""
    found, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q and not any(found.get((i, j + q - i, p)) for p in range(1, q)):
                found[i, j + q - i, q] = True
            i = j
    # a stretch with a smaller period isn't a run of a larger one
    out = [(s, n_, q) for s, n_, q in found if n_ >= max(least, 2 * q) and smallest(x[s : s + n_]) == q]
    return sorted(out, key=lambda r: (r[0], r[2]))


def smallest(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=40), st.lists(st.integers(0, 2), max_size=60), st.integers(1, 60).map(lambda n: [0] * n), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 8), st.lists(st.integers(0, 3), max_size=6)).map(lambda t: t[2] + t[0] * t[1] + t[2])))
def test_all_runs_of_a_sequence(x):
    assert pr.runs_of(np.array(x, np.int64)) == brute(x)


def test_fibonacci_and_long_sequences():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    assert pr.runs_of(np.array(b)) == brute(b)
    x = np.tile(np.arange(700), 43)
    assert pr.runs_of(x) == [(0, len(x), 700)]
    assert pr.runs_of(np.zeros(40_000, np.int64)) == [(0, 40_000, 1)]
    assert pr.runs_of(np.arange(1000)) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=6))
def test_texts_keep_apart(lists):
    """Runs of many texts at once are those of each text, whatever the least length."""
    h = np.array([w for x in lists for w in x], np.uint64)
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    for least in (4, 12):
        at, want = 0, []
        for x in lists:
            want += [(at + s, n, q) for s, n, q in brute(x, least)]
            at += len(x)
        assert pr.runs_in_texts(h, text, least) == sorted(want, key=lambda r: (r[0], r[2]))


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute(words, 12) if len(words) < 500 else None
    if runs is None:
        return len(words), None, None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents(spark, docs, rows):
    r = random.Random(5)
    more = []
    for k in range(40):
        words = [r.choice(["a", "b", "é", "Long-word", "x"]) for _ in range(r.randint(0, 12))]
        more.append((10_000 + k, " ".join(r.choice(["q", "w"]) for _ in range(r.randint(0, 9))) + "\n" + r.choice([" ", "\t"]).join(words * r.randint(1, 6)) + " end"))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(((x["doc_id"], x["n_words"], [tuple(q) for q in x["runs"]], bytes(x["collapsed"]).decode()) for x in pr.find_runs(both).collect()), key=repr)
    want = []
    for i, t in [*rows, *more]:
        n, runs, kept = plain(t)
        want.append((i, n, runs, kept))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and (b[2] is None or a[2:] == b[2:])
    assert sum(bool(x[2]) for x in got) > 10


def test_reordered_words(spark):
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100))), (2, "a b"), (3, None)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in pr.find_runs(one, reorder=lambda i, n: np.where(np.arange(n) < 10, np.arange(n), 10 + (np.arange(n) - 10) % 30) if i == 1 else None).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(10, 90, 30)] and bytes(got[1]["collapsed"]).decode() == " ".join(f"w{i}" for i in range(40))
    assert bytes(got[2]["collapsed"]) == b"a b" and got[3]["n_words"] == 0 and got[3]["runs"] == []


def test_empty_table(empty):
    assert pr.find_runs(empty).collect() == []
