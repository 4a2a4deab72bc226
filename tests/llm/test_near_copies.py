import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestar.llm import near_copies, simhash
from tests.llm.conftest import EXTRA, SCHEMA


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """The first of each group of near copies, for each text, by search."""
    sets, out = [shingles(t) for t in texts], {}
    for i in range(len(texts)):
        todo = [] if i in out else [i]
        out.setdefault(i, i)
        while todo:
            a = sets[todo.pop()]
            for k, b in enumerate(sets):
                if k not in out and (a == b or len(a & b) / len(a | b) >= 0.8):
                    out[k] = i
                    todo.append(k)
    return [out[i] for i in range(len(texts))]


def texts_with_copies():
    """Texts, their near copies at all similarities, chains, a large group of near copies, and texts that share most words."""
    r = random.Random(5)
    words = lambda n: [str(r.randrange(10**6)) for _ in range(n)]

    def changed(w, n):
        w = list(w)
        for k in r.sample(range(len(w)), n):
            w[k] = str(r.randrange(10**6))
        return w

    out = []
    for _ in range(40):
        w = words(r.randint(3, 150))
        out += [w, changed(w, 1), w + words(r.randint(1, 9)), w[r.randint(0, 3) :]]
    w = words(80)
    for _ in range(30):  # a chain
        out.append(w)
        w = changed(w, 1)
    w = words(100)
    out += [changed(w, r.randint(0, 2)) for _ in range(150)]
    out += [words(6) + w[:60] + words(6) for _ in range(30)]
    return [" ".join(x) for x in out] + ["", None, "a", "A", "a b c d", "a b c d e"]


@pytest.fixture(scope="module")
def table(spark):
    texts = texts_with_copies()
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["c"] * len(EXTRA)) for i, t in enumerate(texts)], SCHEMA).repartition(3), texts


@pytest.mark.parametrize("block", [400, 3])
def test_groups(spark, table, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    docs, texts = table
    by: dict = {}
    for r in near_copies.near_copies(docs).collect():
        by.setdefault(r["root"], []).append(r["doc_id"])
    got = {i: min(g) for g in by.values() for i in g}
    assert [got[i] for i in range(len(texts))] == groups(texts)


def test_stage_drops_near_copies(spark, table):
    docs, texts = table
    kept = sorted(r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, "").collect())
    assert kept == sorted(set(groups(texts)))


def test_stage_keeps_one_row_of_each_group(spark):
    """Ids that repeat with different texts."""
    r = random.Random(9)
    a, b = (" ".join(str(r.randrange(10**6)) for _ in range(40)) for _ in "ab")
    rows = [(3, a), (5, a), (5, b), (5, b + " x"), (7, a + " x"), (8, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["c"] * len(EXTRA)) for i, t in rows], SCHEMA)
    kept = sorted((x["doc_id"], (x["text"] or "")[:20]) for x in cp.near_duplicate_stage(spark, docs, "").collect())
    assert kept == [(3, a[:20]), (5, b[:20]), (8, "")]


def test_blocks_of_long_lists_hold_all_pairs(spark):
    lists = spark.createDataFrame([(1, n, 20, n) for n in range(23)] + [(2, 5, 20, 5), (2, 6, 20, 6)], "key long, node long, n long, root long")
    seen = {}
    near_copies.BLOCK, kept = 5, near_copies.BLOCK
    try:
        for r in near_copies._blocks(lists).collect():
            seen.setdefault((r["key"], r["i"], r["j"]), set()).add(r["node"])
    finally:
        near_copies.BLOCK = kept
    pairs = {(k, a, b) for (k, _, _), g in seen.items() for a in g for b in g if a < b}
    assert pairs == {(1, a, b) for a in range(23) for b in range(a + 1, 23)} | {(2, 5, 6)} and max(map(len, seen.values())) < 23


def test_further_links_of_a_list():
    """A list in which the least member is like none of the others."""
    import pandas as pd

    sets = [list(range(k, k + 20)) for k in (0, 1, 2, 4, 50, 52)]
    group = pd.DataFrame({"key": 1, "node": range(10, 16), "n": 20, "root": range(10, 16), "shingles": sets})
    got = {frozenset(x) for x in near_copies._rest_of_list(group).itertuples(index=False)}
    assert got == {frozenset(x) for x in [(10, 11), (10, 12), (12, 13), (14, 15)]}


def test_fingerprints_are_simhashes_of_the_shingles():
    sets = [s for s in near_copies.shingle_sets([x.encode() for x in ("a b c d e f g", " ".join(map(str, range(9000))), "", "one")])]
    for s in sets:
        plain = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s))
        assert near_copies.fingerprint(s) % 2**64 == plain


def test_stage_goes_through_the_fingerprint_index(spark, table, monkeypatch):
    """Close copies are linked by their fingerprints alone: here no text shares a band of min-hashes. Two random texts aren't linked."""
    r, asked, linked = random.Random(3), [], simhash.links
    w = [str(r.randrange(10**6)) for _ in range(3000)]
    texts = [" ".join(w), " ".join(w[:2990]), " ".join(w[5:]), " ".join(str(r.randrange(10**6)) for _ in range(3000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["c"] * len(EXTRA)) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(simhash, "links", lambda fps, **bounds: asked.append(bounds) or linked(fps, **bounds))
    signed = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda *a: signed(*a).withColumn("keys", F.array(F.col("doc_id"))))
    kept = sorted(x["doc_id"] for x in cp.near_duplicate_stage(spark, docs, "").collect())
    assert kept == [0, 3] and asked == [{"shared_bytes": 4, "bits": near_copies.BITS}]
