import random
import re
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from lodestar.llm import decontamination as dc
from tests.llm.conftest import sentence


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def tiling(p, t, least=5):
    """Words of p that a plain greedy tiling covers."""
    mp, mt, covered, at = [0] * len(p), [0] * len(t), 0, defaultdict(list)
    for j, w in enumerate(t):
        at[w].append(j)
    while True:
        best, found = least - 1, []
        for i in range(len(p)):
            for j in at.get(p[i], ()):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [1] * best
                covered += best


def test_tiles_against_plain_tiling():
    r = random.Random(1)
    for _ in range(300):
        p, t = [r.randint(0, 6) for _ in range(r.randint(0, 30))], [r.randint(0, 6) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5 and len(p) > 10:
            k = r.randint(1, len(p))
            t[len(t) // 2 : len(t) // 2] = p[k:] + p[:k]
        found = dc.tiles(np.array(p, np.uint64), np.array(t, np.uint64))
        spots = [(i + k, d + k) for i, d, n in found for k in range(n)]
        assert len({a for a, _ in spots}) == len({b for _, b in spots}) == len(spots) and all(p[a] == t[b] for a, b in spots)
        assert all(n >= 5 for *_, n in found) and len(spots) == tiling(p, t)


def test_repeated_phrases_take_little_time():
    """An item that repeats a phrase, and a long document that repeats it often; a phrase before and after another."""
    import time

    r = random.Random(8)
    phrase = [r.getrandbits(60) for _ in range(6)]
    other = lambda n: [r.getrandbits(60) for _ in range(n)]
    for times, more in ((100, 2000), (300, 6000)):
        item = [w for _ in range(times) for w in [*phrase, *other(3)]]
        doc = [w for _ in range(more) for w in [*phrase, *other(3)]]
        began = time.perf_counter()
        found = dc.tiles(np.array(item, np.uint64), np.array(doc, np.uint64))
        assert sum(n for *_, n in found) == 6 * times and time.perf_counter() - began < 5
    x, y, z = other(5), other(5), other(5)
    assert sum(n for *_, n in dc.tiles(np.array(x + y + x, np.uint64), np.array(x + z + x, np.uint64))) == 10
    assert dc.tiles(np.zeros(0, np.uint64), np.array(x, np.uint64)) == [] == dc.tiles(np.array(x, np.uint64), np.zeros(0, np.uint64))


def test_rolling_hashes_tell_runs_apart():
    from lodestar.llm.words import Rolling

    r = np.random.default_rng(2)
    a, b = r.integers(0, 3, 500).astype(np.uint64), r.integers(0, 3, 700).astype(np.uint64)
    for n in (1, 2, 5, 9):
        ha, hb = Rolling(a).windows(n), Rolling(b).windows(n)
        same = (np.lib.stride_tricks.sliding_window_view(a, n)[:, None] == np.lib.stride_tricks.sliding_window_view(b, n)[None]).all(axis=2)
        assert ((ha[:, None] == hb[None]) == same).all()
    assert len(Rolling(a).windows(501)) == 0


def test_items_that_repeat_an_id_are_judged_by_themselves(spark):
    r = random.Random(6)
    short, long = sentence(r, 10), sentence(r, 100)
    bench = spark.createDataFrame([(7, short), (7, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {short} y"), (2, " ".join(long.split()[:30]))], "doc_id long, text string")
    assert [(x["doc_id"], x["item_id"], x["item_words"]) for x in dc.leaks(docs, bench).collect()] == [(1, 7, len(words(short)))]


def test_reordered_passages_are_found_and_clean_documents_stay(spark, docs, rows, empty):
    r = random.Random(2)
    items = [(k, sentence(r, r.randint(20, 60))) for k in range(12)] + [(90, None), (91, ""), (92, "too short"), (None, sentence(r, 30)), (3, None)]
    more = []
    for k in range(12):
        w = items[k][1].split()
        cut = len(w) // 2
        more.append((1000 + k, sentence(r, 50) + " " + " ".join(w[cut:]).upper() + ". " + sentence(r, 30) + " " + ", ".join(w[:cut])))
        more.append((2000 + k, sentence(r, 40) + " " + " ".join(w[: len(w) // 4])))
    plain = spark.createDataFrame([*more, *[(i, t) for i, t in rows], more[0]], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, seeds string")
    got = {(x["doc_id"], x["item_id"]): x["covered"] for x in dc.leaks(plain, bench).collect()}
    want = {}
    for i, t in {*more, *rows}:
        for k, x in items:
            p = words(x)
            if i is not None and k is not None and len(p) >= 5 and (c := tiling(p, words(t))) >= 0.5 * len(p):
                want[i, k] = c
    assert set(got) == set(want) >= {(1000 + k, k) for k in range(12)}
    assert dc.leaks(empty, bench).collect() == [] and dc.leaks(docs, bench.limit(0)).collect() == []


def test_a_phrase_that_stands_everywhere_makes_no_pairs(spark):
    """Items and documents share one phrase; only those that share more meet, and the leaks are those of all pairs."""
    r = random.Random(8)
    phrase = "in the light of what was said above"
    items = [(k, f"{sentence(r, 40)} {phrase} {sentence(r, 10)}") for k in range(60)] + [(99, phrase)]
    docs = [(k, f"{sentence(r, 30)} {phrase} {sentence(r, 5)} " + (items[k][1] if k < 5 else "")) for k in range(150)]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    seeds = dc.written(dc.item_seeds(bench))
    found = dc.written(dc.seeded_documents(table, dc.bitmap(seeds)).withColumn("text_hash", F.xxhash64("text")))
    assert found.count() == 150
    pairs = {(x["doc_id"], x["item_id"]) for x in dc.likely_pairs(found, seeds).collect()}
    leaked = {(k, k) for k in range(5)} | {(k, 99) for k in range(150)}
    assert leaked <= pairs and len(pairs) < len(leaked) + 100  # of 9,150; words beside the phrase agree here and there
    assert {(x["doc_id"], x["item_id"]) for x in dc.leaks(table, bench).collect()} == leaked
