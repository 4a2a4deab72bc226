import random
import re

import pytest
import xxhash

from lodestar.llm import simhash
from lodestar.llm.components import components


def fingerprint(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps):
    """The smallest of each group of numbers at two bits or fewer, by search."""
    fps, out = sorted(set(fps)), {}
    for x in fps:
        if x not in out:
            todo = [x]
            out[x] = x
            while todo:
                a = todo.pop()
                for b in fps:
                    if b not in out and (a ^ b).bit_count() <= 2:
                        out[b] = x
                        todo.append(b)
    return out


def test_documents(docs, rows, empty):
    fp = {t: fingerprint(t) for _, t in rows}
    root = groups(fp.values())
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(least.get(root[fp[t]], i), i)
    want = sorted(((i is None, i or 0, fp[t], least[root[fp[t]]]) for i, t in rows), key=str)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("limit", [0, 3, 64])
def test_links_span_all_near_fingerprints(spark, limit):
    r = random.Random(limit)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
    fps |= {r.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 2**63, 2**64 - 1}
    signed = lambda x: x - (x >> 63 << 64)
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash.links(table, limit)
    assert all((a ^ b).bit_count() <= 2 or limit < 64 for a, b in ((r["a"] % 2**64, r["b"] % 2**64) for r in found.collect()))
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    by_root: dict = {}
    for x in fps:
        by_root.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    want: dict = {}
    for x, g in groups(fps).items():
        want.setdefault(g, set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("split", [0, 10**6])
def test_components_of_long_chains(spark, monkeypatch, split):
    import lodestar.llm.components

    monkeypatch.setattr(lodestar.llm.components, "SPLIT", split)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5), (None, 3), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 999, 999: 999}
