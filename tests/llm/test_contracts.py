"""The thin queries op11 and op13 against their contracts, worked out plainly over a whole small table; op12 has SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from lodestar.llm import queries

from .test_secret_scan import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11(spark, documents):
    got = {r["doc_id"]: r for r in queries.op11_secret_scan(spark, SF).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        base = plain(text)
        r = got[i]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in spans if k != "random"] == base
        order = [(int(a), ["assign", "access", "hex", "random"].index(k)) for k, a, _ in spans]
        assert order == sorted(order)


def all_runs(words):
    """Every run of 12 words or more, period by period."""
    x = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int)
    found = []
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate(([False], x[:-q] == x[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= q and b - a + q >= 12 and not any(s <= a and b + q <= s + n for s, n, p in found if q % p == 0):
                found.append((a, b - a + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_op13(spark, documents):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    seen = 0
    for i, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = all_runs(words)
        seen += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert seen > 10
