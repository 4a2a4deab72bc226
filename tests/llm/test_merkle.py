import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import merkle as m


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings of each leaf by level: [(before, after)]) of a plain tree."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // 8 * 8
            proofs[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        at = [i // 8 for i in at]
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain(rows):
    """rows of FIELDS -> sorted rows of the manifest, by the plain definition."""
    leaf = lambda r: H(*map(enc, r))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[lang] = tree([leaf(r) for r in trees[lang]])
    root, upper = tree([subs[x][0] for x in order])
    out = []
    for lang, up in zip(order, upper, strict=True):
        for r, low in zip(trees[lang], subs[lang][1], strict=True):
            path, text = low + up, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            got = leaf((*r[:4], text))
            for before, after in path:
                got = H(before, got, after)
            out.append((r[0], leaf(r), subs[lang][0], root, H(*[x for pair in path for x in pair]), got, got == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pieces,fan", [(1 << 16, 16), (6, 2)])
def test_manifest_equals_the_plain_tree(spark, docs, monkeypatch, pieces, fan):
    monkeypatch.setattr(m, "PIECE", pieces)
    monkeypatch.setattr(m, "FAN", fan)
    from pyspark.sql import functions as F

    langs = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, "").when(F.col("doc_id") % 7 == 2, "é").otherwise("en")
    mixed = docs.withColumn("lang", langs).withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.when(F.col("doc_id") % 5 > 0, "s"))
    rows = [tuple(r) for r in mixed.select(*m.FIELDS).collect()]
    got = sorted((tuple(r) for r in m.manifest(mixed, m.tampered()).collect()), key=repr)
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_untampered_tables_verify(docs):
    rows = m.manifest(docs).collect()
    assert len(rows) == docs.count() and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1


def test_one_row_and_none(spark, empty):
    assert m.manifest(empty).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    r = m.manifest(one).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == H("-----") and r["proof_sha256"] == H()


def test_many_trees(spark):
    rows = [(i, "s", f"l{i // 3:03d}", i, f"Text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in m.manifest(df, m.tampered()).collect()), key=repr) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.data())
def test_fragments_merge_in_any_order(n, data):
    """The monoid: whatever the parts and the order in which they meet, the same nodes are left."""
    leaves = [H(str(i)).encode() for i in range(n)]
    owner = [data.draw(st.integers(0, 4)) for _ in range(n)] if n < 40 else [i * 5 // n for i in range(n)]
    parts = [m.Fragment(n, {(0, i): leaves[i] for i in range(n) if owner[i] == k}) for k in range(5)]
    order = data.draw(st.permutations(range(5)))
    a = parts[order[0]]
    for k in order[1:]:
        a = a.merge(parts[k])
    left = parts[order[0]].merge(parts[order[1]])
    right = parts[order[2]].merge(parts[order[3]]).merge(parts[order[4]])
    b = left.merge(right)
    assert a.nodes == b.nodes == {(m.height(n), 0): a.root} and a.root.decode() == tree([x.decode() for x in leaves])[0]


def test_a_piece_keeps_few_nodes():
    of = m.Fragment(100_000, {(0, i): b"0" for i in range(12_345, 54_321)})
    assert len(of.nodes) <= 14 * m.height(100_000)
