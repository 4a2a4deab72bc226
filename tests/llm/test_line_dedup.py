from collections import defaultdict

from pyspark.sql import functions as F

from lodestar.llm import line_dedup as ld


def brute(rows, least=3, chars=20):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                where[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < chars or len(where[key(x)]) < least or max(where[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(docs, **more):
    kept = ld.apply_keep_bitmaps(docs, ld.line_keep_bitmaps(docs, **more), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])


def test_against_brute_force(docs, rows):
    assert sorted((tuple(r) for r in run(docs).collect()), key=key) == sorted(brute(rows), key=key)
    assert sorted((tuple(r) for r in run(docs, min_docs=2, min_chars=1).collect()), key=key) == sorted(brute(rows, 2, 1), key=key)


def test_edges_of_the_key(spark):
    line = "é" * 19 + "x"
    rows = [(1, line), (2, "\x0b" + line.upper().replace("É", "é") + "\x0c"), (3, line + "\n" + line), (4, "é" * 19), (5, "é" * 19), (6, "é" * 19), (7, " " + line)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)
    assert sum(r["n_dropped"] for r in got) == 2


def test_empty_table_and_native_plan(docs, empty):
    assert run(empty).collect() == []
    plan = run(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_columns_stay(docs):
    kept = ld.apply_keep_bitmaps(docs, ld.line_keep_bitmaps(docs))
    assert kept.columns == docs.columns and kept.where(F.col("score") == "clash").count() == docs.count()
