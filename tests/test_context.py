import pytest

from lodestar.operators import context, units


def chain(spark, rows, **more):
    m = spark.createDataFrame(rows, "fullname string, kind string, thread_fullname string, parent_fullname string")
    return {r["fullname"]: r for r in context.ancestor_chains(m, **more).collect()}


def test_walks(spark):
    deep = [("t3_r", "submission", "t3_r", None)] + [(f"t1_{k}", "comment", "t3_r", f"t1_{k - 1}" if k else "t3_r") for k in range(7)]
    got = chain(spark, deep)
    assert got["t3_r"]["ancestors"] == [] and got["t3_r"]["context_complete"]
    assert got["t1_0"]["ancestors"] == ["t3_r"] and got["t1_2"]["ancestors"] == ["t3_r", "t1_0", "t1_1"] and got["t1_2"]["context_complete"]
    assert got["t1_3"]["ancestors"] == ["t3_r", "t1_0", "t1_1", "t1_2"] and not got["t1_3"]["ancestors_truncated"]
    assert got["t1_6"]["ancestors"] == ["t3_r", "t1_2", "t1_3", "t1_4", "t1_5"] and got["t1_6"]["ancestors_truncated"] and not got["t1_6"]["context_complete"]
    assert chain(spark, deep, max_parents=0)["t1_6"]["ancestors"] == ["t3_r"]


def test_absent_parents_and_roots(spark):
    got = chain(spark, [("t3_w", "submission", "t3_w", None), ("t1_n", "comment", "t3_w", "t1_gone"), ("t1_x", "comment", "t3_none", "t1_n2"), ("t1_y", "comment", "t3_none", "t3_none")])
    assert (got["t1_n"]["ancestors"], got["t1_n"]["missing_parent_ids"]) == (["t3_w"], ["t1_gone"])
    assert got["t1_x"]["missing_parent_ids"] == ["t3_none", "t1_n2"] and got["t1_y"]["missing_parent_ids"] == ["t3_none"]


def test_cycles(spark):
    got = chain(spark, [("t1_a", "comment", "t3_r", "t1_b"), ("t1_b", "comment", "t3_r", "t1_a"), ("t1_s", "comment", "t3_r", "t1_s"), ("t3_r", "submission", "t3_r", None)])
    assert got["t1_a"]["parent_cycle_detected"] and got["t1_a"]["missing_parent_ids"] == ["t1_a"] and got["t1_a"]["ancestors"] == ["t3_r", "t1_b"]
    assert got["t1_s"]["missing_parent_ids"] == ["t1_s"]


@pytest.mark.parametrize(("n", "count"), [(8, 1), (9, 2), (14, 2), (15, 3), (40, 7)])
def test_chunks_of_one_paragraph(spark, n, count):
    from pyspark.sql import functions as F

    text = " ".join(f"w{k}" for k in range(n))
    spans = units.chunk_spans(text, 8, 2)
    assert len(spans) == count and spark.range(1).select(units.chunk_count(F.lit(text), 8, 2)).first()[0] == count
    if n == 40:
        assert [(text[a:b].split()[0], text[a:b].split()[-1]) for a, b in spans] == [(f"w{a}", f"w{b}") for a, b in [(0, 7), (6, 13), (12, 19), (18, 25), (24, 31), (30, 37), (36, 39)]]


def test_chunks_keep_offsets():
    assert units.chunk_spans("a b\n\nc d e\nf g h i", 5, 1) == [(0, 11), (11, 18)]  # from paragraph to paragraph, line feeds included
    assert units.chunk_spans("  \na b\n \nc d e f\n", 5, 1) == [(3, 9), (9, 17)]  # a blank paragraph before a chunk is left out, one inside stays
    assert units.chunk_spans("a\n" + "x y z w v u\n" + " \n", 3, 1) == [(0, 2), (2, 7), (6, 11), (10, 13), (14, 16)]
    assert units.chunk_spans(" \n" + "x y z w\n", 3, 1) == [(0, 2), (2, 7), (6, 9)]
    assert units.chunk_spans("", 6, 1) == [(0, 0)] and units.chunk_spans("\n\n", 6, 1) == [(0, 2)] and units.chunk_spans(" \n", 6, 1) == [(0, 2)]
    text = "\U0001f642 one\u00a0two\n\n  three four five\nsix " + "x " * 20
    spans = units.chunk_spans(text, 6, 1)
    assert spans[0] == (0, text.index("six")) and [text[a:b].split() for a, b in spans[1:]][0] == ["six", *["x"] * 5]
    with pytest.raises(ValueError):
        units.chunk_spans("a", 3, 3)


def test_counts_bound_the_chunks(spark):
    from pyspark.sql import functions as F

    texts = ["", "\n", "  ", "a\n \nb", "a\u00a0b\u2003c d\x1ce", "x " * 9 + "\n" + "y " * 3, "\r\n a\r\n"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(units.chunk_count(F.col("x"), 4, 1)).collect()]
    assert got == [1, 1, 1, 3, 2, 4, 2] and all(len(units.chunk_spans(x, 4, 1)) <= n for x, n in zip(texts, got, strict=True))


def test_fields_of_units(spark):
    m = spark.createDataFrame([("t1_a", "comment", "", ""), ("t3_b", "submission", "title", ""), ("t3_c", "submission", "title", "body")], "fullname string, kind string, raw_title string, raw_body string")
    assert {r["fullname"]: (r["focus_field"], r["focus_text"]) for r in units.chunks(m).collect()} == {"t1_a": ("body", ""), "t3_b": ("title", "title"), "t3_c": ("selftext", "body")}
