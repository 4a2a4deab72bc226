import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, fusion, lexical


def test_bm25_golden(spark):
    u = spark.createDataFrame([("one", "expense tracker without bank sync", ""), ("two", "bank account advice with an expense tracker", "")], "unit_id string, focus_text string, context_only_text string")
    post, (n, mean) = lexical.postings(u), lexical.statistics(u)
    got = {r["unit_id"]: r["score"] for r in lexical.bm25(post, "expense AND bank", n, mean).collect()}
    assert got["one"] == pytest.approx(-2.1463414634146348e-06, abs=1e-18) and got["two"] == pytest.approx(-1.8723404255319154e-06, abs=1e-18)
    assert [r["unit_id"] for r in lexical.top_k(lexical.bm25(post, "expense bank", n, mean), 1).collect()] == ["one"]


@pytest.mark.parametrize(("query", "found"), [("apple pear", "12"), ("apple OR plum", "1234"), ("apple NOT pear", "3"), ('"apple pear"', "1"), ("app*", "1234"), ("focus_text:app*", "123"), ("focus_text:plum", "34"), ("NEAR(apple plum, 1)", "3"), ("(apple OR plum) NOT kiwi", "124"), ("zzz", "")])
def test_query_language(spark, query, found):
    u = spark.createDataFrame([("1", "apple pear", "x"), ("2", "pear then apple", "x"), ("3", "apple kiwi plum", "x"), ("4", "plum", "apple2 y")], "unit_id string, focus_text string, context_only_text string")
    assert "".join(sorted(r["unit_id"] for r in lexical.match(lexical.postings(u), query).collect())) == found


@pytest.mark.parametrize("bad", ["how?", "don't", "", "(a", "a AND", "NOT a", '"open'])
def test_bad_queries(bad):
    with pytest.raises(lexical.QueryError):
        lexical.parse(bad)


def test_variants_and_fusion(spark):
    hits = spark.createDataFrame([("a", 0, 1, 1.0), ("b", 0, 2, 5.0), ("b", 1, 1, 999.0), ("c", 1, 2, 2.0)], "candidate_id string, variant int, rank int, score double")
    assert [(r["candidate_id"], r["rank"], r["score"]) for r in fusion.variant_merge(hits, 3).orderBy("rank").collect()] == [("a", 1, 1.0), ("b", 2, 999.0), ("c", 3, 2.0)]
    b = spark.createDataFrame([("a", "lexical", 1, 1.0), ("b", "lexical", 2, 1.0), ("b", "dense", 1, 1.0), ("a", "dense", 2, 1.0)], "candidate_id string, branch string, rank int, score double")
    got = fusion.rrf(b).orderBy("rank").collect()
    assert [r["candidate_id"] for r in got] == ["a", "b"] and got[0]["rrf_score"] == got[1]["rrf_score"] == 0.03252247488101534
    with pytest.raises(ValueError):
        fusion.rrf(b, 0)


def test_feedback(spark):
    a = spark.createDataFrame([("seed", 1), ("seen", 2)], "candidate_id string, rank int")
    b = spark.createDataFrame([("seen", 1), ("new", 2)], "candidate_id string, rank int")
    assert [(r["candidate_id"], r["origin"]) for r in fusion.feedback_union(a, b, 3).orderBy("rank").collect()] == [("seed", "original"), ("seen", "already_seen"), ("new", "new")]
    seeds = spark.createDataFrame([("s", 1, [1.0, 0.0], True), ("s", 2, [0.0, 1.0], False)], "scenario_id string, id int, vector array<float>, positive boolean")
    (c,) = dense.feedback_centroids(seeds, 2).collect()
    assert c["query"] == [1.0, 0.0] and c["negatives"] == [2]
    many = spark.createDataFrame([("s", k, [1.0, 0.0], True) for k in range(6)], seeds.schema)
    with pytest.raises(Exception, match="too many positive"):
        dense.feedback_centroids(many, 2).collect()


def test_rerank_uses_the_cache_and_refuses_what_isn_t_finite(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "candidate_id string, rank int")
    cache = spark.createDataFrame([("a", 0.5)], "key string, score double")
    got = fusion.rerank(c, F.col("rank").cast("double"), 2, cache, F.col("candidate_id")).orderBy("rerank_rank").collect()
    assert [(r["candidate_id"], r["rerank_score"], r["cached"]) for r in got] == [("b", 2.0, False), ("a", 0.5, True)]
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(c, F.lit(float("nan")), 2).collect()


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    p = spark.createDataFrame([(k, [r.random() - 0.5 for _ in range(4)]) for k in range(60)], "id long, vector array<float>")
    q = p.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, dense.search(q, p, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK", 7)
    assert sorted(map(tuple, dense.search(q, p, 3).collect())) == whole and len(whole) == 180


def test_ties_of_dense_search_go_by_id(spark):
    p = spark.createDataFrame([(k, [1.0, 0.0]) for k in (5, 3, 9)] + [(1, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, query array<float>")
    for parts in (1, 4):
        assert [(r["id"], r["rank"]) for r in dense.search(q, p.repartition(parts), 3).orderBy("rank").collect()] == [(3, 1), (5, 2), (9, 3)]


def test_stated_queries_in_one_pass_are_the_single_ones(spark):
    rows = [("a", "red fox and red hen", "x"), ("b", "fox", "red"), ("c", "hen hen", "x"), ("d", "", None), ("e", "the fox, the hen", "fox")]
    u = spark.createDataFrame(rows, "unit_id string, focus_text string, context_only_text string")
    post, (n, mean) = lexical.postings(u), lexical.statistics(u)
    queries = [("s", 0, "fox"), ("s", 1, '"red hen" OR the'), ("t", 0, "fox NOT hen"), ("t", 1, "he*"), ("t", 2, "nowhere")]
    got = {tuple(r) for r in lexical.search(post, queries, n, mean, 2).collect()}
    want = {(s, k, r["unit_id"], r["score"], r["rank"]) for s, k, text in queries for r in lexical.top_k(lexical.bm25(post, text, n, mean), 2).collect()}
    assert got == want and {(s, k) for s, k, *_ in got} == {("s", 0), ("s", 1), ("t", 0), ("t", 1)}
    empty = spark.createDataFrame([], u.schema)
    assert lexical.search(lexical.postings(empty), queries, 0, 0.0, 2).isEmpty()


def test_rankings_are_kept_apart_by_partition(spark):
    c = spark.createDataFrame([("p", "a", 1, 2.0), ("p", "b", 2, 5.0), ("q", "a", 1, 1.0)], "scenario_id string, candidate_id string, rank int, s double")
    got = fusion.rerank(c, F.col("s"), 2, partition=("scenario_id",))
    assert {(r["scenario_id"], r["candidate_id"], r["rerank_rank"]) for r in got.collect()} == {("p", "b", 1), ("p", "a", 2), ("q", "a", 1)}
    new = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "scenario_id string, candidate_id string, rank int")
    union = fusion.feedback_union(c, new, 5, ("scenario_id",))
    assert {tuple(r) for r in union.select("scenario_id", "candidate_id", "rank", "origin").collect()} == {("p", "a", 1, "original"), ("p", "b", 2, "original"), ("q", "a", 1, "already_seen"), ("q", "b", 2, "new")}


def test_blocked_search_is_exact(spark, monkeypatch):
    """Against a plain sort, with ties, points without a score, several blocks and small steps."""
    import numpy as np

    g = np.random.default_rng(3)
    vectors = g.integers(-2, 3, (300, 6)).astype(np.float32)
    rows = [(f"p{k:03d}", vectors[k].tolist()) for k in range(300)] + [("null", None), ("short", [1.0]), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("zero", [0.0] * 6)]
    queries = [(k, g.integers(1, 3, 6).astype(np.float32).tolist()) for k in range(9)]
    p, q = spark.createDataFrame(rows, "id string, vector array<float>").repartition(5), spark.createDataFrame(queries, "query_id long, query array<float>")
    want = []
    for name, x in queries:
        scored = sorted((-round(float(np.dot(np.float64(x), np.float64(v)) / np.linalg.norm(np.float64(x)) / np.linalg.norm(np.float64(v))), 12), i) for i, v in rows[:300] if any(v))
        want += [(name, i, -s, rank) for rank, (s, i) in enumerate(scored[:7], 1)]
    for block, scores in ((10_000, 1 << 22), (2, 64)):
        monkeypatch.setattr(dense, "BLOCK", block)
        monkeypatch.setattr(dense, "SCORES", scores)
        got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 12)) for r in dense.search(q, p, 7).collect())
        assert got == sorted((n, rank, i, s) for n, i, s, rank in want)
    assert dense.search(q, p.limit(0), 3).count() == 0 == dense.search(q.limit(0), p, 3).count()
    assert "Join" not in dense.search(q, p, 7)._jdf.queryExecution().executedPlan().toString()
