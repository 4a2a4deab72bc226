"""Results don't depend on the order or the partitions of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import context, fusion, lexical, messages, pooling, review, similarity, tombstones


def words(r, n):
    return " ".join(r.choice(["bank", "expense", "sync", "link", "private", "budget", "tool"]) + str(r.randint(0, 3)) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    r = random.Random(8)
    docs = [(f"t3_{k:03}", "submission", f"t3_{k:03}", None, "", words(r, r.randint(5, 30)), f"r{k % 3}") for k in range(80)]
    docs += [(f"t1_{k:03}", "comment", f"t3_{k % 80:03}", f"t3_{k % 80:03}" if k < 40 else f"t1_{k - 40:03}", "", docs[k][5], "x") for k in range(80)]
    return docs


def forms(spark, rows, schema):
    yield spark.createDataFrame(rows, schema).coalesce(1)
    yield spark.createDataFrame(rows[::-1], schema).repartition(7)


SCHEMA = "fullname string, kind string, thread_fullname string, parent_fullname string, raw_title string, raw_body string, subreddit string"


def sample(m):
    return messages.top_by_hash(m, 17, 3).select("fullname")


def chains(m):
    return context.ancestor_chains(m)


def ranking(m):
    u = m.select(F.col("fullname").alias("unit_id"), F.col("raw_body").alias("focus_text"), F.lit("").alias("context_only_text"))
    post, (n, mean) = lexical.postings(u), lexical.statistics(u)
    return lexical.top_k(lexical.bm25(post, "bank1 OR expense2", n, mean), 20)


def fused(m):
    a = messages.top_by_hash(m, 30, 1).select(F.col("fullname").alias("candidate_id"), F.lit("a").alias("branch"), F.length("raw_body").alias("rank"), F.lit(1.0).alias("score"))
    b = messages.top_by_hash(m, 30, 2).select(F.col("fullname").alias("candidate_id"), F.lit("b").alias("branch"), F.length("raw_body").alias("rank"), F.lit(1.0).alias("score"))
    return fusion.rrf(a.union(b)).select("candidate_id", "rrf_score", "rank")


def pool(m):
    runs = messages.top_by_hash(m, 40, 5).select(F.col("fullname").alias("candidate_id"), F.col("subreddit").alias("scenario_id"), F.length("raw_body").alias("rank"), F.lit(0.5).alias("score"), F.lit("r").alias("run"))
    return pooling.interleaved(pooling.blinded_pool(runs, m.select(F.col("fullname").alias("candidate_id")), 30, 9))


def split(m):
    p = m.select(F.col("fullname").alias("candidate_id"), "thread_fullname")
    e = similarity.duplicate_edges(m.select(F.col("fullname").alias("candidate_id"), F.col("raw_body").alias("text")))
    return similarity.group_split(p, similarity.groups(p, e), 4)


def queue(m):
    found = messages.discover(m, {"a": [["bank1"]], "b": [["expense2"]], "c": [["sync"], ["link3"]]})
    return review.balanced_queue(review.cards(found, F.xxhash64("fullname")), 21)


def digest(m):
    return tombstones.ledger_digest(m.select(F.col("fullname").alias("message_fullname"), F.lit(None).cast("string").alias("source_revision_id"), F.col("subreddit").alias("reason")))


@pytest.mark.parametrize("run", [sample, chains, ranking, fused, pool, split, queue, digest])
def test_order_and_partitions(spark, data, run):
    a, b = (sorted(map(str, run(m).collect())) for m in forms(spark, data, SCHEMA))
    assert a and a == b
