"""The log of generations, digests of ordered tables, tables in buckets, and the index that follows its units."""

import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestar.operators import audit, lexical
from lodestar.plans import pipelines, postings, publish


def test_of_concurrent_switches_one_wins(spark, tmp_path):
    root = str(tmp_path)
    for k in range(6):
        publish.publish(spark.range(k), f"{root}/g{k}", {"k": k})
    publish.switch(spark, root, f"{root}/g0")
    seen, _ = publish.head(spark, root)
    gate, results = threading.Barrier(5), {}

    def put(k):
        gate.wait()
        try:
            results[k] = publish.commit(spark, root, {"folder": f"{root}/g{k}", "previous": f"{root}/g0"}, seen)
        except publish.Conflict:
            results[k] = None

    threads = [threading.Thread(target=put, args=(k,)) for k in range(1, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [k for k, n in results.items() if n]
    assert len(results) == 5 and len(winners) == 1 and publish.current(spark, root) == f"{root}/g{winners[0]}"
    with pytest.raises(publish.Conflict):
        publish.switch(spark, root, f"{root}/g1", after=seen)
    assert publish.rollback(spark, root) == f"{root}/g0" and publish.head(spark, root)[0] == seen + 2
    assert [p.name for p in (tmp_path / "_log").iterdir() if p.name.startswith("_")] == []


def test_ordered_digests_dont_hang_on_partitions(spark):
    rows = spark.range(500).select((F.lit(1000) - F.col("id")).alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("t"))
    digests = {publish.ordered_digest(rows.repartition(p), ["n"], 7) for p in (1, 3, 16)}
    nodes = [hashlib.sha256(f'{{"n":{n},"t":{t}}}'.encode()).hexdigest() for n in range(501, 1001) for t in [f'"é{1000 - n}"' if (1000 - n) % 3 else "null"]]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[k : k + 7]).encode()).hexdigest() for k in range(0, len(nodes), 7)]
    assert digests == {nodes[0]}
    assert publish.ordered_digest(rows.limit(0), ["n"]) == hashlib.sha256(b"").hexdigest()


def test_an_index_in_buckets_isnt_moved(spark, tmp_path):
    keys = "fullname string, revision string, thread string, text string"
    every = spark.createDataFrame([(f"s{k % 2}", k, f"n{k % 50}", "r", "t", "x") for k in range(400)], f"source_id string, line bigint, {keys}")
    resolved = spark.createDataFrame([("e1", "n1", "r", "t", "x", True), ("e2", "n2", "r", "t", "y", True), ("e3", None, None, None, None, False)], f"exposure_id string, {keys}, identified boolean")
    folder = f"{tmp_path}/index"
    pipelines.archive_index(every, folder, {"k": 1}, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pipelines.match_indexed(spark, folder, resolved)
        plain = audit.match_exposures(resolved, every)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and {r["archive_matches"] for r in found.collect()} == {0, 8}
        index, wanted = publish.open_bucketed(spark, folder), resolved.select("exposure_id", F.xxhash64(*audit.KEYS).alias("identity"))
        plan = index.join(wanted, "identity")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        spark.sql(f"DROP TABLE lodestar_{hashlib.sha256(folder.encode()).hexdigest()[:24]}")  # as a new session
        assert publish.open_bucketed(spark, folder).count() == 400 and "Bucketed: true" in publish.open_bucketed(spark, folder).join(wanted, "identity")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="another run"):
        pipelines.archive_index(every, folder, {"k": 2}, 8)


def test_scores_after_updates_are_those_of_a_new_index(spark, tmp_path):
    r = random.Random(4)
    schema = "snapshot_id string, unit_id string, focus_text string, context_only_text string"
    text = lambda n: " ".join(r.choice("bank sync expense the a of report bill".split()) for _ in range(n))
    live = {f"u{k}": ("s", f"u{k}", text(r.randint(1, 20)), text(3)) for k in range(40)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    root = f"{tmp_path}/index"
    postings.build(spark, root, frame(live.values()))

    def same():
        post, n, mean = postings.read(spark, root)
        units = frame(live.values())
        assert (n, round(mean, 9)) == (lexical.statistics(units)[0], round(lexical.statistics(units)[1], 9))
        whole = lexical.postings(units, postings.KEYS)
        for query in ("bank sync", '"the report" OR bill*', "expense NOT a"):
            score = lambda p: sorted((x["unit_id"], round(x["score"], 12)) for x in lexical.bm25(p, query, n, mean, id_cols=postings.KEYS).collect())  # noqa: B023, E731
            assert score(post) == score(whole)

    same()
    new = {f"u{k}": ("s", f"u{k}", text(9), text(2)) for k in range(30, 55)}
    postings.update(spark, root, frame(new.values()), frame([live[f"u{k}"] for k in (1, 2, 3)] + [("s", "none", "", "")]).select("snapshot_id", "unit_id"))
    live = {k: v for k, v in (live | new).items() if k not in ("u1", "u2", "u3")}
    same()
    back = {"u2": ("s", "u2", "bank bank sync", "the")}
    postings.update(spark, root, frame(back.values()))
    live |= back
    same()
    before = postings.read(spark, root)[1:]
    assert len(postings.compact(spark, root)["parts"]) == 1 and postings.read(spark, root)[1:] == before
    same()
    with pytest.raises(ValueError, match="at once"):
        postings.update(spark, root, frame(back.values()), frame(back.values()).select("snapshot_id", "unit_id"))
    with pytest.raises(Exception, match="twice"):
        postings.update(spark, root, frame([*back.values(), *back.values()]))
