"""Generations, purges, operations, audits that resume, configurations, and orders over whole tables."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, messages, ordering, pooling, similarity, state
from lodestar.plans import config, pipelines, publish
from lodestar.sources import archive

LEDGER = "message_fullname string, source_revision_id string, reason string"
OUTBOX = "identity string, scope string, records bigint, status string, observed bigint, deleted bigint, attempts bigint, claimed_at string, updated_at string, error string"


@pytest.fixture
def corpus(spark, tmp_path):
    """A root with one generation of units in force."""
    rows = [(f"u{k}", "s1", f"t1_{k}", "r", f"text {k}", "", f"[FOCUS COMMENT t1_{k}]\ntext {k}", [], []) for k in range(6)]
    units = spark.createDataFrame(rows, "unit_id string, snapshot_id string, message_fullname string, source_revision_id string, focus_text string, context_only_text string, context_text string, missing_context_ids array<string>, context_message_refs array<string>")
    root = f"{tmp_path}/corpus"
    publish.publish(units, f"{root}/first", {"n": 1})
    publish.switch(spark, root, f"{root}/first")
    return root


def test_a_purge_is_backed_up_published_and_rolled_back(spark, corpus, tmp_path):
    ledger = spark.createDataFrame([("t1_2", None, "asked")], LEDGER)
    before = publish.fingerprint(publish.published(spark, publish.current(spark, corpus)))
    done = pipelines.purge(spark, corpus, ledger, "s1", f"{tmp_path}/backup")
    assert done["status"] == "applied" and done["executed"] == {"backup": True, "propagation": True, "publication": True}
    assert publish.current(spark, corpus) == done["current"] and publish.published(spark, done["current"]).count() == 5
    assert publish.fingerprint(publish.published(spark, f"{tmp_path}/backup")) == before
    again = pipelines.purge(spark, corpus, ledger, "s1", f"{tmp_path}/other")
    assert again["status"] == "no_op" and not any(again["executed"].values()) and publish.read_manifest(spark, f"{tmp_path}/other") is None
    assert publish.rollback(spark, corpus) == f"{corpus}/first" and publish.published(spark, publish.current(spark, corpus)).count() == 6
    with pytest.raises(ValueError, match="isn't complete"):
        publish.switch(spark, corpus, f"{corpus}/none")
    with pytest.raises(ValueError, match="empty"):
        pipelines.purge(spark, corpus, ledger.limit(0), "s1", f"{tmp_path}/b")
    with pytest.raises(ValueError, match="in force"):
        pipelines.purge(spark, f"{tmp_path}/nothing", ledger, "s1", f"{tmp_path}/b")


def test_a_failed_purge_leaves_the_old_generation(spark, corpus, tmp_path):
    publish.publish(spark.range(3), f"{tmp_path}/backup", {"another": "run"})
    with pytest.raises(ValueError, match="another run"):
        pipelines.purge(spark, corpus, spark.createDataFrame([("t1_2", None, "asked")], LEDGER), "s1", f"{tmp_path}/backup")
    assert publish.current(spark, corpus) == f"{corpus}/first"


def test_rollback_needs_a_generation_before(spark, corpus):
    with pytest.raises(ValueError, match="go back"):
        publish.rollback(spark, corpus)


def test_fingerprints_tell_content_not_order(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert publish.fingerprint(a) == publish.fingerprint(a.orderBy(F.desc("a")).repartition(3)) == publish.fingerprint(a.select("b", "a"))
    assert len({publish.fingerprint(x) for x in (a, a.limit(1), a.union(a), a.withColumn("b", F.lit("x")), a.limit(0))}) == 5


def test_a_configured_operation(spark, corpus, tmp_path):
    box = spark.createDataFrame([], OUTBOX)
    ledger = spark.createDataFrame([("t1_4", None, "asked"), ("t1_5", None, "asked")], LEDGER)
    publish.publish(spark.range(3), f"{tmp_path}/taken", {"another": "run"})
    box, told = pipelines.run_operation(spark, box, corpus, ledger, "s1", f"{tmp_path}/taken", "1")
    assert told["status"] == "failed" and box.first()["status"] == "failed" and publish.current(spark, corpus).endswith("first")
    box, told = pipelines.run_operation(spark, box, corpus, ledger, "s1", f"{tmp_path}/backup", "2")
    row = box.first()
    assert told["status"] == "applied" and (row["status"], row["deleted"], row["attempts"], row["records"]) == ("applied", 2, 2, 2) and told["precheck"] == 2
    box, told = pipelines.run_operation(spark, box, corpus, ledger, "s1", f"{tmp_path}/backup2", "3")
    assert told["status"] == "no_op" and box.first()["attempts"] == 2
    publish.rollback(spark, corpus)  # the artifact was rewound: the deletion is done again
    box, told = pipelines.run_operation(spark, box, corpus, ledger, "s1", f"{tmp_path}/backup", "4")
    assert told["status"] == "applied" and publish.published(spark, publish.current(spark, corpus)).count() == 4
    with pytest.raises(ValueError, match="in progress"):
        pipelines.run_operation(spark, state.claim(box.withColumn("status", F.lit("pending")), 1, "5"), corpus, ledger, "s1", f"{tmp_path}/b", "6")


def test_audits_resume_by_source_and_rematch_is_bound(spark, tmp_path):
    keys = "fullname string, revision string, thread string, text string"
    every = spark.createDataFrame([(f"s{k % 2}", k, f"n{k}", "r", "t", "x") for k in range(10)], f"source_id string, line bigint, {keys}")
    resolved = spark.createDataFrame([("e1", "n1", "r", "t", "x", True), ("e2", "n2", "r", "t", "x", True), ("e3", "n99", "r", "t", "x", True), ("e4", None, None, None, None, False)], f"exposure_id string, {keys}, identified boolean")
    for k in range(2):
        (tmp_path / f"s{k}").write_text(f"content {k}")
    sources = spark.createDataFrame([(f"s{k}", f"{tmp_path}/s{k}") for k in range(2)], "source_id string, path string")
    units = every.select("fullname", "revision", "thread", "text").limit(3)
    read = []

    def records(names):
        read.extend(names)
        if len(read) == 2:
            raise RuntimeError("cut off")
        return every.where(F.col("source_id").isin(names))

    with pytest.raises(RuntimeError):
        pipelines.audit_by_source(spark, sources, records, units, resolved, f"{tmp_path}/audit", at_once=1)
    got = pipelines.audit_by_source(spark, sources, records, units, resolved, f"{tmp_path}/audit", at_once=1)
    assert read == ["s0", "s1", "s1"] and sorted(map(tuple, got.collect())) == [("e1", "s1", 1), ("e2", "s0", 2)]
    assert pipelines.audit_by_source(spark, sources, records, units, resolved, f"{tmp_path}/audit").count() == 2 and len(read) == 3
    (tmp_path / "s0").write_text("content 7")  # of equal size, and no checksum is declared
    assert pipelines.audit_by_source(spark, sources, records, units, resolved, f"{tmp_path}/audit").count() == 2 and read[3:] == ["s0"]
    pipelines.audit_by_source(spark, sources, records, units.limit(2), resolved, f"{tmp_path}/audit")
    assert read[4:] == ["s0", "s1"]  # another corpus
    m = publish.publish(every, f"{tmp_path}/index", {"n": 1})
    assert {r["exposure_id"]: r["status"] for r in pipelines.rematch(spark, f"{tmp_path}/index", m["run_id"], resolved).collect()} == {"e1": "matched", "e2": "matched", "e3": "unresolved", "e4": "unresolved"}
    with pytest.raises(ValueError, match="isn't the run"):
        pipelines.rematch(spark, f"{tmp_path}/index", "0" * 64, resolved)


def test_runtime_and_comparison_configurations(tmp_path):
    run = config.runtime_config({"models": {"embedding_revision": "a", "reranker_revision": "b"}})
    assert run["context"]["focus_chunk_tokens"] == 512 and run["retrieval"]["rrf_k"] == 60 and config.configuration_hash(run) == config.configuration_hash(json.loads(json.dumps(run)))
    for bad in ({"other": 1}, {"schema_version": 2}, {"schema_version": True}, {"models": {"device": "tpu"}}, {"context": {"focus_overlap_tokens": 512}}, {"sampling": {"seed": "1"}}, {"network": {"allow_remote_inference": True}}, {"review": {"mode": "model"}}, {"feedback": {"max_positive_examples": 6}}, {"paths": 1}):
        with pytest.raises(ValueError):
            config.runtime_config(bad)
    variants = [{"variant_id": v, "lexical": True, "dense": v != "A", "reranker": v != "A", "feedback": v == "C"} for v in "ABC"]
    plan = {"snapshot_id": "s", "split": "dev", "output_limit": 20, "review_budget": 20, "lexical_candidates": 100, "dense_candidates": 100, "rerank_candidates": 100, "feedback_candidates": 200, "rrf_k": 60, "variants": variants}
    assert config.comparison_config(plan)["variants"][2]["feedback"]
    for bad in ({"variants": variants[:2]}, {"variants": variants[::-1]}, {"output_limit": 21}, {"rrf_k": 0}, {"snapshot_id": " "}, {"split": "all"}, {"more": 1}):
        with pytest.raises(ValueError):
            config.comparison_config(plan | bad)
    told = config.retrieval_preflight({"models": {"embedding_revision": "a", "reranker_revision": "b"}}, plan)
    assert told["ready"] and told["blockers"] == [] and told["runtime_configuration_hash"] == config.configuration_hash(run)
    told = config.retrieval_preflight({"qdrant": {"url": "http://far.example:1"}, "network": {"allow_model_downloads": True}}, plan | {"rrf_k": 61})
    assert [k for k, v in told["checks"].items() if not v] == ["comparison_matches_runtime_limits", "embedding_revision_pinned", "local_only_policy", "qdrant_url_loopback", "reranker_revision_pinned"]
    told = config.retrieval_preflight({"x": 1}, {})
    assert not told["ready"] and told["runtime_configuration_hash"] is None and len(told["blockers"]) == 2
    registry = {"entries": [{"alias": "a", "collection": 3}, {"alias": "a", "collection": "c", "snapshot_id": "s"}]}
    assert config.resolve_alias(registry, "a") == ("c", "s") and config.resolve_alias(registry, "b") is None
    for name, app in (("b.json", "y"), ("a.json", "x")):
        (tmp_path / name).write_text(json.dumps({"app_id": app, "profile_version": 1, "capabilities": [{"claim_id": "c1", "status": "verified", "evidence_ref": "e"}, {"claim_id": "c2", "status": "unknown"}]}))
    assert [p["app_id"] for p in config.profiles(str(tmp_path))] == ["x", "y"] and config.missing_evidence(config.profiles(str(tmp_path))[0]) == ["c2"]
    (tmp_path / "c.json").write_text(json.dumps({"app_id": "x", "profile_version": 1}))
    with pytest.raises(ValueError, match="twice"):
        config.profiles(str(tmp_path))
    folder = tmp_path / "scenarios"
    folder.mkdir()
    one = {"scenario_id": "s", "lexical_queries": ["a", "b", "c"], "semantic_queries": ["d", "e"]}
    (folder / "s.json").write_text(json.dumps({"scenarios": [one, {**one, "scenario_id": "t", "required_claim_ids_for_fit": ["c"], "app_id": "x"}]}))
    assert [s["scenario_id"] for s in config.scenarios(str(folder))] == ["s", "t"]
    (folder / "u.json").write_text(json.dumps({"scenarios": [{**one, "scenario_id": "u", "required_claim_ids_for_fit": ["c"]}]}))
    with pytest.raises(ValueError, match="without an app"):
        config.scenarios(str(folder))


def test_points_go_by_identity_and_by_reference(spark):
    rows = [("p1", "s", "t1_a", "r1", ["t3_x"]), ("p2", "s", "t1_b", "r1", ["t1_a", "t3_x"]), ("p3", "s", "t1_a", "r2", ["t1_a"]), ("p4", "other", "t1_a", "r1", ["t1_a"]), ("p5", "s", "t1_c", "r1", [])]
    points = spark.createDataFrame(rows, "id string, snapshot_id string, message_fullname string, source_revision_id string, context_message_refs array<string>")
    given = lambda *r: spark.createDataFrame(list(r), "message_fullname string, source_revision_id string, unit_id string")
    after, counts = dense.delete_points(points, given(("t1_a", "r1", None), ("t1_a", "r1", None), ("t1_c", None, "p9")), "s")
    assert counts.first().asDict() == {"requested": 2, "deleted": 1, "context_deleted": 2, "before": 5, "after": 2} and {r["id"] for r in after.collect()} == {"p4", "p5"} and after.columns == points.columns
    assert dense.delete_points(after, given(("t1_a", "r1", None)), "s")[1].first()["deleted"] == 0
    assert dense.delete_points(points, given(("t1_c", None, "p5")), "s")[1].first()["deleted"] == 1
    for bad in (points.drop("context_message_refs"), points.withColumn("context_message_refs", F.lit(None).cast("array<string>"))):
        with pytest.raises(Exception, match="references"):
            dense.delete_points(bad, given(("t1_a", None, None)), "s")[1].collect()
    for bad in (("", None, None), ("t1_a", "", None), (None, None, None)):
        with pytest.raises(Exception, match="empty field"):
            dense.delete_points(points, given(bad), "s")[1].collect()
    with pytest.raises(ValueError):
        dense.delete_points(points, given(("t1_a", None, None)), " ")


def test_threads_are_capped_only_if_asked(spark):
    rows = spark.createDataFrame([(k, f"t{k % 2}" if k < 9 else None) for k in range(12)], "rank int, thread_fullname string")
    assert messages.thread_cap(rows).count() == 12 and messages.thread_cap(rows, 2).count() == 4 + 3
    with pytest.raises(ValueError):
        messages.thread_cap(rows, 0)


@pytest.mark.parametrize("small", [0, 100_000])
def test_one_order_over_many_ranges(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL", small)
    rows = spark.createDataFrame([(k * 7919 % 1000, k % 5) for k in range(1000)], "k int, n int").repartition(6)
    got = {r["k"]: (r["place"], r["total"]) for r in ordering.running_total(ordering.numbered(rows, ["k"], "place"), ["k"], F.col("n"), "total").collect()}
    n, total = {r["k"]: r["n"] for r in rows.collect()}, 0
    for place, k in enumerate(sorted(n), 1):
        total += n[k]
        assert got[k] == (place, total)
    assert ordering.numbered(rows.limit(0), ["k"], "place").collect() == []


@pytest.mark.parametrize("few", [0, 7, 100_000])
def test_groups_are_filled_as_by_a_plain_walk(spark, monkeypatch, few):
    import random

    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(ordering, "SMALL", few)
    r = random.Random(few)
    for target, sizes in ((40, [r.randint(1, 9) for _ in range(60)]), (5, [9, 1, 2, 3]), (0, [1, 2]), (100, [3, 4]), (30, [20, 25, 6, 9, 3, 1, 5])):
        rows = [(f"{r.random():.9f}", f"g{k}", n) for k, n in enumerate(sizes)]
        want, n = [], 0
        for _, g, tasks in sorted(rows):
            if n < target and (n + tasks <= target or not want):
                want.append(g)
                n += tasks
        got = similarity._filled(spark.createDataFrame(rows, "key string, group_id string, tasks bigint").repartition(3), target)
        assert sorted(x["group_id"] for x in got.collect()) == sorted(want)


def test_sides_alternate(spark):
    pool = spark.createDataFrame([(f"p{k}", k, k >= 3) for k in range(8)], "pool_id string, pool_order int, is_control boolean")
    assert [r["pool_id"] for r in pooling.interleaved(pool).orderBy("card_order").collect()] == ["p0", "p3", "p1", "p4", "p2", "p5", "p6", "p7"]
    assert sorted(r["card_order"] for r in pooling.interleaved(pool, 3).collect()) == list(range(1, 9))


def test_checksums_of_files(spark, tmp_path):
    import hashlib

    for n in (1, 5000):
        (tmp_path / f"f{n}").write_bytes(b"x" * n)
    paths = [str(tmp_path / "f1"), str(tmp_path / "f5000")]
    assert archive.checksums(spark, paths) == {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths} and archive.checksums(spark, []) == {}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        publish.shared_folder(session)
