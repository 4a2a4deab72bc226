import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import models, state
from lodestar.plans import pipelines, publish
from lodestar.sources import archive


@pytest.fixture
def dump(spark, tmp_path):
    rows = [{"name": f"t3_{k}", "title": f"Expense {k}", "selftext": "bank sync" if k % 2 else "nothing", "subreddit": "r", "permalink": "/p", "created_utc": k} for k in range(20)]
    (tmp_path / "rs.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "bad\n" + json.dumps({**rows[1], "permalink": None}) + "\n")
    return archive.register(spark, [{"source_id": "s", "path": str(tmp_path / "rs.jsonl"), "source_kind": "submission"}])


RULES = {"money": [["expense"], ["bank"]]}


def test_discovery_to_search_to_deletion(spark, dump, tmp_path):
    ledger = spark.createDataFrame([("t3_1", None, "asked")], "message_fullname string, source_revision_id string, reason string")
    out = f"{tmp_path}/run"
    m = pipelines.discovery(spark, dump, RULES, 5, 7, out, ledger)
    assert m["scan_complete"] and m["counts"] == {"lines": 22, "quarantined": 1, "rejected": 1, "tombstoned": 1, "matched": 9, "selected": 5, "threads": 5}
    assert pipelines.discovery(spark, dump, RULES, 5, 7, out, ledger) == m
    with pytest.raises(ValueError, match="another run"):
        pipelines.discovery(spark, dump, RULES, 6, 7, out, ledger)
    assert publish.published(spark, f"{out}/worksheet").where("review_status = 'pending'").count() == 5
    selected = publish.published(spark, f"{out}/selection")
    pipelines.build_corpus(selected, selected.limit(0), "s1", f"{tmp_path}/corpus")
    with pytest.raises(ValueError, match="budget"):
        pipelines.build_corpus(selected, selected.limit(0), "s1", f"{tmp_path}/other", max_bytes=10)
    found = pipelines.lexical_scenarios(spark, f"{tmp_path}/corpus", [{"scenario_id": "x", "lexical_queries": ["bank", "expense", "zzz"]}])
    assert found.count() == 0 or found.where("position = 1").count() == 1
    name = selected.first()["fullname"]
    gone = spark.createDataFrame([(name, None, "asked")], ledger.schema)
    first = pipelines.delete(spark, f"{tmp_path}/corpus", gone, "s1", f"{tmp_path}/corpus2")
    assert first["published"] and first["counts"]["deleted"] == 1 and publish.published(spark, f"{tmp_path}/corpus2/units").count() == 4
    assert not pipelines.delete(spark, f"{tmp_path}/corpus2", gone, "s1", f"{tmp_path}/corpus3")["published"]
    empty = spark.createDataFrame([], "identity string, scope string, records bigint, status string, observed bigint, deleted bigint, attempts bigint, claimed_at string, updated_at string, error string")
    box = state.register(empty, spark.createDataFrame([("i", "x", 1)], "identity string, scope string, records bigint"), "1")
    done, _ = pipelines.operate(spark, box, f"{tmp_path}/corpus", gone, "s1", f"{tmp_path}/corpus4", "2")
    assert [(r["status"], r["deleted"]) for r in done.collect()] == [("applied", 1)]
    failed, told = pipelines.operate(spark, box, f"{tmp_path}/corpus", gone.union(gone), "s1", f"{tmp_path}/corpus5", "2")
    assert failed.first()["status"] == "failed" and "duplicate" in told["error"]
    assert pipelines.package(spark, [f"{out}/selection", f"{out}/cards"], f"{tmp_path}/pack") == {"selection": 5, "cards": 5}


def thread(k):
    """A submission, a comment on it, and an answer to that, as raw records."""
    common = {"subreddit": "r", "permalink": "/p", "created_utc": k}
    first = {"name": f"t3_{k}", "title": f"Expense {k}", "selftext": "bank sync" if k % 3 == 0 else "nothing", **common}
    return first, [{"name": f"t1_{k}{c}", "link_id": f"t3_{k}", "parent_id": p, "body": f"answer {c} of {k}", **common} for c, p in (("a", f"t3_{k}"), ("b", f"t1_{k}a"))]


@pytest.fixture
def month(spark, tmp_path):
    """Two archives of 40 threads; some lines are bad, some names repeat with other texts."""
    import zstandard

    posts, comments = zip(*(thread(k) for k in range(40)), strict=True)
    lines = [json.dumps(r) for r in posts] + ["bad"] + [json.dumps({**posts[k], "selftext": "again bank"}) for k in range(0, 40, 4)]
    answers = [json.dumps(r) for rs in comments for r in rs] + ["[1]", json.dumps({**comments[3][0], "body": None})] + [json.dumps({**comments[k][0], "body": "edited"}) for k in range(0, 40, 5)]
    pack = lambda xs, n: b"".join(zstandard.ZstdCompressor().compress("".join(x + "\n" for x in xs[k : k + n]).encode()) for k in range(0, len(xs), n))
    (tmp_path / "rs.jsonl").write_text("".join(x + "\n" for x in lines))
    (tmp_path / "rc.jsonl.zst").write_bytes(pack(answers, 7))
    return archive.register(spark, [{"source_id": "rs", "path": f"{tmp_path}/rs.jsonl", "source_kind": "submission"}, {"source_id": "rc", "path": f"{tmp_path}/rc.jsonl.zst", "source_kind": "comment", "source_role": "context_only"}])


def test_hydration_that_is_killed_goes_on(spark, month, tmp_path):
    """Stopped after half of its batches and started again: the same rows as one run, which are those of the operator on whole tables."""
    from lodestar.operators import context, messages

    selected = spark.createDataFrame([(f"t3_{k}", f"t3_{k}") for k in range(0, 40, 3)], "fullname string, thread_fullname string")
    ledger = spark.createDataFrame([("t1_3a", None, "asked"), ("t1_6b", "0" * 64, "asked")], "message_fullname string, source_revision_id string, reason string")
    args = (spark, month, selected, 12, 9, 5)
    whole = pipelines.hydration(*args, f"{tmp_path}/one", ledger, units_at_once=1, unit_bytes=1500)
    seen = []

    def cut(number):
        seen.append(number)
        if len(seen) == 3:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        pipelines.hydration(*args, f"{tmp_path}/two", ledger, units_at_once=1, unit_bytes=1500, each_batch=cut)
    assert publish.read_manifest(spark, f"{tmp_path}/two/context") is None
    again = pipelines.hydration(*args, f"{tmp_path}/two", ledger, units_at_once=1, unit_bytes=1500, each_batch=seen.append)
    assert seen[2:4] == [2, 2] and len(seen) == len(set(seen)) + 1 and again["complete"] and again["sources"] == whole["sources"]
    key = lambda folder: sorted(map(str, publish.published(spark, folder).collect()))
    assert all(key(f"{tmp_path}/one/{n}") == key(f"{tmp_path}/two/{n}") for n in ("context", "controls"))
    normal = messages.valid(messages.normalize(archive.quarantined(archive.scan(spark, month)).where("problem IS NULL")))
    want = context.hydrate(normal, selected, ledger, 12, 9, 5)
    for kind, folder in (("context", "context"), ("control", "controls")):
        plain = want.where(F.col("class") == kind).drop("class")
        assert sorted(map(str, plain.select(sorted(plain.columns)).collect())) == sorted(map(str, publish.published(spark, f"{tmp_path}/one/{folder}").select(sorted(plain.columns)).collect()))
    counts = whole["sources"]
    assert sum(counts["rs"].values()) == 51 and sum(counts["rc"].values()) == 90 and counts["rs"]["quarantined"] == 1 and counts["rc"]["rejected"] == 1 and counts["rc"]["tombstoned"] == 1
    assert whole["context_from_context_only"] == counts["rc"]["context"] and pipelines.hydration(*args, f"{tmp_path}/two", ledger)["run_id"] == again["run_id"]


def test_hydration_withholds_its_shards_at_a_cap(spark, month, tmp_path):
    selected = spark.createDataFrame([("t3_0", "t3_0")], "fullname string, thread_fullname string")
    told = pipelines.hydration(spark, month, selected, 5, 5, 1, f"{tmp_path}/h", max_records=100, units_at_once=1, unit_bytes=1500)
    assert not told["complete"] and told["withheld"] == ["context", "controls"] and publish.read_manifest(spark, f"{tmp_path}/h/context") is None
    assert not pipelines.hydration(spark, month, selected, 5, 5, 1, f"{tmp_path}/h", max_records=100, units_at_once=1, unit_bytes=1500)["complete"]
    assert pipelines.hydration(spark, month, selected, 5, 0, 1, f"{tmp_path}/i", max_records=139)["complete"]
    assert publish.published(spark, f"{tmp_path}/i/controls").count() == 0 and publish.published(spark, f"{tmp_path}/i/context").count() == 2


def test_discovery_that_is_killed_goes_on(spark, month, tmp_path):
    whole = pipelines.discovery(spark, month, RULES, 6, 7, f"{tmp_path}/one", units_at_once=1, unit_bytes=1500)
    seen = []

    def cut(number):
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        pipelines.discovery(spark, month, RULES, 6, 7, f"{tmp_path}/two", units_at_once=1, unit_bytes=1500, each_batch=cut)
    assert pipelines.discovery(spark, month, RULES, 6, 7, f"{tmp_path}/two", units_at_once=1, unit_bytes=1500)["counts"] == whole["counts"]
    rows = lambda n: sorted(map(str, publish.published(spark, f"{tmp_path}/{n}/selection").collect()))
    assert rows("one") == rows("two") and whole["counts"]["lines"] == 141
    capped = pipelines.discovery(spark, month, RULES, 6, 7, f"{tmp_path}/three", max_records=10_000)
    assert capped["scan_complete"] and capped["counts"] == whole["counts"] and rows("three") == rows("one")


def test_hydrated_context_gets_into_the_units(spark, month, tmp_path):
    from lodestar.operators import messages

    every = messages.valid(messages.normalize(archive.quarantined(archive.scan(spark, month)).where("problem IS NULL")))
    one = messages.one_per_name(every, [F.col("provenance")[0]["source_id"], F.col("provenance")[0]["line_number"]])
    selected, hydrated = publish.written(one.where("fullname = 't1_1b'")), publish.written(one.where("fullname IN ('t1_1a', 't3_1')"))
    first = pipelines.build_corpus(selected, hydrated, "s1", f"{tmp_path}/c1")
    u = publish.published(spark, f"{tmp_path}/c1/units").first()
    assert u["context_complete"] and u["context_message_refs"] == ["t3_1", "t1_1a"] and u["missing_context_ids"] == []
    assert u["context_text"] == "[SUBMISSION t3_1]\nExpense 1\nnothing\n\n[COMMENT t1_1a]\nanswer a of 1\n\n[FOCUS COMMENT t1_1b]\nanswer b of 1"
    gone = spark.createDataFrame([("t1_1a", None, "asked")], "message_fullname string, source_revision_id string, reason string")
    second = pipelines.build_corpus(selected, hydrated, "s1", f"{tmp_path}/c2", gone)
    v = publish.published(spark, f"{tmp_path}/c2/units").first()
    assert second["run_id"] != first["run_id"] and not v["context_complete"] and v["missing_context_ids"] == ["t1_1a"] and "answer a" not in v["context_text"]
    with pytest.raises(ValueError, match="another run"):
        pipelines.build_corpus(selected, hydrated, "s1", f"{tmp_path}/c1", gone)
    edited = hydrated.withColumn("raw_body", F.concat("raw_body", F.lit("!")))
    with pytest.raises(ValueError, match="another run"):
        pipelines.build_corpus(selected, edited, "s1", f"{tmp_path}/c1")
    assert pipelines.build_corpus(selected, hydrated, "s1", f"{tmp_path}/c1") == first
    assert pipelines.delete(spark, f"{tmp_path}/c1", gone, "s1", f"{tmp_path}/c3")["counts"]["matched"] == 1  # found by its context reference
    for bad, why in ((selected.limit(0), "empty"), (selected.union(selected), "twice")):
        with pytest.raises(ValueError, match=why):
            pipelines.build_corpus(bad, hydrated, "s1", f"{tmp_path}/c4")


def test_audits_are_bound_to_the_content_of_their_inputs(spark, tmp_path):
    keys = "fullname string, revision string, thread string, text string"
    archived = lambda name: spark.createDataFrame([("s", 1, name, "r", "t", "x")], f"source_id string, line bigint, {keys}")
    units = spark.createDataFrame([("u", "n", "r", "t", "x")], f"unit_id string, {keys}")
    exposures = spark.createDataFrame([("e", "u", None, None, None, None)], "exposure_id string, candidate_id string, message_fullname string, source_revision_id string, thread_fullname string, focus_text string")
    status = lambda folder: publish.published(spark, f"{folder}/matches").first()["status"]
    pipelines.exposure_audit(archived("other"), units, exposures, f"{tmp_path}/a")
    assert status(f"{tmp_path}/a") == "unresolved"
    with pytest.raises(ValueError, match="another run"):
        pipelines.exposure_audit(archived("n"), units, exposures, f"{tmp_path}/a")
    pipelines.exposure_audit(archived("n"), units, exposures, f"{tmp_path}/b", partitioned=True)
    assert status(f"{tmp_path}/b") == "matched"


def test_a_capped_scan_says_so(spark, dump, tmp_path):
    m = pipelines.discovery(spark, dump, RULES, 50, 7, f"{tmp_path}/run", max_records=6)
    assert not m["scan_complete"] and m["counts"]["selected"] == 3


def test_comparison(spark):
    b = spark.createDataFrame([(f"c{k}", n, r, 1.0) for n, s in (("lexical", 0), ("dense", 3)) for r, k in enumerate(range(s, s + 6), 1)], "candidate_id string, branch string, rank int, score double")
    score = F.substring("candidate_id", 2, 3).cast("double")
    runs, cost = pipelines.compare(b, score, lambda r: b.where("branch = 'dense'").select("candidate_id", "rank"), output=3)
    got = {}
    for r in runs.orderBy("variant", "rank").collect():
        got.setdefault(r["variant"], []).append(r["candidate_id"])
    assert got == {"A": ["c0", "c1", "c2"], "B": ["c8", "c7", "c6"], "C": ["c8", "c7", "c6"]} and set(cost) == {"A", "B", "C"}
    with pytest.raises(ValueError, match="test split"):
        pipelines.compare(b, score, split="test")
    with pytest.raises(ValueError, match="lexical"):
        pipelines.candidates(b.where("branch = 'dense'"))
    blocked = spark.createDataFrame([("c3",)], "candidate_id string")
    assert pipelines.candidates(b, blocked).where("candidate_id = 'c3'").count() == 0


def test_models(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id long, text string")
    got = models.embed(rows, models.hash_encoder(), 8, instruction="q: ").collect()
    assert len(got) == 3 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in got)
    with pytest.raises(Exception, match="bad vector"):
        models.embed(rows, lambda: lambda texts: [[0.0] * 8 for _ in texts], 8).collect()
    overlap = models.scorer(lambda: lambda q, t: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, t, strict=True)])
    assert spark.range(1).select(overlap(F.lit("a b"), F.lit("b a c"))).first()[0] == 2.0
    assert spark.range(1).select(models.yes_no_score(F.lit(0.0), F.lit(0.0))).first()[0] == 0.5
    t = pipelines.Telemetry()
    t.observe("rows", 3)
    assert t.report(["rows", "gpu"]) == {"rows": 3, "gpu": None} and pipelines.doctor(spark)["spark"]
