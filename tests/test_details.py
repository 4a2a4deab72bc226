"""Operators that the queries don't reach, or whose refusals they don't show."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import audit, dense, labels, lexical, messages, pooling, review, state, tombstones


def test_projection_and_references(spark):
    led = spark.createDataFrame([("t3_a", None, "x"), ("t3_a", "r", "x")], "message_fullname string, source_revision_id string, reason string")
    assert tombstones.projection(led).count() == 2
    with pytest.raises(Exception, match="duplicate tombstone"):
        tombstones.projection(led.union(led)).collect()
    ctx = "struct<context_message_refs:array<string>,context:struct<message_fullnames:array<string>>>"
    rows = spark.createDataFrame([((["a"], (["b"],)), (None, (["a", "c"],))), ((None, (None,)), (None, (None,)))], f"row {ctx}, source {ctx}")
    got = rows.select(tombstones.row_references(F.col("row"), F.col("source")).alias("r"), tombstones.has_structured_context(F.col("row"), F.col("source")).alias("h")).collect()
    assert [(r["r"], r["h"]) for r in got] == [(["a", "b", "c"], True), ([], False)]


def test_unit_scoped_tombstones_delete_one_unit_but_scrub_all(spark):
    u = spark.createDataFrame([("u1", "s", "t3_a", "r", "", "", [], [], True), ("u2", "s", "t3_a", "r", "", "", [], [], True), ("u3", "s", "t1_b", "r", "[SUBMISSION t3_a]\nx", "[SUBMISSION t3_a]\nx\n\n[FOCUS COMMENT t1_b]\ny", [], ["t3_a"], True)], "unit_id string, snapshot_id string, message_fullname string, source_revision_id string, context_only_text string, context_text string, missing_context_ids array<string>, context_message_refs array<string>, context_complete boolean")
    t = spark.createDataFrame([("t3_a", None, "u1")], "message_fullname string, source_revision_id string, unit_id string")
    after, counts = tombstones.apply_tombstones(u, t, "s")
    got = {r["unit_id"]: r for r in after.collect()}
    assert set(got) == {"u2", "u3"} and got["u3"]["context_text"] == "[FOCUS COMMENT t1_b]\ny" and got["u3"]["missing_context_ids"] == ["t3_a"] and got["u3"]["context_message_refs"] == []
    assert counts.first().asDict() == {"matched": 2, "deleted": 1, "scrubbed": 1, "idempotent": False}
    assert tombstones.apply_tombstones(u, t, "other")[1].first()["matched"] == 0


def test_state_refusals(spark):
    claims = spark.createDataFrame([("a", True)], "claim_id string, synthetic boolean")
    with pytest.raises(Exception, match="synthetic"):
        state.refuse_synthetic(claims).collect()
    with pytest.raises(Exception, match="unknown status"):
        state.status_counts(spark.createDataFrame([("odd",)], "status string")).collect()
    box = spark.createDataFrame([("a", "s", 1, "applied", 1, 2), ("b", "s", 1, "odd", None, None), ("c", "s", 1, "applied", None, None)], "identity string, scope string, records bigint, status string, observed bigint, deleted bigint").withColumn("error", F.lit(None).cast("string"))
    assert [r["problem"] for r in state.inventory(box).orderBy("identity").collect()] == ["deleted_more_than_observed", "status", "applied_without_counts"]
    assert state.source_status(spark.createDataFrame([], "status string")).first()[0] == "partial"


def test_sessions(spark):
    rows = [("a", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", None), ("b", "x", "2026-01-02T00:00:00Z", None), ("c", "2026-01-03T00:00:00Z", "2026-01-02T00:00:00Z", None), ("d", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "2026-01-01T12:00:00Z")]
    got = review.session_problems(spark.createDataFrame(rows, "session_id string, started_at string, updated_at string, completed_at string"))
    assert [r["problem"] for r in got.orderBy("session_id").collect()] == [None, "bad_start", "bad_update", "bad_completion"]


def test_vectors_join_their_units(spark):
    u = spark.createDataFrame([("u1", ["a"])], "unit_id string, context_message_refs array<string>")
    p = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert dense.migrated(p("u1"), u).collect() == [("u1", ["a"])]
    with pytest.raises(Exception, match="no unit for vector"):
        dense.migrated(p("u1", "u2"), u).collect()
    with pytest.raises(Exception, match="appeared"):
        dense.deletion_counts(p("u1"), p("u1", "u2")).collect()
    jobs = spark.createDataFrame([("s", "r", "u1", "h", "pending")], "snapshot_id string, recipe_hash string, unit_id string, content_hash string, status string")
    after = dense.mark(jobs, jobs.select("unit_id", "content_hash"), "s", "r", "indexed")
    units = spark.createDataFrame([("u1", "s", "h"), ("u2", "s", "h")], "unit_id string, snapshot_id string, content_hash string")
    assert {(r["unit_id"], r["reason"]) for r in dense.pending(units, after, "s", "r").collect()} == {("u2", "new")}


def test_label_and_pool_refusals(spark):
    sheet = spark.createDataFrame([("a", None, "done", "what", "clear")], "candidate_id string, scenario_id string, review_status string, topic_fit string, need_clarity string")
    with pytest.raises(Exception, match="unknown answer"):
        labels.from_worksheet(sheet).collect()
    rows = spark.createDataFrame([("a", False, "", None, None)], "candidate_id string, is_control boolean, focus_text string, raw_body string, raw_title string")
    with pytest.raises(Exception, match="no full text"):
        pooling.source_text(rows).collect()
    q = spark.createDataFrame([("a", 1), ("b", 1)], "candidate_id string, queue_order bigint")
    with pytest.raises(Exception, match="stands twice"):
        review.worksheet(q).collect()
    m = spark.createDataFrame([("unresolved", 1)], "status string, archive_matches bigint")
    with pytest.raises(Exception, match="has matches"):
        audit.derived_coverage(m).collect()
    for call in (lambda: pooling.blinded_pool(q, q, 0, 1), lambda: review.balanced_queue(q, 0), lambda: messages.top_by_hash(q, -1, 1, "candidate_id"), lambda: lexical.bm25(q, "a", 1, 1.0, (3.0, 1.0))):
        with pytest.raises(ValueError):
            call()


def test_blocked_units_stay_out_of_the_index(spark):
    u = spark.createDataFrame([("s", "u1"), ("s", "u2")], "snapshot_id string, unit_id string")
    assert lexical.index_units(u, None, u.limit(1)).count() == 1


def test_folding_leaves_plain_texts_to_spark(spark):
    """Equal to the library's folding for every letter, alone and beside others; texts of Latin letters never reach Python."""
    import unicodedata

    from lodestar.functions import text

    letters = [chr(k) for k in [*range(0x3000), *range(0x3041, 0x3100), *range(0xAC00, 0xAC40), *range(0xF900, 0xFA00), *range(0xFB00, 0x10000)] if unicodedata.category(chr(k)) != "Cn"]
    texts = [None, "", "Straße", "ΟΔΟΣ x", "é", "\u1100\u1161", "가\u11a8", *letters, *[f"aB{c}ñ\u0301" for c in letters[:0x600]]]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3).select("t", text.fold(F.col("t")).alias("f")).collect()
    assert all(r["f"] == unicodedata.normalize("NFKC", r["t"] or "").casefold() for r in rows) and len(rows) == len(texts)

    sent = spark.sparkContext.accumulator(0)

    @F.arrow_udf("string")
    def counted(c):
        sent.add(len(c) - c.null_count)
        return c

    kept, text._folded = text._folded, counted
    try:
        got = spark.createDataFrame([("Über die Straße, señor",), ("‘quoted’ – text",), ("ﬁ",)], "t string").select(text.fold(F.col("t"))).collect()
    finally:
        text._folded = kept
    assert sent.value == 1 and got[0][0] == "über die strasse, señor"


def test_texts_are_cut_in_pieces(spark, monkeypatch):
    """Pieces of few bytes give the same chunks, and no batch holds more than a piece."""
    from lodestar.operators import units

    rows = [(f"t3_{i}", "submission", "", "word " * (i % 7 * 20) + "\nnext line") for i in range(300)]
    m = spark.createDataFrame(rows, "fullname string, kind string, raw_title string, raw_body string").coalesce(1)
    want = sorted((n, a, b) for n, _, _, body in rows for a, b in units.chunk_spans(body, 16, 4))
    monkeypatch.setattr(units, "PIECE", 2000)
    cut = units.chunks(m, 16, 4)
    assert sorted((r["fullname"], r["focus_start"], r["focus_end"]) for r in cut.collect()) == want
    batch = pa.RecordBatch.from_pydict({"fullname": [r[0] for r in rows], "field": ["selftext"] * 300, "text": [r[3] for r in rows]})
    pieces = list(units.cutter(16, 4)(iter([batch])))
    assert sum(p.num_rows for p in pieces) == len(want) and max(p.nbytes for p in pieces) < 8000


def test_postings_are_made_without_a_shuffle(spark):
    u = spark.createDataFrame([("u1", "b a b, c B", "a x"), ("u2", "", None), ("u3", None, "Z")], "unit_id string, focus_text string, context_only_text string")
    post = lexical.postings(u)
    got = sorted((r["unit_id"], r["column"], r["term"], r["positions"], r["length"]) for r in post.collect())
    f, c = "focus_text", "context_only_text"
    assert got == sorted([("u1", f, "a", [1], 7), ("u1", f, "b", [0, 2, 4], 7), ("u1", f, "c", [3], 7), ("u1", c, "a", [0], 7), ("u1", c, "x", [1], 7), ("u3", c, "z", [0], 1)])
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
