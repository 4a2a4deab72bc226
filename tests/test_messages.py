import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import nfkc_casefold, nul_joined, seeded_ratio, uuid5, without_marks
from lodestar.operators import messages

SUBMISSION = {"name": "t3_a", "title": "T", "selftext": "B", "subreddit": "r", "permalink": "/p", "created_utc": 1700000000}
COMMENT = {"id": "c", "link_id": "t3_a", "parent_id": "t3_a", "body": "b", "subreddit": "r", "permalink": "/p", "created_utc": 1700000000.0, "score": 3, "depth": 1}


def normal(spark, kind, *payloads):
    lines = [("s", kind, k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads, 1)]
    return messages.normalize(spark.createDataFrame(lines, "source_id string, source_kind string, line_number bigint, raw_line string")).orderBy("provenance").collect()


def test_good_records(spark):
    a, b, c = normal(spark, "submission", SUBMISSION, {**SUBMISSION, "selftext": None}, {k: v for k, v in SUBMISSION.items() if k != "name"} | {"id": "z", "score": 1.5})
    assert a["norm_error"] is None and a["source_revision_id"] == hashlib.sha256(b"T\0B").hexdigest() and a["thread_fullname"] == "t3_a" and a["parent_fullname"] is None
    assert b["raw_body"] == "" and c["fullname"] == "t3_z" and c["archive_score"] == 1.5
    (d,) = normal(spark, "comment", COMMENT)
    assert (d["fullname"], d["thread_fullname"], d["raw_title"], d["created_utc"], d["archive_score"], d["depth"]) == ("t1_c", "t3_a", "", 1700000000, 3.0, 1)


@pytest.mark.parametrize(("change", "word"), [
    ({"created_utc": True}, "created_utc"), ({"created_utc": 1.5}, "created_utc"), ({"created_utc": "1"}, "created_utc"), ({"created_utc": None}, "created_utc"), ({"permalink": None}, "permalink"),
    ({"name": "t1_a"}, "name"), ({"name": "t3_"}, "name"), ({"name": 5}, "name"), ({"title": None}, "title"), ({"selftext": 3}, "selftext"), ({"subreddit": None}, "subreddit"),
    ({"parent_id": "x"}, "parent_id"), ({"score": True}, "score"), ({"score": "3"}, "score"), ({"depth": 1.5}, "depth"), ({"depth": False}, "depth"),
])
def test_bad_records(spark, change, word):
    (r,) = normal(spark, "submission", {**SUBMISSION, **change})
    assert word in r["norm_error"]


def test_what_isn_t_an_object(spark):
    got = normal(spark, "submission", "[1]", "nope", '{"a": NaN}', "3")
    assert {r["norm_error"] for r in got} == {"not an object"}


def test_rules_and_sampling_don_t_depend_on_order(spark):
    rows = [(f"t3_{k}", "Expense", f"bank {k}" if k % 3 else "Straße") for k in range(60)]
    rules = {"money": [["expense", "budget"], ["bank", "sync"]], "none": [["zzz"]]}
    names = []
    for parts, data in ((1, rows), (7, rows[::-1])):
        m = spark.createDataFrame(data, "fullname string, raw_title string, raw_body string").repartition(parts)
        found = messages.discover(m, rules)
        assert found.count() == 40 and found.select("matched_rule_ids").distinct().collect()[0][0] == ["money"]
        names.append([r["fullname"] for r in messages.top_by_hash(found, 10, 5).collect()])
    want = sorted((hashlib.sha256(f"5\0t3_{k}".encode()).hexdigest(), f"t3_{k}") for k in range(60) if k % 3)
    assert names[0] == names[1] == [n for _, n in want[:10]]
    assert messages.top_by_hash(m, 0, 5).count() == 0


def test_identities(spark):
    import unicodedata
    import uuid

    names = ["plain", "é\U0001f642", "a\0b"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u"), nfkc_casefold(F.lit("ﬁ Straße")).alias("f"), without_marks(F.lit("Café")).alias("m")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) and r["f"] == unicodedata.normalize("NFKC", "ﬁ Straße").casefold() and r["m"] == "cafe" for r in got)
    ratio = spark.range(1).select(seeded_ratio(20260912, F.lit("9781d34b-e9f9-5b4b-ac5e-5dbe224b0cb3"), F.lit(""))).first()[0]
    assert round(ratio, 6) == 0.896116
    assert spark.range(1).select(nul_joined(1, F.lit("a"))).first()[0] == "1\0a"


def test_case_folding_is_the_full_one(spark):
    from lodestar.functions.text import casefold

    texts = ["", "Straße STRASSE", "ﬁnden ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "İstanbul ŉ ſ K Å µ", "ꭰᎠ \U00010400 \U0001e900", "ᾳ ᾼ ᾲ ẞ ΐ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(casefold(F.col("t"))).collect()]
    assert got == [t if t is None else t.casefold() for t in texts]
    letters = spark.createDataFrame([(chr(k),) for k in range(0x80, 0x1F000) if not 0xD800 <= k < 0xE000], "c string")
    wrong = [r["c"] for r in letters.select("c", F.lower("c").alias("low"), casefold(F.col("c")).alias("f")).collect() if r["f"] != r["c"].casefold() and r["low"] == r["c"].lower()]
    assert wrong == []  # all letters that the JVM's lower case knows
