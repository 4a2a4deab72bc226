import itertools
import random

import pytest

from lodestar.operators import graph, metrics, similarity, tombstones


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(1)
    base = [[f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 60))] for _ in range(12)]
    texts = []
    for k in range(120):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = "other"
        texts.append((f"c{k:03}", " ".join(w)))
    s = similarity.shingled(spark.createDataFrame(texts, "candidate_id string, text string"))
    sets = {r["id"]: set(r["shingles"]) for r in s.collect()}
    got = {(r["a"], r["b"]) for r in similarity.prefix_pairs(s, s, 0.6, same=True).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_one_more_word_is_near(spark):
    w = [chr(97 + k) for k in range(23)]
    e = similarity.duplicate_edges(spark.createDataFrame([("1", " ".join(w)), ("2", " ".join([*w, "x"])), ("3", " ".join(w).upper()), ("4", "too short")], "candidate_id string, text string"))
    assert {(r["a"], r["b"], r["relation"]) for r in e.collect()} == {("1", "3", "exact_text"), ("1", "2", "near_duplicate")}


def test_components(spark):
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(90)] + [("z", "y"), ("q", "q")], "a string, b string")
    nodes = spark.createDataFrame([(f"n{k:03}",) for k in range(95)] + [("y",)], "node string")
    got = {r["node"]: r["root"] for r in graph.components(nodes, edges).collect()}
    assert all(got[f"n{k:03}"] == "n000" for k in range(91)) and got["n093"] == "n093" and got["y"] == "y"


@pytest.mark.parametrize(("sizes", "fraction", "taken"), [([3, 4, 1], 0.5, {0, 2}), ([9, 1, 1], 0.1, {0}), ([1, 1, 1, 2], 0.5, {0, 1})])
def test_greedy_fill(spark, sizes, fraction, taken, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(similarity, "stable_rank", lambda seed, *parts: F.col("group_id"))
    rows = [(f"c{g}_{k}", f"g{g}") for g, n in enumerate(sizes) for k in range(n)]
    grouped = spark.createDataFrame(rows, "candidate_id string, group_id string")
    split = similarity.group_split(grouped.select("candidate_id"), grouped, 1, fraction)
    assert {int(r["group_id"][1:]) for r in split.where("split = 'test'").collect()} == taken and similarity.crossing_groups(split).count() == 0


def test_group_names(spark):
    pool = spark.createDataFrame([("c1", "t"), ("c2", "t"), ("c3", None)], "candidate_id string, thread_fullname string")
    none = spark.createDataFrame([], "a string, b string")
    got = {r["candidate_id"]: (r["group_id"], r["group_size"]) for r in similarity.groups(pool, none).collect()}
    assert got["c1"] == got["c2"] == ("group-304ead38a1702653", 2) and got["c3"][1] == 1


A, B, F_ = "[SUBMISSION t3_a]\nroot", "[COMMENT t1_b]\nreply", "[FOCUS COMMENT t1_f]\nmine"


@pytest.mark.parametrize(("blocks", "gone", "keep", "want"), [
    ([A, B, F_], {"t1_b"}, True, [A, F_]), ([A, "more of a", B], {"t3_a"}, False, [B]), ([A, "more of a", B], {"t1_b"}, False, [A, "more of a"]), (["nobody's", A], {"t1_x"}, False, [A]),
    ([A, "[FOCUS COMMENT t1_zz]\nfake", B, F_], {"t1_b"}, True, [A, "[FOCUS COMMENT t1_zz]\nfake", F_]), ([A, F_, "after", B], {"t1_b"}, True, [A, F_]), ([A, F_], {"t3_a"}, False, []), ([], {"t3_a"}, True, []),
])
def test_scrubbing(blocks, gone, keep, want):
    assert tombstones.scrub("\n\n".join(blocks), gone, keep, "t1_f") == "\n\n".join(want)


def test_metrics_golden(spark):
    run = spark.createDataFrame([(f"c{k}", "s", k, k, True) for k in range(1, 7)], "candidate_id string, scenario_id string, rank int, position int, context_complete boolean")
    labels = spark.createDataFrame([("c2", "yes"), ("c4", "yes"), ("c5", "no"), ("c1", "unknown")], "candidate_id string, topic_fit string").selectExpr("*", "'human' AS evaluator_kind", "CAST(NULL AS string) AS scenario_id", "'v' AS evaluator_version")
    pool = run.select("candidate_id", "scenario_id")
    (m,) = metrics.scenario_metrics(run, metrics.judgements(labels, pool), pool).collect()
    assert (m["returned"], m["judged"], m["relevant"], m["unjudged"], m["judgement_coverage"], m["pool_recall"], m["reciprocal_rank"]) == (6, 3, 2, 3, 0.5, 1.0, 0.5)
    assert m["precision_judged"] == pytest.approx(2 / 3) and m["precision_returned"] is None and m["precision_slots"] is None
    with pytest.raises(Exception, match="contradicting"):
        metrics.judgements(labels.unionByName(labels.limit(1).selectExpr("'c2' AS candidate_id", "'no' AS topic_fit", "evaluator_kind", "scenario_id", "evaluator_version")), pool).collect()


@pytest.mark.parametrize("each", [20, 0])
def test_pairs_and_links_against_all_pairs(spark, monkeypatch, each):
    """Near copies in clusters and a common passage: the pairs are those of a plain comparison, and links connect the same texts with fewer of them."""
    monkeypatch.setattr(similarity, "PAIRS_EACH", each)
    monkeypatch.setattr(similarity, "COMMON", 3)
    r = random.Random(each)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(30)]
    texts = {}
    for c in range(6):
        base = [word() for _ in range(300)]
        for k in range(8):
            w = [*base, *common]
            w[r.randrange(300)] = word()
            texts[f"c{c}_{k}"] = " ".join(w)
    for k in range(30):
        texts[f"x{k:02d}"] = " ".join([word() for _ in range(r.randint(20, 80))] + common)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9}
    s = similarity.written(similarity.shingled(spark.createDataFrame(list(texts.items()), "candidate_id string, text string")))
    assert {(x["a"], x["b"]) for x in similarity.near_pairs(s).collect()} == want and len(want) > 100
    links = {(x["a"], x["b"]) for x in similarity.near_links(s).collect()}

    def groups(edges):
        root = {i: i for i in texts}
        for _ in texts:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert links <= want and groups(links) == groups(want) and (each or len(links) < len(want) / 2)
    p, d = s.where("id LIKE 'c0%'"), s.where("id LIKE 'c%' AND id NOT LIKE '%_0'")
    assert {(x["a"], x["b"]) for x in similarity.prefix_pairs(p, d).collect()} == {(a, b) for a, b in want | {(b, a) for a, b in want} | {(a, a) for a in texts} if a.startswith("c0") and b.startswith("c") and not b.endswith("_0")}


def _moved(spark, run):
    """(what run returns, bytes that it shuffled and wrote)."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        listed = store.stageList(spark._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in map(listed.apply, range(listed.size()))}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(v for k, v in total().items() if k not in before)


def _texts_with_a_common_passage(n):
    """Texts of 300 words, 40 of which they all share; every tenth has a near copy."""
    r = random.Random(4)
    shared = [f"c{k}" for k in range(40)]
    out = []
    for i in range(n):
        words = [str(r.randrange(10**6)) for _ in range(130)] + shared + [str(r.randrange(10**6)) for _ in range(130)]
        out.append((f"d{i}", " ".join(words)))
        if i % 10 == 0:
            out.append((f"e{i}", " ".join(words[:-2])))
    return out


def test_near_duplicates_move_little_where_all_texts_share_a_passage(spark):
    texts = _texts_with_a_common_passage(600)
    pool = similarity.written(spark.createDataFrame(texts, "candidate_id string, text string").repartition(4))
    edges, moved = _moved(spark, lambda: similarity.duplicate_edges(pool, unicode=False).collect())
    assert {(x["a"], x["b"]) for x in edges} == {(f"d{i}", f"e{i}") for i in range(0, 600, 10)}
    assert moved < 5 * sum(len(t) for _, t in texts)


def test_exposure_moves_only_shingles_of_development_texts(spark):
    texts = _texts_with_a_common_passage(300)
    pool = similarity.written(spark.createDataFrame(texts, "candidate_id string, text string").repartition(4))
    development = spark.createDataFrame([("x", texts[0][1]), ("y", " ".join(texts[50][1].split()[:150]))], "id string, text string")
    found, moved = _moved(spark, lambda: similarity.exposed(pool, development, unicode=False, threshold=0.3).collect())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in [*texts, ("x", texts[0][1]), ("y", " ".join(texts[50][1].split()[:150]))]}
    assert {x["candidate_id"] for x in found} == {i for i, _ in texts if any(len(sets[i] & sets[d]) / len(sets[i] | sets[d]) >= 0.3 for d in "xy")} and len(found) > 1
    assert moved < sum(len(t) for _, t in texts) + 50_000


def test_shared_shingles_are_moved_once(spark):
    texts = _texts_with_a_common_passage(300)
    pool = similarity.written(spark.createDataFrame(texts, "candidate_id string, text string").repartition(4))
    edges, moved = _moved(spark, lambda: similarity.shared_shingle_edges(pool, unicode=False).collect())
    first = {}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    for i in sorted(sets):
        for s in sets[i]:
            first.setdefault(s, i)
    assert {(x["a"], x["b"]) for x in edges} == {(first[s], i) for i in sets for s in sets[i] if first[s] != i}
    assert moved < 17 * sum(map(len, sets.values()))


def test_texts_of_one_origin_that_are_not_near_move_little(spark):
    """Clusters of which all texts share much, but no two enough: their pairs are settled without moving sets for them."""
    r = random.Random(6)
    texts = []
    for c in range(8):
        base = [str(r.randrange(10**6)) for _ in range(300)]
        for k in range(40):
            words = list(base)
            for i in r.sample(range(300), 4):
                words[i] = str(r.randrange(10**6))
            texts.append((f"c{c}_{k}", " ".join(words)))
        texts.append((f"d{c}", " ".join([*words, "end"])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9}
    pool = similarity.written(spark.createDataFrame(texts, "candidate_id string, text string").repartition(4))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges, moved = _moved(spark, lambda: similarity.duplicate_edges(pool, unicode=False).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    got = {(x["a"], x["b"]) for x in edges}
    assert got <= want and {x for pair in got for x in pair} == {x for pair in want for x in pair} and len(want) >= 8
    assert moved < 5 * sum(len(t) for _, t in texts), moved / sum(len(t) for _, t in texts)


@pytest.mark.parametrize("marks", [1 << 24, 64])
def test_marked_keys(spark, monkeypatch, marks):
    monkeypatch.setattr(similarity, "MARKS", marks)
    rows, keys = spark.range(300).selectExpr("CAST(id AS string) AS id"), spark.range(0, 600, 7).selectExpr("CAST(id AS string) AS id")
    among = {str(k) for k in range(0, 300, 7)}
    assert among <= {x["id"] for x in similarity.maybe(rows, keys, "id").collect()}
    assert {x["id"] for x in similarity._without(rows, keys, "id").collect()} == {str(k) for k in range(300)} - among


def test_parities_keep_all_pairs_at_the_threshold(spark):
    """Sets of all sizes, also around the powers of two at which the bits become more: no pair at the threshold is lost, most pairs far below it are."""
    r = random.Random(9)
    sets, pairs, near = {}, [], {}
    for k, n in enumerate([1, 2, 5, 20, 60, 64, 65, 120, 127, 128, 130, 250, 256, 258, 500, 512, 540, 1000, 1024, 1100, 4090, 4200]):
        sets[f"b{k}"] = {r.randrange(-(2**63), 2**63) for _ in range(n)}
        for j, change in enumerate([0, 0.02, 0.04, 0.05, 0.2]):
            for more in (0, 0.05):
                i, base = f"m{k}_{j}_{more}", sorted(sets[f"b{k}"])
                sets[i] = set(base[int(n * change) :]) | {r.randrange(-(2**63), 2**63) for _ in range(int(n * (change + more)))}
                pairs.append((f"b{k}", i))
                near[pairs[-1]] = len(sets[f"b{k}"] & sets[i]) / len(sets[f"b{k}"] | sets[i])
    s = spark.createDataFrame([(i, list(x), len(x)) for i, x in sets.items()], "id string, shingles array<bigint>, n int")
    left = {(x["a"], x["b"]) for x in similarity._alike(spark.createDataFrame(pairs, "a string, b string"), lambda ids: similarity.maybe(s, ids, "id"), 0.9).collect()}
    assert {p for p in pairs if near[p] >= 0.9} <= left
    far = [p for p in pairs if near[p] < 0.75 and len(sets[p[0]]) >= 120]
    assert far and sum(p in left for p in far) < len(far) / 5
