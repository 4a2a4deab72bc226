import random

from lodestar.llm import toxicity
from tests.llm.conftest import sentence


def test_toxic_documents_are_caught_and_clean_ones_left(spark):
    r = random.Random(7)
    docs, labels, truth = [], [], {}
    for i in range(900):
        toxic = r.random() < 0.2
        words = sentence(r, r.randint(30, 90)).split()
        for _ in range(r.randint(2, 6) if toxic else 0):
            words.insert(r.randint(0, len(words)), r.choice(["Grobian,", "oaf", "dullard", "grobianisch", "oafish!"]))
        docs.append((i, " ".join(words)))
        truth[i] = int(toxic)
        if i % 2:
            labels.append((i, 1, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.fit(d, y)).collect()
    assert sum((x["toxic"] >= 0.5) != truth[x["doc_id"]] for x in got) <= 9
    assert all(x["severe"] <= x["abusive"] + 0.2 for x in got)


def _newton(x, y, decay):
    """Logistic regression by another way: Newton's steps on columns of unit norm; the constant last, without a penalty."""
    import numpy as np

    scale = 1 / np.sqrt(np.maximum((x**2).sum(axis=0), 1e-6))
    z, w = x * scale, np.zeros(x.shape[1])
    penalty = np.array([decay] * (len(w) - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
    return w * scale


def test_the_chain_against_a_plain_one(spark, monkeypatch):
    """The whole training again without Spark: counts, nested choice of features and lexicon, folds, and models by Newton's method."""
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "PENALTIES", (1.0,))
    r = random.Random(3)
    texts = []
    for i in range(240):
        words = [f"w{r.randint(0, 60)}" for _ in range(12)] + [r.choice(["foul", "vile", "rude"]) for _ in range(r.randint(0, 4) if i % 3 == 0 else 0)] + ["meh"] * (i % 4 == 0)
        texts.append((i * 7, " ".join(words), int(i % 3 == 0)))
    d = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(7, "zzz other text of this id")], "doc_id long, text string")
    y = spark.createDataFrame([(i, k) for i, _, k in texts] + [(14, 1), (None, 1)], "doc_id long, toxic int")
    sample = sorted(toxicity.training_sample(d, y).collect())
    assert [r["doc_id"] for r in sample] == [i for i, _, _ in texts] and sample[2]["y"] == 1
    chain = toxicity.fit(d, y)
    got = {x["doc_id"]: [x[c] for c in toxicity.CATEGORIES] for x in toxicity.score(d.where("doc_id <> 7"), chain).collect()}

    sets, labels, folds = [toxicity.present(x["text"].encode()) for x in sample], np.array([x["y"] for x in sample]), np.array([x["fold"] for x in sample])

    def chosen(inside):
        n1 = labels[inside].sum()
        n0 = inside.sum() - n1
        found = []
        for f in set().union(*sets):
            has = np.array([f in s for s in sets]) & inside
            toxic, clean = int((has & (labels == 1)).sum()), int((has & (labels == 0)).sum())
            share = (toxic + clean + 1) / (n0 + n1 + 2)
            z = (toxic / n1 - clean / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
            if toxic + clean >= 3 and abs(z) >= toxicity.LEAST_Z:
                found.append((-abs(z), f, z > 3 and clean / n0 < 0.02 * toxic / n1))
        found.sort()
        return [f for _, f, _ in found], {f for _, f, bad in found if bad}

    def targets(lexicon):
        hits = np.array([len(s & lexicon) for s in sets])
        return [labels * (hits >= 1), labels * (hits >= 3), labels]

    def matrix(features, earlier):
        return np.concatenate([np.array([[f in s for f in features] for s in sets], float).reshape(len(sets), -1), earlier, np.ones((len(sets), 1))], axis=1)

    every = np.ones(len(sets), bool)
    features, lexicon = chosen(every)
    earlier, want = np.zeros((len(sets), 0)), []
    for k in range(3):
        x = matrix(features, earlier)
        w = _newton(x, targets(lexicon)[k], 1.0)
        m = len(features)
        known = np.concatenate([x[:, :m], np.array(want).T.reshape(len(sets), k), np.ones((len(sets), 1))], axis=1)
        want.append(1 / (1 + np.exp(-known @ w)))
        out = np.zeros(len(sets))
        for f in range(toxicity.FOLDS):
            inside = folds != f
            some, bad = chosen(inside)
            x = matrix(some, earlier)
            out[~inside] = (1 / (1 + np.exp(-x @ _newton(x[inside], targets(bad)[k][inside], 1.0))))[~inside]
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    assert set(chain.vocabulary) == set(features) and len(lexicon) >= 3
    worst = max(abs(got[x["doc_id"]][k] - want[k][n]) for n, x in enumerate(sample) for k in range(3) if x["doc_id"] != 7)
    assert worst < 0.01


def test_very_long_texts_and_ties(spark):
    r = random.Random(1)
    docs = [(i, sentence(r, 20) + (" oaf dolt" if i % 2 else "")) for i in range(200)] + [(900, sentence(r, 60_000) + " oaf dolt"), (901, sentence(r, 60_000))]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    runs = [{x["doc_id"]: x["toxic"] for x in toxicity.score(d, toxicity.fit(a, b)).collect()} for a, b in ((d, y), (d.repartition(9), y.repartition(3)))]
    assert runs[0] == runs[1] and runs[0][900] > runs[0][901]  # oaf and dolt, always together, tie


def test_all_kinds_of_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(3, 0, 0, "x"), (6, 0, 1, "x"), (6, 0, 1, "x"), (9, 0, None, "x"), (None, 1, 1, "x"), (77777, 1, 1, "x")], "doc_id long, quality int, toxic int, score string")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r[c] <= 1 for r in got for c in toxicity.CATEGORIES)
    assert {r["toxic"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []


def test_features_are_words_and_beginnings():
    assert toxicity.present(b"Idiotic, cat") == {b"idiotic", b"cat", b"idio*", b"idiot*", b"idioti*"} and toxicity.present(b"") == set()
