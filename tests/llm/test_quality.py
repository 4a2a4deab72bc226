import random
import zlib

import numpy as np
import pytest

from lodestar.llm import quality
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = sentence(r, r.randint(20, 80)) if good else r.choice([lambda: sentence(r, 40).upper().replace(" ", "!! "), lambda: "Haan " * r.randint(20, 60), lambda: sentence(r, 30).replace(" ", "$$$ ")])()
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    truth = {r[0]: r[1] for r in labels.collect()}
    got = quality.classify(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 100 and np.mean([truth[r["doc_id"]] == r["predicted"] for r in out]) > 0.95


def test_labels_of_held_out_rows_are_not_used(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_isotonic_fit():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.1, 0.5, 0.3, 0.9, 0.8]), np.array([1.0, 1, 1, 1, 3]))
    assert np.allclose(x, [0, 1.5, 3.75]) and np.allclose(y, [0.1, 0.4, 0.825])


def test_all_kinds_of_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(3, 1, 0, "x"), (6, 0, 0, "x"), (9, None, 0, "x"), (None, 1, 0, "x"), (77777, 1, 0, "x"), (12, 7, 0, "x")], "doc_id long, quality int, toxic int, score string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, labels).collect() == []
    model = quality.fit(quality.document_statistics(docs), labels)
    from pyspark.sql import functions as F

    told = docs.select("doc_id", "score", quality.score_of(quality.statistics_of(F.col("text")), model).alias("own"))
    assert told.count() == len(rows) and all(r["score"] == "clash" and 0 <= r["own"] <= 1 for r in told.collect())


def solved(x, y, model):
    """The ridge solution on features that aren't rounded, by another way: least squares with a row more for each weight."""
    z = np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - model.mean) / model.scale, -6, 6) @ model.frequencies + model.phases)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    more = np.sqrt(quality.RIDGE * len(x) + 1e-6) * np.eye(z.shape[1])
    return z, np.linalg.lstsq(np.concatenate([z, more]), np.concatenate([y, np.zeros(len(more))]), rcond=None)[0]


def test_normal_equations_and_weights_against_numpy(labelled):
    docs, labels = labelled
    stats = quality.written(quality.document_statistics(docs))
    model = quality.fit(stats, labels)
    truth = {r[0]: r[1] for r in labels.collect()}
    rows = [(r["doc_id"], r["stats"]) for r in stats.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 in (0, 1)]
    x, y = np.array([s for _, s in rows]), np.array([truth[i] for i, _ in rows], float)
    every = [(s, truth[i]) for i, s in ((r["doc_id"], r["stats"]) for r in stats.collect()) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert np.allclose(model.mean, np.mean([s for s, _ in every], axis=0), atol=1e-8)
    z, w = solved(x, y, model)
    table = docs.sparkSession.createDataFrame([(s, float(truth[i])) for i, s in rows], "stats array<double>, y double").repartition(7)
    a, b = quality.normal_equations(table, model)
    z[:, -1] = quality.CONSTANT
    assert np.allclose(a, z.T @ z, atol=1e-3) and np.allclose(b, z.T @ y, atol=1e-2)
    z[:, -1] = 1
    assert np.abs(model.raw(x) - z @ w).max() < 1e-2


def test_sums_and_scores_don_t_depend_on_order_or_partitions(labelled):
    docs, labels = labelled
    stats = quality.document_statistics(docs)
    runs = [{r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(n), labels.repartition(m)).collect()} for n, m in ((3, 2), (11, 5))]
    assert runs[0] == runs[1]
    model = quality.fit(stats, labels)
    y = stats.join(labels, "doc_id").selectExpr("stats", "double(quality) AS y")
    a, b = (quality.normal_equations(y.repartition(n, "y", "stats"), model) for n in (2, 40))
    assert all((p == q).all() for p, q in zip(a, b, strict=True))
