import random

import pytest

import corpus_pipeline as cp
from lodestar.llm.common import written
from tests.llm.conftest import EXTRA, SCHEMA, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    """Tables with the odd documents, many good ones, junk, an item's passage, and labels."""
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(11)
    item = sentence(r, 40)
    good = [(1000 + i, sentence(r, r.randint(40, 90)) + "\nThe same closing line of every letter") for i in range(200)]
    junk = [(3000 + i, "Haan " * 50 if i % 2 else sentence(r, 40).upper().replace(" ", "!! ")) for i in range(60)]
    leak = [(5000, sentence(r, 30) + " " + item + " " + sentence(r, 30)), (5001, good[7][1] + " x")]
    docs = [*rows, *good, *junk, *leak]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["c"] * len(EXTRA)) for i, t in docs], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 3000), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first, ids = docs, []
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, folder))
        if name != "packing":
            assert out.columns == first.columns and dict(out.dtypes) == dict(first.dtypes), name
            ids.append({r[0] for r in out.select("doc_id").collect()})
            docs = out
    quality, lines, near, clean = ids
    assert len([i for i in quality if i and 3000 <= i < 3060]) <= 1 and len([i for i in quality if i and 1000 <= i < 1200]) >= 195
    assert lines == quality
    assert near <= lines and len([i for i in near if i and 1000 <= i < 1200]) >= 190
    assert 5000 not in clean and clean >= {i for i in near if i != 5000}
    closing = docs.where(r"text RLIKE '(?m)^The same closing line of every letter$'").count()
    assert closing <= 1
    assert out.count() >= len(clean) and {r[0] for r in out.select("doc_id").collect()} == clean


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near duplicates", "benchmark decontamination", "packing"]
    got = cp.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, folder))
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("labels", [[], [(1000 + i, None, None) for i in range(20)], [(9, 1, 0)], [(1000 + i, 0, 0) for i in range(20)]])
def test_quality_stage_keeps_all_without_usable_labels(spark, docs, tmp_path, labels):
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, f"some words of text {i}") for i in range(20)], "doc_id long, text string"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.quality_stage(spark, some, str(tmp_path)).count() == some.count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
