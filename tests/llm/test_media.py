import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.llm import media


def expected(i, t):
    b = (t or "").encode()
    p = b + b" " * (-len(b) % 192) if b else b" " * 192
    m = media.wav(p) + p
    return i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), media.features(p)


def test_all_rows_come_back(docs, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r) for r in media.media_columns(docs).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_hot_chunks_are_salted(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT", 4)
    rows = [(i, "the same text") for i in range(90)] + [(1000 + i, f"own text {i}") for i in range(20)] + [(None, "the same text")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = media.written(media.manifests(docs))
    hot = media.hot_digests(manifest)
    assert [r["salts"] for r in hot.collect()] == [7]  # 97 references, half of a share being 14
    store = media.chunk_store(docs, b"", hot)
    assert store.count() == 20 + 7 and {r["salt"] for r in store.collect()} == set(range(7))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r) for r in media.media_columns(docs).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_a_missing_chunk_is_an_error(docs):
    store = media.chunk_store(docs)
    with pytest.raises(Exception, match="lacks a chunk"):
        media.rebuild(media.manifests(docs), store.where(F.length("chunk") < 40), b"", media.described, media.DESCRIBED).collect()


def test_empty_table(empty):
    assert media.media_columns(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4), st.integers(0, 200_000), st.integers(0, 99))
def test_cuts_cover_and_keep_bounds(unit, n, seed):
    import random

    data = (unit or b"q") * (n // max(1, len(unit))) + random.Random(seed).randbytes(n % 30_000)
    ends = media.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(sizes) == len(data) and all(s <= media.MOST for s in sizes) and all(s >= media.LEAST for s in sizes[:-1])


def test_cuts_follow_content():
    import random

    data = random.Random(1).randbytes(400_000)
    a = {data[i:j] for i, j in zip([0, *media.cuts(data)], media.cuts(data), strict=False)}
    other = b"something before" + data
    b = {other[i:j] for i, j in zip([0, *media.cuts(other)], media.cuts(other), strict=False)}
    assert len(a & b) > 0.8 * len(a)


def test_equal_chunks_are_stored_once_and_a_wrong_chunk_is_found(docs):
    store = media.chunk_store(docs)
    assert store.count() == store.select("digest").distinct().count()
    broken = store.withColumn("chunk", F.first("chunk").over(Window.orderBy("digest")))
    with pytest.raises(Exception, match="don't give its medium|Decompressed"):
        media.rebuild(media.manifests(docs), broken, b"", media.described, media.DESCRIBED).collect()


def test_a_medium_by_hand():
    """Header and statistics of one small payload, written out."""
    samples = media.payload(b"ab")
    assert samples == b"ab" + b" " * 190
    assert media.wav(samples) == bytes.fromhex("52494646" "e4000000" "57415645" "666d7420" "10000000" "0100" "0100" "401f0000" "401f0000" "0100" "0800" "64617461" "c0000000")
    # 190 samples of 32 - 128 = -96, one of 97 - 128 = -31, one of 98 - 128 = -30
    level, rms = (190 * -96 - 31 - 30) / 192, ((190 * 96**2 + 31**2 + 30**2) / 192) ** 0.5
    assert media.features(samples) == f"wav8;seconds=0.024;level={level:.4f};rms={rms:.4f};zcr={1 / 192:.5f};peak=96;chunks=1"


def test_the_dictionary_takes_heads_only(spark):
    long = spark.createDataFrame([(i, f"{i} " * 50_000) for i in range(80)] + [(None, None)], "doc_id long, text string")
    heads = spark.createDataFrame([(i, (f"{i} " * 50_000)[:4096]) for i in range(80)] + [(None, None)], "doc_id long, text string")
    assert media.dictionary(long.coalesce(1)) == media.dictionary(heads.coalesce(1)) and media.dictionary(long.limit(3)) == b""
