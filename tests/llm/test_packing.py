import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 3000), max_size=40))
def test_patterns_hold_the_histogram(histogram):
    found = packing.patterns(histogram, 64)
    held: Counter = Counter()
    for count, pattern in found:
        assert count > 0 and sum(length * copies for length, copies in pattern) <= 64
        for length, copies in pattern:
            held[length] += count * copies
    assert held == Counter(histogram) and len(found) <= 2 * 64


def test_ids_are_the_library_s():
    r = random.Random(2)
    letters = "ab'sStTdDmllre.,!- \n\t\x0b\x1c\x85\xa0éÉ́ñ1２½🙂<|>_İΣς"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a <|endoftext|>b<|startoftext|>", "it's 'tis don'T we'll"]
    library = Tokenizer.from_file(PATH)
    assert packing.token_ids([t.encode() for t in texts], PATH) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_id_lies_in_one_piece(docs, rows):
    library = Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs, PATH, size=256).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(seqs) == list(range(len(seqs)))
    want: Counter = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for s in range(0, len(ids), 256):
            want[i, len(ids), s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())] += 1
    assert Counter((i, n, s, length, crc) for (i, n), parts in pieces.items() for s, length, crc in parts) == want
    total = sum(r["length"] for r in got)
    assert total / (256 * len(seqs)) > 0.97


def test_clashing_names(spark):
    rows = spark.createDataFrame([(k, 1 + k % 9, "x", "y", "z", "w") for k in range(50)], "k long, length int, __salt string, __rank string, __before string, count string")
    got = packing.pack(rows, 10, ("k",))
    assert got.columns == [*rows.columns, "sequence_id", "offset"] and sorted(r["k"] for r in got.collect()) == list(range(50))
    with pytest.raises(ValueError):
        packing.pack(rows.withColumn("offset", rows["k"]), 10, ("k",))


def test_salts_follow_the_number_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_PIECES", 3)
    rows = spark.createDataFrame([(k, 4096) for k in range(400)], "k long, length int").repartition(7)
    assert sorted(r["sequence_id"] for r in packing.pack(rows, 4096, ("k",)).collect()) == list(range(400))


def test_empty_table(empty):
    assert packing.pack_documents(empty, PATH).collect() == []
