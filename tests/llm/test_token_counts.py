import random

import public_tokenizers
from tokenizers import Tokenizer

from lodestar.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_are_the_library_s(monkeypatch):
    r = random.Random(1)
    letters = "ab 's'relltvmd\n\t .,1é幅🙂\x0b\x1c\x85\xa0 "
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(2500)]
    odd += ["", " ", "a  b", "it's we'll 'tis I'd've ''s", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c <|endoftext", "x" * 9000, " " * 5000 + "y", "🙂👍🏽 é" * 400, "!" * 3000]
    odd += [chr(c) + "a " + chr(c) for c in range(0x20, 0x3000, 7)]
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(odd, add_special_tokens=False)]
    counter = tc.Counter(PATH)
    assert counter.count(odd).tolist() == want
    monkeypatch.setattr(tc, "CHUNK", 16)  # many chunks without a border
    monkeypatch.setattr(tc, "STATES", 10)  # the machine starts anew with each batch
    assert [int(counter.count([t])[0]) for t in odd[-60:]] == want[-60:] and counter.count(odd).tolist() == want


def test_long_texts_without_borders(monkeypatch):
    """One piece of many chunks: repetitive, random, and of letters that need several bytes."""
    r = random.Random(4)
    texts = ["x" * 70_000, "ab" * 30_001, "".join(r.choice("aeinorst") for _ in range(60_000)), "".join(r.choice("的一是不了人我在有") for _ in range(20_000)), "=" * 40_000 + " " + "-" * 30_001]
    library, counter = Tokenizer.from_file(PATH), tc.Counter(PATH)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count(texts).tolist() == want and [int(counter.count([t])[0]) for t in texts] == want
    monkeypatch.setattr(tc.Counter, "_entering", lambda self, grid, chunk: (chunk[:0], chunk[:0]))  # states that no map foresees are added
    assert counter.count([t[:9000] for t in texts]).tolist() == [len(library.encode(t[:9000], add_special_tokens=False).ids) for t in texts]


def test_rows(docs, rows, empty):
    library = Tokenizer.from_file(PATH)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tc.count_tokens(docs, PATH).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert tc.count_tokens(empty, PATH).collect() == []


def test_a_token_may_follow_another():
    m = tc.Transducer([(b"a", b"b"), (b"ab", b"c"), (b"b", b"c")])
    assert not m.follows(b"a", b"b") and not m.follows(b"ab", b"c") and m.follows(b"c", b"a") and m.follows(b"abc", b"ab") and not m.follows(b"a", b"bc")
