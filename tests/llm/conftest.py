import random

import pytest

from pyspark.sql import types as T

#: Further columns whose names the operators use themselves.
EXTRA = ["score", "stats", "seed", "h", "key", "fp", "line", "pos", "words", "component_id", "text_hash", "item_id", "starts", "length", "y", "__score", "__id", "__hash", "route"]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["an", "the", "ou", "re", "ti", "é", "Ka", "lo"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """Documents with copies, near copies, shared lines, null and empty texts, a null id, repeated rows and one very long text."""
    r = random.Random(3)
    shared, line = sentence(r, 60), "Subscribe to this very long newsletter today"
    texts = [sentence(r, r.randint(1, 120)) + r.choice(["", "\n" + line, "\n  " + line.upper() + "\t", "\n\n"]) for _ in range(60)]
    texts += [texts[0], texts[0], texts[5] + " x", shared, "intro " + shared, shared.replace(" the", " The", 1) + "\r\nend", "a", "a b", "", " \t\n", None, sentence(r, 60_000), "x" * 5000, "\x00\x1c  <|endoftext|> \U0001f642"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[0]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, *["clash"] * len(EXTRA)) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
