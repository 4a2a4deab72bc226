"""Model inference as injected functions over Arrow batches, and stand-ins that need no model files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import nul_joined, sha_hex
from ..functions.vectors import invalid_vector, norm


def embed(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, text_col: str = "text", instruction: str = "", batch: int = 8) -> DataFrame:
    """rows with a column vector of unit length: `make` builds the encoder once in each task, which gets texts in batches of similar length.

    The instruction goes before each text (queries have one, documents none). A vector that can't be indexed is an error.
    """
    columns = list(rows.columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for part in parts:
            texts = [instruction + (t or "") for t in part[text_col]]
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            out: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                vectors = encode([texts[k] for k in some])
                if len(vectors) != len(some):
                    raise ValueError("the encoder gave another number of vectors than it got texts")
                for k, v in zip(some, vectors, strict=True):
                    out[k] = [float(x) for x in v]
            yield part.assign(vector=out)[[*columns, "vector"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vector array<float>"
    found = rows.mapInPandas(run, schema)
    problem = invalid_vector(F.col("vector"), dimension)
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("bad vector: "), problem)).cast("array<float>")).otherwise(F.col("vector"))
    size = norm(F.col("vector"))
    return found.withColumn("vector", checked).withColumn("vector", F.transform("vector", lambda x: (x / size).cast("float")))


def scorer(make: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A Column function (query, text) -> score from a scorer that `make` builds once in each task."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for query, text in batches:
            yield pd.Series(score(query.tolist(), text.fillna("").tolist()), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType=DoubleType())


def yes_no_score(yes: Column, no: Column) -> Column:
    """The share of yes in the softmax over two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def cache_key(**inputs: Column | str | int) -> Column:
    """A digest of everything that a score depends on, by name."""
    return sha_hex(nul_joined(*[x for name in sorted(inputs) for x in (name, inputs[name])]))


def hash_encoder(dimension: int = 8) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A stand-in encoder: the first bytes of a text's SHA-256 over 255."""

    def make():
        return lambda texts: [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dimension]] for t in texts]

    return make
