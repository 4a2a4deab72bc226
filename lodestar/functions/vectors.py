"""Vectors as array<float>: checks, cosine, centroids, and a hash embedding for tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def invalid_vector(v: Column, dimension: int) -> Column:
    """Why a vector can't be indexed; null if it can."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(~finite, "not_finite").when(norm(v) == 0, "zero_norm")
    )


def centroid(v: Column, dimension: int) -> Column:
    """An aggregate: the mean of vectors, place by place."""
    return F.array(*[F.avg(v[k].cast("double")) for k in range(dimension)])


def hash_embedding(text: Column, dimension: int = 8) -> Column:
    """The first bytes of the text's SHA-256 over 255; a stand-in for a model."""
    h = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: (F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255).cast("float"))
