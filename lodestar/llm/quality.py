"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are counts and shares of a text's bytes, words and lines; they see whole texts and nothing but the text. They are
standardised and mapped to cosines at random frequencies, which approximate a Gaussian kernel. Each partition of training rows
sums its part of the normal equations; the parts are added by row in two levels, and the solved ridge scores are calibrated
by an isotonic fit over a histogram of the scores of other training rows (at most `BINS` bins). Only sums of a fixed size
come to the driver, and all labelled training rows count. Features are rounded to multiples of 1 / UNIT and added as whole
numbers, so sums, and with them scores, are the same in whatever order or partition rows come, and if a task runs again.

Null and empty texts have statistics 0 and a score like any other. Labels that are null or whose document is missing are not
used; repeated labels count as often as they stand there. Without training rows, or with labels of one kind, the score is
the share of label 1 (0.5 without any). A null id is never held out and gets a score. Repeated rows are scored one by one, and
equal texts tie. Very long texts are measured whole. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, map_rows, texts, utf8, written

#: Random features, histogram bins of the calibration, ridge strength for a training row.
FEATURES, BINS, RIDGE = 256, 1024, 1e-3

#: Steps of a feature within 1, the constant feature, and decimals of means, deviations and scores.
UNIT, CONSTANT, DECIMALS = 1 << 16, 1 / 16, 9

#: Groups in which parts of the normal equations meet first.
GROUPS = 32

STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "punctuation", "non_ascii", "blank", "distinct",
    "repeated", "most_common", "log_lines", "line_words", "distinct_lines", "one_byte_words",
)

_UPPER, _LOWER, _DIGIT = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_PUNCTUATION = np.array([chr(b) in ".,;:!?'\"()-" for b in range(256)])
_SYMBOL = np.array([33 <= b <= 126 for b in range(256)]) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_PUNCTUATION


def statistics(data: bytes) -> list[float]:
    """The numbers STATS of a text."""
    if not data:
        return [0.0] * len(STATS)
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    w, letters = max(1, len(words)), max(1, int(n[_UPPER].sum() + n[_LOWER].sum()))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(data)), np.log1p(len(words)), (len(data) - n[_BLANK].sum()) / w, n[_UPPER].sum() / letters, n[_DIGIT].sum() / len(data),
        n[_SYMBOL].sum() / w, n[_PUNCTUATION].sum() / w, n[128:].sum() / len(data), n[_BLANK].sum() / len(data), len(seen) / w ** 0.8,
        repeated / w, max(seen.values(), default=0) / w, np.log1p(len(lines)), np.log1p(len(words) / len(lines)), len(set(lines)) / len(lines), sum(len(x) == 1 for x in seen) / w,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in utf8(column)], np.float64).reshape(-1, len(STATS))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>)."""

    def one(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column(1))
        return {"doc_id": batch.column(0), "stats": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATS), dtype=np.int32)), pa.array(x.ravel()))}

    return map_rows(texts(docs, id_col, text_col), one, "doc_id long, stats array<double>")


@dataclass
class Model:
    """Fixed-size parameters: how to standardise, the frequencies and phases, the ridge weights, the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    prior: float

    def features(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers: the features, and the constant one, in units of 1 / UNIT."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.frequencies + self.phases
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(z)
        return np.rint(np.concatenate([cosines, np.full((len(x), 1), CONSTANT)], axis=1) * UNIT)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights / UNIT

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        slope = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))  # a slight one: no ties within a step
        return np.clip(0.998 * np.interp(raw, self.knots, self.levels) + 0.002 * slope, 0, 1).round(DECIMALS)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the steps of the increasing fit to y at sorted x with weights w (pool adjacent violators)."""
    blocks: list[list[float]] = []  # sum of w, sum of w * y, sum of w * x
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([c, c * b, c * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks).reshape(-1, 3)
    return sums[:, 2] / sums[:, 0], sums[:, 1] / sums[:, 0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z^T and of z y over all rows (stats, y of 0 or 1): each partition adds its own, and equal rows of the matrix meet in two levels.

    A product of two features is below 2^26 units, so that 64 bits hold the sums of 2^37 rows, and a batch's product is exact.
    """
    n = FEATURES + 1

    def part(batches):
        total = np.zeros((n, n + 1), np.int64)
        some = 0
        for b in batches:
            z = model.features(np.array(b.column(0).to_pylist(), np.float64).reshape(-1, len(STATS)))
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            total += (z.T @ np.concatenate([z, y], axis=1)).astype(np.int64)
            some += len(z)
        if some:
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(n), pa.int32()), "g": pa.array([group] * n, pa.int32()), "v": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [sum(np.frombuffer(v, np.int64) for v in group["v"]).tobytes()]})

    parts = rows.select("stats", "y").mapInArrow(lean(part), "i int, g int, v binary")
    sums = parts.groupBy("i", "g").applyInPandas(add, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").collect()  # FEATURES + 1 rows
    total = np.zeros((n, n + 1))
    for i, v in sums:
        total[i] = np.frombuffer(bytes(v), np.int64)
    return total[:, :n] / UNIT**2, total[:, n] / UNIT


def ridge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weights for normal equations of features that end with the constant one; RIDGE is for each row."""
    rows = a[-1, -1] / CONSTANT**2
    return np.linalg.solve(a + (RIDGE * max(rows, 1) + 1e-6) * np.diag([*[1.0] * (len(a) - 1), CONSTANT**2]), b)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", seed: int = 5) -> Model:
    """The model of labels (id, 0 or 1) from stats (doc_id, stats), without the held-out ids. Weights come from remainders 0 and 1 of an id's crc32 by 4, the calibration from remainder 3."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    rows = written(stats.join(y.where(~held_out(F.col("doc_id"))), "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4), few=True)
    random = np.random.default_rng(seed)
    frequencies, phases = random.normal(size=(len(STATS), FEATURES)) / np.sqrt(len(STATS)), random.uniform(0, 2 * np.pi, FEATURES)
    of = [F.col("stats")[k] for k in range(len(STATS))]
    moments = rows.agg(F.count("*"), F.sum("y"), *[F.avg(c) for c in of], *[F.stddev_pop(c) for c in of]).first()
    d, none = len(STATS), np.zeros(0)
    if not moments[0] or moments[1] in (0, moments[0]):
        return Model(np.zeros(d), np.ones(d), frequencies, phases, np.zeros(FEATURES + 1), none, none, moments[1] / moments[0] if moments[0] else 0.5)
    mean, scale = np.array(moments[2 : 2 + d], float).round(DECIMALS), np.array(moments[2 + d :], float).round(DECIMALS)
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), frequencies, phases, np.zeros(FEATURES + 1), none, none, moments[1] / moments[0])
    model.weights = ridge(*normal_equations(rows.where("fold <> 3"), model))

    def binned(batch: pa.RecordBatch) -> dict:
        raw = model.raw(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d))
        units = np.rint(raw * UNIT).astype(np.int64)
        return {"bin": pa.array(np.clip((units / UNIT + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), "units": pa.array(units), "y": batch.column(1)}

    sums = F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("units").alias("units")
    bins = map_rows(rows.where("fold = 3").select("stats", "y"), binned, "bin int, units long, y double").groupBy("bin").agg(*sums).orderBy("bin").collect()  # at most BINS rows
    if bins:
        n = np.array([r["n"] for r in bins], float)
        model.knots, model.levels = isotonic(np.array([r["units"] for r in bins]) / n / UNIT, np.array([r["y"] for r in bins]) / n, n)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, stats)."""

    def one(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": pa.array(model.score(np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATS))))}

    return map_rows(stats.select("doc_id", "stats"), one, "doc_id long, score double")


def statistics_of(text: Column) -> Column:
    """The statistics of a text column; only that column goes to Python."""

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        x = _matrix(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATS), dtype=np.int32)), pa.array(x.ravel()))

    return of(F.coalesce(text.cast("string"), F.lit("")))


def score_of(stats: Column, model: Model) -> Column:
    """The scores of a column of statistics."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array(column.to_pylist(), np.float64).reshape(-1, len(STATS))))

    return of(stats)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    stats = written(document_statistics(docs))
    scored = score(stats, fit(stats, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
