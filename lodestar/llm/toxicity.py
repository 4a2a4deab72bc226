"""Toxicity by a classifier chain of linear models over words and their beginnings.

The labels know one kind, toxic. Two categories are derived from it for training: `abusive`, a toxic document that holds a
word or beginning of a word from the abuse lexicon, and `severe`, one that holds three or more; the lexicon is what the
training sample shows to be tied to the label most (at most `LEXICON` entries that hardly ever stand in clean documents). The
chain predicts abusive, severe and toxic in this order. Each model is a logistic regression over the presence of the chosen
features and the probabilities of the categories before it; for training, those are out-of-fold predictions, so that a later
model sees them as uncertain as they will be for new documents. A fold's predictions come from the other folds alone: they
choose the features, they make the lexicon and with it the derived categories, and they fit the models. One thing isn't nested:
the earlier probabilities of the rows that fit a fold's later model come from models that saw that fold. Folds are dealt by a hash of the id. The penalty is the one of PENALTIES whose out-of-fold predictions of toxic have the least log loss.

Features are chosen, and the models fitted, on a bounded sample of labelled rows: the SAMPLE ids of the smallest hashes.
An id with several labels counts as toxic if one of them says so; of an id with several texts the one of least hash is taken.
Every document is scored over its whole text, however long. Null and empty texts have no features and get the models' base
rates. Null labels, and labels without a document, are not used; without both kinds of label every probability is the share
of label 1. Ties among features go by their bytes. Repeated rows are scored one by one; a null id stays null. Further columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts, utf8, written
from .license_scan import WORD_BYTES

#: Labelled rows for training, features, entries of the lexicon, folds.
SAMPLE, FEATURES, LEXICON, FOLDS = 8000, 2048, 512, 5

#: Least difference of a feature's shares in toxic and clean rows, in standard errors.
LEAST_Z = 2.0

#: Strengths of the penalty to choose from, and gradient steps for that and for the models.
PENALTIES, TRIAL_STEPS, STEPS = (0.001, 0.01, 0.1), 60, 300

CATEGORIES = ("abusive", "severe", "toxic")


def present(data: bytes) -> set[bytes]:
    """A text's features: its words, and their first four to six bytes with a star."""
    words = set(data.translate(WORD_BYTES).split())
    out = set(words)
    for k in (4, 5, 6):
        out.update([w[:k] + b"*" for w in words if len(w) > k])
    return out


@dataclass
class Chain:
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]  # of each category: features, earlier categories, constant
    prior: float

    def indices(self, data: bytes) -> list[int]:
        return [self.vocabulary[f] for f in present(data) if f in self.vocabulary]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """A row of probabilities, in the order of CATEGORIES, for each list of feature indices."""
        n = len(rows)
        if not self.weights:
            return np.full((n, len(CATEGORIES)), self.prior)
        at, row = np.array([j for r in rows for j in r], np.int64), np.repeat(np.arange(n), [len(r) for r in rows])
        out = np.zeros((n, len(CATEGORIES)))
        f = len(self.vocabulary)
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.bincount(row, weights=w[at], minlength=n) + out[:, :k] @ w[f : f + k] + w[-1])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(at: np.ndarray, row: np.ndarray, earlier: np.ndarray, y: np.ndarray, features: int, decay: float, steps: int = STEPS) -> np.ndarray:
    """Logistic regression with a quadratic penalty, by accelerated gradient steps over columns of unit norm."""
    n, k = earlier.shape
    columns = np.concatenate([np.bincount(at, minlength=features), (earlier**2).sum(axis=0), [n]])
    scale = 1 / np.sqrt(np.maximum(columns, 1e-6))

    def values(v: np.ndarray) -> np.ndarray:
        w = v * scale
        return np.bincount(row, weights=w[at], minlength=n) + earlier @ w[features:-1] + w[-1]

    def slope(error: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, weights=error[row], minlength=features), earlier.T @ error, [error.sum()]]) * scale

    probe = np.ones(features + k + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        probe = slope(values(probe / np.linalg.norm(probe)))
    rate = 1 / (0.3 * np.linalg.norm(probe) + decay)
    w = np.zeros(features + k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) / scale[-1]
    v = w
    for step in range(steps):
        down = slope(_sigmoid(values(v)) - y)
        down[:-1] += decay * v[:-1]
        new = v - rate * down
        v, w = new + step / (step + 3) * (new - w), new
    return w * scale


def _rows_of(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of each entry of lists of features."""
    return np.array([j for r in lists for j in r], np.int64), np.repeat(np.arange(len(lists)), [len(r) for r in lists])


def _values(w: np.ndarray, at: np.ndarray, row: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """The probabilities of rows (entries, earlier categories) by weights."""
    n, k = earlier.shape
    return _sigmoid(np.bincount(row, weights=w[at], minlength=n) + earlier @ w[len(w) - 1 - k : -1] + w[-1])


@dataclass
class View:
    """What a set of training rows says: the vocabulary, which entries are the lexicon, and all rows' entries in that vocabulary."""

    vocabulary: dict[bytes, int]
    lexicon: np.ndarray
    inside: np.ndarray  # the rows that it rests on
    at: np.ndarray
    row: np.ndarray

    def targets(self, y: np.ndarray) -> list[np.ndarray]:
        hits = np.bincount(self.row, weights=self.lexicon[self.at], minlength=len(y))
        return [y * (hits >= 1), y * (hits >= 3), y]

    def fit(self, earlier: np.ndarray, y: np.ndarray, decay: float, steps: int = STEPS) -> np.ndarray:
        """Weights by the inside rows."""
        number, used = np.cumsum(self.inside) - 1, self.inside[self.row]
        return _fit(self.at[used], number[self.row[used]], earlier[self.inside], y[self.inside].astype(float), len(self.vocabulary), decay, steps)

    def predict(self, w: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _values(w, self.at, self.row, earlier)


def _chosen(counts: DataFrame, clean, toxic, n0: int, n1: int) -> list:
    """(f, z, clean, toxic) of the features whose shares in n0 clean and n1 toxic rows differ most: at most FEATURES rows."""
    share = (clean + toxic + 1) / (n0 + n1 + 2)
    z = (toxic / n1 - clean / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    kept = counts.select("f", z.alias("z"), clean.alias("clean"), toxic.alias("toxic")).where("clean + toxic >= 3")
    return kept.where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).collect()


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, fold, text): at most SAMPLE rows, one for an id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    taken = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    found = texts(docs, id_col, text_col).join(F.broadcast(taken), "doc_id")  # at most SAMPLE rows of two numbers
    one = found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Chain:
    sample = written(training_sample(docs, labels, label_col, id_col, text_col), few=True)

    def counted(batch: pa.RecordBatch) -> dict:
        seen: dict[tuple[bytes, int], list[int]] = {}
        for y, fold, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            for f in present(data):
                seen.setdefault((f, fold), [0, 0])[y] += 1
        columns = [f for f, _ in seen], [k for _, k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]
        return {n: pa.array(c, kind) for n, c, kind in zip(("f", "fold", "clean", "toxic"), columns, (pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)}

    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", "y").count().collect()}
    n0, n1 = (sum(n for (_, y), n in sizes.items() if y == kind) for kind in (0, 1))
    if not n0 or not n1:
        return Chain({}, [], n1 / (n0 + n1) if n0 + n1 else 0.5)
    of = lambda kind, fold: F.sum(F.when(F.col("fold") == fold, F.col(kind)).otherwise(0)).alias(f"{kind}_{fold}")
    counts = map_rows(sample.select("y", "fold", "text"), counted, "f binary, fold int, clean long, toxic long").groupBy("f").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), *[of(kind, fold) for kind in ("clean", "toxic") for fold in range(FOLDS)]
    )
    counts = written(counts.where("clean + toxic >= 3"), few=True)
    best = {}  # by the fold that is left out; None: all rows
    for fold in (None, *range(FOLDS)):
        rest = [sizes.get((fold, kind), 0) for kind in (0, 1)]
        left = [F.col(kind) - (F.lit(0) if fold is None else F.col(f"{kind}_{fold}")) for kind in ("clean", "toxic")]
        if n0 > rest[0] and n1 > rest[1]:
            best[fold] = _chosen(counts, *left, n0 - rest[0], n1 - rest[1])
    union = {f: k for k, f in enumerate(sorted({bytes(r["f"]) for rows in best.values() for r in rows}))}

    def indexed(batch: pa.RecordBatch) -> dict:
        found = [sorted(union[f] for f in present(x) if f in union) for x in utf8(batch.column(3))]
        return {"doc_id": batch.column(0), "y": batch.column(1), "fold": batch.column(2), "at": pa.array([np.array(x, "<i4").tobytes() for x in found], pa.binary())}

    rows = map_rows(sample, indexed, "doc_id long, y int, fold int, at binary").orderBy("doc_id").collect()  # at most SAMPLE rows, with four bytes for each chosen feature that they have
    y, folds = np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])
    every_at, every_row = _rows_of([np.frombuffer(bytes(r["at"]), "<i4").tolist() for r in rows])

    def view(fold: int | None) -> View:
        own = {bytes(r["f"]): k for k, r in enumerate(best[fold])}
        number = np.full(len(union) + 1, -1)
        number[[union[f] for f in own]] = range(len(own))
        at = number[every_at]
        inside = folds != (-1 if fold is None else fold)
        toxic, clean = max(1, int(y[inside].sum())), max(1, int((1 - y[inside]).sum()))
        lexicon = np.zeros(len(own), bool)
        lexicon[[k for k, r in enumerate(best[fold]) if r["z"] > 3 and r["clean"] / clean < 0.02 * r["toxic"] / toxic][:LEXICON]] = True
        return View(own, lexicon, inside, at[at >= 0], every_row[at >= 0])

    whole, none = view(None), np.zeros((len(y), 0))
    parts = [(folds == fold, view(fold)) for fold in range(FOLDS) if fold in best and (folds == fold).any()]

    def out_of_fold(earlier: np.ndarray, k: int, decay: float, steps: int) -> np.ndarray:
        """Predictions of category k: each fold's by the others; the share of the category where they have one kind of label only."""
        out = np.full(len(y), whole.targets(y)[k].mean())
        for own, v in parts:
            out[own] = v.predict(v.fit(earlier, v.targets(y)[k], decay, steps), earlier)[own]
        return out

    def loss(decay: float) -> float:
        p = np.clip(out_of_fold(none, 2, decay, TRIAL_STEPS), 1e-6, 1 - 1e-6)
        return float(-np.where(y == 1, np.log(p), np.log(1 - p)).mean())

    decay = min(PENALTIES, key=loss)
    earlier, weights = none, []
    for k, target in enumerate(whole.targets(y)):
        weights.append(whole.fit(earlier, target, decay))
        if k < len(CATEGORIES) - 1:
            earlier = np.concatenate([earlier, out_of_fold(earlier, k, decay, STEPS)[:, None]], axis=1)
    return Chain(whole.vocabulary, weights, n1 / (n0 + n1))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, abusive, severe, toxic): probabilities of the categories."""

    def one(batch: pa.RecordBatch) -> dict:
        p = chain.probabilities([chain.indices(x) for x in utf8(batch.column(1))])
        return {"doc_id": batch.column(0)} | {c: pa.array(p[:, k]) for k, c in enumerate(CATEGORIES)}

    return map_rows(texts(docs, id_col, text_col), one, "doc_id long, abusive double, severe double, toxic double")
