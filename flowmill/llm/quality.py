"""Quality by regularised quadratic discriminant analysis of document statistics.

Fourteen statistics of a whole text, transformed to be nearly normal, are modelled as one Gaussian per class.
Covariances are shrunk towards the pooled one and its diagonal, and kept as Cholesky factors; the score is the
logistic of the tempered difference of Mahalanobis log-densities plus the log prior ratio. The Gaussians are
fitted on a bounded sample of labelled texts (SAMPLE rows); scoring covers every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, slices

#: Labelled texts the model is fitted on, at most.
SAMPLE = 4000
#: Shares of the class's own covariance, the pooled one and the pooled diagonal.
SHRINK = (0.7, 0.25, 0.05)
#: Log-density differences are divided by this before the logistic.
TEMPER = 2.0
REJECT_BELOW = 0.3
HELD_OUT = (5, 0)

STATS = ("words", "length", "upper", "symbols", "bang", "pipe", "digit", "distinct", "top", "bigrams", "lines", "stops", "end", "space")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>~^=_@\\"]] = True


def statistics(text: str | None) -> list[float]:
    """The raw statistics of a text; of a text without words all are 0."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    chars = max(1, len(text))
    seen = np.bincount(raw, minlength=256)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    long_words = sum(map(len, words))
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(n), np.log(long_words / n), np.sqrt(sum(map(str.isupper, words)) / n), np.sqrt(seen[_SYMBOL].sum() / chars), np.sqrt(seen[33] / chars),
        np.sqrt(seen[124] / chars), np.sqrt(seen[48:58].sum() / chars), len(counts) / n, np.sqrt(max(counts.values()) / n), np.sqrt(same / n),
        np.sqrt(1 - len(set(lines)) / len(lines)), short / n, np.sqrt((seen[46] + seen[44]) / chars), np.log1p(n / len(lines)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATS))


def fit(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Class means, Cholesky factors of shrunk covariances, their log-determinants and the log prior ratio."""
    if len(set(y.tolist())) < 2:
        return None
    mid, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mid) / scale
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    own, shared, diagonal = SHRINK
    model = {"mid": mid, "scale": scale, "prior": float(np.log(y.mean() / (1 - y.mean())))}
    for c in (0, 1):
        cov = own * np.cov(z[y == c].T, bias=True) + shared * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-3 * np.eye(x.shape[1])
        chol = np.linalg.cholesky(cov)
        model[c] = (z[y == c].mean(0), np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum())
    return model


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Probability of class 1; 0.5 without a model."""
    if model is None:
        return np.full(len(x), 0.5)
    z = (x - model["mid"]) / model["scale"]
    logs = []
    for c in (0, 1):
        mean, inverse, logdet = model[c]
        logs.append(-0.5 * (np.square((z - mean) @ inverse.T).sum(1) + logdet))
    return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPER + model["prior"], -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    sample = labelled_sample(docs, labels, "quality", *HELD_OUT, SAMPLE).select("text", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    rows = sample.mapInArrow(measure, "x array<double>, y int").collect()
    if not rows:
        return None
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows]))


def with_score(docs: DataFrame, labels: DataFrame, into: str = "score") -> DataFrame:
    """docs with the column `into`: the quality score (0 to 1) of each row's whole text.

    A null text scores as the empty one. Without labels of both classes every score is 0.5."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series(score(model.value, matrix([None if t is None or t != t else t for t in text])))

    return docs.select(*[c for c in docs.columns if c != into], scored("text").alias(into))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= REJECT_BELOW)."""
    out = with_score(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    return with_score(docs, labels, "__quality").filter(F.col("__quality") >= REJECT_BELOW).drop("__quality")
