"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and a sample of unlabelled text train a linear model over the presence of words and word
beginnings. The risk is pi * R+(P) + max(0, R-(U) - pi * R-(P)) with the logistic loss and class prior pi; where
the second part would turn negative its gradient is reversed, so the model cannot fit the positives hidden in the
unlabelled sample. Every token of the samples is a feature, none is cut: a feature's value is how surely its share among the
positives exceeds that among the unlabelled, in standard errors over the surest one's, so that the same penalty weighs
more on less telling tokens. Both samples are bounded (POSITIVES, UNLABELLED); scoring covers every whole text.

Repeated rows are scored alike and count once in the samples; ties of a sample go by hashed id, then id. Columns other
than doc_id and text are ignored, whatever their names. An empty table gives an empty result, an empty label table one where
nothing is flagged. A text is read whole at any length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, one_each, slices

POSITIVES, UNLABELLED = 1500, 4000
BEGINNINGS = (4, 5, 6)
EPOCHS, STEP, DECAY = 200, 0.12, 1e-4
FLAG_AT = 0.7
HELD_OUT = (3, 1)

_WORDS = re.compile(r"\w+")


def tokens(text: str | None) -> set[str]:
    """Lower-cased words of a text and, marked by a tilde, the beginnings of the longer ones."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {w[:n] + "~" for w in words if len(w) > 4 for n in BEGINNINGS if len(w) > n}


def hashed(text: str | None) -> list[int]:
    """The 32-bit hashes of a text's tokens, each once, in order."""
    return sorted({zlib.crc32(t.encode("utf-8", "replace")) for t in tokens(text)})


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Presence rows over sorted feature names, each feature worth its value."""

    def __init__(self, sets: list[np.ndarray], names: np.ndarray, value: np.ndarray):
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
        there = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        self.n, self.width = len(sets), len(names)
        self.row, self.column = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[there], at[there].astype(np.int32)
        self.value = value[self.column]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, minlength=self.n)

    def transposed_times(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, c[self.row] * self.value, minlength=self.width)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, sorted, and the standard errors by which their share is greater among the positives, over the largest."""
    names, inverse = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    cut = sum(len(s) for s in positive)
    p = np.bincount(inverse[:cut], minlength=len(names)) / len(positive)
    q = (np.bincount(inverse[cut:], minlength=len(names)) + 1) / len(unlabelled)
    z = np.maximum((p - q) / np.sqrt(p * (1 - p) / len(positive) + np.maximum(q * (1 - q), 0) / len(unlabelled) + 1 / len(positive) ** 2), 0)
    return names, z / max(z.max(initial=0), 1e-12)


def gradient(p: Sparse, u: Sparse, w: np.ndarray, bias: float, prior: float) -> tuple[np.ndarray, float]:
    """Descent direction of the non-negative risk in the weights and the bias, the penalty apart."""
    fp, fu = bias + p.times(w), bias + u.times(w)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    cp, cu = -prior * _logistic(fp) / p.n, _logistic(fu) / u.n
    if negative >= 0:
        cp = cp + prior * (_logistic(fp) - 1) / p.n
    else:
        cp, cu = -cp, -cu
    return p.transposed_times(cp) + u.transposed_times(cu), float(cp.sum() + cu.sum())


class Model:
    """A bias and a weight for each token of the samples."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.bias + Sparse(sets, self.names, self.weights).times(np.ones(len(self.names)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw([np.array(hashed(t), np.int64) for t in texts]), -40, 40)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimise the risk by Adam. A text is the array of its distinct tokens."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -9.0)
    names, value = telling(positive, unlabelled)
    p, u = Sparse(positive, names, value), Sparse(unlabelled, names, value)
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(1, EPOCHS + 1):
        g, g_bias = gradient(p, u, w[:-1], w[-1], prior)
        g = np.append(g + DECAY * w[:-1], g_bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - STEP * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-5)
    return Model(names, w[:-1] * value, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most POSITIVES confirmed toxic and UNLABELLED other documents, those with the least hashed ids,
    held-out rows apart. The prior is the share of toxic among all labels that are not held out."""
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), *HELD_OUT))
    facts = seen.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()
    prior = min(0.5, max(0.005, facts.p or 0.0))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic = seen.filter("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(POSITIVES)
    other = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *HELD_OUT)).select("doc_id").distinct().orderBy(*order).limit(UNLABELLED)
    drawn = toxic.select("doc_id", F.lit(1).alias("y")).union(other.select("doc_id", F.lit(0).alias("y")))

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [hashed(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(sets, pa.list_(pa.int64()))], ["y", "t"])

    # the samples come to the driver as Arrow columns of numbers
    rows = one_each(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "doc_id", "y").select("text", "y").mapInArrow(seen_in, "y int, t array<long>").toArrow()
    y, t = rows.column("y").to_numpy(), rows.column("t").combine_chunks()
    if not len(y):
        return fit([], [], prior)
    off, values = t.offsets.to_numpy(), t.values.to_numpy()
    sets = [values[a:b] for a, b in zip(off, off[1:], strict=False)]
    return fit([s for s, k in zip(sets, y, strict=True) if k], [s for s, k in zip(sets, y, strict=True) if not k], prior)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= FLAG_AT). Null and empty texts score
    the bias alone; without toxic labels nothing is flagged."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = model.value.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= FLAG_AT).cast("int"))
