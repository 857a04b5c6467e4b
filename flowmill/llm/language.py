"""Language identification with string kernels.

A text is the set of its letter n-grams (n = 1 to GRAM, words bounded by a blank): the blended-spectrum presence
kernel of two texts is the number of n-grams both have over the root of the product of their numbers. Every code point
is a symbol of its own and n-grams are numbered exactly, so the kernel is that of the whole sets. Landmark texts give a
Nyström map, and one-versus-rest kernel ridge regression is solved in it. The score is linear in the presence of the
landmarks' n-grams over the root of the text's own number, so a batch is scored by one matrix product.

The model is fitted on a bounded sample: PER_LANG texts of each language, at most SAMPLE in all, of which LANDMARKS
are landmarks. Prediction sees nothing but the text.

Null ids are never learned from. Rows that share an id and a language count once in the sample (the least text); every row
is predicted, repeated rows alike. Equal scores go to the first language by name. A text is read whole at any length.
Columns other than doc_id, text and lang are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, one_each, slices

PER_LANG = 250
SAMPLE = 4000
LANDMARKS = 240
GRAM = 3
#: Bits of a symbol: any code point plus one.
BITS = 21
RIDGE = 1e-3
SHARPNESS = 6.0
HELD_OUT = (5, 0)
UNKNOWN = "und"
BATCH = 64

_LETTER = np.array([chr(i).isalpha() for i in range(0xD800)], bool)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with 0 for everything that is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = points < len(_LETTER)
    is_letter = np.zeros(len(points), bool)
    is_letter[known] = _LETTER[points[known]]
    if not known.all():
        rest = np.unique(points[~known])
        is_letter |= np.isin(points, [c for c in rest.tolist() if chr(c).isalpha()])
    return np.where(is_letter, points, 0)


def grams(text: str | None) -> np.ndarray:
    """The sorted distinct n-grams of a text, n = 1 to GRAM, as numbers; runs of blanks are one. Symbols count from one, so
    n-grams of unlike lengths differ. Empty if the text has no letter."""
    points = letters(text or "")
    if not points.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([[0], points, [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] + 1
    every, code = [s], s
    for n in range(2, GRAM + 1):
        code = (code[:-1] << BITS) + s[n - 1 :]
        every.append(code)
    return np.unique(np.concatenate(every))


class Model:
    def __init__(self, sets: list[np.ndarray], langs: list[str]):
        """sets: the n-grams of the sample's texts, none of them empty."""
        self.langs = sorted(set(langs))
        marks = list(range(0, len(sets), max(1, -(-len(sets) // LANDMARKS))))
        self.known = np.unique(np.concatenate([sets[i] for i in marks]))
        self.land = np.zeros((len(self.known), len(marks)), bool)
        for k, i in enumerate(marks):
            self.land[np.searchsorted(self.known, sets[i]), k] = True
        self.size = np.sqrt(self.land.sum(0))
        x = self.kernel(sets)
        values, vectors = np.linalg.eigh(x[marks])
        good = values > 1e-6 * values.max()
        nystrom = vectors[:, good] / np.sqrt(values[good])
        phi = np.column_stack([x @ nystrom, np.ones(len(x))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        beta = np.linalg.solve(phi.T @ phi + RIDGE * len(x) * np.eye(phi.shape[1]), phi.T @ y)
        # the landmarks' coefficients, spread over their n-grams
        alpha = (nystrom @ beta[:-1]) / self.size[:, None]
        self.weights = np.concatenate([self.land[at : at + 10_000] @ alpha for at in range(0, len(self.known), 10_000)]).astype(np.float32)
        self.bias = beta[-1]

    def places(self, s: np.ndarray) -> np.ndarray:
        """Where the n-grams that a landmark has stand in `known`."""
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return at[self.known[at] == s]

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of each set with each landmark."""
        shared = np.array([self.land[self.places(s)].sum(0) for s in sets], np.float64)
        return shared / self.size / np.sqrt(np.maximum([[len(s)] for s in sets], 1))

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        """Ridge scores: presence over the batch's n-grams times their weights."""
        at = [self.places(s) for s in sets]
        columns = np.unique(np.concatenate(at))
        presence = np.zeros((len(sets), len(columns)), np.float32)
        for row, p, s in zip(presence, at, sets, strict=True):
            row[np.searchsorted(columns, p)] = 1 / np.sqrt(max(len(s), 1))
        return presence @ self.weights[columns] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sets = [grams(t) for t in texts]
        raw = self.raw(sets)
        e = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(self.langs[b], float(p[i, b])) if len(sets[i]) else (UNKNOWN, 0.0) for i, b in enumerate(best)]


def train(docs: DataFrame) -> Model | None:
    """Fit on the PER_LANG texts with the least hashed ids of each language, held-out rows apart, SAMPLE in all (each
    language's first texts come first). The per-language limit is a window rank, which Spark cuts before the shuffle;
    the sample reaches the driver as n-gram numbers."""
    can = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = can.select("lang", "doc_id").distinct().withColumn("_r", rank).filter(F.col("_r") <= PER_LANG)
    drawn = ranked.orderBy("_r", F.xxhash64("doc_id", "lang"), "doc_id", "lang").limit(SAMPLE).select("doc_id", "lang")

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [grams(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "lang", "g"])

    rows = one_each(can.join(F.broadcast(drawn), ["doc_id", "lang"]), "doc_id", "lang").select(F.col("doc_id").cast("long"), "lang", "text")
    t = rows.mapInArrow(seen_in, "doc_id long, lang string, g array<long>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    found = t.column("g").combine_chunks()
    if not len(t):
        return None
    off, values = found.offsets.to_numpy(), found.values.to_numpy()
    sets, langs = [values[a:b] for a, b in zip(off, off[1:], strict=False)], t.column("lang").to_pylist()
    some = [(g, x) for g, x in zip(sets, langs, strict=True) if len(g)]
    return Model([g for g, _ in some], [x for _, x in some]) if some else None


def identify(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    Texts that are null or have no letter are 'und' with score 0, as are all where nothing can be learned."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                texts = b.column("text").to_pylist()
                found = model.value.predict(texts) if model.value else [(UNKNOWN, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
