"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words in which words q apart are equal, q its smallest period, that is at least max(6, 4 q) words long and
that no neighbouring word extends. For a length L = 4, 8, 16, ... the text has blocks of L words that begin every L / 2 words. A
run with L / 2 < q <= L (q <= 4 for L = 4) is long enough to hold a block together with its next occurrence, q words on, since
a block of at least q words of it recurs at multiples of q only. So each block asks for its first occurrence in the window of
L places behind it: a range successor on the block's interval of the suffix array, by a wavelet tree. Neighbouring blocks that
answer the same distance are one progression, hence one candidate; its ends are less than L / 2 words further out and are
found by comparing words. Everything is exact and in proportion to the words, up to logarithms.

Texts of about a megabyte are indexed together (words of different documents differ); nothing is shuffled and a lost task is
read again. A long text is one slice by itself."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The shortest run, how often it holds its period, the shortest block.
SHORTEST, TIMES, BLOCK = 6, 4, 4

ROWS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Suffix array of a sequence of word numbers, by doubling, as deep as queries reach: suffixes that agree on more words than
    half of the longest document stay in any order.

    `blocks[L]` holds for the blocks of L words, one every L / 2 words, the interval (first place, end) of the suffixes that begin
    with it. `shared` marks the places of suffixes whose first BLOCK words occur elsewhere in their document. Suffixes are
    cut at the ends of their documents; only those that still share their words take part in the next doubling."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, ends: np.ndarray, longest: int):
        n = len(words)
        key = doc * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.shared = np.zeros(n, bool)
        first = self._starts(key[self.order])
        rank = np.zeros(n, np.int64)
        rank[self.order] = first
        length = 1
        while True:
            size = np.bincount(first, minlength=n)
            many = size[first] > 1
            if length == BLOCK:
                self.shared = many
            if length >= BLOCK:
                lo = rank[:: length // 2].copy()
                self.blocks[length] = lo, lo + size[lo]
            active = np.flatnonzero(many)
            if not len(active) or 2 * length > longest:
                return
            # order each group by the rank of what follows; a suffix that ends there is before all others
            at = self.order[active]
            behind = at + length
            follows = np.where(behind < ends[doc[at]], rank[np.minimum(behind, n - 1)] + 1, 0)
            old = first[active]
            turn = np.lexsort((follows, old))
            self.order[active] = at[turn]
            new = follows[turn]
            fresh = np.ones(len(active), bool)
            fresh[1:] = (old[1:] != old[:-1]) | (new[1:] != new[:-1])
            first[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
            rank[self.order[active]] = first[active]
            length *= 2

    @staticmethod
    def _starts(ordered: np.ndarray) -> np.ndarray:
        """For every place the first place of its group of equal keys."""
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        return np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))


class WaveletTree:
    """Wavelet tree of a sequence of numbers, most significant bit first; all queries of a batch walk it together."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            count = np.zeros(self.n + 1, np.int64)
            np.cumsum(zero, out=count[1:])
            self.zeros.append(count)
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places lo to hi are less than x."""
        less = np.zeros(len(x), np.int64)
        lo, hi = lo.copy(), hi.copy()
        beyond = x >= 1 << self.bits
        less[beyond], hi[beyond] = (hi - lo)[beyond], lo[beyond]
        for level, count in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            left, right = count[lo], count[hi]
            less += np.where(one, right - left, 0)
            lo = np.where(one, count[-1] + lo - left, left)
            hi = np.where(one, count[-1] + hi - right, right)
        return less

    def ranked(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k smaller ones among places lo to hi (k less than hi - lo)."""
        value = np.zeros(len(k), np.int64)
        for level, count in enumerate(self.zeros):
            left, right = count[lo], count[hi]
            one = k >= right - left
            k = np.where(one, k - (right - left), k)
            value += np.where(one, 1 << (self.bits - 1 - level), 0)
            lo = np.where(one, count[-1] + lo - left, left)
            hi = np.where(one, count[-1] + hi - right, right)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value of at least x in places lo to hi, -1 where there is none."""
        k = self.below(lo, hi, x)
        there = np.flatnonzero(k < hi - lo)
        out = np.full(len(x), -1, np.int64)
        out[there] = self.ranked(lo[there], hi[there], k[there])
        return out


def reach(words: np.ndarray, at: np.ndarray, edge: np.ndarray, period: np.ndarray, way: int, most: int) -> np.ndarray:
    """How many words from `at` on in direction `way`, at most `most` and none past `edge`, equal the word a period back."""
    out = np.zeros(len(at), np.int64)
    wide = max(1, (1 << 18) // most)
    for lo in range(0, len(at), wide):
        here = slice(lo, lo + wide)
        place = at[here, None] + way * np.arange(most)
        inside = (place - edge[here, None]) * way <= 0
        place = np.where(inside, place, at[here, None] - way)
        same = inside & (words[place] == words[place - way * period[here, None]])
        out[here] = np.cumprod(same, axis=1).sum(1)
    return out


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in order of document, start and period. Document i has the word
    numbers words[bounds[i]:bounds[i + 1]]; starts count from there."""
    n, found = len(words), [np.zeros((0, 4), np.int64)]
    if n < SHORTEST:
        return found[0]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin, end = bounds[:-1], bounds[1:]
    suffixes = Suffixes(words, doc, end, int((end - begin).max()))
    # the other suffixes are in no query's interval, so the tree leaves them out
    moved = np.concatenate([[0], np.cumsum(suffixes.shared)])
    tree = WaveletTree(suffixes.order[suffixes.shared])
    for size, (lo, hi) in suffixes.blocks.items():
        block = np.arange(0, n, size // 2)
        good = (hi - lo > 1) & (block + size <= end[doc[block]])
        block, lo, hi = block[good], lo[good], hi[good]
        step = tree.successor(moved[lo], moved[hi], block + 1) - block
        good = (step > (size // 2 if size > BLOCK else 0)) & (step <= size)
        block, step = block[good], step[good]
        # blocks of one run answer the same step at a distance that leaves at least a period in common
        by = np.lexsort((block, step, doc[block]))
        block, step = block[by], step[by]
        new = np.ones(len(block), bool)
        new[1:] = (doc[block][1:] != doc[block][:-1]) | (step[1:] != step[:-1]) | (np.diff(block) > size)
        last = np.append(np.flatnonzero(new)[1:], len(block)) - 1 if len(block) else new.astype(np.int64)
        left, right, period, of = block[new], block[last] + step[last] + size, step[new], doc[block[new]]
        left = left - reach(words, left - 1, begin[of], period, -1, size // 2)
        right = right + reach(words, right, end[of] - 1, period, 1, size // 2)
        good = right - left >= np.maximum(SHORTEST, TIMES * period)
        found.append(np.stack([of, left - begin[of], right - left, period], axis=1)[good])
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


@dataclass
class Text:
    """Words of one document and for each place the word that stands there."""

    words: list[bytes]
    place: np.ndarray


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of n places: in one document of ten (by the checksum of its id) the words from
    some place on repeat a short stretch; elsewhere, and without an id, all stay."""
    place = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[a:] = a + (place[a:] - a) % p
    return place


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """ROWS per row of docs: the number of runs, the one of the greatest length over period (ties: smallest start, then period;
    nulls without any), the checksum of all runs and that of the text without repetitions: words after a run's first q are
    dropped. With `plant`, over texts into which repetitions are planted (`planted`).

    A null or empty text has no words: no run, and the checksums of the empty string. Repeated rows are answered each; null ids
    are kept (nothing is planted there); other columns are ignored; an empty table gives an empty one. Words are compared as
    bytes, and a text is never cut."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            texts = [(t or "").encode().split() for t in b.column("text").to_pylist()]  # at the six ASCII spaces
            texts = [Text(ws, planted(i if plant else None, len(ws))) for i, ws in zip(ids, texts, strict=True)]
            bounds = np.concatenate([[0], np.cumsum([len(t.words) for t in texts])]).astype(np.int64)
            flat = pa.array([w for t in texts for w in t.words], pa.large_binary()).dictionary_encode()
            number = np.asarray(flat.indices, np.int64)
            if len(number):
                number = number[np.concatenate([t.place + lo for t, lo in zip(texts, bounds[:-1], strict=True)])]
            runs = find_runs(number, bounds)
            cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_pylist([{"doc_id": i, **report(t, runs[lo:hi, 1:])} for i, t, lo, hi in zip(ids, texts, cut[:-1], cut[1:], strict=True)], SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(answer, ROWS)


SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in ROWS.split(", ")])


def report(text: Text, runs: np.ndarray) -> dict[str, int | str | None]:
    keep = np.ones(len(text.words), bool)
    best: list[int] | None = None
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
        if best is None or length * best[2] > best[1] * period:
            best = [start, length, period]
    kept = b" ".join([text.words[i] for i in text.place[keep].tolist()])
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    start, length, period = best or (None, None, None)
    return {
        "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if best else None,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
    }
