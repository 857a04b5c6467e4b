"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. For each of HASHES hash functions the Cartesian tree over the hashed
shingles splits the subsequences of at least LEAST words into compact windows (l, c, r): every subsequence inside
[l, r] that holds position c has its least hash there. Windows of different documents with the same least hash
share that shingle, so the subsequences around it may be near-duplicates. As a passage of LEAST words reaches
SIDE shingles to the left or to the right of c, windows of one signature meet only where the SIDE shingles on one
side are the same too; that is certain for an exact passage, while an edit on either side within SIDE shingles can hide
a near one from one hash function.

Windows that meet are paired with the least document of their key (a star); the windows that two documents share are
joined to intervals and confirmed on the shingles themselves. Two windows that passages join to their key's least document are
in one class through it. All others are open and may hold a passage with any document of their key. Such a passage has so many
shingles around the window's that of the rarest of either side's, one is in both (a prefix filter, exact): these shingles refine
the key, the refined keys are stars again, and what is not in one class there either is compared pair by pair. So no pair of a
key is left out but those in one class; a frequent line alone refines to nothing, as what surrounds it is each document's own.
Before that, windows of a key that are alike as far as a shortest passage can reach become one: what meets one of them there meets
all, so copies are linked with the least of them and not compared with everything else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_long, cut, discard, mix, release, slices, stream

SHINGLE = 5
#: Words of the shortest passage; similarity in hundredths of shared to all shingles.
LEAST = 50
PERCENT = 75
HASHES = 3
SPAN = LEAST - SHINGLE + 1
SIDE = SPAN // 4

#: sig: the least hash with the function's number in its low bits; span: l << 32 | r; place: c << 32 | the left and
#: the right side's print in 16 bits each, 0 where the window does not reach so far; near: print of all that a shortest passage of
#: the window can reach.
LOW = 3
WINDOW = "sig long, doc_id long, span long, place long, near long"
#: Ranges of up to 2 ** LEVELS shingles have their least hash in a table.
LEVELS = 14


def _tables(v: np.ndarray, least: bool = True, levels: int = LEVELS) -> list[np.ndarray]:
    """t[j][i]: the least (or greatest) of v[i : i + 2 ** j], j up to levels."""
    out, pick = [v], np.minimum if least else np.maximum
    while len(out) <= levels and len(out[-1]) > 1 << (len(out) - 1):
        half = 1 << (len(out) - 1)
        out.append(pick(out[-1][:-half], out[-1][half:]))
    return out


def _stretch(t: list[np.ndarray], at: np.ndarray, low: np.ndarray, step: int) -> np.ndarray:
    """How far from `at` on (step 1) or before it (step -1) all values stay >= low (before it: > low)."""
    at, n = at.copy(), len(t[0])

    def hop(j: int, who: np.ndarray) -> np.ndarray:
        start = at[who] if step > 0 else at[who] - (1 << j)
        good = (start >= 0) & (start < len(t[j]))
        value = t[j][np.where(good, start, 0)]
        good &= (value >= low[who]) if step > 0 else (value > low[who])
        at[who[good]] += step << j
        return who[good]

    who = np.arange(len(at))
    while len(who):  # a long stretch takes several of the greatest hops
        who = hop(len(t) - 1, who)
    for j in range(len(t) - 2, -1, -1):
        hop(j, np.arange(len(at)))
    return np.clip(at, 0, n)


def windows(v: np.ndarray, least: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows l, c, r (inclusive) of the subsequences of at least `least` values. v may hold several texts
    with a 0 between them, which no window crosses; values are 1 or more. Of equal values the leftmost counts, so windows of
    one value inside a text lie apart."""
    none = np.zeros(0, np.int64)
    if len(v) < least:
        return none, none, none
    gaps = np.flatnonzero(v == 0)
    longest = int(np.diff(np.concatenate([[-1], gaps, [len(v)]])).max()) - 1
    t = _tables(v, levels=min(LEVELS, max(longest, least).bit_length()))  # no stretch is longer than a text
    j = min(least.bit_length() - 1, len(t) - 1)
    low = np.minimum(t[j][: len(v) - least + 1], t[j][least - (1 << j) : len(v) - (1 << j) + 1])
    # a value is the least of some subsequence of that length if the greatest of those minima around it is itself
    padded = np.concatenate([np.zeros(least - 1, v.dtype), low, np.zeros(least - 1, v.dtype)])
    g = _tables(padded, False, j)
    high = np.maximum(g[j][: len(v)], g[j][least - (1 << j) : least - (1 << j) + len(v)])
    c = np.flatnonzero((high == v) & (v > 0) & (np.concatenate([v[:1] + v.dtype.type(1), v[:-1]]) != v))
    l, r = _stretch(t, c, v[c], -1), _stretch(t, c, v[c], 1) - 1
    keep = (r - l + 1 >= least) & ((l == 0) | (v[np.maximum(l, 1) - 1] != v[c]))
    return l[keep], c[keep], r[keep]


def _print(s: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """16-bit print of the SIDE shingles from each place in `at` on; 0 where it is not there."""
    out = np.zeros(len(at), U64)
    for n, step in enumerate(stream(SIDE, 223)):
        out += s[np.clip(at + n, 0, len(s) - 1)] * step
    return np.where(there, mix(out) >> U64(48) | U64(1), U64(0))


def _reach(l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last shingle that a shortest passage of a window can hold."""
    return np.maximum(l, c - SPAN + 1), np.minimum(r, c + SPAN - 1)


def _rolling(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values before each place, each times a power of an odd number, and the inverses of these powers."""
    base = int(stream(1, 227)[0])
    power, inverse = (np.multiply.accumulate(np.full(len(s) + 1, b, U64)) for b in (base, pow(base, -1, 1 << 64)))
    return np.concatenate([np.zeros(1, U64), np.cumsum(s * power[:-1], dtype=U64)]), inverse


def _near(rolling: tuple[np.ndarray, np.ndarray], l: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """64-bit print of the shingles within reach of each window and of the place of c among them."""
    lo, hi = _reach(l, c, r)
    total, inverse = rolling
    one, two = stream(2, 229)
    return mix((total[hi + 1] - total[lo]) * inverse[lo] + (c - lo).astype(U64) * one + (hi - c).astype(U64) * two)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = stream(HASHES, 211)
    for batch in slices(batches):
        texts = [(d, x) for d, x in zip(batch.column("doc_id").to_pylist(), Words(batch.column("text")).shingles(SHINGLE), strict=True) if len(x) >= SPAN]
        if not texts:
            continue
        size = np.array([len(x) + 1 for _, x in texts])
        start = np.cumsum(size) - size
        s = np.concatenate([part for _, x in texts for part in (x, np.zeros(1, U64))])
        gap = start + size - 1
        rolling = _rolling(s)
        sig, doc, span, place, near = [], [], [], [], []
        ids = np.array([d for d, _ in texts], np.int64)
        for k, seed in enumerate(seeds):
            v = mix(s ^ seed) | U64(LOW + 1)
            v[gap] = 0
            l, c, r = windows(v)
            of = np.searchsorted(start, c, "right") - 1
            left, right = _print(s, c - SIDE, c - SIDE >= l), _print(s, c + 1, c + SIDE <= r)
            near.append(as_long(_near(rolling, l, c, r)))
            l, c, r = l - start[of], c - start[of], r - start[of]
            sig.append(as_long(v[c + start[of]] & U64(~LOW & 0xFFFFFFFFFFFFFFFF) | U64(k)))
            doc.append(ids[of])
            span.append(l << 32 | r)
            place.append(as_long(c.astype(U64) << U64(32) | left << U64(16) | right))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, doc, span, place, near)], ["sig", "doc_id", "span", "place", "near"])


#: What a missing shingle costs in hits: by the similarity itself where only one text differs, twice that where
#: both do, and so much that a run has none.
COSTS = (PERCENT / (100 - PERCENT), 2 * PERCENT / (100 - PERCENT), 1e6)


def _isin(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y."""
    if not len(y):
        return np.zeros(len(x), bool)
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union."""
    a, b = _distinct(a), _distinct(b)
    both = int(np.count_nonzero(_isin(a, b)))
    return both, len(a) + len(b) - both


def _segment(hit: np.ndarray, cost: float) -> tuple[int, int]:
    """Bounds [a, b) of the run in which hits most outweigh misses."""
    total = np.concatenate([[0.0], np.cumsum(np.where(hit, 1.0, -cost))])
    low = np.minimum.accumulate(total)
    b = int((total - low).argmax())
    return int(total[: b + 1].argmin()), b


def _narrowed(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[int, int, int, int, float] | None:
    """Passage (start, shingles, start, shingles, similarity) of a and b: their best runs, each cut to what the other
    holds until they are similar enough or change no more."""
    i, j, k, m = 0, len(a), 0, len(b)
    while True:
        p, q = _segment(_isin(b[k:m], a[i:j]), cost)
        k, m = k + p, k + q
        if m - k < SPAN:
            return None
        both, every = _overlap(a[i:j], b[k:m])
        if 100 * both >= PERCENT * every:
            return i, j - i, k, m - k, both / every
        p, q = _segment(_isin(a[i:j], b[k:m]), cost)
        if q - p < SPAN or (p, q) == (0, j - i):
            return None
        i, j = i + p, i + q


def _grams(x: np.ndarray) -> np.ndarray:
    """Hash of the SPAN shingles from each position on."""
    out = np.zeros(len(x) - SPAN + 1, U64)
    for n, step in enumerate(stream(SPAN, 307)):
        out += x[n : n + len(out)] * step
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The runs of SPAN shingles or more of a that b holds in the same order."""
    x, y = _grams(a), _grams(b)
    values, first = np.unique(y, return_index=True)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    to = np.where(values[at] == x, first[at], -1)
    out, i = [], 0
    while i < len(x):
        if to[i] < 0:
            i += 1
            continue
        n = SPAN
        while i + n < len(a) and to[i] + n < len(b) and a[i + n] == b[to[i] + n]:
            n += 1
        out.append((i, n, int(to[i]), n, 1.0))
        i += n - SPAN + 1
    return out


#: Shingles that two passages of SPAN shingles must share at least.
ENOUGH = -(-2 * PERCENT * SPAN // (100 + PERCENT))


def _best(hit: np.ndarray) -> np.ndarray:
    """Hits among the SPAN shingles from each position on."""
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[SPAN:] - total[:-SPAN]


def _slid(x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages of SPAN shingles: of each run of starts with enough hits the first, the last and some between."""
    starts = np.flatnonzero(_best(hit) >= ENOUGH)
    out = []
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) and len(y) >= SPAN else []:
        for i in sorted({*run[:: SPAN // 2].tolist(), int(run[-1])}):
            a = x[i : i + SPAN]
            j = int(_best(_isin(y, a)).argmax())
            b = y[j : j + SPAN]
            both, every = _overlap(a, b)
            if 100 * both >= PERCENT * every:
                out.append((i, SPAN, j, SPAN, both / every))
    return out


def _within(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages of two intervals. A run that fails is tried again at the next cost, its sides at the same one; where
    one failed, exact passages and short near ones are searched for too."""
    if np.array_equal(x, y):
        return [(0, len(x), 0, len(y), 1.0)]
    hit = _isin(x, y)
    out, failed = [], False
    todo = [(0, len(x), 0)]
    while todo:
        l, r, level = todo.pop()
        # a run that outweighs its misses has so many hits at least
        if r - l < SPAN or 100 * np.count_nonzero(hit[l:r]) < PERCENT * SPAN:
            continue
        i, j = _segment(hit[l:r], COSTS[level])
        i, j = l + i, l + j
        p = _narrowed(x[i:j], y, COSTS[level]) if j - i >= SPAN else None
        if p:
            i, j = i + p[0], i + p[0] + p[1]
            out.append((i, p[1], *p[2:]))
        else:
            failed = failed or j - i >= SPAN
            if level + 1 < len(COSTS):
                todo.append((i, j, level + 1))
        todo += [(l, i, level), (j, r, level)]  # the rest of the interval may hold another passage
    if failed:
        return out + _exact(x, y) + _slid(x, y, hit)
    return out or _slid(x, y, hit)  # a run shorter than SPAN may be enough of a passage with what surrounds it


def shared_passages(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, ...]]) -> list[tuple[int, int, int, int, float]]:
    """Confirmed passages (x start, x shingles, y start, y shingles, similarity) around anchors
    (l, c, r, l2, c2, r2). Anchors whose windows overlap near one diagonal are joined first."""
    joined: list[list[int]] = []
    for l, c, r, l2, c2, r2 in sorted(anchors, key=lambda a: (a[1] - a[4], a[0])):
        last = joined[-1] if joined else None
        if last and abs((c - c2) - last[4]) <= SPAN // 2 and l <= last[1] + 1 and l2 <= last[3] + 1 and r >= last[0] - 1 and r2 >= last[2] - 1:
            last[0], last[1], last[2], last[3], last[4] = min(l, last[0]), max(r, last[1]), min(l2, last[2]), max(r2, last[3]), c - c2
        else:
            joined.append([l, r, l2, r2, c - c2])
    out: list[tuple[int, int, int, int, float]] = []
    for l, r, l2, r2, _ in joined:
        if r - l + 1 >= SPAN and r2 - l2 + 1 >= SPAN:
            out += [(l + i, n, l2 + k, m, same) for i, n, k, m, same in _within(x[l : r + 1], y[l2 : r2 + 1])]
    seen: list[tuple[int, int, int, int, float]] = []
    for p in sorted(set(out), key=lambda p: (-p[1], p)):
        if not any(q[0] <= p[0] and p[0] + p[1] <= q[0] + q[1] for q in seen):
            seen.append(p)
    return seen


def _anchors(column: pa.Array) -> list[list[tuple[int, ...]]]:
    """Per row its anchors (l, c, r, l2, c2, r2), each once."""
    import pyarrow.compute as pc

    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    span, place, others = column.flatten().flatten()
    times = pc.list_value_length(others).to_numpy(zero_copy_only=False)
    span2, place2 = (x.to_numpy() for x in others.flatten().flatten())
    row = np.repeat(np.repeat(np.arange(len(column)), counts), times)
    span, place = np.repeat(span.to_numpy(), times), np.repeat(place.to_numpy(), times)
    low = 0xFFFFFFFF
    t = [row, span >> 32, place >> 32, span & low, span2 >> 32, place2 >> 32, span2 & low]
    order = np.lexsort(t[::-1])
    t = [x[order] for x in t]
    new = np.ones(len(row), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in t], axis=0)
    ends = np.searchsorted(t[0][new], np.arange(len(column) + 1))
    rows = list(zip(*(x[new].tolist() for x in t[1:]), strict=True))
    return [rows[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


#: Pairs of a key's open and other windows up to which they are compared one by one.
CROWD = 1024
LINK = "doc_id long, match_id long, start int, n_words int, match_start int, match_words int, similarity double"


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LINK.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
    for batch in slices(batches, "ta", 1 << 19):
        us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        # a document's rows are neighbours: it is hashed once
        once = [{d: i for i, d in enumerate(ids)} for ids in (us, vs)]
        left, right = (dict(zip(at, Words(batch.column(c).take(pa.array(at.values(), pa.int64()))).shingles(SHINGLE), strict=True)) for c, at in zip(("ta", "tb"), once, strict=True))
        rows = []
        for u, v, anchors in zip(us, vs, _anchors(batch.column("anchors")), strict=True):
            rows += [(u, v, p[0], p[1] + SHINGLE - 1, p[2], p[3] + SHINGLE - 1, p[4]) for p in shared_passages(left[u], right[v], anchors)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _keyed(members: DataFrame) -> DataFrame:
    """A row per window and side: key (of signature, side and that side's print), doc_id, span, place, near."""
    side = lambda i: F.shiftright("place", 16 * (1 - i)).bitwiseAND(F.lit(0xFFFF))
    keys = [F.when(side(i) != 0, F.xxhash64("sig", F.lit(i), side(i))) for i in (0, 1)]
    return members.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "doc_id", "span", "place", "near")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles around the windows of each document, each once: as far as a shortest passage can reach."""
    for batch in slices(batches):
        ids, parts = [], []
        for d, found, x in zip(batch.column("doc_id").to_pylist(), batch.column("windows").to_pylist(), Words(batch.column("text")).shingles(SHINGLE), strict=True):
            near = np.zeros(len(x), bool)
            for w in found:
                c = w["place"] >> 32
                near[max(w["span"] >> 32, c - SPAN + 1) : min(w["span"] & 0xFFFFFFFF, c + SPAN - 1) + 1] = True
            parts.append(np.unique(x[near]))
            ids.append(np.full(len(parts[-1]), d, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(as_long(np.concatenate(parts)))], ["doc_id", "s"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with the shingles around them that occur elsewhere, the rarest first: of `known`, the first `rare` must hold one of any
    passage's, and `need` must be in it. A passage of the window has SPAN shingles or more around c, and shares PERCENT of its distinct
    ones; windows that cannot have one are left out."""
    for batch in slices(batches):
        rows = []
        for d, found, common, x in zip(batch.column("doc_id").to_pylist(), batch.column("windows").to_pylist(), batch.column("common").to_pylist(), Words(batch.column("text")).shingles(SHINGLE), strict=True):
            s = as_long(x)
            often = {w["s"]: w["k"] for w in common or []}
            seen: dict[tuple[int, int], tuple[list[int], int]] = {}
            for w in found:
                at = w["span"], w["place"] >> 32
                if at not in seen:
                    lo, hi = max(at[0] >> 32, at[1] - SPAN + 1), min(at[0] & 0xFFFFFFFF, at[1] + SPAN - 1)
                    near = set(s[lo : hi + 1].tolist())
                    starts = range(lo, min(at[1], hi - SPAN + 1) + 1)
                    distinct = SPAN if len(near) == hi - lo + 1 else min((len(set(s[i : i + SPAN].tolist())) for i in starts), default=SPAN)
                    seen[at] = [v for _, v in sorted((often[v], v) for v in near if v in often)], -(-PERCENT * distinct // 100)
                known, need = seen[at]
                if len(known) >= need:
                    rows.append((w["key"], known, len(known) + 1 - need, need, d, w["span"], w["place"], w["open"]))
        if rows:
            names = ["key", "known", "rare", "need", "doc_id", "span", "place", "open"]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _held(met: DataFrame, links: DataFrame) -> DataFrame:
    """met (windows of doc_id, and `others`: windows of v) with `joined`: whether a confirmed passage of the two holds the window's
    shingle and one of the others'."""
    runs = links.groupBy(F.col("doc_id").alias("_u"), F.col("match_id").alias("_v")).agg(F.collect_set(F.struct("start", "n_words", "match_start", "match_words")).alias("_runs"))
    holds = lambda start, words, c: (start <= c) & (c <= start + words - SHINGLE)
    c = F.shiftright("place", 32)
    both = F.exists("_runs", lambda x: holds(x["start"], x["n_words"], c) & F.exists("others", lambda w: holds(x["match_start"], x["match_words"], F.shiftright(w["place"], 32))))
    met = met.join(runs, (met.doc_id == runs._u) & (met.v == runs._v), "left")
    return met.withColumn("joined", F.coalesce(both, F.lit(False))).drop("_runs", "_u", "_v")


def _joined(windows_: DataFrame, of_rep: DataFrame, links: DataFrame) -> DataFrame:
    """windows_ with `v` and `others` (their key's representative and its windows) and `joined` as in _held."""
    return _held(windows_.join(of_rep, "key").filter("doc_id != v"), links)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Pairs (doc_id, match_id) of documents that share a passage of LEAST words or more, with the passage's first
    word and length in both and its similarity; match_id is the representative of the key they met in or, where
    that shares no passage, any document of the key.

    Documents without a shared passage are absent, as are rows without an id, null, empty and shorter texts.
    Copies are linked with their representative only. Rows that share an id are one document, so a passage that only they
    share is none. Very long texts are taken whole. Ties between windows go to the leftmost shingle. Columns other than doc_id
    and text are ignored; an empty table gives none."""
    named = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = cut(named.mapInArrow(_windows, WINDOW), "windows")
    several = every.groupBy("sig").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("sig")
    members = cut(every.join(several.hint("merge"), "sig", "left_semi"), "members")
    discard(every)  # larger than the texts
    release(docs)
    key = ["key"]
    least = _keyed(members).groupBy(key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_m"), (F.count("*") > 2).alias("many")).filter("rep != _m").select(*key, "rep", "many")
    keyed = cut(_keyed(members).join(least.hint("merge"), key), "keyed")
    release(docs)
    ids = keyed.select("doc_id").distinct()
    texts = cut(named.join(ids.hint("merge"), "doc_id", "left_semi").withColumnRenamed("doc_id", "id"), "texts")
    a, b = texts.select(F.col("id").alias("u"), F.col("text").alias("ta")), texts.select(F.col("id").alias("v"), F.col("text").alias("tb"))

    def compared(pairs: DataFrame) -> DataFrame:
        asked = pairs.groupBy("u", "v").agg(F.collect_set(F.struct("span", "place", "others")).alias("anchors"))
        return cut(asked.join(a, "u").join(b, "v").select("u", "v", "anchors", "ta", "tb").mapInArrow(_confirm, LINK), "links")

    window = F.struct("span", "place")
    first = lambda w: w.join(w.groupBy("key").agg(F.min("doc_id").alias("v")), "key").filter("doc_id = v").groupBy("key").agg(F.first("v").alias("v"), F.collect_set(window).alias("others"))
    several_of = lambda w: w.groupBy("key").agg(F.bool_or("open").alias("o"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("o and a != b").select("key")
    starred = lambda w: w.select(F.col("doc_id").alias("u"), "v", "span", "place", "others")
    of_rep = keyed.filter("doc_id = rep").groupBy(key).agg(F.first("rep").alias("v"), F.collect_set(window).alias("others"), F.collect_set("near").alias("nears"))
    found = compared(starred(keyed.filter("doc_id != rep").join(of_rep, key)))
    release(docs)
    # Keys of three documents or more with a window that its representative does not hold. What looks like the representative has been
    # compared with all of its key in its place.
    seen = _joined(keyed.filter("many").drop("rep", "many"), of_rep, found).filter(~F.col("joined") | ~F.array_contains("nears", F.col("near")))
    seen = cut(seen.select(*key, "doc_id", "span", "place", "near", (~F.col("joined")).alias("open")), "seen")
    active = cut(seen.join(several_of(seen), key, "left_semi"), "active")
    # Windows that are alike: the least document's stays, the others are linked with it unless they are.
    alike = active.withColumn("key", F.xxhash64("key", "near"))
    alike = alike.join(several_of(alike), key, "left_semi")
    copies = _joined(alike, first(alike), found).filter("not joined")
    active = active.groupBy(*key, "near").agg(F.min(F.struct("doc_id", "span", "place")).alias("w"), F.bool_or("open").alias("open")).select(*key, "w.*", "open")
    active = cut(active.join(several_of(active), key, "left_semi"), "active")
    places = active.groupBy("doc_id").agg(F.collect_set(window).alias("windows"))
    around = cut(places.join(texts, F.col("doc_id") == F.col("id")).select("doc_id", "text", "windows").mapInArrow(_around, "doc_id long, s long"), "around")
    often = around.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1")
    common = cut(around.join(often, "s").groupBy("doc_id").agg(F.collect_list(F.struct("s", "k")).alias("common")), "common")
    release(docs)

    apart = active.groupBy("doc_id").agg(F.collect_list(F.struct(*key, "span", "place", "open")).alias("windows")).join(common, "doc_id")
    apart = apart.join(texts, F.col("doc_id") == F.col("id")).select("doc_id", "text", "windows", "common")
    kept = cut(apart.mapInArrow(_refined, "key long, known array<long>, rare int, need int, doc_id long, span long, place long, open boolean"), "kept")
    # Keys of few windows: pair by pair, those that have enough in common. All others are refined.
    crowd = kept.groupBy(key).agg(F.count_if("open").alias("o"), F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("o > 0 and a != b").select(*key, (F.col("o") * F.col("n") > CROWD).alias("crowded"))
    kept = cut(kept.join(crowd, key), "kept")
    few = kept.filter("not crowded")
    y = few.select(*key, F.col("known").alias("y_known"), F.col("need").alias("y_need"), F.col("doc_id").alias("v"), F.array(window).alias("others"), F.col("open").alias("y_open"))
    few = few.join(y, key).filter("doc_id > v and (open or y_open)").filter(F.size(F.array_intersect("known", "y_known")) >= F.least("need", "y_need"))
    few = _held(few.select("doc_id", "v", "span", "place", "others"), found).filter("not joined")
    fine = kept.filter("crowded").select(*key, F.explode(F.slice("known", F.lit(1), F.col("rare"))).alias("s"), "doc_id", "span", "place", "open")
    fine = cut(fine.select(F.xxhash64("key", "s").alias("key"), "doc_id", "span", "place", "open"), "fine")
    fine = cut(fine.join(several_of(fine), key, "left_semi"), "fine")
    release(docs)
    of_first = cut(first(fine), "first")
    starts = starred(_joined(fine, of_first, found).filter("not joined")).union(starred(copies)).union(starred(few))
    more = found.union(compared(starts))
    release(docs)
    # Pairs of a refined key of which one is open and one is not in the representative's class.
    rest = _joined(fine, of_first, more).select(*key, "doc_id", "span", "place", "open", "joined")
    rest = cut(rest, "rest")
    y = rest.select(*key, F.col("doc_id").alias("y"), F.col("span").alias("y_span"), F.col("place").alias("y_place"), F.col("open").alias("y_open"), F.col("joined").alias("y_joined"))
    # each pair once: its greater document leads, from whichever side it was met
    pair = rest.filter("not joined").join(y, key).filter("doc_id != y and (open or y_open) and (doc_id > y or y_joined)")
    lead = F.col("doc_id") > F.col("y")
    of = lambda a, b: F.when(lead, F.col(a)).otherwise(F.col(b))
    pair = pair.select(of("doc_id", "y").alias("doc_id"), of("y", "doc_id").alias("v"), of("span", "y_span").alias("span"), of("place", "y_place").alias("place"), F.array(F.struct(of("y_span", "span").alias("span"), of("y_place", "place").alias("place"))).alias("others"))
    last = cut(starred(_held(pair.distinct(), more).filter("not joined")), "pairs")
    return more.union(compared(last)).distinct()
