"""Periodic runs against brute force over every period, planted repetitions, digests and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from flowmill.llm import periods, queries


def brute(w):
    """(start, length, period) of every run, by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and all(any(w[x] != w[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, plant=True):
    """The row of one document, by the definitions."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def key(row):
    return tuple((x is None, x) for x in row)


def test_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = []
            for _ in range(rng.randint(0, 5)):
                u = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 22))]
                w += (u * 9)[: len(u) * rng.randint(1, 6) + rng.randint(0, 3)]
            texts.append(w)
        flat = np.array([x for t in texts for x in t], np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        assert [tuple(r) for r in periods.find_runs(flat, bounds).tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute(t)]


def test_wavelet_tree():
    rng = np.random.default_rng(7)
    for n in (1, 2, 7, 64, 200):
        v = rng.permutation(n)
        lo, x = rng.integers(0, n, 300), rng.integers(0, 2 * n + 3, 300)
        hi = lo + rng.integers(0, n - lo + 1)
        want = [min((y for y in v[a:b] if y >= z), default=-1) for a, b, z in zip(lo, hi, x)]
        assert periods.WaveletTree(v).successor(lo, hi, x).tolist() == want


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op12_periods(spark, sf).collect()), key=key)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 20_000).collect()
    want = sorted((plain(*d) for d in docs), key=key)
    kept = {d["doc_id"] for d in docs}
    assert len(kept) > 150 and [r for r in got if r[0] in kept] == want
    assert sum(r[1] > 0 for r in got) > 5


def test_edge_cases(spark):
    long = "ab cd " * 50_000 + "x"
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a a a a a a a"), (4, "a\x0ba a\x0ca a\ta"), (5, "x y " * 4), (5, "x y " * 4), (6, "é à " * 3), (7, long), (8, "a\u2003a a a a a a"), (9, "a A a A a A a A"), (10, "w " * 5)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, n_runs string")
    got = sorted(map(tuple, periods.periodic_runs(df).collect()), key=key)
    assert got == sorted((plain(*r, plant=False) if r[0] != 7 else (7, 1, 0, 100_000, 2, 50_000_000, *(hashlib.sha256(x).hexdigest() for x in (b"0,100000,2\n", b"ab cd x"))) for r in rows), key=key)
    assert periods.periodic_runs(df.limit(0)).count() == 0
