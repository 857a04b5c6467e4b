"""Neighbour search against brute force: recall, scores, order, copies, hot vectors and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import neighbours


def brute(rows, k):
    """Per query id (divisible by 20) every candidate's best score, the k best first; one vector length only."""
    best = {}
    for i, v in rows:
        best.setdefault(i, []).append(np.array(v, np.float64))
    ids = sorted(best)
    x = np.concatenate([best[i] for i in ids])
    owner = np.concatenate([[i] * len(best[i]) for i in ids])
    out = {}
    for q in ids:
        if q % 20 == 0:
            score = {}
            for v in best[q]:
                for i, s in zip(owner, (x * v).sum(1), strict=True):
                    if i != q:
                        score[i] = max(s, score.get(i, -math.inf))
            out[q] = sorted(score.items(), key=lambda e: (-round(e[1], 9), e[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def ask(spark, rows, schema="vec_id long, embedding array<float>", k=20):
    return found(neighbours.search(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, k))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_and_scores(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "SAMPLE", 1500)
    monkeypatch.setattr(neighbours, "LIST", 100)
    monkeypatch.setattr(neighbours, "GROUP", 512)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16))
    if clustered:
        x = rng.standard_normal((40, 16))[rng.integers(0, 40, 6000)] + 0.2 * x
    x = (x * rng.uniform(0.5, 2, (6000, 1))).astype(np.float32)
    x[3000:5000] = x[60]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = ask(spark, rows), brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-9 for _, i, s in got[q])
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        hits += len({i for i, _ in w} & {i for _, i, _ in got[q]})
    assert hits >= 0.93 * 20 * len(want)
    assert [i for _, i, _ in got[60]] == [i for i, _ in want[60]]  # ties of copies go to the smallest ids
    assert [i for _, i, _ in got[4000]] == [i for i, _ in want[4000]]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(90)]
    got, want = ask(spark, rows), brute(rows, 20)
    assert {q: [i for _, i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    got = ask(spark, rows[:8])
    assert {q: len(g) for q, g in got.items()} == {0: 7}  # fewer candidates than k: all of them
    assert ask(spark, rows[:1]) == {}
    assert ask(spark, []) == {}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]),
            (None, [9.0, 9.0]), (20, None), (40, [0.0, 1.0]), (8, [-1.0, 0.0]), (8, [0.0, 3.0]), (8, [0.0, 3.0]), (40, [0.0, 1.0]), (60, [])]
    got = ask(spark, rows, "vec_id long, embedding array<double>")
    assert got == {0: [(1, 1, 0.5), (2, 8, 0.0), (3, 40, 0.0)], 40: [(1, 8, 3.0), (2, 1, 0.5), (3, 0, 0.0)]}


def test_clashing_columns(spark):
    rows = [(i, [float(i), 1.0], "a", 1, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int, score double")
    got = found(neighbours.search(df, F.col("id") % 20 == 0))
    assert [i for _, i, _ in got[20]] == list(range(29, 20, -1)) + list(range(19, 8, -1))


def test_quantile_and_test_level():
    """Of squared lengths of random vectors, the share in the first columns exceeds the limit about as often as stated."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200_000, 16)) ** 2
    for d, limit in neighbours.stops(16, 0.01):
        assert 0.008 < (x[:, :d].sum(1) / x.sum(1) > limit).mean() < 0.012
