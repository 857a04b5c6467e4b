import random

import numpy as np
import pyarrow as pa

from flowmill.llm import passages as p


def brute_windows(v, least):
    """For every subsequence of `least` values or more, the place of its least value."""
    return {(i, j): i + int(v[i : j + 1].argmin()) for i in range(len(v)) for j in range(i + least - 1, len(v))}


def plain_windows(v, least):
    """Compact windows by recursion, without those inside a window of the same least value."""
    out, todo = [], [(0, len(v))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            c = lo + int(v[lo:hi].argmin())
            out.append((lo, c, hi - 1))
            todo += [(lo, c), (c + 1, hi)]
    return sorted(w for w in out if not any(o != w and v[o[1]] == v[w[1]] and o[0] <= w[0] and w[2] <= o[2] for o in out))


def kernel(v, least):
    return sorted(zip(*(x.tolist() for x in p.windows(v, least)), strict=True))


def test_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(1)
    for n in (0, 3, 9, 40):
        v = rng.permutation(n).astype(np.uint64) + p.U64(1)
        found = {}
        for l, c, r in kernel(v, 5):
            for i in range(l, c + 1):
                for j in range(c, r + 1):
                    if j - i + 1 >= 5:
                        assert (i, j) not in found
                        found[i, j] = c
        assert found == brute_windows(v, 5)


def test_windows_of_equal_values_and_several_texts():
    rng = np.random.default_rng(2)
    for n in (1, 46, 100, 700):
        for high in (2, 6, 1 << 60):
            v = rng.integers(1, high, n).astype(np.uint64)
            assert kernel(v, 46) == plain_windows(v, 46)
    a, b = rng.integers(1, 9, 100).astype(np.uint64), rng.integers(1, 1 << 60, 300).astype(np.uint64)
    both = kernel(np.concatenate([a, [p.U64(0)], b, [p.U64(0)]]), 46)
    assert both == plain_windows(a, 46) + [(l + 101, c + 101, r + 101) for l, c, r in plain_windows(b, 46)]
    assert kernel(np.full(200_000, 7, np.uint64), 46) == [(0, 0, 199_999)]


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rnd = random.Random(4)
    passage, line = words(rnd, 60), words(rnd, 20)
    near = passage[:]
    near[30] = "changed"
    rows = []
    for i in range(60):
        w = words(rnd, rnd.randrange(100, 300))
        at = rnd.randrange(len(w))
        if i % 6 == 0:
            w[at:at] = passage if i % 12 else near
        elif i % 6 == 1:
            w[at:at] = line
        rows.append((i, " ".join(w), 0))
    got = p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()
    assert {r.doc_id for r in got} | {r.match_id for r in got} == {i for i in range(60) if i % 6 == 0}
    for r in got:
        mine, other = (rows[i][1].split()[s : s + n] for i, s, n in ((r.doc_id, r.start, r.n_words), (r.match_id, r.match_start, r.match_words)))
        assert len(set(mine) & set(passage)) >= 50 and len(set(other) & set(passage)) >= 50


def test_documents_with_exact_common_runs(spark):
    """Every pair of documents that shares a run of 60 words has both ends in the result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text.translate({c: c + 32 for c in range(65, 91)}).split() for r in docs.collect()}
    runs = {}
    for i, w in texts.items():
        for k in range(len(w) - 59):
            runs.setdefault(" ".join(w[k : k + 60]), set()).add(i)
    want = {i for s in runs.values() if len(s) > 1 for i in s}
    got = p.repeated_passages(docs).collect()
    assert want <= {r.doc_id for r in got} | {r.match_id for r in got}


def test_nulls_repeats_long_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    same = " ".join(["the"] * 5000)
    rows = [(None, long), (1, None), (2, ""), (3, long), (4, long), (4, long), (5, same), (6, same)]
    got = {(r.doc_id, r.match_id, r.n_words) for r in p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (4, 3, 20000) in got
    assert p.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passage_of_frequent_lines_is_found(spark):
    """Two documents share a passage whose every least shingle is in lines that many lower ids have without it."""
    rnd = random.Random(9)
    one, two = words(rnd, 40), words(rnd, 40)
    rows = [(i, " ".join(words(rnd, 60) + (one, two)[i % 2] + words(rnd, 60))) for i in range(24)]
    rows += [(i, " ".join(words(rnd, 60) + one + two + words(rnd, 60))) for i in (100, 101)]
    got = p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.match_id) for r in got} == {(101, 100)}
    assert all(r.n_words >= p.LEAST for r in got)


def test_narrow_window_of_a_repeated_shingle_is_kept():
    """The least shingle occurs in two windows apart; both are kept, the wider and the narrower."""
    rnd = random.Random(3)
    line = words(rnd, 40)
    text = pa.array([" ".join(sum((words(rnd, n) + line for n in (90, 200, 60, 120, 80, 150)), []))])
    shingles = p.Words(text).shingles(p.SHINGLE)[0]
    want = set()
    for k, seed in enumerate(p.stream(p.HASHES, 211)):
        v = p.mix(shingles ^ seed) | p.U64(p.LOW + 1)
        for l, c, r in plain_windows(v, p.SPAN):
            want.add((int(p.as_long(np.array([int(v[c]) & ~p.LOW | k], p.U64))[0]), l << 32 | r))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), text], ["doc_id", "text"])
    got = [(a, b) for out in p._windows(iter([batch])) for a, b in zip(out.column("sig").to_pylist(), out.column("span").to_pylist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({a for a, _ in got}) < len(got)


def test_exact_passage_beside_a_run_that_fails():
    """A long run of shingles that the other text holds singly and in another order hides no exact passage."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    many = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    apart = np.concatenate([np.append(many[i : i + 20], rng.integers(0, 1 << 60, 20).astype(np.uint64)) for i in range(0, 300, 20)])
    junk = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    for x in (np.concatenate([many, junk, passage]), np.concatenate([many, passage])):
        y = np.concatenate([passage, junk[::-1], apart])
        got = p.shared_passages(x, y, [(0, len(x) - 1, len(x) - 1, 0, 49, len(y) - 1)])
        at = len(x) - 50
        assert any(q[0] <= at and q[0] + q[1] >= at + 50 and q[2] == 0 for q in got)


def test_near_passages_are_recalled(spark):
    """Of pairs of documents with a passage at similarity 0.75 to 1, one edit or more each, at least 0.9 are found."""
    rnd = random.Random(11)
    rows, want = [], set()
    for k in range(120):
        one = words(rnd, rnd.randrange(60, 160))
        two = one[:]
        for at in range(rnd.randrange(25, 35), len(two) - 4, rnd.randrange(36, 60)):
            two[at] = "edit"
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        if len(x & y) / len(x | y) >= 0.75:
            want.add(k)
        rows += [(2 * k + i, " ".join(words(rnd, 80) + t + words(rnd, 80))) for i, t in enumerate((one, two))]
    assert len(want) > 80
    got = {(r.match_id, r.doc_id) for r in p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)
    assert len({a // 2 for a, _ in got} & want) >= 0.9 * len(want)


def test_links_between_other_members_of_a_key_are_kept(spark):
    """Every document holds one of two lines. Two documents hold a few more words beside it; passages elsewhere join each to one that
    holds both lines over and over, and all of those to each other, so that the two are in one group before they meet."""
    rnd = random.Random(21)
    line = [words(rnd, 42) for _ in range(2)]
    rows = [(i, " ".join(words(rnd, 60) + line[i % 2] + words(rnd, 60))) for i in range(8)]
    want = set()
    for k in range(12):
        more, at, one, two = words(rnd, 9), 100 + 4 * k, line[k % 2], line[1 - k % 2]
        for i in (at, at + 1):
            elsewhere = words(rnd, 60)
            rows += [(i, " ".join(elsewhere + words(rnd, 60) + two + one + two)), (i + 2, " ".join(elsewhere + words(rnd, 60) + one + more + words(rnd, 60)))]
            want.add((i + 2, i))
        want.add((at + 3, at + 2))
    got = {(r.doc_id, r.match_id) for r in p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got
    assert all(u % 4 < 2 and v % 4 < 2 for u, v in got - want)


def test_short_common_run_is_enough_of_a_passage(spark):
    """45 words in common make 41 of the 51 shingles of two passages of 50 words: similarity 0.80."""
    rnd = random.Random(22)
    common = words(rnd, 45)
    rows = [(i, " ".join(words(rnd, 60) + common + words(rnd, 60))) for i in (1, 2)]
    got = p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.match_id, r.n_words, r.match_words) for r in got} == {(2, 1, 50, 50)}
    assert all(r.similarity >= 0.75 for r in got)


def test_windows_alike_within_reach_have_one_print():
    """Prints agree exactly where the shingles that a shortest passage can hold are the same, and c lies alike among them."""
    rnd = random.Random(23)
    common = words(rnd, 300)
    texts = pa.array([" ".join(words(rnd, n) + common[:cut] + words(rnd, n)) for n, cut in ((60, 300), (85, 300), (70, 150))])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], ["doc_id", "text"])
    shingles = p.Words(texts).shingles(p.SHINGLE)
    prints, alike = {}, 0
    for out in p._windows(iter([batch])):
        for d, span, place, near in zip(*(out.column(c).to_pylist() for c in ("doc_id", "span", "place", "near")), strict=True):
            c = place >> 32
            lo, hi = max(span >> 32, c - p.SPAN + 1), min(span & 0xFFFFFFFF, c + p.SPAN - 1)
            whole = (c - lo, *shingles[d - 1][lo : hi + 1].tolist())
            alike += whole in prints and prints[whole][1] != d
            assert prints.setdefault(whole, (near, d))[0] == near
    assert alike > 10 and len({near for near, _ in prints.values()}) == len(prints)
