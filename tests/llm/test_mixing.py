import hashlib
import re

from flowmill.llm import mixing


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, size):
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, all_ = set(), sum(total.values())
    while True:  # share, cap, share the excess again
        free = [s for s in order if s not in capped]
        rest = all_ - sum(3 * total[s] for s in capped)
        goal = {s: 3.0 * total[s] for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 3 * total[s]}
        if not over:
            return size, total, goal
        capped |= over


def u(seed, doc_id):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def check(spark, rows, near):
    size, total, goal = brute(rows)
    got = mixing.mix_report(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")).collect()
    assert len(got) == len(rows)
    key = {}
    for (i, _, s), n in zip(rows, size):
        key.setdefault((i, n, total[s], round(goal[s], 4)), 0)
        key[i, n, total[s], round(goal[s], 4)] += 1
    for r in got:
        k = (r.doc_id, r.size, r.source_size, round(r.target, 4))
        assert key.get(k, 0) > 0, k
        key[k] -= 1
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s in total:
        mine = [r for r in got if (r.source_size, round(r.target, 4)) == (total[s], round(goal[s], 4))]
        if near and total[s]:
            assert abs(sum(r.taken for r in mine) - goal[s]) <= 0.05 * goal[s] + 5 * max(size), s
    return got


def test_targets_and_takes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    a = check(spark, [tuple(r) for r in docs], True)
    b = check(spark, [tuple(r) for r in reversed(docs)], True)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_small_and_odd_sources(spark):
    rows = [(i, "w " * (i % 7), "big") for i in range(400)] + [(900, "x y", "a"), (901, "x", None), (902, None, "zero"), (None, "q r s", None), (903, "", ""), (903, "", "")]
    check(spark, rows, False)
    assert mixing.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    check(spark, [(1, None, None), (2, "", "x")], False)


def test_mix_repeats_rows_with_all_columns(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 20 else "b", i) for i in range(220)], "doc_id long, text string, source string, copies int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    have = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in want.items() if v}


def test_join_beyond_the_broadcast_bound_is_salted_and_equal(spark, monkeypatch):
    from flowmill.llm import common

    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    a = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == a
