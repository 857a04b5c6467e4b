import hashlib

from flowmill.llm import fingerprint as fp


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_bit_parallel_lcs_equals_the_table():
    import random

    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 70))] for _ in "xy")
        assert fp._common(a, b) == lcs(a, b)


def test_edits_change_the_fingerprint_in_part():
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(600))
    edited = base[:2000] + "something else" + base[2050:]
    assert fp.likeness(fp.fingerprint(base), fp.fingerprint(edited)) > 0.85
    other = " ".join(f"term{i * 104729 % 977}" for i in range(600))
    assert fp.likeness(fp.fingerprint(base), fp.fingerprint(other)) < 0.2
    assert fp.fingerprint("") == "3::" and fp.likeness("3::", fp.fingerprint("abc")) == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (i, t), (_, a) in zip(rows, rows[1:] + rows[:1]):
        t, a = t or "", a or ""
        half = len(t) // 2
        e = t[: len(t) - half] + a[:half]
        x, y, z = map(fp.fingerprint, (t, e, a))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), x, y, fp.likeness(x, y), fp.likeness(x, z)))
    return out


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fp.fingerprints(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_nulls_ties_and_empty(spark):
    rows = [(None, "x y z"), (1, None), (1, None), (2, ""), (3, "é😀" * 50), (3, "é😀" * 50), (4, "a" * 200_000)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = fp.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert (lone.edited_sha256, lone.near_next) == (hashlib.sha256(b"abcabc").hexdigest(), 1.0)
