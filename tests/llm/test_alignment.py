"""Alignment against plain loops over whole texts: tokens, groups, links, corpus counts; sparse products against dense ones."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowmill.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def stand_for():
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out, more = {chr(b): b for b in keep}, 256
    for b in range(256):
        if b not in keep:
            out[chr(more)], more = b, more + 1
    return out


STAND = stand_for()
A_TEXT = {i: t for t, i in A.get_vocab().items()}


def tokens(text):
    """(id, bytes) of both sides for the whole text, without any cutting; none where bytes come back wrong."""
    if not text:
        return [], []
    a = [(i, bytes(STAND[c] for c in A_TEXT[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("\u2581", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def plain(rows):
    links, half = [], []
    for doc_id, text in rows:
        a, b = tokens(text)
        ends = [{}, {}]
        for side, toks in enumerate((a, b)):
            at = 0
            for i, x in toks:
                at += len(x)
                ends[side][at] = i
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in both:
            groups.append("|".join(",".join(str(e[k]) for k in sorted(e) if last < k <= c) for e in ends))
            last = c
        links.append([(ends[0][c], ends[1][c]) for c in both])
        half.append((doc_id, len(a), len(b), len(both), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((*h[:5], sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), h[5]) for h, x in zip(half, links)), key=key)


def key(row):
    return tuple((x is None, x) for x in row)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n, m, p = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, m)) * (rng.random((n, m)) < 0.4), rng.integers(0, 3, (m, p)) * (rng.random((m, p)) < 0.4)
        got = alignment.product(csr(x), csr(y))
        assert (dense(got, n) == x @ y).all()
        assert (dense(alignment.transpose(csr(x)), m) == x.T).all()


def csr(x):
    r, c = np.nonzero(x)
    return alignment.Csr(np.searchsorted(r, np.arange(len(x) + 1)), c, x[r, c], x.shape[1])


def dense(m, n):
    out = np.zeros((n, m.width), np.int64)
    out[m.rows(), m.indices] = m.data
    return out


def test_numbers_as_bytes():
    for v in ([], [0], [127, 128, 0, 1 << 40, 300], list(range(20_000))):
        x = np.array(v, np.int64)
        assert alignment.unpack(alignment.pack(x)).tolist() == v


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_alignment(spark, sf)) == plain(docs)


def test_hard_texts(spark):
    rng = random.Random(9)
    bits = ["the", " ", "  ", "\n", "\t", "don't", "'s", " 's", "é", "ﬁ", "日本語テキスト", "🙂🙃", "<|endoftext|>", "<s>", "</s>", "\x00", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "12345", "...", "e\u0301", " \u0301", "ABC", "foo bar"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "a b"), (7, None), (7, ""), (7, " "), (7, "  "), (7, "x "), (7, "a \u2581b"), (8, "same text"), (8, "same text"), (9, "word " * 30_000), (10, "x" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_a int, pair string")
    assert rows_of(alignment.aligned(df.repartition(3))) == plain(rows)
    assert alignment.aligned(df.limit(0)).count() == 0
    assert rows_of(alignment.aligned(spark.createDataFrame([(1, None), (2, "\u2581")], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_small_blocks_and_forgetting(spark, monkeypatch):
    """Counts hold over many blocks, in the driver's process so that the settings reach the code."""
    monkeypatch.setattr(alignment, "REMEMBER", 50)
    t = alignment.Tokenizers(*alignment.tokenizer_paths())
    rng = random.Random(10)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(30)) for _ in range(40)]
    for at in range(0, 40, 10):
        block = alignment.Block()
        block.add(t, list(range(10)), texts[at : at + 10])
        row = block.row(1).to_pylist()[0]
        want = [tokens(x) for x in texts[at : at + 10]]
        assert row["n_a"] == [len(a) for a, _ in want] and row["n_b"] == [len(b) for _, b in want]
        assert row["groups_sha256"] == [r[7] for r in plain(list(enumerate(texts[at : at + 10])))]


def test_links(spark):
    text = "Unbelievable tokenisation, isn't it? naïve 日本 12345"
    df = spark.createDataFrame([(1, text), (2, None), (3, "x \u2581")], "doc_id long, text string")
    a, b = tokens(text)
    span = []
    for side in (a, b):
        at = 0
        span.append([(at, at := at + len(x)) for _, x in side])
    cuts = sorted({e for _, e in span[0]} & {e for _, e in span[1]})
    group = lambda e: sum(c < e for c in cuts)
    over = {(i, j): min(e, f) - max(s, r) for i, (s, e) in enumerate(span[0]) for j, (r, f) in enumerate(span[1]) if min(e, f) > max(s, r)}
    got = {k: alignment.token_links(df, k).filter(F.col("doc_id") == 1).collect() for k in ("overlap", "end", "group")}
    assert {(r.a_index, r.b_index): r.bytes for r in got["overlap"]} == over
    assert {(r.a_index, r.b_index) for r in got["end"]} == {(i, j) for i, j in over if span[0][i][1] == span[1][j][1]}
    assert {(r.a_index, r.b_index) for r in got["group"]} == {(i, j) for i, (_, e) in enumerate(span[0]) for j, (_, f) in enumerate(span[1]) if group(e) == group(f)}
    assert all(r.a_id == a[r.a_index][0] and r.b_id == b[r.b_index][0] for r in got["overlap"])
    assert alignment.token_links(df).filter(F.col("doc_id") > 1).count() == 0
