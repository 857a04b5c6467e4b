import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowmill.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(packing.tokenizer_path())


TOOL = packing.Ids(packing.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abZé'sdl ÀßĂ.,!<|>09 \n\t\x1c\x85½µ", max_size=60)), max_size=6))
def test_ids_equal_the_tokenizers_own(texts):
    own = tokenizers.Tokenizer.from_file(packing.tokenizer_path()) if not hasattr(test_ids_equal_the_tokenizers_own, "t") else test_ids_equal_the_tokenizers_own.t
    test_ids_equal_the_tokenizers_own.t = own
    for t, got in zip(texts, TOOL.of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_special_tokens_in_text(plain):
    t = "ab <|endoftext|>cd it's don't I'LL 12"
    assert np.frombuffer(next(TOOL.of([t])), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def check(got, docs, plain):
    want = {}
    for i, t in docs:
        ids = (plain.encode(t, add_special_tokens=False).ids if t else []) + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.setdefault((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())), 0)
            want[(i, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    have, bins = {}, {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        have[key] = have.get(key, 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), math.ceil(sum(k[3] * n for k, n in want.items()) / 4096)


def test_documents_pack_close_to_the_bound(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins, bound = check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], plain)
    assert bins <= bound * 1.01 + 1


def test_nulls_repeats_long_and_empty(spark, plain):
    rows = [(1, None), (1, None), (2, ""), (None, "some words"), (3, "word " * 9000), (3, "word " * 9000), (4, "a" * 30000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int")
    check(packing.pack(docs).collect(), rows, plain)
    assert packing.pack(docs.limit(0)).count() == 0


def bins_of(where):
    out = {}
    for i, k in enumerate(where.tolist()):
        out.setdefault(k, []).append(i)
    return list(out.values())


def test_every_step_keeps_every_item_once():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 3000, 300)
    a = packing.best_fit(size)
    b = packing.mutate(size, a, rng)
    worst = packing.placed(size, np.full(300, -1), rng.permutation(300), "worst")
    first = packing.placed(size, np.full(300, -1), rng.permutation(300), "first")
    for where in (a, b, worst, first, packing.cross(size, a, b, rng), packing.cross(size, worst, first, rng), packing.evolve(size, [a], 5)):
        bins = bins_of(where)
        assert sorted(i for x in bins for i in x) == list(range(300))
        assert max(sum(size[i] for i in x) for x in bins) <= 4096
        assert sorted(set(where.tolist())) == list(range(len(bins)))
    assert packing.fitness(size, packing.evolve(size, [a], 5)) <= packing.fitness(size, a)


def test_placing_equals_a_plain_walk():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 3000, 120)
    order = rng.permutation(120)
    for rule in ("best", "worst", "first"):
        room, want = [], {}
        for i in order.tolist():
            can = [k for k, r in enumerate(room) if r >= size[i]]
            k = {"best": min, "worst": max}[rule](can, key=lambda k: (room[k], k)) if can and rule != "first" else can[0] if can else len(room)
            if k == len(room):
                room.append(4096)
            room[k] -= size[i]
            want[i] = k
        got = packing.placed(size, np.full(120, -1), order, rule)
        assert {i: int(got[i]) for i in range(120)} == want


def test_exchanges_fill_bins_further():
    rng = np.random.default_rng(5)
    size = rng.integers(800, 2048, 200)
    where = packing.best_fit(size)
    where = packing._renumbered(np.where(where % 7 == 0, -1, where))
    after = packing.exchanged(size, where, rng)
    assert size[after < 0].sum() < size[where < 0].sum()
    assert (packing._fill(size, after) >= packing._fill(size, where)).all() and packing._fill(size, after).max() <= 4096


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_sizes_take_fewer_bins_than_best_fit(spark, seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(819, 2048, 1500)
    rows = spark.createDataFrame([(0, size.tolist()), (1, [2000] * 10)], "block long, size array<long>")
    got = {r.block: r for r in packing.searched(rows).collect()}
    hard = got[0]
    assert hard.best_fit == packing.fitness(size, packing.best_fit(size))[0]
    # best fit leaves some 37 bins above the bound; the search at most 15
    assert hard.best_fit - hard.bound > 30 and hard.bins - hard.bound <= 15
    assert packing.fitness(size, np.array(hard.elite))[0] == hard.bins and packing._fill(size, np.array(hard.elite)).max() <= 4096
    assert got[1].bins == got[1].bound == 5


def test_a_task_that_runs_again_gives_the_same(spark):
    size = np.random.default_rng(4).integers(819, 2048, 200)
    one, other = (packing.evolve(size, [], 7, 1) for _ in range(2))
    assert (one == other).all()


def test_thousands_of_empty_and_repeated_rows(spark, plain):
    rows = [(i, "") for i in range(4500)] + [(7, "the same words again")] * 3000
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, offset int, sequence_id int")
    bins, bound = check(packing.pack(docs).collect(), rows, plain)
    assert bins <= bound + 1


def test_one_rule_for_one_block_and_for_several(spark, monkeypatch):
    class Asked(Exception):
        pass

    def spied(rows, blocks, name, slack=0):
        raise Asked(blocks, slack)

    monkeypatch.setattr(packing, "_packed", spied)
    docs = spark.createDataFrame([(i, "some words") for i in range(30)], "doc_id long, text string")
    asked = []
    for block in (30, 10):
        monkeypatch.setattr(packing, "BLOCK", block)
        with pytest.raises(Asked) as e:
            packing.pack(docs)
        asked.append(e.value.args)
    assert asked == [(1, 1), (3, 1)]
