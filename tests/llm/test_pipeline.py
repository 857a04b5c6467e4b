"""Every stage on what its predecessor kept, against a plain version."""

import re
import zlib

import corpus_pipeline
from flowmill.llm import mixing, near_dedup, pii, quality
from flowmill.llm.common import cut

D = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, at, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, D).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == columns
        seen[name] = at.collect()
    raw = docs.collect()
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = quality.train(docs, labels)
    good = {r.doc_id for r, s in zip(raw, quality.score(model, quality.matrix([r.text for r in raw])), strict=True) if s >= 0.3}
    assert {r.doc_id for r in seen["quality"]} == good
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i, q in truth.items() if q == 1 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in good for i in held) >= 0.97 * len(held)

    left = {r.doc_id: r for r in near_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "quality"))).collect()}
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i, r in left.items() if r.component_id == i}

    before = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert {r.doc_id for r in seen["pii"]} == set(before)
    for r in seen["pii"]:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+|AKIA[A-Z0-9]{16}|\+1 \(\d{3}\)", r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]

    want = {r.doc_id: r.copies for r in mixing.mix_report(spark.read.parquet(str(tmp_path / "pii"))).collect()}
    have = {}
    for r in seen["mixing"]:
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert have == {i: n for i, n in want.items() if n}

    packed = corpus_pipeline.STAGES[-1][1](spark, at, D).collect()
    from tokenizers import Tokenizer

    from flowmill.llm import packing

    plain, total = Tokenizer.from_file(packing.tokenizer_path()), 0
    for r in seen["mixing"]:
        total += len(plain.encode(r.text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in packed) == total
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) == max(o + n for o, n in b) <= 4096 for b in used.values())
    assert len(used) <= -(-total // 4096) * 1.01 + 1


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 500


def test_redaction_covers_all_base_spans(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    clean = pii.report(cut(pii.redact(docs)))
    assert clean.filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
