"""Context-triggered piecewise hashing of texts.

A rolling hash over seven bytes ends a chunk where it hits the block size's residue, so boundaries depend on
content and survive edits elsewhere. Each chunk gives a 12-bit code (two characters); a fingerprint is
'block:codes:codes at twice the block'. Two fingerprints are compared at a block size both have, as
1 - indel distance / total length of the code sequences; without one they are 0 alike."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, mix, stream

WINDOW = 7
LEAST_BLOCK = 3
CHUNKS = 64
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in _SIGNS for b in _SIGNS]
_BYTE = stream(256, 301)
_STEP = stream(WINDOW, 303)


def _codes(trigger: np.ndarray, content: np.ndarray, block: int) -> str:
    ends = np.flatnonzero(trigger % U64(block) == U64(block - 1)) + 1
    starts = np.concatenate([[0], ends])
    starts = starts[starts < len(content)]
    if not len(starts):
        return ""
    code = mix(np.add.reduceat(content, starts)) >> U64(52)
    return "".join([_PAIRS[c] for c in code.tolist()])


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; equal texts have equal ones. The empty text's is '3::'."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    block = LEAST_BLOCK
    while block * CHUNKS < n:
        block *= 2
    if not n:
        return f"{block}::"
    value = np.concatenate([np.zeros(WINDOW - 1, U64), _BYTE[raw]])
    rolled = np.zeros(n, U64)
    for i in range(WINDOW):
        rolled += value[i : i + n] * _STEP[i]
    content = mix(value[WINDOW - 1 :] * _STEP[0] + value[WINDOW - 2 : -1] * _STEP[1] + value[WINDOW - 3 : -2] * _STEP[2])
    trigger = mix(rolled)
    return f"{block}:{_codes(trigger, content, block)}:{_codes(trigger, content, 2 * block)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def likeness(x: str, y: str) -> float:
    """0 to 1: one less the indel distance of the code sequences at the best shared block size."""
    if x == y:
        return 1.0
    (bx, *cx), (by, *cy) = x.split(":"), y.split(":")
    best = 0.0
    for i in (0, 1):
        for j in (0, 1):
            if int(bx) << i == int(by) << j:
                a, b = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (cx[i], cy[j]))
                if a and b:
                    best = max(best, 2 * _common(a, b) / (len(a) + len(b)))
    return best


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: str, after: str, after_print: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    edited_print = own if edited == text else fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, edited_print, likeness(own, edited_print), likeness(own, after_print)


_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in _NAMES[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64())])
_WIDE = pa.schema([("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), *_ARROW])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: a 'row' per document that has a next one here; its first document as 'head'
    and its last as 'tail', both with text, for joining neighbouring partitions."""
    part, before, out = TaskContext.get().partitionId(), None, []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _WIDE, strict=True)], schema=_WIDE)

    none = (None,) * (len(_NAMES) - 1)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            own = fingerprint(text)
            if before is None:
                out.append((part, "head", text, doc_id, *none))
            else:
                out.append((part, "row", None, *_row(*before, text, own)))
            before = (doc_id, text, own)
            if len(out) >= 1000:
                yield table()
                out = []
    if before:
        out.append((part, "tail", before[1], before[0], *none))
    if out:
        yield table()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(d, t, fingerprint(t), a, fingerprint(a)) for d, t, a in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs its fingerprint and those of its edited text and next document (RESULT's columns).

    The next document follows by (doc_id, text), null ids first, and the first follows the last; a lone
    document follows itself. Null texts are empty. Texts move once, range-partitioned by doc_id; only the two
    outer documents of each partition are joined afterwards."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked = cut(ordered.mapInArrow(_walk, f"part int, role string, text string, {RESULT}"), "walked")
    parts = walked.filter("role = 'head'").select("part")
    ring = Window.orderBy("part")  # one narrow row per partition
    follow = parts.select("part", F.lead("part").over(ring).alias("_next"), F.min("part").over(ring).alias("_first")).select("part", F.coalesce("_next", "_first").alias("next_part"))
    tails = walked.filter("role = 'tail'").select("part", "doc_id", "text").join(follow, "part")
    heads = walked.filter("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    edges = tails.join(heads, "next_part").select("doc_id", "text", "after").mapInArrow(_edges, RESULT)
    return walked.filter("role = 'row'").select(*_NAMES).union(edges)
