"""Alignment of two tokenizers over the same bytes, by products of incidence matrices.

A token of either tokenizer covers bytes of the text, so each tokenizer has a token-byte incidence matrix, held here in compressed
sparse rows (CSR). The row products A B^T (Gustavson: a row of A gathers the rows of B^T that its entries name, and equal
columns are summed) are the overlap links, each with the number of bytes two tokens share; those whose ranges end together are
what `aligned` counts. Byte offsets where a token of both ends cut the text into groups; the product of the two token-group
matrices are the shared-group links.

Both tokenizers treat a text's words apart: neither joins anything across a space that follows another character (A splits
there; B has no piece with a space behind another character, which is checked). So a text is cut there into units, each of
which begins with its space; every cut ends a group, and a unit's tokens, links and groups are computed once per worker and
remembered. A text's are those of its units in order.

Counts over the corpus: texts are put together in blocks of about BLOCK_BYTES. A block's row holds its distinct id pairs with
their number of links and, per document, which it has how often. Pairs are summed over blocks (a row per block and pair moves,
not per link), the greatest count of each B id is found, and every block gets back the counts of its own pairs. A block is
written once, so lost executors cost a reread."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices

#: Bytes of text in a block on average; units that a worker remembers.
BLOCK_BYTES, REMEMBER = 16 << 20, 300_000
#: Documents in a block at most.
BLOCK_DOCS = 200_000
#: A pair of ids (A's below 2^18, B's below 2^20) as one number, and the number of such numbers.
PAIR, PAIRS = 1 << 20, 1 << 38

DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BLOCK = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pair array<long>, n array<long>, distinct array<long>, gaps binary, times binary"
)
LINK = "doc_id long, a_index long, b_index long, a_id long, b_id long, bytes long"


# ---- sparse matrices --------------------------------------------------------------------------


@dataclass
class Csr:
    """Compressed sparse rows: row i has the columns indices[indptr[i]:indptr[i + 1]] with their values."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def transpose(m: Csr) -> Csr:
    """Columns become rows, by counting; entries of a row stay in order."""
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.width))])
    order = np.argsort(m.indices, kind="stable")
    return Csr(indptr, m.rows()[order], m.data[order], len(m.indptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """a times b by rows: each entry (i, k) of a adds its multiple of b's row k to row i; equal columns are summed."""
    size = np.diff(b.indptr)[a.indices]
    source = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b.indptr[a.indices], size)
    key = np.repeat(a.rows(), size) * b.width + b.indices[source]
    value = np.repeat(a.data, size) * b.data[source]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    value = np.add.reduceat(value, first) if len(first) else value
    row, column = np.divmod(key[first], b.width) if b.width else (key, key)
    return Csr(np.searchsorted(row, np.arange(len(a.indptr))), column, value, b.width)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Token-byte incidence of tokens that follow each other."""
    n = int(lengths.sum())
    return Csr(np.concatenate([[0], np.cumsum(lengths)]), np.arange(n), np.ones(n, np.int64), n)


def token_groups(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Token-group incidence: the group of a token is that of its last byte."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), np.ones(len(ends), np.int64), len(cuts))


def overlap(a_len: np.ndarray, b_len: np.ndarray) -> Csr:
    """Rows of A tokens, columns of B tokens, values the bytes both cover."""
    return product(token_bytes(a_len), transpose(token_bytes(b_len)))


def shared_groups(a_len: np.ndarray, b_len: np.ndarray) -> Csr:
    """Rows of A tokens, columns of the B tokens in the same group."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    return product(token_groups(a_end, cuts), transpose(token_groups(b_end, cuts)))


# ---- tokenizers -------------------------------------------------------------------------------


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


#: A cut comes before a space that follows another character and is not the text's last.
UNITS = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=.)", re.DOTALL)


class Tokenizers:
    """Ids and bytes of both tokenizers for units, and all that units have."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        meaning = byte_level()
        self.a_bytes = {i: bytes(meaning[c] for c in t) if all(c in meaning for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: whether texts may be cut into units
        self.cuts = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, 1 if the bytes are right
        self.at = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of texts that begin with a space, B's of the texts without it."""
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self.b.encode([u[1:] for u in units], num_threads=1)

    def units(self, text: str) -> list[str]:
        if not self.cuts:
            return [" " + text]
        # a cut's space goes to the unit behind it, so every unit begins with one
        return [" " + u for u in UNITS.split(text)]

    def learn(self, units: list[str]) -> None:
        """Tokens, groups and links of new units, all in one product."""
        a, b = self.encoded(units)
        right = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == (raw := u.encode()) == b"".join(map(self.b_bytes.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)], bool)
        a = [x if ok else [] for x, ok in zip(a, right, strict=True)]
        b = [x if ok else [] for x, ok in zip(b, right, strict=True)]
        a_id, b_id = (np.fromiter((t for x in side for t in x), np.int64) for side in (a, b))
        a_of, b_of = (np.repeat(np.arange(len(units)), [len(x) for x in side]) for side in (a, b))
        a_len = np.fromiter((len(self.a_bytes[t]) for t in a_id.tolist()), np.int64)
        b_len = np.fromiter((len(self.b_bytes[t]) for t in b_id.tolist()), np.int64)
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)

        links = overlap(a_len, b_len)
        i, j = links.rows(), links.indices
        together = a_end[i] == b_end[j]
        i, j = i[together], j[together]

        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_in, b_in = token_groups(a_end, cuts), token_groups(b_end, cuts)
        by_a, by_b = transpose(a_in), transpose(b_in)
        # the tokens of a unit in print: groups in order, A's before B's; each token knows what follows it
        a_last, b_last = (np.isin(np.arange(len(end)), by.indptr[1:] - 1) for end, by in ((a_end, by_a), (b_end, by_b)))
        printed = np.empty(len(a_id) + len(b_id), object)
        printed[np.arange(len(a_id)) + by_b.indptr[a_in.indices]] = [f"{t}|" if last else f"{t}," for t, last in zip(a_id.tolist(), a_last.tolist(), strict=True)]
        printed[np.arange(len(b_id)) + by_a.indptr[b_in.indices + 1]] = [f"{t};" if last else f"{t}," for t, last in zip(b_id.tolist(), b_last.tolist(), strict=True)]
        tokens = np.bincount(a_of, minlength=len(units)) + np.bincount(b_of, minlength=len(units))
        stop = np.cumsum(tokens)
        shown = printed.tolist()

        self.known.update(zip(units, range(len(self.text), len(self.text) + len(units)), strict=True))
        self.text += ["".join(shown[e - n : e])[:-1] for e, n in zip(stop.tolist(), tokens.tolist(), strict=True)]
        n_groups = np.bincount(a_of[by_a.indices[by_a.indptr[:-1]]] if len(cuts) else a_of[:0], minlength=len(units))
        new = np.stack([np.bincount(a_of, minlength=len(units)), np.bincount(b_of, minlength=len(units)), n_groups, right], axis=1)
        self.counts = np.concatenate([self.counts, new])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(a_of[i], minlength=len(units)))])
        self.pairs = np.concatenate([self.pairs, a_id[i] * PAIR + b_id[j]])

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all units in order, and how many each text has (an empty text has none)."""
        split = [self.units(t) if t else [] for t in texts]
        new = {u for us in split for u in us}.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBER:
                self.forget()
                new = {u for us in split for u in us}
            self.learn(sorted(new))
        get = self.known.__getitem__
        return np.fromiter((n for us in split for n in map(get, us)), np.int64), np.array([len(us) for us in split], np.int64)


_TOOLS: dict[tuple[str, str], Tokenizers] = {}


def tools(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _TOOLS:
        _TOOLS[paths] = Tokenizers(*paths)
    return _TOOLS[paths]


# ---- numbers as bytes ---------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers, seven bits a byte, low ones first, the high bit set on all but a number's last byte."""
    size = 1 + sum((values >> (7 * i) > 0).astype(np.int64) for i in range(1, 6))
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[first[has] + i] = ((values[has] >> (7 * i)) & 127) | np.where(size[has] > i + 1, 128, 0)
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).astype(np.int64)
    last = raw < 128
    start = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127) << (7 * place), start) if len(start) else raw


# ---- the corpus -----------------------------------------------------------------------------------


class Block:
    """Texts gathered until they are BLOCK_BYTES; then one row."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.shas = 0, [], []
        self.docs: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, t: Tokenizers, ids: list[int | None], texts: list[str]) -> None:
        unit, size = t.look_up(texts)
        doc = np.repeat(np.arange(len(texts)), size)
        stop = np.cumsum(size)
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(t.counts[unit], axis=0)])
        sums = total[stop] - total[stop - size]
        good = (sums[:, 3] == size) & (size > 0)
        sums[~good] = 0
        number, text = unit.tolist(), t.text
        for ok, e, n in zip(good.tolist(), stop.tolist(), size.tolist(), strict=True):
            self.shas.append(hashlib.sha256(";".join([text[u] for u in number[e - n : e]]).encode()).hexdigest() if ok else "")
        unit, doc = unit[good[doc]], doc[good[doc]]
        links = t.at[unit + 1] - t.at[unit]
        source = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links) + np.repeat(t.at[unit], links)
        sums[:, 3] = np.bincount(doc, weights=links, minlength=len(texts)).astype(np.int64)
        # a slice has fewer than 2^25 texts, so document and pair are one number for sorting
        key = np.sort(np.repeat(doc, links) * PAIRS + t.pairs[source])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        of, pair = np.divmod(key[first], PAIRS)
        self.found.append((of + len(self.ids), pair, np.diff(np.append(first, len(key)))))
        self.docs.append(sums)
        self.ids += ids
        self.bytes += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        doc, pair, times = (np.concatenate(x) for x in zip(*self.found, strict=True))
        distinct, where = np.unique(pair, return_inverse=True)
        n = np.bincount(where, weights=times, minlength=len(distinct)).astype(np.int64)
        # frequent pairs get small numbers, which are short as gaps
        by = np.argsort(-n, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        where = place[where]
        order = np.argsort(doc * max(1, len(distinct)) + where)
        doc, where, times = doc[order], where[order], times[order]
        gaps = np.diff(where, prepend=0)
        new = np.diff(doc, prepend=-1) != 0
        gaps[new] = where[new]
        sums = np.concatenate(self.docs)

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = [pa.array([number], pa.int64()), one(pa.array(self.ids, pa.int64())), *(one(pa.array(sums[:, i])) for i in range(4)), one(pa.array(self.shas, pa.string())),
                   one(pa.array(distinct[by])), one(pa.array(n[by])), one(pa.array(np.bincount(doc, minlength=len(self.ids)))),
                   pa.array([pack(gaps)], pa.binary()), pa.array([pack(times)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """BLOCK rows of docs (doc_id long, text)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, block, number = tools(paths), Block(), TaskContext.get().partitionId() << 32
        for b in slices(batches):
            block.add(t, b.column("doc_id").to_pylist(), [x or "" for x in b.column("text").to_pylist()])
            if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                yield block.row(number)
                block, number = Block(), number + 1
        if block.ids:
            yield block.row(number)

    return docs.mapInArrow(gather, BLOCK)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """DIGEST per row of docs: tokens of each side, groups, links that end together, how many of these have the greatest count
    of all pairs of their B id, the sum of their counts, and the checksum of the groups.

    A text that is null or empty, or whose bytes either tokenizer does not give back (B reads U+2581 as a space), has no tokens:
    zeros, and '' for the checksum. Repeated rows and ids are answered, and counted, each; null ids are kept; other columns are
    ignored; an empty table gives an empty one. Ties of counts are all best. Texts are never cut."""
    paths = paths or tokenizer_paths()
    table = cut(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), paths), "aligned")
    pairs = table.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.col("pair") % PAIR))  # at most as many rows as A has ids
    graded = cut(pairs.select("pair", "count", (F.col("count") == highest).alias("best")), "graded")
    asked = table.select(F.col("block").alias("of"), F.posexplode("pair").alias("place", "pair"))
    answers = asked.join(graded, "pair").groupBy("of").agg(F.collect_list(F.struct("place", "count", "best")).alias("answers"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                flat = {c: row.column(c).flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "distinct", "answers")}
                place, count, best = (np.asarray(x) if j < 2 else np.asarray(x.cast(pa.int64())) for j, x in enumerate(flat["answers"].flatten()))
                counts, bests = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                counts[place], bests[place] = count, best
                size, gaps, times = np.asarray(flat["distinct"]), unpack(row.column("gaps")[0].as_py()), unpack(row.column("times")[0].as_py())
                stop = np.cumsum(size)
                total = np.concatenate([[0], np.cumsum(gaps)])
                where = total[1:] - np.repeat(total[stop - size], size)
                sums = [np.concatenate([[0], np.cumsum(times * x[where])]) for x in (bests, counts)]
                yield pa.RecordBatch.from_arrays(
                    [*(flat[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *(pa.array(s[stop] - s[stop - size]) for s in sums), flat["groups_sha256"]], [c.split()[0] for c in DIGEST.split(", ")]
                )

    return table.join(answers, table["block"] == answers["of"], "left").drop("pair", "n", "block", "of").mapInArrow(digest, DIGEST)


def token_links(docs: DataFrame, kind: str = "overlap", paths: tuple[str, str] | None = None) -> DataFrame:
    """LINK rows of every text, token numbers counted from 0: kind 'overlap' (bytes: those both tokens cover), 'end' (of these the ones
    that end together) or 'group' (tokens of one group; bytes is 1). Texts without tokens (see `aligned`) have none. The
    shared-group links of a group are the product of its two sizes."""
    paths = paths or tokenizer_paths()
    if kind not in ("overlap", "end", "group"):
        raise ValueError(kind)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tools(paths)
        for b in slices(batches, most=1 << 16):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                units = t.units(text) if text else []
                a, c = ([x for ids in side for x in ids] for side in t.encoded(units))
                raw = (" " + text).encode() if text else b""
                if not raw or b"".join(map(t.a_bytes.__getitem__, a)) != raw or b"".join(map(t.b_bytes.__getitem__, c)) != raw:
                    continue
                a_id, b_id = np.array(a, np.int64), np.array(c, np.int64)
                a_len, b_len = np.array([len(t.a_bytes[x]) for x in a]), np.array([len(t.b_bytes[x]) for x in c])
                found = shared_groups(a_len, b_len) if kind == "group" else overlap(a_len, b_len)
                i, j, value = found.rows(), found.indices, found.data
                if kind == "end":
                    keep = np.cumsum(a_len)[i] == np.cumsum(b_len)[j]
                    i, j, value = i[keep], j[keep], value[keep]
                for lo in range(0, len(i), 1 << 16):
                    k = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(i[k]), pa.int64()), *map(pa.array, (i[k], j[k], a_id[i[k]], b_id[j[k]], value[k]))], [c.split()[0] for c in LINK.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(linked, LINK)
