"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

Texts become token ids in tasks, each piece one narrow row; a document longer than a sequence is cut, and whole
sequences stand alone. The other pieces are dealt by hash into blocks of bounded size. A block is evolved on
several islands, which start from unlike packings: a chromosome is a grouping of pieces into bins; crossover injects whole
well-filled bins of one parent into the other, drops the bins that hold duplicates, exchanges displaced pieces for
smaller ones in bins that this fills further, and best-fits the rest; mutation empties the least filled bins and some
others. After each epoch every island's elite migrates to the next island of its block, until the block takes no more
bins than its tokens need or the epochs end; then the best island wins. Pieces of poorly filled bins are pooled over
many blocks and packed once more."""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

CAPACITY = 4096
END = 1
#: Pieces in a block on average; islands of a block, epochs between migrations, generations in an epoch, chromosomes.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4000, 2, 4, 20, 10
#: Displaced pieces that exchanges take in pairs and in threes, and how far apart two pieces of a bin may lie in it.
#: These bound the work of a try, not what is packed.
PAIRED, TRIPLED, NEAR = 60, 16, 12
#: Bins filled less than this go to the second round.
LOOSE = 0.97
#: Pieces whose ids one worker remembers, at most.
REMEMBER = 600_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's pre-tokens are independent, so each is encoded once and remembered. Texts of ASCII and
    Latin-1 letters only are split here by the tokenizer's own rule; any other text is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.plain = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\x0b\x0c\r 0-9a-zß-öø-ÿ]+").findall

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBER:
            self.known.clear()
        runs = [words[i : i + 256] for i in range(0, len(words), 256)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            parts = np.split(ids, np.flatnonzero(self.ends[ids])[:-1] + 1)
            if len(parts) == len(run):
                self.known.update(zip(run, [p.tobytes() for p in parts], strict=True))
            else:
                self.known.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in run)

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [self.split(t.lower()) if t and "<|" not in t and self.plain(t) else None for t in texts]
        new = {w for ws in split if ws for w in ws}.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBER:
                self.known.clear()
                new = {w for ws in split if ws for w in ws}
            self._learn(sorted(new))
        get = self.known.__getitem__
        for t, ws in zip(texts, split, strict=True):
            if ws is not None:
                yield b"".join(map(get, ws))
            else:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes()


_TOOLS: dict[str, Ids] = {}


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """PIECE rows of every text: ids plus END, cut at CAPACITY. A null text is empty and has the END alone."""
    path = path or tokenizer_path()

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOOLS:
            _TOOLS[path] = Ids(path)
        end, step = np.array([END], "<u4").tobytes(), 4 * CAPACITY
        names = [x.split()[0] for x in PIECE.split(", ")]
        for whole in slices(batches):
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), _TOOLS[path].of(b.column("text").to_pylist()), strict=True):
                    ids += end
                    for i, k in enumerate(range(0, len(ids), step)):
                        part = ids[k : k + step]
                        for column, v in zip(out, (doc_id, i, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cutting, PIECE)


# ---- the genetic algorithm on one block: a chromosome holds the bin number of every piece -------------


def _fill(size: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Tokens in each bin; pieces of number -1 are in none."""
    held = where >= 0
    return np.bincount(where[held], size[held]).astype(np.int64)


def _renumbered(where: np.ndarray) -> np.ndarray:
    """The same grouping with bins numbered gapless from 0; -1 stays."""
    held = where >= 0
    out = where.copy()
    out[held] = np.unique(where[held], return_inverse=True)[1]
    return out


def placed(size: np.ndarray, where: np.ndarray, order: np.ndarray, choose: str = "best") -> np.ndarray:
    """`where` with the pieces of `order` put in turn into the bin that they leave the least room in ("best"), the
    most ("worst"), or the first that has room ("first"); bins are opened as needed."""
    where = where.copy()
    room = (CAPACITY - _fill(size, where)).tolist()
    if choose == "first":
        for i in order.tolist():
            s = int(size[i])
            k = next((k for k, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(CAPACITY)
            room[k] -= s
            where[i] = k
        return where
    by_room = sorted((r, k) for k, r in enumerate(room))
    bins = len(room)
    for i in order.tolist():
        s = int(size[i])
        at = bisect.bisect_left(by_room, (s, -1))
        if at == len(by_room):
            left, k = CAPACITY, bins
            bins += 1
        else:
            left, k = by_room.pop(at if choose == "best" else -1)
        where[i] = k
        bisect.insort(by_room, (left - s, k))
    return where


def _falling(size: np.ndarray, items: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items, -size[items]))]


def best_fit(size: np.ndarray) -> np.ndarray:
    """Best fit of all pieces by falling size, the packing that the search starts from and is compared with."""
    return placed(size, np.full(len(size), -1), _falling(size, np.arange(len(size))))


def fitness(size: np.ndarray, where: np.ndarray) -> tuple[int, float]:
    """Fewer bins, then fuller ones (a falling number is better)."""
    fill = _fill(size, where)
    return len(fill), -float(np.square(fill / CAPACITY).sum())


def _sums(size: np.ndarray, free: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sums of one, two and three free pieces, rising, with the pieces of each (-1: none)."""
    free = rng.permutation(free)
    n = len(free)
    one = np.column_stack([free, np.full((n, 2), -1)])
    i, j = np.triu_indices(min(n, PAIRED), 1)
    two = np.column_stack([free[i], free[j], np.full(len(i), -1)])
    m = min(n, TRIPLED)
    x, y, z = np.nonzero((np.arange(m)[:, None, None] < np.arange(m)[:, None]) & (np.arange(m)[:, None] < np.arange(m)))
    every = np.vstack([one, two, np.column_stack([free[x], free[y], free[z]])])
    total = np.append(size, 0)[every].sum(1)
    order = np.argsort(total, kind="stable")
    return total[order], every[order]


def exchanged(size: np.ndarray, where: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Replace one or two pieces of a bin by up to three displaced ones wherever that fills the bin further.

    Each exchange makes the displaced pieces smaller in total, so that rounds end."""
    where = where.copy()
    while (where < 0).any():
        free = np.flatnonzero(where < 0)
        sums, parts = _sums(size, free, rng)
        room = CAPACITY - _fill(size, where)
        order = np.flatnonzero(where >= 0)
        order = order[np.argsort(where[order], kind="stable")]
        first, second = [order], [np.full(len(order), -1)]
        for d in range(1, NEAR):
            a, b = order[:-d], order[d:]
            same = where[a] == where[b]
            if not same.any():
                break
            first.append(a[same])
            second.append(b[same])
        first, second = np.concatenate(first), np.concatenate(second)
        out = size[first] + np.where(second >= 0, size[second], 0)
        open_ = room[where[first]] > 0
        first, second, out = first[open_], second[open_], out[open_]
        at = np.searchsorted(sums, out + room[where[first]], "right") - 1
        gain = np.where(at >= 0, sums[at] - out, 0)
        left = room[where[first]] - gain
        better = np.flatnonzero(gain > 0)
        used_bins, used = set(), set()
        for c in better[np.lexsort((-gain[better], left[better]))].tolist():
            k, part = int(where[first[c]]), [i for i in parts[at[c]].tolist() if i >= 0]
            if k in used_bins or not used.isdisjoint(part):
                continue
            used_bins.add(k)
            used.update(part)
            where[first[c]] = -1
            if second[c] >= 0:
                where[second[c]] = -1
            where[part] = k
            if len(used) == len(free):
                break
        if not used:
            break
    return where


def repaired(size: np.ndarray, where: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The displaced pieces exchanged for smaller ones, the rest by best fit."""
    where = exchanged(size, _renumbered(where), rng)
    return _renumbered(placed(size, where, _falling(size, np.flatnonzero(where < 0))))


def cross(size: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inject whole bins of b, drawn among its better filled half, into a: a's bins that hold any of their pieces
    go, what else these held is displaced and put back by exchanges and best fit."""
    fill = _fill(size, b)
    better = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[better[rng.random(len(better)) < rng.uniform(0.05, 0.5)]] = True
    taken = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[taken]] = True
    return repaired(size, np.where(taken, b + a.max() + 1, np.where(hit[a], -1, a)), rng)


def mutate(size: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Empty the least filled bins and a few others, and put their pieces back."""
    fill = _fill(size, a)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: int(rng.integers(2, 8))]] = True
    gone[rng.integers(0, len(fill), int(rng.integers(1, 8)))] = True
    return repaired(size, np.where(gone[a], -1, a), rng)


def _founders(size: np.ndarray, island: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Unlike packings: an island has best fit by falling size or by nearly falling size, and packings of shuffled
    pieces, each by another rule."""
    none = np.full(len(size), -1)
    out = [best_fit(size)] if island == 0 else [placed(size, none, np.argsort(-size * rng.uniform(0.9, 1, len(size)), kind="stable"))]
    for k in range(POPULATION - 1):
        rule = ("best", "worst", "first")[(k + island) % 3]
        out.append(mutate(size, placed(size, none, rng.permutation(len(size)), rule), rng) if k % 2 else mutate(size, out[0], rng))
    return out


def evolve(size: np.ndarray, seeds: list[np.ndarray], seed: int, island: int = 0, slack: int = 0) -> np.ndarray:
    """One epoch on one island: the best grouping found, not worse than any of `seeds` or best fit's own.

    It ends where bins are no more than the tokens need and `slack`. The first epoch has no seeds and founds a population; later ones found it from the elites they are given. The
    number of generations is fixed, so that a task that runs again gives the same packing."""
    size = np.asarray(size, np.int64)
    bound = math.ceil(int(size.sum()) / CAPACITY) + slack
    key = lambda x: fitness(size, x)
    best = min([*seeds, best_fit(size)], key=key)
    if key(best)[0] <= bound:
        return best
    rng = np.random.default_rng(seed)
    pool = list(seeds)
    while seeds and len(pool) < POPULATION:
        pool.append(mutate(size, seeds[len(pool) % len(seeds)], rng))
    pool = sorted(pool or _founders(size, island, rng), key=key)
    for _ in range(GENERATIONS):
        a, b = sorted(rng.permutation(len(pool))[:2].tolist())
        young = [cross(size, pool[a], pool[b], rng), mutate(size, pool[0], rng)]
        # equal fitness would fill the pool with one chromosome's copies
        pool = sorted({key(x): x for x in [*young, *pool]}.items())[:POPULATION]
        pool = [x for _, x in pool]
        if key(pool[0])[0] <= bound or len(pool) < 2:
            break
    return min([best, *pool], key=key)


def _islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, island, epoch, size, migrants) -> elite, its bins and looseness, best fit's bins and the bound."""
    names = [x.split()[0] for x in ELITE.split(", ")]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            size = np.array(r["size"], np.int64)
            seed = (r["block"] * 1_000_003 + r["island"] * 1_009 + r["epoch"]) & 0xFFFFFFFF
            where = evolve(size, [np.array(m, np.int64) for m in r["migrants"] or []], seed, r["island"], r["slack"])
            rows.append((r["block"], r["island"], where.tolist(), *fitness(size, where), fitness(size, best_fit(size))[0], math.ceil(int(size.sum()) / CAPACITY)))
        if rows:
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


ELITE = "block long, island int, elite array<long>, bins long, loose double, best_fit long, bound long"


def searched(spread: DataFrame, name: str = "search", slack: int = 0) -> DataFrame:
    """Blocks (block, size: array of lengths) -> ELITE rows, the winner of each block.

    Every island runs an epoch, then its elite migrates to the next island of the block. Blocks that take no
    more than `slack` bins above the bound are done; the others go on for EPOCHS epochs. An empty table gives none."""
    won = None
    left = spread
    for epoch in range(EPOCHS):
        every = left.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        if won is None:
            start = every.withColumn("migrants", F.lit(None).cast("array<array<long>>"))
        else:  # the island's own elite and that of the island before it
            near = elites.select("block", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island"), "elite").groupBy("block", "island").agg(F.sort_array(F.collect_list("elite")).alias("migrants"))
            start = every.join(near, ["block", "island"])
        start = start.select("block", "island", F.lit(epoch).alias("epoch"), F.lit(slack).alias("slack"), "size", "migrants").repartition("block", "island")
        elites = cut(start.mapInArrow(_islands, ELITE), f"{name}-elites")
        least = elites.groupBy("block").agg(F.min(F.struct("bins", "loose", "island", "elite", "best_fit", "bound")).alias("w"))
        least = least.select("block", "w.island", "w.elite", "w.bins", "w.loose", "w.best_fit", "w.bound")
        done = least if epoch == EPOCHS - 1 else least.filter(F.col("bins") <= F.col("bound") + slack)
        won = done if won is None else won.union(done)
        if epoch < EPOCHS - 1:
            far = elites.groupBy("block").agg(F.min("bins").alias("bins"), F.first("bound").alias("bound")).filter(F.col("bins") > F.col("bound") + slack).select("block")
            elites = cut(elites.join(far, "block", "left_semi"), f"{name}-open")
            if elites.isEmpty():
                break
            left = spread.join(far, "block", "left_semi")
    return won


def _packed(rows: DataFrame, blocks: int, name: str, slack: int = 0) -> DataFrame:
    """rows (a struct `item` with length) -> block, bin, item, fill; blocks: how many to deal them into."""
    # the row's number deals repeated rows apart
    block = F.pmod(F.xxhash64("item.doc_id", "item.piece", "item.ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    dealt = cut(rows.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items")), f"{name}-blocks")
    won = searched(dealt.select("block", F.transform("items", lambda i: i["length"]).alias("size")), name, slack)
    items = dealt.join(won.select("block", "elite"), "block").select("block", F.explode(F.arrays_zip("items", "elite")).alias("z")).select("block", F.col("z.elite").alias("bin"), F.col("z.items").alias("item"))
    bins = items.groupBy("block", "bin").agg(F.collect_list("item").alias("items"), F.sum("item.length").alias("fill"))
    return cut(bins, name)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, repeated ones too; null texts are empty; a text longer than a sequence is cut and none
    is shortened; other columns of docs, also of these names, are ignored. In a sequence pieces lie largest first, gapless
    from 0. An empty table gives none."""
    cutted = cut(pieces(docs, path), "pieces")
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32").alias("item")
    # ids of sequences: top bits tell whole pieces, first and second round apart
    whole = cutted.filter(F.col("length") == CAPACITY).select(item).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("items", F.array("item"))
    small = cutted.filter(F.col("length") < CAPACITY).select(item)
    n = small.count()
    # one bin above a block's bound is part-filled, and its pieces are pooled and packed again without slack
    first = _packed(small, max(1, math.ceil(n / BLOCK)), "packed", 1)
    loose = F.col("fill") < LOOSE * CAPACITY
    pooled = first.filter(loose).select(F.explode("items").alias("item"))
    again = _packed(pooled, max(1, math.ceil(pooled.count() / BLOCK)), "repacked")
    key = lambda df, top: df.withColumn("sequence_id", F.lit(top << 60) + F.col("block") * (1 << 20) + F.col("bin"))
    every = whole.select("sequence_id", "items").union(key(first.filter(~loose), 1).select("sequence_id", "items")).union(key(again, 2).select("sequence_id", "items"))
    # each piece with its offset: one running sum over a sequence's pieces, which come out one a row
    ordered = every.select("sequence_id", F.reverse(F.sort_array("items")).alias("items"))
    ends = F.aggregate("items", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["length"])))
    return ordered.select("sequence_id", F.explode(F.arrays_zip(F.col("items").alias("item"), ends.alias("offset"))).alias("z")).select("z.item", "z.offset", "sequence_id").filter("item is not null").select(
        "item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", "offset")
