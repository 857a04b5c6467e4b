"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

k-means centroids are fitted on a bounded sample; every row belongs to the list of its nearest centroid. Lists are dealt
to groups of about GROUP rows, a longer list to several, so a hot list is many tasks. Equal query vectors are asked once.
Inside a group vectors are turned by one random rotation and scanned in blocks of columns: a candidate whose partial
squared distance is too large for its full one to lie within the query's threshold (a test at LEVEL on the share that the
seen columns of a random rotation take, a beta variable) is abandoned. What survives all columns is scored in double
precision on the original vectors. A query's first threshold is its k-th score in the sample, whose rows are answers
themselves; it rises as better ones are found.

How many lists a query probes is chosen on the sample: the fewest that find RECALL of the sample's own neighbours.

Rows whose vector is null, zero, holds a null or non-finite component or is not of the table's most frequent length take
no part, nor do those without an id. Rows that share an id are one candidate (and one query) with the best score that any of
its vectors has. With fewer candidates than k a query gets all of them; an empty table gives none. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from .common import cut

#: Rows of the sample at most, and its bytes at most.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
#: Rows in a list on average until there are LISTS lists; rows in a group and query vectors in a part of one on average.
LIST, LISTS, GROUP, QUERIES = 500, 1024, 4096, 4096
#: Share of the sample's own neighbours that the probed lists must hold; level of one test.
RECALL, LEVEL = 0.97, 0.001
#: Pairs that one numpy step compares.
PAIRS = 1 << 20
#: A query vector with more than 1/HEAVY of all queries is salted in the last join; so there are at most HEAVY of them.
HEAVY, SALTS = 1000, 64

FOUND = "h1 long, h2 long, id long, score double"


@dataclass
class Index:
    """Rotation, columns at which to test with the shares allowed there, centroids, lists to probe, sample."""

    rotation: np.ndarray
    stops: list[tuple[int, float]]
    centres: np.ndarray
    probes: int
    sample_id: np.ndarray
    sample: np.ndarray


def beta_quantile(a: float, b: float, level: float) -> float:
    """The value that a beta variable exceeds with probability `level`, by summing its density on a grid."""
    x = (np.arange(20_000) + 0.5) / 20_000
    density = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(density - density.max()))
    return float(x[min(np.searchsorted(mass, (1 - level) * mass[-1]), len(x) - 1)])


def stops(dim: int, level: float = LEVEL) -> list[tuple[int, float]]:
    """Column counts (half of all, then eighths) and the largest share of the squared distance allowed there."""
    ends = sorted({min(dim, -(-dim * e // 8)) for e in (4, 5, 6, 7)} - {dim, 0})
    return [(d, beta_quantile(d / 2, (dim - d) / 2, level)) for d in ends]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(1)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest_list(x, centres)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def probed(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Per query a row of flags: the lists whose centroids have the largest inner products."""
    flags = np.zeros((len(q), len(centres)), bool)
    if probes >= len(centres):
        flags[:] = True
        return flags
    best = np.argpartition(-(q @ centres.T), probes - 1, axis=1)[:, :probes]
    np.put_along_axis(flags, best, True, axis=1)
    return flags


def fit(ids: np.ndarray, x: np.ndarray, rows: int, k: int) -> Index:
    """An index from the sample of a table of `rows` rows."""
    dim = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, dim)))[0]
    distinct = np.unique(x, axis=0)
    n_lists = max(1, min(LISTS, rows // LIST, len(distinct) // 4))
    centres = k_means(distinct, n_lists)
    probes, pick = n_lists, np.arange(0, len(distinct), max(1, len(distinct) // 256))
    if n_lists > 1:
        asked = distinct[pick]
        score = asked @ distinct.T
        score[np.arange(len(pick)), pick] = -np.inf
        take = min(k, len(distinct) - 1)
        best = np.argpartition(-score, take - 1, axis=1)[:, :take]
        order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
        place = np.take_along_axis(order, nearest_list(distinct, centres)[best], axis=1)
        probes = int(np.quantile(place, RECALL)) + 1
    return Index(rotation, stops(dim), centres, probes, ids, x)


def scan(q: np.ndarray, tau: np.ndarray, flags: np.ndarray, x: np.ndarray, lists: np.ndarray, ids: np.ndarray, index: Index, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query number the ids and scores of its k best candidates of the probed lists that reach tau, best first."""
    # equal vectors are compared once; of each the k smallest ids can be answers
    order = np.lexsort((ids, *x.T[::-1], lists))
    x, lists, ids = x[order], lists[order], ids[order]
    new = np.ones(len(x), bool)
    new[1:] = (lists[1:] != lists[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    copies = np.diff(np.append(first, len(x)))
    x, lists = x[first], lists[first]
    xr, qr = x @ index.rotation, q @ index.rotation
    ends = [d for d, _ in index.stops] + [x.shape[1]]
    x2, q2 = np.cumsum(xr**2, axis=1), np.cumsum(qr**2, axis=1)
    tau = tau.copy()
    best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]

    for number in np.unique(lists):
        lo, hi = np.searchsorted(lists, [number, number + 1])
        asking = np.flatnonzero(flags[:, number])
        wide = max(1, PAIRS // max(1, hi - lo))
        for at in range(0, len(asking), wide):
            some = asking[at : at + wide]
            d = ends[0]
            inner = qr[some, :d] @ xr[lo:hi, :d].T
            qi, xi = np.divmod(np.arange(inner.size), hi - lo)
            inner, qi, xi = inner.ravel(), some[qi], xi + lo
            for step, (d, share) in enumerate(index.stops):
                norms = q2[qi, -1] + x2[xi, -1]
                limit = share * (norms - 2 * tau[qi]) + 1e-9 * norms
                keep = np.flatnonzero(q2[qi, d - 1] + x2[xi, d - 1] - 2 * inner <= limit)
                qi, xi, inner = qi[keep], xi[keep], inner[keep]
                to = ends[step + 1]
                inner = inner + np.einsum("ij,ij->i", qr[qi, d:to], xr[xi, d:to])
            keep = np.flatnonzero(inner >= tau[qi] - 1e-9 * (q2[qi, -1] + x2[xi, -1]))
            qi, xi = qi[keep], xi[keep]
            score = np.einsum("ij,ij->i", q[qi], x[xi])
            keep = np.flatnonzero(score >= tau[qi])
            qi, xi, score = qi[keep], xi[keep], score[keep]
            cuts = np.flatnonzero(np.diff(qi)) + 1
            for who, what, how in zip(np.split(qi, cuts), np.split(xi, cuts), np.split(score, cuts), strict=True):
                if not len(who):
                    continue
                held = best[who[0]]
                held.append((what, how))
                if sum(len(h) for h, _ in held) > 4 * k:
                    best[who[0]] = [kept(held, k, copies)]
                    what, how = best[who[0]][0]
                    if copies[what].sum() >= k:
                        tau[who[0]] = max(tau[who[0]], how.min())
    for i, held in enumerate(best):
        if held:
            what, how = kept(held, k, copies)
            entries = [(ids[first[w] : first[w] + min(k, copies[w])], s) for w, s in zip(what, how, strict=True)]
            who, s = np.concatenate([e for e, _ in entries]), np.concatenate([np.full(len(e), s) for e, s in entries])
            order = np.lexsort((who, -s))
            yield i, who[order][:k], s[order][:k]


def kept(held: list[tuple[np.ndarray, np.ndarray]], k: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that can hold one of the k best: those scoring no less than the one at which k ids are reached."""
    what, how = (np.concatenate(p) for p in zip(*held, strict=True))
    order = np.argsort(-how, kind="stable")
    what, how = what[order], how[order]
    reached = np.searchsorted(np.cumsum(np.minimum(copies[what], k)), k)
    if reached >= len(what):
        return what, how
    keep = how >= how[reached]
    return what[keep], how[keep]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def taking_part(vectors: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that take part, their number and the length of their vectors (both 0 without any)."""
    held = vectors.schema[vector].dataType
    double = isinstance(held, ArrayType) and isinstance(held.elementType, DoubleType)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>" if double else "array<float>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, n = (size["dim"], size["count"]) if size else (0, 0)
    return rows.filter(F.size("v") == dim), n, dim


def sampled(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
    t = rows.orderBy(F.xxhash64("id", "v"), "id").limit(most).toArrow()
    v = t.column("v").combine_chunks()
    return np.asarray(t.column("id"), np.int64), matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v, max(1, dim))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `is_query` (of the column `id`) holds."""
    rows, n, dim = taking_part(vectors, id_column, vector)
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(*sampled(rows, dim), n, k)
    more = k + 1  # a query may find itself

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(nearest_list(matrix(b.column(0), dim), index.centres), pa.int32())], ["list"])

    size = np.zeros(len(index.centres), np.int64)
    for r in rows.select("v").mapInArrow(listed, "list int").groupBy("list").count().collect():  # a row per list
        size[r["list"]] = r["count"]
    pieces = np.maximum(1, -(-size // GROUP))
    # long lists have groups of their own, the others share groups up to GROUP rows
    first, at, room = np.zeros(len(size), np.int64), 0, GROUP
    for i in np.argsort(-size, kind="stable"):
        if pieces[i] > 1:
            first[i], at = at, at + pieces[i]
        else:
            if room < size[i] or at == 0 or room == GROUP:
                at, room = at + 1, GROUP
            first[i], room = at - 1, room - size[i] if size[i] else room

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0), np.int64)
            number = nearest_list(matrix(b.column(1), dim), index.centres)
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            group = first[number] + (mixed % pieces[number].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(number, pa.int32()), b.column(0), b.column(1)], ["group", "list", "id", "v"])

    element = rows.schema["v"].dataType.simpleString()
    candidates = rows.mapInArrow(grouped, f"group long, list int, id long, v {element}")
    members = rows.filter(is_query).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), "v")
    asked = cut(members.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies")), "asked")

    def in_sample(q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the sample's best ids and scores."""
        wide = max(1, PAIRS // len(index.sample))
        for lo in range(0, len(q), wide):
            for row in q[lo : lo + wide] @ index.sample.T:
                top = np.argpartition(-row, more - 1)[:more] if len(row) > more else np.arange(len(row))
                yield index.sample_id[top], top

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query vector and group that holds one of its lists, with its first threshold."""
        held = np.zeros((len(index.centres), int((first + pieces).max())), np.float32)
        for i in range(len(held)):
            held[i, first[i] : first[i] + pieces[i]] = size[i] > 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                q = matrix(b.column("v"), dim)
                groups = probed(q, index.centres, index.probes).astype(np.float32) @ held
                tau = np.array([np.einsum("j,ij->i", v, index.sample[t]).min() - 1e-12 if len(t) >= more else -np.inf for v, (_, t) in zip(q, in_sample(q), strict=True)])
                i, group = np.nonzero(groups)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), b.column("h1").take(take), b.column("h2").take(take), b.column("v").take(take), pa.array(tau[i])], ["group", "h1", "h2", "v", "tau"])

    def from_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                q = matrix(b.column("v"), dim)
                found = [(i, ids, np.einsum("j,ij->i", v, index.sample[t])) for i, (v, (ids, t)) in enumerate(zip(q, in_sample(q), strict=True))]
                yield answer(b, found)

    def answer(b: pa.RecordBatch | pa.Table, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        take = np.concatenate([np.full(len(ids), i) for i, ids, _ in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        h1, h2 = (np.asarray(b.column(c), np.int64)[take] for c in ("h1", "h2"))
        ids = np.concatenate([x for _, x, _ in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        score = np.concatenate([s for _, _, s in found] or [np.zeros(0)])
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids), pa.array(score)], ["h1", "h2", "id", "score"])

    def scanned(asks: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([answer(asks, [])])
        if not asks.num_rows or not held.num_rows:
            return empty
        q, x = (matrix(t.column("v").combine_chunks(), dim) for t in (asks, held))
        lists, ids, tau = (np.asarray(t.column(c)) for t, c in ((held, "list"), (held, "id"), (asks, "tau")))
        found = list(scan(q, tau, probed(q, index.centres, index.probes), x, lists, ids, index, more))
        return pa.Table.from_batches([answer(asks, found)])

    parts = max(1, -(-asked.count() // QUERIES))
    asks = asked.select("h1", "h2", "v").mapInArrow(asking, f"group long, h1 long, h2 long, v {element}, tau double").withColumn("part", F.pmod("h1", F.lit(parts)))
    candidates = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    found = asks.groupBy("group", "part").cogroup(candidates.groupBy("group", "part")).applyInArrow(scanned, FOUND)
    found = found.unionByName(asked.select("h1", "h2", "v").mapInArrow(from_sample, FOUND)).repartition("h1", "h2")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    found = found.groupBy("h1", "h2", "id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= more)
    found = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("id", "score")).alias("found"))

    # back to the rows that asked; vectors with very many of them are salted
    heavy = asked.filter(F.col("copies") > (asked.agg(F.sum("copies")).first()[0] or 0) / HEAVY).filter(F.col("copies") > SALTS).select("h1", "h2", F.lit(SALTS).alias("salts"))
    heavy = F.broadcast(heavy)  # at most HEAVY rows: each has more than that share
    salts = F.coalesce("salts", F.lit(1))
    found = found.join(heavy, ["h1", "h2"], "left").select("h1", "h2", "found", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    members = members.drop("v").join(heavy, ["h1", "h2"], "left").select("h1", "h2", F.col("id").alias("query_id"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    pairs = members.join(found, ["h1", "h2", "salt"]).select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
    pairs = pairs.filter(F.col("vec_id") != F.col("query_id")).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
