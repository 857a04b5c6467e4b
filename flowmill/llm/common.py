"""Helpers that the text operators share: table cuts, checked joins, word hashing over Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 20_000
#: Bytes of text that one numpy pass works on.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on local[*] a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="flowmill-")
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back, so that lineage ends here and a lost executor
    costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote and nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of tables that are written and no longer referred to: its cleaner acts when the
    driver collects garbage, which a driver with little to do seldom does."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def held_out(doc_id: Column, m: int, r: int) -> Column:
    """True where crc32(doc_id as text) mod m is r; a null id counts as not held out."""
    return F.coalesce(crc_mod(doc_id, m) == r, F.lit(False))


def small_join(df: DataFrame, small: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """Left join of df with a table of one row per key (nulls match nulls). The table is counted: up to
    BROADCAST_ROWS it is broadcast, beyond that df's rows are salted so that a hot key spreads out."""
    names = {k: f"_k_{k}" for k in keys}
    right = small.withColumnsRenamed(names)
    same = [df[k].eqNullSafe(right[v]) for k, v in names.items()]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), same, "left").drop(*names.values())
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.lit(salts)).cast("int"))
    same = [left[k].eqNullSafe(right[v]) for k, v in names.items()]
    return left.join(right, [*same, left["_salt"] == right["_salt_r"]], "left").drop(*names.values(), "_salt", "_salt_r")


def one_each(drawn: DataFrame, *keys: str) -> DataFrame:
    """Of drawn rows that share the keys the one of the least text (null texts count as none), so that a repeated id
    does not break a sample's bound. Copies are aggregated before they move."""
    return drawn.groupBy(*keys).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, m: int, r: int, rows: int) -> DataFrame:
    """At most `rows` labelled documents (text, y) that are not held out, those with the smallest hashed ids. Rows
    that share an id count once.

    Ids are drawn from the narrow label table first, so only the drawn texts are moved."""
    drawn = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), m, r))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return one_each(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "doc_id", "y").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


# ---- numpy kernels over Arrow batches ----------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xA0761D6478BD642F) + U64(seed)) | U64(1)


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_EXACT = stream(256, 7)
_BYTE = _EXACT[_LOWER]


class Words:
    """Words of a slice of texts: the text's row, byte bounds in `raw` and a 64-bit hash (A-Z lowered unless told not to)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.n_docs = len(texts)
        n = len(self.raw)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            self.bounds = np.zeros(self.n_docs + 1, np.int64)
            return
        inside = _IS_WORD[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True  # a text's first byte begins anew
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(self.off[1:], self.start, "right")
        self.bounds = np.searchsorted(self.start, self.off)
        size = self.end - self.start
        if not len(size):
            self.hash = np.zeros(0, U64)
            return
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(size.sum()) - np.repeat(first, size)
        weight = stream(int(size.max()), 11)
        self.hash = mix(np.add.reduceat((_BYTE if lower else _EXACT)[self.raw[inside]] * weight[place], first) + size.astype(U64))

    def shingles(self, k: int = 5) -> list[np.ndarray]:
        """Per text the hashes of its k-word shingles in order; of fewer words the whole sequence is one."""
        step = stream(k, 13)
        h, b = self.hash, self.bounds
        rolled = np.zeros(max(0, len(h) - k + 1), U64)
        for i in range(k):
            rolled += h[i : len(h) - k + 1 + i] * step[i]
        rolled = mix(rolled)
        out = []
        for i in range(self.n_docs):
            lo, hi = b[i], b[i + 1]
            if hi - lo >= k:
                out.append(rolled[lo : hi - k + 1])
            elif hi > lo:
                out.append(mix(np.array([np.sum(h[lo:hi] * step[: hi - lo]) + U64(hi - lo)], U64)))
            else:
                out.append(np.zeros(0, U64))
        return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `most` bytes of text (one text at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
