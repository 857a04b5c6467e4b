"""MinHash near-duplicate detection with odd sketches.

1. Each text's set of five-word shingles gives 128 min-hashes, 32 band keys of four, and an odd sketch: every
   min-hash flips one bit, so the XOR of two sketches counts the samples in which the sets differ.
2. Texts of equal sets fall into one class; only one representative of a class goes on.
3. In every band bucket the least id is the pivot (a star, no pairs among members). A text is paired with the
   pivot it meets most often and its least one, then with pivots that are still in other components. Pairs whose sketches and
   sizes allow the similarity are confirmed on the full sets.
4. A bucket that still holds several components gets a second pivot, the text of which the least is its own, and
   every member is compared with it. The shingles that two members both share with it, and those that each shares
   with any other text at all, bound what the two can share.
5. The members of the smaller components meet the bucket's texts of a similar size; pairs that this bound and the
   sketches leave are confirmed, so every candidate pair is inside one component, ruled out exactly (by the bound),
   by its sketches, or compared. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_long, cut, mix, slices, stream
from .components import components

SHINGLE = 5
#: Linked where 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Bits of an odd sketch; SKETCH_SLACK is how many standard errors below the threshold still go on.
SKETCH_BITS = 512
SKETCH_SLACK = 4.5
#: Ratio of neighbouring size classes in the last step.
SIZE_STEP = 1.1

SIGNATURE = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = BANDS * ROWS
    a, b = stream(k, 101)[:, None], stream(k, 103)[:, None]
    lane, salt = np.arange(k, dtype=U64), stream(BANDS, 107)
    fold = stream(ROWS, 109)
    for batch in slices(batches):
        n, c1, c2, bands, sketches = [], [], [], [], []
        for s in Words(batch.column("text")).shingles(SHINGLE):
            s = np.unique(s)
            n.append(len(s))
            c1.append(np.sum(mix(s), dtype=U64) + U64(len(s)))
            c2.append(np.sum(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64))
            if not len(s):
                bands.append(None)
                sketches.append(None)
                continue
            low = np.full(k, np.iinfo(U64).max, U64)
            for at in range(0, len(s), 4096):
                np.minimum(low, (s[None, at : at + 4096] * a + b).min(axis=1), out=low)
            keys = mix((low.reshape(BANDS, ROWS) * fold).sum(axis=1, dtype=U64) ^ salt)
            bits = np.bincount((mix(low + lane) % U64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
            bands.append(as_long(keys))
            sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
        arrays = [
            batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(as_long(np.array(c1, U64))), pa.array(as_long(np.array(c2, U64))),
            pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "c1", "c2", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit print, band keys and odd sketch of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures, SIGNATURE)


def _bits(words: Column) -> Column:
    return F.aggregate(F.transform(words, lambda x: F.bit_count(x).cast("int")), F.lit(0), lambda s, x: s + x)


def sketch_distance(a: Column, b: Column) -> Column:
    """Number of bits in which two odd sketches differ."""
    return _bits(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def sketch_limit(percent: int = PERCENT) -> int:
    """The largest XOR count at which two sketches may still have the similarity. Two sets of similarity J
    differ in about k(1-J) of k samples; each such sample flips two bits."""
    k, m, miss = BANDS * ROWS, SKETCH_BITS, 1 - percent / 100
    differ = k * miss + SKETCH_SLACK * np.sqrt(k * miss * (1 - miss))
    return int(np.ceil(m / 2 * (1 - (1 - 2 / m) ** (2 * min(k, differ))))) + 1


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "ta", 1 << 19):
        left, right = Words(batch.column("ta")).shingles(SHINGLE), Words(batch.column("tb")).shingles(SHINGLE)
        keep = []
        for x, y in zip(left, right, strict=True):
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep))


#: inside: one bit for each shingle of v that u holds, in order of hash; held: their number.
AGAINST = "u long, v long, linked boolean, inside array<long>, held long"


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "ta", 1 << 19):
        left, right = Words(batch.column("ta")).shingles(SHINGLE), Words(batch.column("tb")).shingles(SHINGLE)
        linked, inside, held = [], [], []
        for x, y in zip(left, right, strict=True):
            x, y = np.unique(x), np.unique(y)
            bits = np.isin(y, x, assume_unique=True)
            both = int(bits.sum())
            linked.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            inside.append(np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, bool)])).view(np.int64))
            held.append(both)
        columns = [batch.column("u"), batch.column("v"), pa.array(linked), pa.array(inside, pa.list_(pa.int64())), pa.array(held, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["u", "v", "linked", "inside", "held"])


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = texts.select(F.col("id").alias("u"), F.col("text").alias("ta")), texts.select(F.col("id").alias("v"), F.col("text").alias("tb"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "ta", "tb")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough; texts: id, text."""
    return _texts_of(pairs, texts).mapInArrow(_linked, "u long, v long")


def _plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs that sizes and odd sketches do not rule out. facts: id, n, sketch."""
    x = facts.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    y = facts.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    return pairs.join(x, "u").join(y, "v").filter(_near("nu", "nv", "su", "sv")).select("u", "v").distinct()


def _near(nu: str, nv: str, su: str, sv: str) -> Column:
    sized = 100 * F.least(nu, nv) >= PERCENT * F.greatest(nu, nv)
    return sized & (sketch_distance(F.col(su), F.col(sv)) <= sketch_limit())


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [np.unique(s) for s in Words(batch.column("text")).shingles(SHINGLE)]
        ids = np.repeat(batch.column("id").to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(as_long(np.concatenate(sets)))], ["id", "s"])


def _own(texts: DataFrame) -> DataFrame:
    """id, own: how many of the text's shingles no other of the texts holds."""
    return texts.select("id", "text").mapInArrow(_shingle_rows, "id long, s long").groupBy("s").agg(F.count("*").alias("k"), F.min("id").alias("id")).filter("k = 1").groupBy("id").agg(F.count("*").alias("own"))


def _apart(of: DataFrame) -> DataFrame:
    """The rows (b, id, c, ...) of buckets that hold several components."""
    several = of.groupBy("b").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo != _hi").select("b")
    return of.join(several, "b", "left_semi")


def _named(df: DataFrame, found: DataFrame, at: str, name: str) -> DataFrame:
    """df with the component of the id in column `at`; an id without links is its own."""
    own = found.select(F.col("id").alias(at), F.col("component").alias("_c"))
    return df.join(own, at, "left").withColumn(name, F.coalesce("_c", at)).drop("_c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, class_id.

    docs needs doc_id (integer) and text; other columns are ignored. Vertices are ids: rows that share an id
    are one document. Documents are linked where 100 * |A & B| >= 75 * |A | B| of their shingle sets, and
    component_id is the least id reachable. Empty or null texts link with nothing. Rows without an id link with
    nothing, have a null component and are kept. An empty table gives an empty result."""
    sigs = cut(signatures(docs), "signatures")
    named = sigs.filter("doc_id is not null and n_shingles > 0")
    classes = cut(
        named.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    buckets = classes.select("id", F.explode("bands").alias("b"))
    pivots = buckets.groupBy("b").agg(F.min("id").alias("v"), F.max("id").alias("_m")).filter("v != _m").select("b", "v")
    shared = cut(buckets.join(pivots, "b").select("b", F.col("id").alias("u"), "v"), "buckets")
    facts = cut(classes.join(shared.select(F.col("u").alias("id")).distinct().hint("merge"), "id", "left_semi").select("id", "n", "sketch"), "facts")
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(facts.select("id").distinct().hint("merge"), "id"), "texts")

    # Each text with the pivot it shares most bands with and the least of its pivots, which a large group has
    # in common; then with those it shares two or more bands with that are
    # still in other components. Pairs that meet in one bucket only are left to the last step.
    often = shared.filter("u != v").groupBy("u", "v").agg(F.count("*").alias("k"))
    two = often.groupBy("u").agg(F.max(F.struct("k", (-F.col("v")).alias("v"))).alias("m"), F.min("v").alias("least"))
    first = two.select("u", F.explode(F.array_distinct(F.array(-F.col("m.v"), F.col("least")))).alias("v"))
    links = cut(confirmed(_plausible(first, facts), texts), "links")
    found = cut(components(links), "found")
    other = _named(_named(often.filter("k >= 2").select("u", "v"), found, "u", "cu"), found, "v", "cv").filter("cu != cv").select("u", "v")
    other = cut(confirmed(_plausible(other, facts), texts), "links")
    links = links.union(other)
    found = found if other.isEmpty() else cut(components(links), "found")

    # Buckets that still hold several components. What no other of their texts holds bounds a text's overlap.
    mixed = cut(_apart(_named(shared.select("b", F.col("u").alias("id")), found, "id", "c")), "mixed")
    ids = mixed.select("id").distinct().hint("merge")
    reach = facts.join(ids, "id", "left_semi").join(_own(texts.join(ids, "id", "left_semi")), "id", "left").select("id", "n", "sketch", (F.col("n") - F.coalesce("own", F.lit(0))).alias("reach"))
    of = cut(mixed.join(reach, "id"), "reach")
    # The text that shares most of itself becomes the bucket's second pivot, and every member is compared with it.
    central = of.groupBy("b").agg(F.max(F.struct((F.col("reach") / F.col("n")).alias("k"), (-F.col("id")).alias("i"))).alias("p")).select("b", (-F.col("p.i")).alias("v"))
    met = cut(of.join(central, "b").filter("id != v"), "met")
    against = cut(_texts_of(met.select(F.col("id").alias("u"), "v").distinct(), texts).mapInArrow(_against, AGAINST), "against")
    more = cut(against.filter("linked").select("u", "v"), "links")
    links = links.union(more)
    found = found if more.isEmpty() else cut(components(links), "found")

    # What is still apart: the smaller components against all the bucket holds of the sizes that can be similar.
    # Two members share no more than what both share with the pivot and the lesser of what else they share with any text.
    bounds = against.select(F.col("u").alias("id"), "v", "inside", "held")
    of = cut(_apart(_named(met.drop("c"), found, "id", "c")).join(bounds, ["id", "v"]).withColumn("extra", F.col("reach") - F.col("held")), "apart")
    major = of.groupBy("b", "c").agg(F.count("*").alias("k")).groupBy("b").agg(F.max(F.struct("k", "c")).alias("m")).select("b", F.col("m.c").alias("major"))
    least = F.ceil(F.col("n") * PERCENT / 100)
    most = F.least(F.floor(F.col("n") * 100 / PERCENT), F.floor(F.col("reach") * (100 + PERCENT) / PERCENT) - F.col("n"))
    one = lambda x: [F.col("id").alias(x), *[F.col(c).alias(c + x) for c in ("c", "n", "extra", "inside", "sketch")]]
    minor = of.join(major, "b").filter((F.col("c") != F.col("major")) & (most >= least)).select("b", F.explode(F.sequence(_size_class(least), _size_class(most))).alias("s"), "major", *one("u"))
    every = of.select("b", _size_class(F.col("n")).alias("s"), *one("v"))
    other = (F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("major")) | (F.col("u") < F.col("v")))
    both = _bits(F.zip_with("insideu", "insidev", lambda x, y: x.bitwiseAND(y))) + F.least("extrau", "extrav")
    rest = minor.join(every, ["b", "s"]).filter(other & ((100 + PERCENT) * both >= PERCENT * (F.col("nu") + F.col("nv"))) & _near("nu", "nv", "sketchu", "sketchv"))
    more = cut(confirmed(rest.select("u", "v").distinct(), texts), "links")

    final = found if more.isEmpty() else components(links.union(more))
    same = classes.select("c1", "c2", "id").join(final, "id", "left").select("c1", "c2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    # An id whose rows differ in text is one vertex: its classes are joined through the id.
    twice = named.groupBy("doc_id").agg(F.min("c1").alias("_lo"), F.max("c1").alias("_hi")).filter("_lo != _hi")
    if not twice.isEmpty():
        via = named.join(twice, "doc_id", "left_semi").join(same, ["c1", "c2"]).select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
        final = components(links.union(more).union(via))
        same = classes.select("c1", "c2", "id").join(final, "id", "left").select("c1", "c2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "c1", "c2").join(same, ["c1", "c2"], "left")
    lone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    comp = F.when(lone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"),
        F.when(lone, F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document left of each near-duplicate group: the one of the least id, and of
    rows that repeat that id one. Texts without words and rows without an id all stay."""
    judged = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct().hint("merge")
    named = docs.join(judged, F.col("doc_id").cast("long") == F.col("__id")).drop("__id")
    twice = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not twice.isEmpty():
        ids = twice.withColumnRenamed("doc_id", "__id")
        same = named.join(ids, named["doc_id"] == ids["__id"], "left_semi").dropDuplicates(["doc_id"])
        named = named.join(ids, named["doc_id"] == ids["__id"], "left_anti").unionByName(same)
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
