"""Mixing sources to target weights, in DataFrame functions only.

Sizes are word counts. Sources ordered by code point (null last) weigh 1, 2, 3, 1, ... and share the corpus;
a target stops at three times its source's size and the excess is shared by weight among the others. The
repetition rate is target / size: a document is taken floor(rate) times, and once more where its hash falls
below the fraction. The hash has a seed; of SEEDS seeds a source uses the one whose sum comes closest to its
target, which an aggregate of one row per source decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small_join

WEIGHTS = (1, 2, 3)
MOST = 3
SEEDS = 16


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: Column | int, doc_id: Column) -> Column:
    """A number in [0, 1) from md5 of 'seed:doc_id' (a null id is the empty text)."""
    key = F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2**52)


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with weight, target and rate. The water level that meets the total is found
    over sources in order of cap / weight; there is one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    level = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = per_source.select("source", "source_size", w.alias("weight")).withColumn("_cap", most * F.col("source_size"))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(level), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0))
    t = t.withColumn("_level", rest / share)
    t = t.withColumn("_water", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.struct(-F.col("_ratio"), F.col("_level").alias("level")))).over(every)["level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap").cast("double")))
    return t.select("source", "source_size", "weight", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, source, size) -> one row per source: source_size, target, rate, seed."""
    rates = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "rates")
    frac = F.col("rate") - F.floor("rate")
    sums = [F.sum(F.when(draw(j, F.col("doc_id")) < frac, F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(seeds)]
    tried = small_join(sized, rates.select("source", "rate"), ["source"]).groupBy("source").agg(*sums)
    want = F.col("target") - F.floor("rate") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{j}") - want).alias("off"), F.lit(j).alias("seed")) for j in range(seeds)]))["seed"]
    t = tried.withColumnRenamed("source", "_s")
    return cut(rates.join(t, rates["source"].eqNullSafe(t["_s"])).select("source", "source_size", "target", "rate", best.alias("seed")), "plan")


def decide(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs with the plan's source_size and target and the document's copies, as columns named _mix_..."""
    named = rates.select("source", *[F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "rate", "seed")])
    extra = draw(F.col("_mix_seed").cast("string"), F.col("doc_id")) < F.col("_mix_rate") - F.floor("_mix_rate")
    return small_join(docs, named, ["source"]).withColumn("_mix_copies", (F.floor("_mix_rate") + F.when(extra, 1).otherwise(0)).cast("long"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, copies.

    Null or empty texts have size 0; null sources are one source, ordered last; rows that share an id draw
    alike; of an empty table the result is empty."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    copies = F.col("_mix_copies")
    return decide(sized, plan(sized, weights)).select(
        "doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: every column of docs, each document as often as the mix takes it."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    decided = decide(docs, plan(sized, weights)).filter("_mix_copies > 0")
    return decided.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns)
