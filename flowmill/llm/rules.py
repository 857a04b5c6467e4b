"""Quality rules with robust multivariate outliers.

Counts of each text give base rules and, transformed, a vector of six statistics. Per (lang, source) the minimum
covariance determinant estimate of that vector is found by concentration steps over all sound rows: each step takes
the SHARE of a group with the least Mahalanobis distance and recomputes mean and covariance. The steps start from all
rows, from medians and absolute deviations, and from SUBSETS small subsets drawn by hash, so that a cluster of outliers
that hides itself in one start does not in all; after FIRST_STEPS the KEPT starts of the least determinants go
on until these fall no more, and the least wins. A step of all starts together is two grouped sums (a histogram of distances, then
moments), so no group meets in one task. A text is rejected where its squared distance exceeds CUT times the group's
consistency factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, slices, small_join

#: Share of a group that the estimate rests on.
SHARE = 0.75
#: Subsets of D + 1 rows that a group's steps start from, besides all rows and medians; steps that every start takes.
SUBSETS, FIRST_STEPS = 10, 2
#: Starts of a group that go on after these steps.
KEPT = 3
#: A determinant falls if its logarithm does by more than this.
FALL = 1e-3
#: Groups of fewer sound rows are judged by the estimate over all of their language, or else over all rows.
LEAST_ROWS = 100
#: Squared distance in units of the consistency-corrected covariance: the 0.9999 quantile of chi-square with six
#: degrees of freedom.
CUT = 27.86
#: The 0.75 quantile of chi-square with six degrees, which the group's own quantile is scaled to.
CHI_SHARE = 7.84
#: Standard deviations added to the covariance's diagonal: differences below these are no sign of a fault.
FLOOR = (0.15, 0.06, 0.1, 0.12, 0.1, 0.1)
STATS = ("mean_length", "symbols", "dup_lines", "repeats", "upper", "marks")
D = len(STATS)
#: Bins of log2 distance per doubling.
FINE = 32

RAW = "doc_id long, grp_lang string, grp_source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:=^~@_"]] = True


def _dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RAW.split(", ")]
    for batch in slices(batches):
        w = Words(batch.column("text"), lower=False)
        total = lambda mask, w=w: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.off])
        n_words = np.diff(w.bounds)
        inside = np.zeros(len(w.raw) + 1, np.int64)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        in_word = np.cumsum(inside[:-1]) > 0
        word_chars = total(in_word & ((w.raw & 0xC0) != 0x80))
        n_symbols = total(_SYMBOL[w.raw])
        dup = np.array([_dup_lines(t) for t in batch.column("text").to_pylist()])
        repeat = np.zeros(w.n_docs, np.int64)
        for i, s in enumerate(w.shingles(3)):
            if n_words[i] >= 3:
                _, back, count = np.unique(s, return_inverse=True, return_counts=True)
                again = np.concatenate([[False, False], count[back] >= 2, [False, False]])
                repeat[i] = (again[:-2] | again[1:-1] | again[2:]).sum()
        n, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
        x = np.column_stack([
            np.log(np.maximum(word_chars, 1) / n), np.sqrt(n_symbols / c), np.sqrt(dup / n), np.sqrt(repeat / n),
            np.sqrt(total(_UPPER[w.raw]) / c), np.sqrt(total(_MARK[w.raw]) / c),
        ])
        columns = [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(v, pa.int64()) for v in (n_words, word_chars, n_symbols, dup, repeat)), pa.array(list(x), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names)


def measured(docs: DataFrame) -> DataFrame:
    """Counts and the transformed vector x of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(_measure, RAW)


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (with base_failed) with the group g whose estimate judges them: (lang, source), the language, or all,
    the first of LEAST_ROWS sound rows; and with the groups `fits` that a sound row is estimated in: its own and,
    where small groups need them, its language and all."""
    counts = rows.groupBy("grp_lang", "grp_source").agg(F.count_if(~F.col("base_failed")).alias("_n"))
    by_lang = counts.groupBy("grp_lang").agg(F.sum("_n").alias("_m"))
    both = counts.join(by_lang.withColumnRenamed("grp_lang", "_l"), F.col("grp_lang").eqNullSafe(F.col("_l"))).drop("_l")
    lang, source = F.coalesce(F.concat(F.lit("l:"), "grp_lang"), F.lit("-")), F.coalesce(F.concat(F.lit("s:"), "grp_source"), F.lit("-"))
    g = F.when(F.col("_n") >= LEAST_ROWS, F.concat_ws("|", lang, source)).when(F.col("_m") >= LEAST_ROWS, lang).otherwise("*")
    both = cut(both.select("grp_lang", "grp_source", g.alias("g"), lang.alias("_lang")), "counts")
    needed = cut(both.filter((F.col("g") == "*") | (F.col("g") == F.col("_lang"))).select(F.col("g").alias("_g")).distinct(), "fallbacks")
    langs = both.join(needed, F.col("_lang") == F.col("_g"), "left").withColumnRenamed("_g", "_by_lang")
    every = F.lit(None if needed.filter("_g = '*'").isEmpty() else "*").cast("string")
    groups = langs.select("grp_lang", "grp_source", "g", F.array_distinct(F.array_compact(F.array("g", "_by_lang", every))).alias("fits"))
    return small_join(rows, cut(groups, "groups"), ["grp_lang", "grp_source"])


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean, inverse Cholesky factor (row-wise lower triangle) and log determinant of each row's moments."""
    upper, low = np.triu_indices(D), np.tril_indices(D)
    for b in batches:
        n = np.asarray(b.column("n"), float)
        s = np.array(b.column("s").to_pylist(), float).reshape(len(n), D)
        q = np.array(b.column("q").to_pylist(), float).reshape(len(n), -1)
        mid = s / n[:, None]
        cov = np.zeros((len(n), D, D))
        cov[:, upper[0], upper[1]] = q / n[:, None]
        cov[:, upper[1], upper[0]] = q / n[:, None]
        cov = cov - mid[:, :, None] * mid[:, None, :] + np.diag(np.square(FLOOR))
        lower = np.linalg.cholesky(cov)
        inverse = np.linalg.inv(lower)
        det = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1)
        yield pa.RecordBatch.from_arrays(
            [b.column("g"), b.column("start"), pa.array(det), pa.array(list(mid), pa.list_(pa.float64())), pa.array(list(inverse[:, low[0], low[1]]), pa.list_(pa.float64()))],
            ["g", "start", "det", "mid", "inv"])


MODEL = "g string, start int, det double, mid array<double>, inv array<double>"


def _moments(rows: DataFrame) -> DataFrame:
    """rows (g, start, x) -> a MODEL row per group and start."""
    x = [F.element_at("x", i + 1) for i in range(D)]
    sums = rows.groupBy("g", "start").agg(
        F.count("*").alias("n"), *[F.sum(F.round(v, 9)).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(F.round(x[i] * x[j], 9)).alias(f"q{i}_{j}") for i in range(D) for j in range(i, D)],
    )
    s, q = F.array(*[f"s{i}" for i in range(D)]), F.array(*[f"q{i}_{j}" for i in range(D) for j in range(i, D)])
    return cut(sums.select("g", F.col("start").cast("int").alias("start"), "n", s.alias("s"), q.alias("q")).mapInArrow(_factor, MODEL), "moments")


def _by_medians(sound: DataFrame) -> DataFrame:
    """Start 1: medians and scaled absolute deviations of each statistic, without correlations.

    Values are rounded to 3 places for it, so that the exact percentile counts few different values."""
    mid = sound.groupBy("g").agg(*[F.percentile(F.round(F.element_at("x", i + 1), 3), 0.5).alias(f"m{i}") for i in range(D)])
    mid = cut(mid.select("g", F.array(*[f"m{i}" for i in range(D)]).alias("mid")), "medians")
    off = small_join(sound, mid, ["g"])
    mad = off.groupBy("g").agg(*[F.percentile(F.round(F.abs(F.element_at("x", i + 1) - F.element_at("mid", i + 1)), 3), 0.5).alias(f"a{i}") for i in range(D)])
    sd = [F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOOR[i] ** 2) for i in range(D)]
    inv = F.array(*[1 / sd[i] if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)])
    det = sum((2 * F.log(v) for v in sd[1:]), 2 * F.log(sd[0]))
    return mid.join(mad, "g").select("g", F.lit(1).alias("start"), det.alias("det"), "mid", inv.alias("inv"))


def _starts(sound: DataFrame) -> DataFrame:
    """MODEL rows to start from: all rows (0), medians (1), and subsets of D + 1 rows (from 2 on)."""
    start = (2 + F.pmod(F.xxhash64("doc_id", "x"), F.lit(SUBSETS))).cast("int")
    drawn = sound.withColumn("start", start).withColumn("_h", F.xxhash64(F.lit("draw"), "x", "doc_id"))
    drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("g", "start").orderBy("_h"))).filter(F.col("_r") <= D + 1)
    every = sound.select("g", F.lit(0).alias("start"), "x").union(drawn.select("g", "start", "x"))
    return cut(_moments(every).union(_by_medians(sound)), "starts")


def distance(x: Column, mid: Column, inv: Column) -> Column:
    """Squared Mahalanobis distance by the inverse Cholesky factor."""
    z = [F.element_at(x, i + 1) - F.element_at(mid, i + 1) for i in range(D)]
    rows, at = [], 1
    for i in range(D):
        term = F.element_at(inv, at) * z[0]
        for j in range(1, i + 1):
            term = term + F.element_at(inv, at + j) * z[j]
        rows.append(term * term)
        at += i + 1
    total = rows[0]
    for r in rows[1:]:
        total = total + r
    return total


def _with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with start and d2, one for each start of their group's models; rows of groups without a model have none."""
    extra = [c for c in model.columns if c not in ("g", "det", "mid", "inv")]
    of_group = cut(model.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "mid", "inv", *[c for c in extra if c != "start"]))).alias("models")), "models")
    each = small_join(rows, of_group, ["g"]).withColumn("_m", F.explode("models")).drop("models")
    return each.select(*rows.columns, *[F.col(f"_m.{c}").alias(c) for c in extra], distance(F.col("x"), F.col("_m.mid"), F.col("_m.inv")).alias("d2"))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-9) * FINE).cast("int")


def _limits(far: DataFrame) -> DataFrame:
    """Per group and start the distance bin that its SHARE quantile falls in, from a histogram."""
    keys = ["g", "start"]
    hist = far.groupBy(*keys, _bin(F.col("d2")).alias("b")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("b"))
    every = F.sum("k").over(Window.partitionBy(*keys))
    return hist.withColumn("_up", upto).withColumn("_all", every).filter(F.col("_up") >= F.ceil(SHARE * F.col("_all"))).groupBy(*keys).agg(F.min("b").alias("limit"))


def concentrated(sound: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of every group and start in model."""
    limit = _limits(_with_distance(sound, model))
    near = _with_distance(sound, model.join(limit, ["g", "start"])).filter(_bin(F.col("d2")) <= F.col("limit"))
    return _moments(near.select("g", "start", "x"))


def _least(model: DataFrame, kept: int) -> DataFrame:
    """The rows of the `kept` least determinants of every group; a group has SUBSETS + 2 rows at most."""
    least = model.groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("det", "start", "mid", "inv"))), 1, kept).alias("w"))
    return cut(least.select("g", F.explode("w").alias("w")).select("g", "w.start", "w.det", "w.mid", "w.inv"), "least")


def estimated(sound: DataFrame) -> DataFrame:
    """sound (doc_id, g, x) -> one MODEL row per group: the least determinant that the steps of its starts end at."""
    model = _starts(sound)
    for _ in range(FIRST_STEPS):
        model = concentrated(sound, model)
    best = moving = _least(model, KEPT)
    while not moving.isEmpty():
        after = concentrated(sound, moving)
        before = moving.select("g", "start", F.col("det").alias("_det"))
        moving = cut(after.join(before, ["g", "start"]).filter(F.col("det") < F.col("_det") - FALL).select("g", "start", "det", "mid", "inv"), "moving")
        best = best.union(moving)
    return _least(best, 1)


def judged(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2.

    Null texts count nothing and fail the base; null languages or sources are groups of their own. Rows that fail
    the base take no part in the estimates. Repeated rows count as often as they occur and are judged alike; whole texts
    are measured, however long; columns of docs beyond doc_id, text, lang and source are ignored, whatever their names.
    An empty table gives none; where no row is sound, none is kept and d2 is null."""
    raw = cut(measured(docs), "measured")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(_grouped(raw.withColumn("base_failed", failed)), "grouped")
    sound = rows.filter(~F.col("base_failed")).select("doc_id", F.explode("fits").alias("g"), "x")
    model = estimated(sound)
    limit = cut(_limits(_with_distance(sound, model)).select("g", (F.pow(F.lit(2.0), (F.col("limit") + 1) / FINE)).alias("edge")), "limits")
    final = small_join(rows, cut(model.join(limit, "g").select("g", "mid", "inv", "edge"), "judges"), ["g"]).withColumn("d2", distance(F.col("x"), F.col("mid"), F.col("inv")))
    factor = F.greatest(F.col("edge") / CHI_SHARE, F.lit(1.0))
    fine = F.coalesce(F.col("d2") <= CUT * factor, F.lit(True))
    return final.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), (F.col("d2") / factor).alias("d2"))
