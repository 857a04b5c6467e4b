"""Multi-day flow tracker: accumulation, persistence, trend and conviction per ticker and as-of date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flow import TRACKER_BUCKETS, grade
from ..functions.scores import let

# Fixed values of the tracker.
ABS_FLOOR, REL_FLOOR, SKEW_FLOOR = 100_000.0, 0.15, 0.10
WEIGHTS = {"persistence": 0.25, "intensity": 0.20, "consistency": 0.25, "accel": 0.20, "mass": 0.05, "oi_change": 0.05}
PCR_MULT, PCR_HISTORY, PCR_BULL, PCR_BEAR, HEDGE_CUT = 1.3, 10, 0.9, 0.5, 0.85
LEAST_3D = 0.70
OI_CEILING = 50.0
GATE = ("min_active_days", "min_cum_premium", "min_prem_mcap_bps", "min_consistency", "min_day_persistence", "require_no_flips", "min_accel_t", "exclude_hedging", "min_grade_rank")
GATES = {
    "2d": {"all": (2, 2e6, 0.50, 0.0, 0.0, False, -99.0, False, 0), "activity": (2, 10e6, 2.5, 0.0, 0.0, False, 0.0, True, 3), "strong": (2, 5e6, 2.0, 0.10, 1.0, True, -99.0, True, 3)},
    "5d": {"all": (2, 2e6, 0.50, 0.0, 0.0, False, -99.0, False, 0), "activity": (4, 25e6, 3.0, 0.0, 0.0, False, 0.0, True, 3), "strong": (4, 25e6, 5.0, 0.10, 0.60, True, 0.0, True, 4)},
    "15d": {"all": (4, 2e6, 0.50, 0.0, 0.0, False, -99.0, False, 0), "activity": (6, 25e6, 3.0, 0.0, 0.0, False, 0.0, True, 3), "strong": (8, 50e6, 5.0, 0.10, 0.60, True, 0.0, True, 4)},
}
GRADE_RANK = {"A+": 6, "A": 5, "A-": 4, "B+": 3, "B": 2, "B-": 1, "C": 0}


def window_rows(snapshots: DataFrame, as_of: DataFrame, days: int) -> DataFrame:
    """Snapshot rows seen from each as-of date: the `days` days up to it. Later rows are invisible. The range join is an
    equality of stretches of `days` days: a row can be seen from its own stretch and the next one only. as_of is a row per
    date, hence broadcast, and the rows stay in their partitions."""
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    ends = as_of.select("as_of", stretch(F.col("as_of")).alias("_k"))
    own = stretch(F.col("snapshot_date"))
    seen = snapshots.withColumn("_k", F.explode(F.array(own, own + 1))).join(F.broadcast(ends), "_k").drop("_k")
    return seen.filter((F.col("snapshot_date") <= F.col("as_of")) & (F.col("snapshot_date") > F.date_sub("as_of", days)))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def log_norm(x: Column, lo: float, hi: float) -> Column:
    """log1p of x between the logs of lo and hi, clipped to 0..1."""
    a, b = math.log1p(lo), math.log1p(hi)
    return clip01((F.log1p(F.greatest(x, F.lit(0.0))) - a) / (b - a))


def daily(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key and day with what the tracker needs of it."""
    change = F.avg("total_oi_change_perc") if "total_oi_change_perc" in rows.columns else F.lit(None).cast("double")
    return rows.groupBy(*keys, "snapshot_date").agg(
        F.sum("total_bullish_premium").alias("bull"), F.sum("total_bearish_premium").alias("bear"), F.max("marketcap").alias("marketcap"), F.max("close").alias("close"), F.avg("put_call_ratio").alias("pcr"),
        F.max("perc_3_day_total").alias("p3"), F.max("dominant_dte_bucket").alias("bucket"), F.max("sector").alias("sector"), F.avg("sweep_share").alias("sweep"), change.alias("oi"),
    )


def accumulate(day: DataFrame, min_active: int = 2, min_premium: float = 250_000, min_mcap: float = 5e8, min_bps: float = 0.10) -> DataFrame:
    """Window sums and shape per (as_of, ticker) of the days seen from there: significant days, log-linear trend t statistic over all
    days with the degrees of freedom of the significant ones, consistency, day persistence and flips.

    All are windows on one sort, of which the newest day's row stays: a median or mode in an aggregate by key would be serialised
    for every key and day."""
    w = Window.partitionBy("as_of", "ticker").orderBy("snapshot_date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = day.withColumn("tot", F.col("bull") + F.col("bear")).withColumns({"idx": F.row_number().over(w) - 1, "mean": F.avg("tot").over(whole), "raw_days": F.count("*").over(whole)})
    skew, y, x = F.col("bull") - F.col("bear"), F.log1p("tot"), F.col("idx").cast("double")
    live = F.col("tot") > 0
    d = d.withColumns({k: v.over(whole) for k, v in {
        "cum_bull": F.sum("bull"), "cum_bear": F.sum("bear"), "active_days": F.count_if(F.col("tot") >= F.greatest(F.lit(ABS_FLOOR), F.col("mean") * REL_FLOOR)), "sxx": F.regr_sxx(y, x), "sxy": F.regr_sxy(y, x), "syy": F.regr_syy(y, x),
        "bull_days": F.count_if(live & (skew / F.nullif("tot", F.lit(0.0)) >= SKEW_FLOOR)), "bear_days": F.count_if(live & (skew / F.nullif("tot", F.lit(0.0)) <= -SKEW_FLOOR)), "live_days": F.count_if(live),
        "_pcr": F.avg("pcr"), "pcr_median": F.percentile("pcr", F.lit(0.5)), "pcr_n": F.count("pcr"), "perc_3d": F.max("p3"), "dominant_dte_bucket": F.mode("bucket", True), "sweep_share": F.avg("sweep"), "oi_change": F.avg("oi"), "first_close": F.first("close"),
    }.items()})
    a = d.filter(F.col("idx") == F.col("raw_days") - 1).drop("pcr", "sweep", "oi", "bull", "bear", "p3", "bucket", "tot", "idx", "mean", "snapshot_date").withColumnsRenamed({"_pcr": "pcr", "close": "last_close"})
    cum = F.col("cum_bull") + F.col("cum_bear")
    bps = F.when((cum > 0) & (F.col("marketcap") > 0), F.round(F.greatest("cum_bull", "cum_bear") / F.col("marketcap") * 10_000, 2)).otherwise(0.0)
    a = a.withColumn("cum_total", cum).withColumn("prem_mcap_bps", bps)
    a = a.filter((F.col("raw_days") >= min_active) & (cum >= min_premium) & (F.col("marketcap") >= min_mcap) & (bps >= min_bps) & (F.col("active_days") >= min_active))
    slope = F.try_divide("sxy", F.nullif("sxx", F.lit(0.0)))
    # the slope is bound to a name once; a projection with such a lambda is also compiled apart, in parts: all of the board in one
    # generated method is longer than the JVM compiles (8,000 bytes), and would be interpreted
    t = let(F.struct(slope.alias("slope"), (F.col("syy") - F.col("sxy") * slope).alias("left")), lambda v: _trend_t(v["slope"], v["left"]))
    lead = F.greatest("bull_days", "bear_days")
    persist = F.when(F.col("bull_days") == F.col("bear_days"), 0.0).otherwise(F.coalesce(F.round(F.try_divide(lead, "live_days"), 4), F.lit(0.0)))
    return a.withColumns({
        "accel_t": t, "consistency": F.coalesce(F.try_divide(F.abs(F.col("cum_bull") - F.col("cum_bear")), F.nullif("cum_total", F.lit(0.0))), F.lit(0.0)), "day_persistence": persist,
        "has_flips": (F.col("bull_days") > 0) & (F.col("bear_days") > 0), "direction": F.when(F.col("cum_bull") >= F.col("cum_bear"), "BULLISH").otherwise("BEARISH"),
        "window_return_pct": F.when((F.col("raw_days") >= 2) & (F.col("first_close") > 0), F.round((F.col("last_close") / F.col("first_close") - 1) * 100, 2)).otherwise(0.0),
    }).drop("sxx", "sxy", "syy")


def _trend_t(slope: Column, left: Column) -> Column:
    """The t statistic of a slope that leaves a sum of squares: 5 or -5 where the fit is exact up to rounding."""
    exact = left <= 1e-10 * F.greatest("syy", F.lit(1e-300))
    se = F.sqrt(F.greatest(left, F.lit(0.0)) / F.greatest(F.col("active_days") - 2, F.lit(1)) / F.nullif("sxx", F.lit(0.0)))
    flat = F.when(slope == 0, 0.0).when(slope > 0, 5.0).otherwise(-5.0)
    return F.when(slope.isNull(), 0.0).when(exact, flat).otherwise(let(se, lambda e: F.when(e <= 1e-9, flat).otherwise(slope / F.when(e > 0, e))))


def scored(acc: DataFrame, total_days: DataFrame, lookback: int, horizon: str = "5d") -> DataFrame:
    """Conviction score and grade, hedging test, accumulation score and gates. total_days: as_of, total_days."""
    a = acc.join(F.broadcast(total_days), "as_of")  # a row per date
    share = F.round(F.col("active_days") / F.col("total_days"), 2)
    a = a.withColumn("persistence_ratio", share).withColumn("trend", F.when(F.col("active_days") < 2, "steady").when(F.col("accel_t") > 1, "accelerating").when(F.col("accel_t") < -1, "fading").otherwise("steady"))
    parts = {"persistence": F.col("persistence_ratio"), "intensity": log_norm(F.col("prem_mcap_bps"), 1.0, 30.0), "consistency": F.col("consistency"), "accel": clip01((F.col("accel_t") + 1) / 3), "mass": log_norm(F.col("cum_total"), 5e5, 5e7), "oi_change": F.least(F.abs(F.coalesce("oi_change", F.lit(0.0))) / OI_CEILING, F.lit(1.0))}
    raw = F.lit(0.0)
    for k, p in parts.items():
        raw = raw + WEIGHTS[k] * p
    mult = F.lit(1.0)
    for label, _, _, m in TRACKER_BUCKETS:
        mult = F.when(F.col("dominant_dte_bucket") == label, m).otherwise(mult)
    ratio, bull = F.try_divide("pcr", F.nullif("pcr_median", F.lit(0.0))), F.col("direction") == "BULLISH"
    relative = (F.col("pcr_n") >= PCR_HISTORY) & (F.col("pcr_median") > 0)
    hedged = F.when(F.coalesce("pcr", F.lit(0.0)) <= 0, False).when(relative, F.when(bull, ratio > PCR_MULT).otherwise(ratio < 1 / PCR_MULT)).otherwise(F.when(bull, F.col("pcr") > PCR_BULL).otherwise(F.col("pcr") < PCR_BEAR))
    a = a.withColumn("hedging_risk", hedged)
    score = F.round(F.greatest(raw * 10 * mult * F.when(F.col("hedging_risk"), HEDGE_CUT).otherwise(1.0), F.lit(0.0)), 1)
    a = a.withColumn("conviction_score", score).withColumn("conviction_grade", grade(F.col("conviction_score")))
    acc_score = 100 * (0.35 * F.least(F.col("active_days") / lookback, F.lit(1.0)) + 0.30 * clip01(F.col("consistency")) + 0.25 * clip01((F.col("accel_t") + 0.5) / 2.5) + 0.10 * clip01(F.col("prem_mcap_bps") / 5))
    a = a.withColumn("accumulation_score", F.round(acc_score, 1))
    return a.withColumns({f"passes_{m}": passes(g) for m, g in GATES[horizon].items()})


def passes(gate: tuple) -> Column:
    """All thresholds of one gate, in the order of GATE."""
    days, prem, bps, cons, persist, no_flips, t, no_hedge, least = gate
    rank = F.lit(0)
    for g, r in GRADE_RANK.items():
        rank = F.when(F.col("conviction_grade") == g, r).otherwise(rank)
    ok = (F.col("active_days") >= days) & (F.col("cum_total") >= prem) & (F.col("prem_mcap_bps") >= bps) & (F.col("consistency") >= cons) & (F.col("accel_t") >= t) & (rank >= least)
    if persist > 0:
        ok = ok & (F.col("day_persistence") >= persist)
    if no_flips:
        ok = ok & ~F.col("has_flips")
    if no_hedge:
        ok = ok & ~F.col("hedging_risk") & (F.coalesce("perc_3d", F.lit(0.0)) <= 0) | (ok & ~F.col("hedging_risk") & (F.col("perc_3d") >= LEAST_3D))
    return ok


def track(snapshots: DataFrame, as_of: DataFrame, days: int, lookback: int = 5, horizon: str = "5d", dates: DataFrame | None = None, **floors) -> DataFrame:
    """The tracker board seen from each as-of date. dates: (snapshot_date) of all snapshots, where the caller has them already. Snapshots in
    partitions of whole tickers are not shuffled."""
    dates = snapshots.select("snapshot_date").distinct() if dates is None else dates
    total = window_rows(dates, as_of, days).groupBy("as_of").agg(F.count("*").alias("total_days"))
    return scored(accumulate(window_rows(daily(snapshots, ["ticker"]), as_of, days), **floors), total, lookback, horizon)


def with_sector_peers(board: DataFrame, gate: str = "passes_all") -> DataFrame:
    """The number of other rows of the board that pass the gate in the same sector and direction."""
    w = Window.partitionBy("as_of", "sector", "direction")
    return board.withColumn("sector_peers", F.count_if(F.col(gate)).over(w) - F.col(gate).cast("int"))


# Fixed values of the print convergence.
PRINT_BULL, PRINT_BEAR, PRINT_BONUS, PRINT_BPS = 0.55, 0.45, 0.30, 3.0


def with_print_convergence(board: DataFrame, prints: DataFrame, keys: list[str]) -> DataFrame:
    """board with dp_aligned and dp_divergent (the prints' bias leans with or against the row), dp_bonus, and score and grade with
    the bonus. prints: keys, dp_bias, dp_bps (notional over market cap). Without prints a row is neither. The bonus grows with
    notional up to 20 basis points and with the bias up to 0.3 from even."""
    b = board.join(prints.select(*keys, "dp_bias", "dp_bps"), keys, "left")
    bull, bias = F.col("direction") == "BULLISH", F.col("dp_bias")
    high, low, no = bias >= PRINT_BULL, bias <= PRINT_BEAR, F.lit(False)
    b = b.withColumns({"dp_aligned": F.coalesce(F.when(bull, high).otherwise(low), no), "dp_divergent": F.coalesce(F.when(bull, low).otherwise(high), no)})
    strength = F.least(F.col("dp_bps") / 20.0, F.lit(1.0)) * F.least(F.abs(bias - 0.5) / 0.30, F.lit(1.0))
    b = b.withColumn("dp_bonus", F.when(F.col("dp_aligned") & (F.col("dp_bps") >= PRINT_BPS), PRINT_BONUS * strength).otherwise(0.0))
    raised = F.round(F.col("conviction_score") * (1.0 + F.col("dp_bonus")) + 1e-7, 1)
    b = b.withColumn("conviction_score", F.when(F.col("dp_bonus") > 0, raised).otherwise(F.col("conviction_score")))
    return b.withColumn("conviction_grade", grade(F.col("conviction_score")))
