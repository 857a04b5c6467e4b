"""Feature panel of a tracker board and what outcomes depend on.

Everything a row gets was known on its as-of date: bars and flow of that date's week, boards before it. Costly features are
masked to the best TOP rows of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
FAR, TOP, LEAST_SECTOR, HEAT_CUT, TAIL_CUT = 0.10, 30, 3, 0.02, 0.005
#: Volatility windows in bars, the returns needed before a regime, and the window of realised volatilities that one is ranked in.
SHORT, LONG, NEEDED, REALISED, HISTORY = 5, 20, 25, 30, 90


def volatility(bars: DataFrame) -> DataFrame:
    """(ticker, date, realized_vol_regime, rv_pct): short over long deviation of returns, and the share in percent of the last
    HISTORY realised volatilities, this one included, that are not above it; null before there are enough returns."""
    w = Window.partitionBy("ticker").orderBy("date")
    over = lambda k: w.rowsBetween(1 - k, 0)
    b = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn("_n", F.count("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    std = lambda k: F.stddev_samp("_r").over(over(k))
    b = b.withColumns({"_s": std(SHORT), "_l": std(LONG), "_v": F.when(F.col("_n") >= REALISED, std(REALISED))})
    b = b.withColumn("_h", F.collect_list("_v").over(over(HISTORY)))  # a frame of HISTORY numbers at most
    below = F.size(F.filter("_h", lambda v: v <= F.col("_v")))
    return b.select(
        "ticker", "date", F.when(F.col("_n") >= NEEDED, F.try_divide(F.col("_s"), F.nullif("_l", F.lit(0.0)))).alias("realized_vol_regime"), F.when(F.col("_v").isNotNull(), 100.0 * below / F.size("_h")).alias("rv_pct"),
    )


def delta_proxy(option_type: Column, strike: Column, spot: Column) -> Column:
    """Half, plus five times the moneyness up to 0.45 either way; less one for puts."""
    call = 0.5 + F.greatest(F.lit(-0.45), F.least(F.lit(0.45), 5 * (spot - strike) / spot))
    return F.when(option_type == "PUT", call - 1.0).otherwise(call)


def week_flow(events: DataFrame) -> DataFrame:
    """Per (ticker, date), date being the week: shares of far calls and puts in the premium, premium weighted by the delta proxy, and
    the expiry features that `panel` masks: the top expiry's share of open interest, dealers' net delta."""
    e = events.filter(F.col("strike").isNotNull() & F.col("underlying_price").isNotNull() & F.col("premium").isNotNull())
    delta, far = delta_proxy(F.col("option_type"), F.col("strike"), F.col("underlying_price")), F.abs(F.col("strike") - F.col("underlying_price")) / F.col("underlying_price") > FAR
    share = lambda kind: F.sum(F.when(far & (F.col("option_type") == kind), F.col("premium")).otherwise(0.0))
    per = e.groupBy("ticker", "date", "expiration_date").agg(
        F.sum("premium").alias("p"), share("CALL").alias("c"), share("PUT").alias("u"), F.sum(F.col("premium") * delta).alias("d"), F.coalesce(F.sum("open_interest"), F.lit(0)).alias("oi"), F.sum(F.col("open_interest") * delta).alias("nd"),
    )
    total = F.sum("p")
    return per.groupBy("ticker", "date").agg(
        F.when(total > 0, F.sum("c") / total).alias("far_otm_call_share"), F.when(total > 0, F.sum("u") / total).alias("far_otm_put_share"), F.sum("d").alias("_ddw"),
        F.try_divide(F.max("oi").cast("double"), F.nullif(F.sum("oi"), F.lit(0))).alias("expiry_concentration_top1"), (-F.sum("nd")).alias("dealer_net_delta"),
    )


def sector_relative(board: DataFrame, value: str) -> DataFrame:
    """(as_of, sector, p10, p50, p90) of sectors with LEAST_SECTOR rows on the date."""
    g = board.filter(F.col("sector").isNotNull() & F.col(value).isNotNull()).groupBy("as_of", "sector").agg(F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= LEAST_SECTOR).select("as_of", "sector", *[F.col("p")[i].alias(f"_p{i}") for i in range(3)])


MASKED = ("expiry_concentration_top1", "dealer_net_delta")


def panel(board: DataFrame, bars: DataFrame, events: DataFrame, iv: DataFrame, top: int = TOP) -> DataFrame:
    """A row per board row with its features. iv: (ticker, date, iv_rank). MASKED columns are null below the `top` best
    conviction scores of a date (ties by ticker). Write it with tables.replace_partitions by as_of: a rerun replaces its own dates."""
    vol, flow = volatility(bars).withColumnRenamed("date", "as_of"), week_flow(events).withColumnRenamed("date", "as_of")
    past = Window.partitionBy("ticker").orderBy("as_of").rowsBetween(-3, -1)
    b = board.withColumns({
        "_mu": F.avg("cum_total").over(past), "_sd": F.stddev_samp("cum_total").over(past), "_n": F.count("cum_total").over(past),
        "_place": F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("conviction_score"), "ticker")),
    })
    b = b.join(vol, ["ticker", "as_of"], "left").join(flow, ["ticker", "as_of"], "left").join(iv.withColumnRenamed("date", "as_of"), ["ticker", "as_of"], "left").join(sector_relative(board, "prem_mcap_bps"), ["as_of", "sector"], "left")
    spread = F.col("_p2") - F.col("_p0")
    rel = F.when(spread > 0, (F.col("prem_mcap_bps") - F.col("_p1")) / spread)
    sign = F.when(F.col("direction") == "BULLISH", 1.0).otherwise(-1.0)
    both = F.col("cum_bull") + F.col("cum_bear")
    return b.select(
        "as_of", "ticker", "direction", "conviction_grade", "conviction_score", "sector", F.try_divide("cum_bull", F.nullif(both, F.lit(0.0))).alias("bullish_premium_share"), (F.col("iv_rank") - F.col("rv_pct")).alias("vrp_proxy"),
        "far_otm_call_share", "far_otm_put_share", (sign * F.col("_ddw")).alias("dollar_delta_weighted_flow"), F.when(rel.isNotNull(), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), rel))).alias("sector_relative_pct"),
        F.when(F.col("_n") == 3, F.try_divide(F.col("cum_total") - F.col("_mu"), F.nullif("_sd", F.lit(0.0)))).alias("prem_momentum_z3d"), "realized_vol_regime", *[F.when(F.col("_place") <= top, F.col(c)).alias(c) for c in MASKED],
    )


# ---- conditions ---------------------------------------------------------------------------------------


def day_conditions(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(as_of, regime) by bullish over bearish premium of all tickers, and (as_of, sector, heat): the sector's net premium over
    the market's whole."""
    bull, bear = F.coalesce(F.col("total_bullish_premium"), F.lit(0.0)), F.coalesce(F.col("total_bearish_premium"), F.lit(0.0))
    sector = snapshots.groupBy(F.col("snapshot_date").alias("as_of"), F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum(bull).alias("b"), F.sum(bear).alias("s"))
    day = sector.groupBy("as_of").agg(F.sum("b").alias("tb"), F.sum("s").alias("ts"))
    ratio = F.try_divide("tb", F.nullif("ts", F.lit(0.0)))
    regime = F.when(F.col("ts") <= 0, "unknown").when(ratio >= 1.05, "bullish_flow").when(ratio <= 0.95, "bearish_flow").otherwise("mixed")
    heat = sector.join(day, "as_of").filter(F.col("tb") + F.col("ts") > 0).select("as_of", "sector", ((F.col("b") - F.col("s")) / (F.col("tb") + F.col("ts"))).alias("heat"))
    return day.select("as_of", regime.alias("regime")), heat


def slices(graded: DataFrame, snapshots: DataFrame, best: str = "A") -> DataFrame:
    """(slice, level, n, hit_rate, mean_excess_pct, mean_r) of rows with signed_excess: of the best grade family by direction, expiry bucket,
    sector, regime of the day, the sector's alignment with the row, and whether the day's rows of that family gained; of all
    families by bucket. Every row is put under all its slices once, so one aggregate serves them all."""
    regime, heat = day_conditions(snapshots)
    g = graded.filter(F.col("signed_excess").isNotNull())
    tail = g.filter(F.col("family") == best).groupBy("as_of").agg(F.avg("signed_excess").alias("_day"))
    g = g.join(regime, "as_of", "left").join(heat, ["as_of", "sector"], "left").join(tail, "as_of", "left")
    lean = F.when(F.col("direction") == "BULLISH", F.col("heat")).otherwise(-F.col("heat"))
    align = F.when(lean.isNull(), "unknown").when(lean > HEAT_CUT, "aligned").when(lean < -HEAT_CUT, "opposite").otherwise("neutral")
    wind = F.when(F.col("_day") > TAIL_CUT, "tailwind").when(F.col("_day") < -TAIL_CUT, "headwind").otherwise("flat")
    of_best = {"direction": F.col("direction"), "bucket": F.col("dominant_dte_bucket"), "sector": F.col("sector"), "regime": F.coalesce("regime", F.lit("unknown")), "sector_alignment": align, "day_tailwind": wind}
    entry = lambda name, level: F.struct(F.lit(name).alias("slice"), level.alias("level"))
    tags = [F.when(F.col("family") == best, entry(k, v)) for k, v in of_best.items()] + [entry("bucket_all", F.col("dominant_dte_bucket"))]
    long_ = g.select("signed_excess", F.inline(F.array_compact(F.array(*tags)))).filter("level is not null")
    x = F.col("signed_excess")
    s = long_.groupBy("slice", "level").agg(F.count("*").alias("n"), F.avg((x > 0).cast("double")).alias("hit_rate"), (F.avg(x) * 100).alias("mean_excess_pct"), (F.avg(x) / 0.02).alias("mean_r"))
    return s.filter((F.col("slice") != "sector") | (F.col("n") >= 2))


def levels(graded: DataFrame, features: list[str]) -> DataFrame:
    """(feature, level, n, mean_signed_excess_pct, hit_rate) of categorical features; blank levels are '-'."""
    rows = graded.filter(F.col("signed_excess").isNotNull())
    tags = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("-")).alias("level")) for c in features]
    x = F.col("signed_excess")
    return rows.select(x, F.inline(F.array(*tags))).groupBy("feature", "level").agg(F.count("*").alias("n"), (F.avg(x) * 100).alias("mean_signed_excess_pct"), F.avg((x > 0).cast("double")).alias("hit_rate"))
