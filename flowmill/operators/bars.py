"""Indicators and price-action rules on OHLCV bars, for every bar of every ticker.

Everything is a window partitioned by ticker and ordered by date; the windows of one call share one sort, so a
table of bars is shuffled once. Callers that want only the newest bar filter on it afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATR_ALPHA = 1 / 14
#: Bars in a block of the exponential means.
BLOCK = 1000

def W():
    """Bars of a ticker in order of date."""
    return Window.partitionBy("ticker").orderBy("date")



def rows(a: int, b: int):
    return W().rowsBetween(a, b)


def clean(df: DataFrame) -> DataFrame:
    """Numeric OHLCV by try_cast, rows with a missing price or volume dropped, volume as a whole number."""
    nums = ("open", "high", "low", "close", "volume")
    out = df.withColumns({c: F.col(c).try_cast("double") for c in nums}).dropna(subset=list(nums))
    return out.withColumn("volume", F.col("volume").cast("long"))


def with_ewm(b: DataFrame, means: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """b with exponential means, unadjusted: name -> (values, alpha, first bar number), null before the first bar. b
    has the bar number i, from 0.

    Within a block of BLOCK bars the recursion has a closed form in one running sum, whose powers stay within a double
    at any length of the series; the mean at the end of the block before is carried in. What lies before that block
    weighs (1 - alpha)^BLOCK, less than a double resolves. The blocks' windows share the tickers' shuffle."""
    b = b.withColumn("_block", F.floor(F.col("i") / BLOCK))
    here = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("ticker").orderBy("_block", "date").rowsBetween(Window.unboundedPreceding, -1)
    i, at = F.col("i"), F.pmod(F.col("i"), F.lit(BLOCK))
    own, whole = {}, {}
    for name, (x, alpha, start) in means.items():
        q = 1 - alpha
        if q**BLOCK > 2.0**-53:
            raise ValueError(f"alpha {alpha} is too small for blocks of {BLOCK} bars")
        j = at - F.when(F.col("_block") == 0, start).otherwise(0)
        weighed = F.when(i == start, x).when(i > start, alpha * x * F.pow(F.lit(q), -j))
        own[f"_own_{name}"] = F.pow(F.lit(q), j) * F.coalesce(F.sum(weighed).over(here), F.lit(0.0))
        carried = F.last(F.when(at == BLOCK - 1, F.col(f"_own_{name}")), ignorenulls=True).over(before)
        whole[name] = F.when(i >= start, F.col(f"_own_{name}") + F.pow(F.lit(q), j + 1) * F.coalesce(carried, F.lit(0.0)))
    return b.withColumns(own).withColumns(whole).drop("_block", *own)


def features(bars: DataFrame) -> DataFrame:
    """Bar number, true range, ATR14, EMA20/50 with slopes, relative volume, ADX and Wilder RSI14."""
    b = bars.withColumn("i", F.row_number().over(W()) - 1)
    before, dh, dl = F.lag("close").over(W()), F.col("high") - F.lag("high").over(W()), F.lag("low").over(W()) - F.col("low")
    b = b.withColumns({
        "prev_close": before, "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "_up": F.greatest(dh, F.lit(0.0)), "_down": F.greatest(dl, F.lit(0.0)), "vol_ma20": F.when(F.count("volume").over(rows(-19, 0)) == 20, F.avg("volume").over(rows(-19, 0))),
    })
    # a missing first difference compares as false, hence zero
    b = b.withColumn("_plus", F.when((F.col("i") > 0) & (F.col("_up") > F.col("_down")), F.col("_up")).otherwise(0.0))
    b = b.withColumn("_minus", F.when((F.col("i") > 0) & (F.col("_down") > F.col("_plus")), F.col("_down")).otherwise(0.0))
    known = F.col("prev_close").isNotNull()  # greatest() skips nulls
    gain, loss = F.greatest(F.col("close") - F.col("prev_close"), F.lit(0.0)), F.greatest(F.col("prev_close") - F.col("close"), F.lit(0.0))
    b = b.withColumns({"_gain": F.when(known, gain), "_loss": F.when(known, loss)})
    b = b.withColumn("rel_volume", F.try_divide(F.col("volume").cast("double"), F.nullif("vol_ma20", F.lit(0.0))))
    b = with_ewm(b, {
        "atr14": (F.col("tr"), ATR_ALPHA, 0), "ema20": (F.col("close"), 2 / 21, 0), "ema50": (F.col("close"), 2 / 51, 0),
        "_sp": (F.col("_plus"), ATR_ALPHA, 0), "_sm": (F.col("_minus"), ATR_ALPHA, 0), "_g": (F.col("_gain"), ATR_ALPHA, 1), "_l": (F.col("_loss"), ATR_ALPHA, 1),
    })
    plus, minus = 100 * F.try_divide("_sp", "atr14"), 100 * F.try_divide("_sm", "atr14")
    b = b.withColumn("_dx", F.abs(plus - minus) / F.when(plus + minus == 0, 1e-9).otherwise(plus + minus) * 100)
    b = with_ewm(b, {"adx": (F.coalesce("_dx", F.lit(0.0)), ATR_ALPHA, 0)}).withColumns({
        "ema20_slope": F.try_divide(F.col("ema20") - F.lag("ema20", 5).over(W()), F.col("atr14")), "ema50_slope": F.try_divide(F.col("ema50") - F.lag("ema50", 5).over(W()), F.col("atr14")),
        "rsi14": F.when(F.col("i") >= 14, 100 - 100 / (1 + F.try_divide("_g", F.nullif("_l", F.lit(0.0))))),
    })
    return b.drop("_up", "_down", "_plus", "_minus", "_sp", "_sm", "_dx", "_gain", "_loss", "_g", "_l")


def trend() -> dict[str, Column]:
    """Trend state and strength from the EMA stack, ADX and slopes; a recovering trend counts 0.7."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    strength = F.round(0.6 * F.greatest(F.lit(0.0), F.least((zero("adx") - 15) / 25, F.lit(1.0))) + 0.4 * F.greatest(F.lit(0.0), F.least(F.abs(zero("ema20_slope")) / 2, F.lit(1.0))), 3)
    c, e20, e50, s50 = F.col("close"), F.col("ema20"), F.col("ema50"), zero("ema50_slope")
    known = F.col("i") >= 1
    up, down = known & (c > e20) & (e20 > e50), known & (c < e20) & (e20 < e50)
    rising, falling = known & (c > e50) & (s50 > 0), known & (c < e50) & (s50 < 0)
    return {
        "trend": F.when(up, "LONG").when(down, "SHORT").when(rising, "LONG").when(falling, "SHORT").otherwise("NEUTRAL"),
        "strength": F.when(up | down, strength).when(rising | falling, F.floor(strength * 700 + 0.5) / 1000).otherwise(0.0),
    }


def pivots(order: int = 3) -> dict[str, Column]:
    """Bars that are the highest or lowest of the `order` bars on both sides; needs them all."""
    full = F.count("*").over(rows(-order, order)) == 2 * order + 1
    return {"pivot_high": full & (F.col("high") == F.max("high").over(rows(-order, order))), "pivot_low": full & (F.col("low") == F.min("low").over(rows(-order, order)))}


def candles(threshold: float = 0.75, ratio: float = 1.5) -> dict[str, Column]:
    """Strong closes and rejection wicks of both sides."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - lo
    body = F.when(c == o, 1e-9).otherwise(F.abs(c - o))
    under, over = F.least(o, c) - lo, h - F.greatest(o, c)
    some = span > 0
    return {
        "bull_strong_close": some & (c > o) & (F.try_divide(c - lo, span) >= threshold), "bear_strong_close": some & (c < o) & (F.try_divide(h - c, span) >= threshold),
        "bull_wick": some & (under >= ratio * body) & (under > over) & (c > lo + span * 0.5), "bear_wick": some & (over >= ratio * body) & (over > under) & (c < lo + span * 0.5),
    }


def volume_rules() -> dict[str, Column]:
    light = F.avg("rel_volume").over(rows(-3, -1))
    return {"light_pullback": F.coalesce((F.col("i") >= 3) & (light <= 1.1), F.lit(False)), "volume_confirmed": F.coalesce(F.col("rel_volume") >= 1.0, F.lit(False))}


def flags(bars: int = 4, most: float = 1.5) -> dict[str, Column]:
    """Tight range of the bars before, broken by this close on volume."""
    top, bottom = F.max("high").over(rows(-bars, -1)), F.min("low").over(rows(-bars, -1))
    ok = (F.col("i") >= bars) & (F.col("atr14") > 0) & F.col("rel_volume").isNotNull() & (top - bottom <= most * F.col("atr14")) & (F.col("rel_volume") >= 1.0)
    return {"flag_breakout": F.coalesce(ok & (F.col("close") > top), F.lit(False)), "flag_breakdown": F.coalesce(ok & (F.col("close") < bottom), F.lit(False))}


def with_clean_trend(b: DataFrame) -> DataFrame:
    """Six of the last ten bars with higher lows or lower highs; sustained adds the EMA stack."""
    b = b.withColumns({"_higher": (F.col("low") > F.lag("low").over(W())).cast("int"), "_lower": (F.col("high") < F.lag("high").over(W())).cast("int")})
    enough = F.col("i") >= 10
    long_, short = enough & (F.sum("_higher").over(rows(-9, 0)) >= 6), enough & (F.sum("_lower").over(rows(-9, 0)) >= 6)
    c, e20, e50 = F.col("close"), F.col("ema20"), F.col("ema50")
    return b.withColumns({"clean_long": long_, "clean_short": short, "sustained_long": long_ & (c >= e20) & (e20 >= e50), "sustained_short": short & (c <= e20) & (e20 <= e50)}).drop("_higher", "_lower")


def relative_strength(bars: DataFrame, index: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Return over k bars less the benchmark's over its own k bars to the same date, in percent."""
    ret = lambda k, w: F.col("close") / F.lag("close", k).over(w) - 1
    wi = Window.orderBy("date")  # the benchmark: one row per date
    idx = index.select("date", *[ret(k, wi).alias(f"_x{k}") for k in windows])
    own = bars.select("ticker", "date", *[ret(k, W()).alias(f"_r{k}") for k in windows])
    return own.join(idx, "date", "left").select("ticker", "date", *[F.round((F.col(f"_r{k}") - F.col(f"_x{k}")) * 100, 2).alias(f"rs_{k}_pct") for k in windows])


def forward_returns(horizons: tuple[int, ...] = (1, 3, 5, 10, 20)) -> dict[str, Column]:
    """Close-to-close returns h bars ahead, clamped at the series' end; null on the last bar."""
    last = F.last("close").over(rows(0, Window.unboundedFollowing))
    more = F.lead("close").over(W()).isNotNull()
    return {f"forward_return_{h}": F.when(more & (F.col("close") > 0), F.coalesce(F.lead("close", h).over(W()), last) / F.col("close") - 1) for h in horizons}


def drawdown(c: str = "close") -> Column:
    peak = F.max(c).over(rows(Window.unboundedPreceding, 0))
    return (peak - F.col(c)) / peak


EMAS = ("ema20", "ema50")


def ema_touches(multiple: float = 0.3, bars: int = 5) -> dict[str, Column]:
    """A bar of the last five reached an EMA and held it, and this bar is still near an EMA (one ATR) or has moved
    on by three ATR at most; mirrored for rallies."""
    a, c = F.col("atr14"), F.col("close")
    near = (F.abs(c - F.col("ema20")) <= a) | (F.abs(c - F.col("ema50")) <= a)
    out = {}
    for name, touch, beyond in (
        ("pullback_to_ema", lambda e: (F.col("low") <= e + multiple * a) & (c >= e), lambda e: (c > e) & (c - e <= 3 * a)),
        ("rally_to_ema", lambda e: (F.col("high") >= e - multiple * a) & (c <= e), lambda e: (c < e) & (e - c <= 3 * a)),
    ):
        hit = F.lit(False)
        for e in EMAS:
            some = F.max((touch(F.col(e)) & (a > 0)).cast("int")).over(rows(-(bars - 1), 0)) == 1
            hit = hit | (some & (near | beyond(F.col(e))))
        out[name] = (F.col("i") >= bars - 1) & (a > 0) & hit
    return out


def retests() -> dict[str, Column]:
    """The bar before tested an EMA and closed near it, and this bar confirms: at least half an ATR long, closing in
    its outer 35 percent."""
    span, a = F.col("high") - F.col("low"), F.col("atr14")
    lag = lambda x: F.lag(x).over(W())
    pa = lag("atr14")
    tested = {s: F.lit(False) for s in ("long", "short")}
    for e in EMAS:
        close_by = F.abs(lag("close") - lag(e)) <= 0.75 * pa
        tested["long"] = tested["long"] | ((lag("low") <= lag(e) + 0.3 * pa) & close_by)
        tested["short"] = tested["short"] | ((lag("high") >= lag(e) - 0.3 * pa) & close_by)
    ok = (F.col("i") >= 2) & (a > 0) & (pa > 0) & (span >= 0.5 * a)
    up = ok & (F.col("close") > F.col("open")) & (F.try_divide(F.col("close") - F.col("low"), F.nullif(span, F.lit(0.0))) >= 0.65) & tested["long"]
    down = ok & (F.col("close") < F.col("open")) & (F.try_divide(F.col("high") - F.col("close"), F.nullif(span, F.lit(0.0))) >= 0.65) & tested["short"]
    return {"retest_long": F.coalesce(up, F.lit(False)), "retest_short": F.coalesce(down, F.lit(False))}


def bounces(multiple: float = 1.0, bars: int = 5, least: int = 1) -> dict[str, Column]:
    """Counter-trend bars that reached an EMA in the bars before, then a reversal bar."""
    a = F.col("atr14")
    red = (F.col("close") < F.col("open")) & (a > 0) & (F.col("low") <= F.greatest(*[F.col(e) for e in EMAS]) + multiple * a)
    green = (F.col("close") > F.col("open")) & (a > 0) & (F.col("high") >= F.least(*[F.col(e) for e in EMAS]) - multiple * a)
    n = lambda x: F.sum(x.cast("int")).over(rows(-bars, -1))
    known = F.col("i") >= bars
    return {"bounce_long": F.coalesce(known & (F.col("close") > F.col("open")) & (n(red) >= least), F.lit(False)), "bounce_short": F.coalesce(known & (F.col("close") < F.col("open")) & (n(green) >= least), F.lit(False))}


def last_levels(b: DataFrame, lookback: int = 20, order: int = 3, band: float = 0.5) -> DataFrame:
    """Support and resistance of each ticker's newest bar: pivots among the `lookback` bars before it, chained into
    clusters while the gap is at most `band` ATR, the cluster with most touches (the lowest on ties) below or above
    the close, else the window's extreme."""
    w = Window.partitionBy("ticker")
    ranked = b.withColumn("_k", F.row_number().over(w.orderBy(F.desc("date"))))
    last = ranked.filter("_k = 1").select("ticker", "date", "close", F.col("atr14").alias("_atr"))
    recent = ranked.filter(F.col("_k").between(2, lookback + 1)).select("ticker", "date", "high", "low")
    full = F.count("*").over(rows(-order, order)) == 2 * order + 1
    marked = recent.withColumns({"_hi": full & (F.col("high") == F.max("high").over(rows(-order, order))), "_lo": full & (F.col("low") == F.min("low").over(rows(-order, order)))})
    sides = F.array(F.struct(F.lit("lo").alias("side"), F.when(F.col("_lo"), F.col("low")).alias("p")), F.struct(F.lit("hi").alias("side"), F.when(F.col("_hi"), F.col("high")).alias("p")))
    p = marked.select("ticker", F.inline(sides)).filter("p is not null").join(last, "ticker").filter("_atr > 0")
    s = Window.partitionBy("ticker", "side").orderBy("p")
    p = p.withColumn("_new", F.coalesce((F.col("p") - F.lag("p").over(s) > band * F.col("_atr")).cast("int"), F.lit(1)))
    p = p.withColumn("_g", F.sum("_new").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    c = p.groupBy("ticker", "side", "_g", "close").agg(F.avg("p").alias("level"), F.count("*").alias("touches"))
    fits = ((F.col("side") == "lo") & (F.col("level") < F.col("close"))) | ((F.col("side") == "hi") & (F.col("level") > F.col("close")))
    best = c.filter(fits).groupBy("ticker").agg(*[F.max(F.when(F.col("side") == x, F.struct("touches", (-F.col("level")).alias("l")))).alias(f"_{x}") for x in ("lo", "hi")])
    ends = recent.groupBy("ticker").agg(F.min("low").alias("_min"), F.max("high").alias("_max"), F.count("*").alias("_n")).filter(F.col("_n") == lookback)
    return last.join(ends, "ticker").join(best, "ticker", "left").select("ticker", "date", F.coalesce(-F.col("_lo.l"), "_min").alias("support"), F.coalesce(-F.col("_hi.l"), "_max").alias("resistance"))
