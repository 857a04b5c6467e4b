"""Scores of candidates and open positions: stack score, ranked reasons, health, trailing stops, regimes.

Each rule ladder is one `when` chain over columns of its row, so all of it stays in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def half_up(x: Column, digits: int) -> Column:
    """Rounding by floor(x + 1/2), the same on every engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


# ---- six-part stack score ----------------------------------------------------------------------

# Points of each part, and the tiers.
STACK = {"flow_core": 50.0, "dp_confirm": 15.0, "chain_confirm": 10.0, "insider": 8.0, "price_confirm": 12.0, "dealer_regime": 5.0}
STACK_TIERS = ((80.0, "elite", "Stack A"), (65.0, "strong", "Stack B"), (50.0, "moderate", "Stack C"), (0.0, "weak", "Stack D"))


def side(direction: Column) -> Column:
    """LONG or SHORT of the labels in use, null of any other."""
    d = F.upper(F.trim(direction))
    return F.when(d.isin("LONG", "BULLISH", "BUY", "NET BULLISH"), "LONG").when(d.isin("SHORT", "BEARISH", "SELL", "NET BEARISH"), "SHORT")


def stack_parts() -> dict[str, Column]:
    """Points of each part from direction, conviction_score, dp_bias, dp_bps, dp_z, hot_chain, call_premium,
    put_premium, insider, session_tone, rs_5, rs_20, window_return_pct and dealer_bias; nulls are missing data."""
    way = side(F.col("direction"))
    long_, short = way == "LONG", way == "SHORT"
    bias, bps = F.coalesce("dp_bias", F.lit(0.5)), F.coalesce("dp_bps", F.lit(0.0))
    buyers = F.when((bias >= 0.6) & (bps >= 5), 12.0).when((bias >= 0.6) & (bps >= 1), 9.0).when((bias >= 0.55) & (bps >= 1), 5.0).when((bias <= 0.4) & (bps >= 1), -4.0).otherwise(0.0)
    sellers = F.when((bias <= 0.4) & (bps >= 5), 12.0).when((bias <= 0.4) & (bps >= 1), 9.0).when((bias <= 0.45) & (bps >= 1), 5.0).when((bias >= 0.6) & (bps >= 1), -4.0).otherwise(0.0)
    hot = F.when((long_ & (F.col("dp_z") >= 2)) | (short & (F.col("dp_z") <= -2)), 3.0).otherwise(0.0)
    no_prints = F.col("dp_bias").isNull() & (bps == 0) & F.col("dp_z").isNull()
    prints = F.when(no_prints, 0.0).otherwise(clamp(F.when(long_, buyers).when(short, sellers).otherwise(0.0) + hot, 0, 15))
    call, put = F.coalesce("call_premium", F.lit(0.0)), F.coalesce("put_premium", F.lit(0.0))
    some = (call != 0) | (put != 0)
    agrees = F.when(some & long_, call >= put).when(some & short, put >= call)
    cap = F.when(F.col("hot_chain"), 10.0).otherwise(5.0)
    chain = F.when(F.col("hot_chain").isNull(), 0.0).when(agrees, cap).when(~agrees, 0.0).otherwise(cap * 0.5)
    insider = F.when((long_ & (F.lower("insider") == "buying")) | (short & (F.lower("insider") == "selling")), 8.0).otherwise(0.0)
    tone, r5, r20, ret = F.upper("session_tone"), F.col("rs_5"), F.col("rs_20"), F.col("window_return_pct")

    def price(strong: str, sign: int) -> Column:
        by_tone = F.when(tone == strong, 8.0).otherwise(0.0)
        by_rs = F.when((sign * r5 > 0) & (sign * r20 > 0), 10.0).when(sign * r20 > 0, 6.0).otherwise(0.0)
        by_ret = F.when(sign * ret > 0, F.least(F.lit(12.0), 6.0 + F.least(sign * ret, F.lit(6.0)))).otherwise(0.0)
        return F.greatest(by_tone, by_rs, by_ret)

    dealer = F.when(way.isNull(), 0.0).when(F.lower("dealer_bias") == "chase", 5.0).when(F.lower("dealer_bias") == "suppress", 1.5).otherwise(0.0)
    return {
        "flow_core": clamp(F.coalesce("conviction_score", F.lit(0.0)), 0, 10) / 10.0 * 50.0, "dp_confirm": prints, "chain_confirm": chain, "insider": insider,
        "price_confirm": F.when(long_, price("STRENGTH", 1)).when(short, price("WEAKNESS", -1)).otherwise(0.0), "dealer_regime": dealer,
    }


def conviction_stack(df: DataFrame) -> DataFrame:
    """df with the points of each part (stack_<part>), raw_score, score, tier, tier_label, drivers (parts at 60 % of
    their points or more) and drags (at 20 % or less, the flow itself apart)."""
    parts = stack_parts()
    df = df.withColumns({f"stack_{k}": v for k, v in parts.items()})
    total = clamp(_sum([F.col(f"stack_{k}") for k in STACK]), 0, 100)
    share = {k: half_up(F.col(f"stack_{k}"), 2) / most for k, most in STACK.items()}
    pick = lambda test, names: F.array_compact(F.array(*[F.when(test(share[k]), F.lit(k)) for k in names]))
    ladder = lambda j: reduce(lambda c, t: c.when(total >= t[0], t[j]), STACK_TIERS[1:], F.when(total >= STACK_TIERS[0][0], STACK_TIERS[0][j]))
    return df.withColumns({
        "raw_score": total, "score": F.bround(total, 0).cast("int"), "tier": ladder(1), "tier_label": ladder(2),
        "drivers": pick(lambda x: x >= 0.6, list(STACK)), "drags": pick(lambda x: x <= 0.2, [k for k in STACK if k != "flow_core"]),
    })


# ---- ranked reasons ----------------------------------------------------------------------------


def ranked_reasons(parts: dict[str, tuple[Column, float]], most_drivers: int = 3, drag_below: float = 0.2) -> tuple[Column, Column]:
    """(drivers, drag) of (points, most points) by part: up to three parts with points, most first, and of the others
    the one with the least share of its points, if below `drag_below`. Null points are missing parts; ties keep the
    given order."""
    rows = F.array(*[F.struct((-p).alias("down"), F.lit(k).alias("at"), (p / top).alias("share"), F.lit(n).alias("part")) for k, (n, (p, top)) in enumerate(parts.items())])
    known = F.array_sort(F.filter(rows, lambda r: r["down"].isNotNull()))
    drivers = F.transform(F.slice(F.filter(known, lambda r: r["down"] < 0), 1, most_drivers), lambda r: r["part"])
    rest = F.filter(known, lambda r: ~F.array_contains(drivers, r["part"]))
    worst = F.array_min(F.transform(rest, lambda r: F.struct(r["share"].alias("share"), r["at"].alias("at"), r["part"].alias("part"))))
    return drivers, F.when(worst["share"] < drag_below, worst["part"])


# ---- trailing stops and health -----------------------------------------------------------------

# Fixed values of the trails.
TRAIL = {"lottery": 1.5, "swing": 2.1, "position": 2.3, "leap": 2.1}
TRAIL_UNKNOWN, HYBRID, AFTER_T1, NEAR_WALL = 2.4, 2.0, 1.0, 1.5
GAMMA = {"NEGATIVE": 1.15, "POSITIVE": 0.85}
GRADES = ("C", "B-", "B", "B+", "A-", "A", "A+")


def _grade_rank(c: str) -> Column:
    return reduce(lambda w, k: w.when(F.trim(c) == GRADES[k], k), range(1, len(GRADES)), F.when(F.trim(c) == GRADES[0], 0))


def flow_penalties() -> dict[str, Column]:
    """What flow has turned against the position: half a point for each grade lost since entry (1.5 at most), sector
    heat of 2 or more against it (a fifth of it, 1.5 at most), and unusual flow of the other side (1)."""
    drop = _grade_rank("entry_grade") - _grade_rank("current_grade")
    long_, heat = F.col("direction") == "LONG", F.col("sector_heat")
    against = F.when(long_ & (heat <= -2), F.least(-heat / 5.0, F.lit(1.5))).when(~long_ & (heat >= 2), F.least(heat / 5.0, F.lit(1.5))).otherwise(0.0)
    flip = F.when(F.upper("unusual_flow") == F.when(long_, "BEARISH").otherwise("BULLISH"), 1.0).otherwise(0.0)
    return {"grade_decay": F.when(drop > 0, F.least(0.5 * drop, F.lit(1.5))).otherwise(0.0), "heat_reversal": against, "flow_flip": flip}


def trailing_stops(df: DataFrame) -> DataFrame:
    """df with best_price, trail_atr, trail_ema, trail_hybrid, trail_post_t1, active_stop and unrealized_r.

    A row is an open position beside its ticker's newest bar: direction, entry_price, initial_stop, risk_per_share,
    target_1, best_price, days_held, partial_filled, bucket, gamma_regime, wall (null without options data), the
    columns of flow_penalties, close, high, low, atr14, ema20. Shorts are computed on negated prices."""
    s = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    at = lambda c: s * F.col(c)
    atr, entry, stop, risk = F.col("atr14"), at("entry_price"), at("initial_stop"), F.col("risk_per_share")
    best = F.greatest(at("best_price"), F.when(s > 0, F.col("high")).otherwise(-F.col("low")))
    r = F.when(risk > 0, (at("close") - entry) / risk).otherwise(0.0)
    gamma = F.when(F.col("gamma_regime") == "NEGATIVE", GAMMA["NEGATIVE"]).when(F.col("gamma_regime") == "POSITIVE", GAMMA["POSITIVE"]).otherwise(1.0)
    own = reduce(lambda w, b: w.when(F.col("bucket") == b, TRAIL[b]), list(TRAIL)[1:], F.when(F.col("bucket") == "lottery", TRAIL["lottery"])).otherwise(TRAIL_UNKNOWN)
    keep = clamp(1.0 - _sum(list(flow_penalties().values())) / 4.0, 0, 1)
    tight = HYBRID * gamma
    loose = (own * keep + HYBRID * (1.0 - keep)) * gamma
    gap = F.when((at("wall") > entry) & (atr > 0), (at("wall") - at("close")) / atr)
    blend = F.when((gap > 0) & (gap < NEAR_WALL), 1.0 - gap / NEAR_WALL).otherwise(0.0)
    mult = F.when(blend > 0, loose * (1.0 - blend) + tight * blend).otherwise(loose)
    df = df.withColumns({"_s": s, "_best": best, "_r": r, "_tight": tight, "_mult": mult})
    step = F.when(F.col("_r") < 1, stop).when(F.col("_r") < 2, entry).otherwise(F.col("_best") - F.col("_tight") * atr)
    hybrid = F.when((F.col("days_held") >= 4) & (F.col("_r") < 0.5), entry).otherwise(step)
    after = F.when(F.col("partial_filled"), F.greatest(at("target_1") - AFTER_T1 * atr, stop))
    df = df.withColumns({"_atr": F.greatest(F.col("_best") - F.col("_mult") * atr, stop), "_hybrid": F.greatest(hybrid, stop), "_after": after})
    active = F.greatest("_atr", at("ema20"), "_hybrid", "_after")  # skips a null
    back = F.col("_s")
    return df.withColumns({
        "best_price": back * F.col("_best"), "trail_atr": back * F.col("_atr"), "trail_ema": F.col("ema20"), "trail_hybrid": back * F.col("_hybrid"),
        "trail_post_t1": back * F.col("_after"), "active_stop": back * active, "unrealized_r": F.col("_r"), "flow_decay_factor": keep,
    }).drop("_s", "_best", "_r", "_tight", "_mult", "_atr", "_hybrid", "_after")


def position_health(df: DataFrame) -> DataFrame:
    """df with the health parts, health (0 to 10) and health_state.

    Beside the columns of trailing_stops a row has active_stop, trend, strength, ema20_slope, target_2,
    rising (three highs in a row, or for shorts lows falling), premium_share (bullish), tick_share, print_share (null
    where missing), wall_pct, and options_known."""
    s = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    long_, atr, slope = F.col("direction") == "LONG", F.col("atr14"), s * F.coalesce("ema20_slope", F.lit(0.0))
    trend = F.when(F.col("trend") == F.col("direction"), 2.0 + F.least("strength", F.lit(1.0))).when((F.col("trend") == "NEUTRAL") & (slope > 0), 1.5).when(F.col("trend") == "NEUTRAL", 0.5).otherwise(0.0)
    gap = F.when(atr > 0, s * (F.col("close") - F.col("active_stop")) / atr)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    structure = flag(s * F.col("close") > s * F.col("initial_stop")) + flag(gap > 0.5)
    momentum = flag(slope > 0) + flag(F.col("rising"))
    way, done = s * (F.col("target_2") - F.col("entry_price")), s * (F.col("close") - F.col("entry_price"))
    target = F.when(way <= 0, 0.5).otherwise(half_up(clamp(done / way, 0, 1), 3))
    mine = lambda c: F.when(long_, F.col(c)).otherwise(1.0 - F.col(c))
    agreed = F.coalesce(mine("premium_share"), F.lit(0.5))
    agreed = F.when(F.col("tick_share").isNotNull(), 0.6 * agreed + 0.4 * mine("tick_share")).otherwise(agreed)
    agreed = F.when(F.col("print_share").isNotNull(), 0.8 * agreed + 0.2 * mine("print_share")).otherwise(agreed)
    wall = F.coalesce(clamp((F.col("wall_pct") - 1.0) / 4.0, 0, 1), F.lit(0.5))
    wall = F.when(F.col("wall_pct").isNull(), 0.5).otherwise(wall)
    good = F.when(long_, "POSITIVE").otherwise("NEGATIVE")
    gamma = F.when(F.col("gamma_regime") == good, 1.0).when(F.col("gamma_regime").isin("POSITIVE", "NEGATIVE"), 0.0).otherwise(0.5)
    options = F.when(F.col("options_known"), half_up(agreed + (wall + gamma) / 2.0, 3)).otherwise(1.0)
    r, days = done / F.col("risk_per_share"), F.col("days_held")
    stale = F.when(F.col("risk_per_share") > 0, flag((days > 3) & (r < 0.5)) + flag((days > 5) & (r < 1.0))).otherwise(0.0)
    df = df.withColumns({
        "h_trend": trend, "h_structure": structure, "h_momentum": momentum, "h_target": target, "h_options": options, "h_decay": stale, "h_stop": 2.0 * flag(gap < 0.5),
        **{f"h_{k}": v for k, v in flow_penalties().items()},
    })
    plus, minus = ("h_trend", "h_structure", "h_momentum", "h_target", "h_options"), ("h_decay", "h_stop")
    flow = _sum([F.col(f"h_{k}") for k in flow_penalties()])
    health = clamp(_sum([F.col(c) for c in plus]) - F.col(minus[0]) - F.col(minus[1]) - flow, 0, 10)
    level = half_up(health, 6)  # a sum that ends on a limit up to rounding has reached it
    return df.withColumns({"health": half_up(health, 2), "health_state": F.when(level >= 7, "STRONG").when(level >= 4, "NEUTRAL").when(level >= 2, "WEAK").otherwise("FAILING")})


# ---- regimes -----------------------------------------------------------------------------------

# Volatility tiers (name, from, factor), event windows in days.
VOLATILITY = (("calm", 0.0, 1.0), ("elevated", 18.0, 0.75), ("panic", 24.0, 0.5), ("halt", 35.0, 0.25))
TIERS = ("calm", "elevated", "panic", "halt")
EVENTS, EVENT_WINDOW = ("fomc", "cpi", "nfp"), 1


def market_regime(df: DataFrame) -> DataFrame:
    """df, the benchmark's features with vix and tide per day, with its four parts, regime_score, market_trend and
    vix_sizing. A missing vix or tide counts one half."""
    c, e20, e50, slope = F.col("close"), F.col("ema20"), F.col("ema50"), F.coalesce("ema20_slope", F.lit(0.0))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    parts = {
        "alignment": half_up((flag(c > e20) + flag(e20 > e50) + clamp((slope + 2.0) / 4.0, 0, 1)) / 3.0, 4),
        "vix_part": F.when(F.col("vix").isNull(), 0.5).otherwise(half_up(clamp((35.0 - F.col("vix")) / 23.0, 0, 1), 4)),
        "calm_part": F.when(c <= 0, 0.5).otherwise(half_up(clamp((0.025 - F.col("atr14") / c) / 0.02, 0, 1), 4)), "tide_part": F.coalesce("tide", F.lit(0.5)),
    }
    return df.withColumns(parts).withColumns({
        "regime_score": half_up(_sum([F.col(k) for k in parts]) / 4.0, 4), "market_trend": F.when((c > e20) & (e20 > e50), "BULLISH").when((c < e20) & (e20 < e50), "BEARISH").otherwise("NEUTRAL"),
        "vix_sizing": F.when(F.col("vix") >= 30, 0.5).when(F.col("vix") >= 20, 0.75).otherwise(1.0),
    })


def risk_regime(df: DataFrame) -> DataFrame:
    """df with risk_tier, multiplier, risk_score, halt_reason and warnings (names of the checks that warn) from vix,
    vix3m, rsi, market_trend, heat_pct, same_sector, same_direction and days to the next event of each kind
    (fomc_days, cpi_days, nfp_days; null if none is near). Missing inputs pass their check."""
    vix = F.col("vix")
    base = F.when(vix.isNull() | (vix < 18), 1.0).when(vix < 24, 0.75).when(vix < 35, 0.5).otherwise(0.25)
    rank = F.when(vix.isNull() | (vix < 18), 0).when(vix < 24, 1).when(vix < 35, 2).otherwise(3)
    warn = {
        "term": (vix > 0) & (F.col("vix3m") > 0) & (F.col("vix3m") / vix < 1.0), "trend": F.upper("market_trend") == "BEARISH", "rsi": (F.col("rsi") >= 70) | (F.col("rsi") <= 30),
        "heat": F.col("heat_pct") >= 3, "sector": F.col("same_sector") >= 3, "direction": F.col("same_direction") >= 6,
    }
    warn = {k: F.coalesce(v, F.lit(False)) for k, v in warn.items()}
    near = lambda e: F.coalesce(F.col(f"{e}_days").between(0, EVENT_WINDOW), F.lit(False))
    soon = lambda e: F.coalesce(F.col(f"{e}_days").between(0, EVENT_WINDOW + 2), F.lit(False))
    text = lambda e: F.concat(F.lit(e.upper()), F.when(F.col(f"{e}_days") == 0, " today").otherwise(" tomorrow"))
    halt = reduce(lambda w, e: w.when(near(e), text(e)), EVENTS[1:], F.when(near(EVENTS[0]), text(EVENTS[0])))
    frozen = F.coalesce(F.col("heat_pct") >= 5, F.lit(False))
    m = base
    for k, f in (("term", 0.85), ("trend", 0.9), ("rsi", 0.9), ("heat", 0.5), ("sector", 0.75), ("direction", 0.75)):
        m = m * F.when(warn[k], f).otherwise(1.0)
    stopped = frozen | halt.isNotNull()
    m = F.when(stopped, 0.0).otherwise(F.least(m, base))
    bumped = F.greatest(rank, F.when(warn["term"] | warn["heat"], 1).otherwise(0))
    worst = F.when(stopped | (m <= 0), 3).when(bumped == 3, 3).when(m < 0.4, F.greatest(bumped, F.lit(2))).when(m < 0.7, F.greatest(bumped, F.lit(1))).otherwise(bumped)
    tier = F.element_at(F.array(*map(F.lit, TIERS)), worst + 1)
    every = reduce(lambda a, b: a | b, [soon(e) for e in EVENTS])
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in warn.items()], F.when(every, F.lit("event"))))
    return df.withColumns({"risk_tier": tier, "multiplier": half_up(m, 3), "risk_score": F.when(worst == 3, 0).otherwise(half_up(m * 100, 0).cast("int")), "halt_reason": halt, "warnings": names})


# ---- alignment bonuses -------------------------------------------------------------------------


def alignment_bonuses(df: DataFrame) -> DataFrame:
    """df with each bonus on final_score and aligned_score: the options premium of the own side, its volume against
    average, intraday premium and momentum, prints, near earnings (a penalty) and insider buying of 50,000 or more.
    Missing options data count one half; any other missing input adds nothing."""
    long_ = F.col("direction") == "LONG"
    mine = lambda c: F.when(long_, F.col(c)).otherwise(1.0 - F.col(c))
    total = F.col("bullish_premium") + F.col("bearish_premium")
    share = F.when(total > 0, F.when(long_, F.col("bullish_premium")).otherwise(F.col("bearish_premium")) / total).otherwise(0.5)
    over = F.when(long_, F.col("call_vs_avg")).otherwise(F.col("put_vs_avg"))
    volume = F.when(over.isNotNull(), F.least(over, F.lit(3.0)) / 3.0).otherwise(0.5)
    step = F.when(long_, F.col("momentum")).otherwise(-F.col("momentum"))
    insider = ((long_ & (F.col("insider") == "buying")) | (~long_ & (F.col("insider") == "selling"))) & (F.col("insider_buy_notional") >= 50_000)
    bonus = {
        "options_bonus": share * 0.06 + volume * 0.05, "ticks_bonus": F.coalesce(0.056 * mine("tick_share") + 0.13 * F.greatest(F.lit(0.0), F.coalesce(step, F.lit(0.0))), F.lit(0.0)),
        "prints_bonus": F.coalesce(0.05 * mine("print_share"), F.lit(0.0)), "earnings_penalty": F.when(F.col("days_to_earnings") <= 5, -0.5).otherwise(0.0), "insider_bonus": F.when(insider, 0.3).otherwise(0.0),
    }
    return df.withColumns(bonus).withColumn("aligned_score", F.col("final_score") + _sum([F.col(k) for k in bonus]))


def freight_train(df: DataFrame, heat: DataFrame, least_streak: int = 4, least_flow: float = 0.5, floor: float = 5.0) -> DataFrame:
    """df (ticker, direction, sector, n, mean_flow, flow_trend) with heat and freight_train: a long, strong, rising
    streak whose sector is hot on that side, or which is itself among the sector's top tickers."""
    h = heat.select("sector", "direction", F.col("sector_heat_score").alias("heat"), F.split("top_tickers", ",").alias("_tops"))
    j = df.join(h, ["sector", "direction"], "left")
    hot = (F.coalesce("heat", F.lit(0.0)) >= floor) | F.coalesce(F.array_contains("_tops", F.col("ticker")), F.lit(False))
    ok = (F.col("n") >= least_streak) & (F.col("mean_flow") >= least_flow) & (F.col("flow_trend") == "rising") & F.col("sector").isNotNull() & hot
    return j.withColumn("freight_train", F.coalesce(ok, F.lit(False))).drop("_tops")


def latest_exposures(df: DataFrame, greeks: tuple[str, ...] = ("gamma", "vanna", "charm")) -> DataFrame:
    """The newest row of each ticker (event_ts, call_<greek>, put_<greek>, puts signed) as as_of and net_<greek>, call
    plus put; null only where both are."""
    net = lambda g: F.when(F.col(f"call_{g}").isNotNull() | F.col(f"put_{g}").isNotNull(), F.coalesce(f"call_{g}", F.lit(0.0)) + F.coalesce(f"put_{g}", F.lit(0.0)))
    last = df.groupBy("ticker").agg(F.max("event_ts").alias("as_of"), F.max_by(F.struct(*[net(g).alias(g) for g in greeks]), "event_ts").alias("_last"))
    return last.select("ticker", "as_of", *[F.col(f"_last.{g}").alias(f"net_{g}") for g in greeks])
