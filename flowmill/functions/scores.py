"""Piecewise scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known reject reasons (fixed values).
REASONS = ("price_validation_failed", "price_over_extended", "poor_rr", "trend_not_aligned", "weak_bullish_flow", "weak_bearish_flow", "weak_relative_strength", "watchlist_reeval_failed", "no_options_context")


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def iv_rank_score(r: Column) -> Column:
    """0 to 2.5, best between 15 and 45."""
    return (
        F.when(r.isNull() | (r <= 5), 0.0).when(r <= 15, (r - 5) / 10).when(r <= 45, 1 + (r - 15) / 30 * 1.5).when(r <= 60, 2.5 - (r - 45) / 15)
        .when(r <= 75, 1.5 - (r - 60) / 15).when(r <= 100, 0.5 - (r - 75) / 25 * 0.5).otherwise(0.0)
    )


def options_score(long_: Column, regime: Column, wall_pct: Column, near_oi: Column, swing_oi: Column, pcr: Column, aligned: Column, iv_rank: Column) -> Column:
    """0-10 from gamma regime, distance to the wall ahead, term structure, put/call ratio, premium share of the
    direction and IV rank."""
    gamma = F.when(regime == "NEGATIVE", 2.5).when(regime == "NEUTRAL", 1.25).otherwise(0.0)
    wall = F.when(wall_pct > 5, 2.5).when(wall_pct > 2, 1.25).otherwise(0.0)
    term = F.when((swing_oi > near_oi) & (near_oi > 0), 0.75).otherwise(0.0)
    ratio = F.when(long_, F.when(pcr < 0.7, 0.75).when(pcr < 1.0, 0.375).otherwise(0.0)).otherwise(F.when(pcr > 1.3, 0.75).when(pcr > 1.0, 0.375).otherwise(0.0))
    return F.least(F.lit(10.0), gamma + wall + term + ratio + F.coalesce(F.least(F.lit(1.0), aligned * 1.5), F.lit(0.0)) + iv_rank_score(iv_rank))


def combined(flow: Column, price: Column, options: Column) -> Column:
    """50/30/20 of the layers, 60/40 where options are missing."""
    return F.when(options.isNotNull(), 0.5 * flow + 0.3 * price + 0.2 * options).otherwise(0.6 * flow + 0.4 * price)


def reject_reason(raw: Column) -> Column:
    """The reason without trailing parentheses; none where blank, other where unknown."""
    s = F.trim(F.regexp_replace(F.trim(raw), r"\s*\(.*\)$", ""))
    return F.when(raw.isNull() | F.lower(F.trim(raw)).isin("", "none", "nan"), "none").when(s.isin(*REASONS), s).otherwise("other")


def growth_label(first: Column, latest: Column) -> Column:
    ratio = F.try_divide(latest, first)
    return F.when((first == 0) & (latest > 0), "new").when(first == 0, "stable").when(ratio > 1.5, "growing").when(ratio < 0.5, "declining").otherwise("stable")


def premium_label(bps: Column) -> Column:
    """Bands of premium over market cap in basis points."""
    return F.when(bps.isNull(), "none").when(bps > 5, "Outsized").when(bps >= 1, "Notable").when(bps >= 0.1, "Normal").otherwise("Minor")


def vehicle(direction: Column, iv_rank: Column, days_to_earnings: Column, adv: Column) -> Column:
    """Stock where options are illiquid, volatility is middling or unknown; a debit spread where it is high or an
    event is near; else a long option."""
    iv, near = F.coalesce(iv_rank, F.lit(-1.0)), F.coalesce(days_to_earnings, F.lit(999)) <= 5
    option = F.when(direction == "LONG", "LONG_CALL").otherwise("LONG_PUT")
    known = direction.isin("LONG", "SHORT")
    return F.when(F.coalesce(adv < 20_000_000, F.lit(False)) | ~known, "STOCK").when((near & (iv >= 60)) | (iv >= 70), "DEBIT_SPREAD").when(iv.between(0, 29.999999), option).otherwise("STOCK")


def promote_reason(grade: Column, score: Column, direction: Column, close: Column, atr: Column, ema20: Column, least: float = 8.0) -> Column:
    """Why a graded row is not promoted; empty where it is."""
    return (
        F.when(~F.upper(F.coalesce(grade, F.lit(""))).isin("A", "A+"), F.concat(F.lit("grade_"), F.upper(F.coalesce(grade, F.lit(""))), F.lit("_not_promotable")))
        .when(F.coalesce(score, F.lit(0.0)) < least, "score_below_floor").when(close.isNull(), "no_ohlcv").when((atr <= 0) | (close <= 0), "atr_or_close_invalid")
        .when((ema20 > 0) & (direction == "BULLISH") & (close < ema20), "long_below_ema20_trend_failed").when((ema20 > 0) & (direction == "BEARISH") & (close > ema20), "short_above_ema20_trend_failed").otherwise("")
    )


# Fixed values of the streak bonus.
STREAK_DAYS, STREAK_STEP, STREAK_MOST, STREAK_FLOOR, STREAK_TREND = 3, 0.25, 1.0, 0.4, {"rising": 1.0, "flat": 0.5, "falling": 0.0}


def streak_bonus(days: Column, trend: Column, mean_flow: Column) -> Column:
    """What a watchlist streak adds to the final score: a step per day from the third on, weighed by the trend of its scores (half
    where that is unknown); nothing where the mean score is low."""
    base = F.least((F.coalesce(days, F.lit(0)) - STREAK_DAYS + 1) * STREAK_STEP, F.lit(STREAK_MOST))
    mult = F.coalesce(*[F.when(F.lower(trend) == k, F.lit(v)) for k, v in STREAK_TREND.items()], F.lit(0.5))
    earned = (F.coalesce(days, F.lit(0)) >= STREAK_DAYS) & (F.coalesce(mean_flow, F.lit(0.0)) >= STREAK_FLOOR)
    return F.when(earned, F.round(base * mult, 4)).otherwise(0.0)


def trajectory_bonus(scans_active: Column, acceleration: Column, breadth: Column, most: float = 0.3) -> Column:
    """What a day's trajectory adds to the final score: nothing for one scan, all of it from eight scans on that accelerate fully in
    every one; negative acceleration counts as none."""
    hours = F.least(scans_active / 8.0, F.lit(1.0))
    bonus = most * hours * (0.5 + 0.3 * F.greatest(F.lit(0.0), F.coalesce(acceleration, F.lit(0.0))) + 0.2 * F.coalesce(breadth, F.lit(0.0)))
    return F.when(scans_active > 1, bonus).otherwise(0.0)


def r_at_market(direction: Column, entry: Column, stop: Column, spot: Column) -> tuple[Column, Column]:
    """(multiples of the risk gained since entry, multiples left to the stop); null where the risk or a price is missing."""
    risk, sign = F.abs(entry - stop), F.when(F.upper(direction) == "LONG", 1.0).otherwise(-1.0)
    known = (entry > 0) & (spot > 0) & (stop != 0) & (risk > 0)
    return F.when(known, sign * (spot - entry) / risk), F.when(known, sign * (spot - stop) / risk)


def exposure_summary(positions):
    """One row over open positions (direction, entry_price, active_stop, shares, health_state): long, short, gross and net notional,
    net in percent of gross, heat (risk to the stops in percent of notional, 99.9 at most) and positions by health."""
    entry, stop, shares = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("entry_price", "active_stop", "shares"))
    notional, live = entry * shares, (entry > 0) & (shares > 0)
    both = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    long_ = F.upper("direction") == "LONG"
    p = positions.agg(
        both(F.when(long_, notional)).alias("long_exposure"), both(F.when(~F.coalesce(long_, F.lit(False)), notional)).alias("short_exposure"), F.count("*").alias("positions"), both(F.when(live, notional)).alias("_n"),
        both(F.when(live & (stop > 0), F.abs(entry - stop) * shares)).alias("_r"), *[F.count_if(F.col("health_state") == h).alias(f"health_{h.lower()}") for h in HEALTH],
    )
    gross, net = F.col("long_exposure") + F.col("short_exposure"), F.col("long_exposure") - F.col("short_exposure")
    return p.withColumns({"gross_exposure": gross, "net_exposure": net, "net_pct": F.coalesce(F.try_divide(net, F.nullif(gross, F.lit(0.0))) * 100, F.lit(0.0)), "heat_pct": F.least(F.coalesce(F.try_divide("_r", F.nullif("_n", F.lit(0.0))) * 100, F.lit(0.0)), F.lit(99.9))}).drop("_n", "_r")


HEALTH = ("STRONG", "NEUTRAL", "WEAK", "FAILING")
