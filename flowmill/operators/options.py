"""Option-surface operators over chain tables keyed by ticker and strike, expiry or tenor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEUTRAL_GEX = 0.0
PIN_BAND = 0.05
PIN_SHARE = 0.25


def gamma_profile(strikes: DataFrame, spot: DataFrame, neutral: float = NEUTRAL_GEX) -> DataFrame:
    """Net gamma exposure, regime, dealer bias, the strike where cumulated gamma first changes sign, and the pin
    strike: the largest gamma within PIN_BAND of spot where it holds PIN_SHARE of the band's.

    strikes: ticker, strike, net_gamma (one row per strike); spot: ticker, spot."""
    w = Window.partitionBy("ticker").orderBy("strike")
    s = strikes.join(spot, "ticker").withColumn("_cum", F.sum("net_gamma").over(w)).withColumn("_before", F.lag("_cum").over(w))
    turn = ((F.col("_before") > 0) & (F.col("_cum") <= 0)) | ((F.col("_before") < 0) & (F.col("_cum") >= 0))
    near = F.col("strike").between(F.col("spot") * (1 - PIN_BAND), F.col("spot") * (1 + PIN_BAND))
    size = F.abs(F.col("net_gamma"))
    a = s.groupBy("ticker").agg(
        F.sum("net_gamma").alias("net_gex"), F.min(F.when(turn, F.col("strike"))).alias("gamma_flip"), F.max("spot").alias("spot"),
        F.max(F.when(near, F.struct(size.alias("g"), (-F.col("strike")).alias("k")))).alias("_top"), F.sum(F.when(near, size)).alias("_band"),
    )
    regime = F.when(F.abs("net_gex") <= neutral, "NEUTRAL").when(F.col("net_gex") > 0, "POSITIVE").otherwise("NEGATIVE")
    share = F.try_divide(F.col("_top.g"), F.nullif("_band", F.lit(0.0)))
    pin = F.when(share >= PIN_SHARE, -F.col("_top.k"))
    return a.select(
        "ticker", F.round("net_gex", 2).alias("net_gex"), regime.alias("gamma_regime"), "gamma_flip",
        F.when(regime == "POSITIVE", "suppress").when(regime == "NEGATIVE", "chase").otherwise("neutral").alias("dealer_bias"),
        pin.alias("pin_strike"), F.round((pin - F.col("spot")) / F.col("spot") * 100, 2).alias("pin_distance_pct"), F.when(share >= PIN_SHARE, F.round(share, 3)).alias("pin_concentration"),
    )


def oi_walls(strikes: DataFrame, spot: DataFrame) -> DataFrame:
    """The strikes above and below spot with most call and put open interest, their distances, put/call ratio."""
    s = strikes.join(spot, "ticker")
    top = lambda side, cond: F.max(F.when(cond, F.struct(F.col(f"{side}_oi").alias("oi"), (-F.col("strike")).alias("k"))))
    a = s.groupBy("ticker").agg(top("call", F.col("strike") >= F.col("spot")).alias("_c"), top("put", F.col("strike") <= F.col("spot")).alias("_p"), F.sum("call_oi").alias("ticker_call_oi"), F.sum("put_oi").alias("ticker_put_oi"), F.max("spot").alias("spot"))
    c, p = -F.col("_c.k"), -F.col("_p.k")
    return a.select(
        "ticker", c.alias("call_wall"), p.alias("put_wall"), F.round((c - F.col("spot")) / F.col("spot") * 100, 2).alias("call_wall_pct"), F.round((F.col("spot") - p) / F.col("spot") * 100, 2).alias("put_wall_pct"),
        "ticker_call_oi", "ticker_put_oi", F.when(F.col("ticker_call_oi") > 0, F.round(F.try_divide(F.col("ticker_put_oi").cast("double"), F.col("ticker_call_oi")), 3)).alias("put_call_ratio"),
    )


def oi_by_term(expiries: DataFrame, as_of) -> DataFrame:
    """Open interest of expiries within 30 and 90 days of as_of and beyond; past ones do not count."""
    days = F.datediff(F.col("expires"), as_of)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("oi"))), F.lit(0))
    return expiries.groupBy("ticker").agg(part(days.between(0, 30)).alias("near_term_oi"), part(days.between(31, 90)).alias("swing_dte_oi"), part(days > 90).alias("long_dated_oi"))


def expiry_concentration(expiries: DataFrame) -> DataFrame:
    """The expiry with most open interest and its share."""
    a = expiries.groupBy("ticker").agg(F.sum("oi").alias("_all"), F.max(F.struct("oi", (-F.unix_date("expires")).alias("e"))).alias("_top"))
    return a.select("ticker", F.date_from_unix_date((-F.col("_top.e")).cast("int")).alias("top_expiry"), F.round(F.try_divide(F.col("_top.oi").cast("double"), F.col("_all")), 6).alias("top_share"))


def tenor(tenors: DataFrame, target: int) -> DataFrame:
    """The row whose days are nearest to target, the shorter on ties."""
    return tenors.groupBy("ticker").agg(F.min_by(F.struct("days", "percentile", "volatility"), F.struct(F.abs(F.col("days") - target), F.col("days"))).alias("t")).select("ticker", "t.*")


def rank_tenor(tenors: DataFrame, target: int = 30) -> DataFrame:
    """The row of exactly `target` days, or else the first one."""
    return tenors.groupBy("ticker").agg(F.min_by(F.struct("days", "percentile", "volatility"), F.struct(F.col("days") != target, F.col("days"))).alias("t")).select("ticker", "t.*")


def chains_by_ticker(contracts: DataFrame, n: int = 5) -> DataFrame:
    """Premium sums, call share, dominant side and the n largest contracts per ticker. The rank is cut per task
    before rows meet."""
    sums = contracts.groupBy("ticker").agg(
        F.count("*").alias("contract_count"), F.round(F.sum("premium"), 2).alias("total_premium"), F.round(F.coalesce(F.sum(F.when(F.col("option_type") == "CALL", F.col("premium"))), F.lit(0.0)), 2).alias("call_premium"),
        F.round(F.coalesce(F.sum(F.when(F.col("option_type") == "PUT", F.col("premium"))), F.lit(0.0)), 2).alias("put_premium"),
    )
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("premium"), "contract_id"))
    top = contracts.withColumn("_r", rank).filter(F.col("_r") <= n).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "contract_id"))), lambda x: x["contract_id"]).alias("top_contracts"))
    total = F.col("call_premium") + F.col("put_premium")
    side = F.when(total > 0, F.when(F.col("call_premium") > F.col("put_premium"), "Calls").otherwise("Puts")).otherwise("-")
    return sums.join(top, "ticker").withColumn("dominant_side", side).withColumn("call_pct", F.when(total > 0, F.round(F.try_divide(F.col("call_premium"), total) * 100, 1)).otherwise(50.0))
