"""Aggregates of flow events by ticker and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow as X

SIDES = (("bullish", "LONG"), ("bearish", "SHORT"))
BASELINE_2H = 2.0 / 6.5
ACCEL_LEAST = 3


def _ratio(a: Column | str, b: Column | str, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.nullif(F.col(b) if isinstance(b, str) else b, F.lit(0))), F.lit(otherwise))


def with_repeat_count(df: DataFrame, by: str = "ticker") -> DataFrame:
    """The number of rows of the row's group."""
    X.require_columns(df, by)
    return df.withColumn("repeat_flow_count", F.count("*").over(Window.partitionBy(by)))


def aggregate_by_ticker(events: DataFrame) -> DataFrame:
    """One row per ticker (null tickers kept): directional sums, counts, breadth, imbalance, intensity over market
    cap, acceleration of the last two hours, sweep and multi-leg shares.

    events: ticker, premium, dte, direction, direction_confidence, is_sweep, is_multileg, volume_oi_ratio,
    marketcap, event_ts. The ticker's last print is found by an aggregate and joined, so a hot ticker is summed
    map-side in both passes instead of being windowed in one task."""
    last = events.groupBy("ticker").agg(F.max("event_ts").alias("_last")).withColumnRenamed("ticker", "_t")
    e = events.join(last, events["ticker"].eqNullSafe(last["_t"]), "left").drop("_t")
    conf = F.col("premium") * F.col("direction_confidence")
    recent = F.col("_last") - F.col("event_ts") <= F.expr("INTERVAL '2' HOUR")
    aggs = [F.sum("premium").alias("total_premium"), F.count("*").alias("total_count"), F.avg("dte").alias("avg_dte"), F.avg("volume_oi_ratio").alias("avg_volume_oi_ratio"), F.count_if("is_multileg").alias("multileg_count"), F.max("marketcap").alias("marketcap")]
    for side, way in SIDES:
        on = F.col("direction") == way
        aggs += [
            F.coalesce(F.sum(F.when(on, conf)), F.lit(0.0)).alias(f"{side}_premium"), F.count_if(on).alias(f"{side}_count"), F.avg(F.when(on, F.col("volume_oi_ratio"))).alias(f"{side}_vol_oi"),
            F.count_if(on & F.col("is_sweep")).alias(f"{side}_sweep_count"), F.coalesce(F.sum(F.when(on & F.col("is_sweep"), conf)), F.lit(0.0)).alias(f"{side}_sweep_premium"),
            F.coalesce(F.max(F.when(on, conf)), F.lit(0.0)).alias(f"{side}_max_trade_premium"), F.count_if(on & recent).alias(f"{side}_repeat_2h"),
        ]
    a = e.groupBy("ticker").agg(*aggs)
    cap = X.mcap_or_null(F.col("marketcap"))
    cols: dict[str, Column] = {"net_premium_bias": F.col("bullish_premium") - F.col("bearish_premium")}
    cols["dominant_direction"] = F.when(cols["net_premium_bias"] > 0, "LONG").when(cols["net_premium_bias"] < 0, "SHORT").otherwise("NEUTRAL")
    cols["flow_imbalance_ratio"] = F.when(F.col("bearish_premium") > 0, F.least(F.try_divide("bullish_premium", "bearish_premium"), F.lit(99.0))).otherwise(F.when(F.col("bullish_premium") > 0, 99.0).otherwise(1.0))
    cols["dte_score"] = X.dte_score(F.col("avg_dte"))
    for side, _ in SIDES:
        prem, n = F.col(f"{side}_premium"), F.col(f"{side}_count")
        cols[f"{side}_premium_per_trade"] = _ratio(prem, n)
        cols[f"{side}_breadth"] = F.when(prem > 0, 1 - F.try_divide(F.col(f"{side}_max_trade_premium"), prem)).otherwise(0.0)
        cols[f"{side}_flow_intensity"] = F.coalesce(prem / cap, F.lit(0.0))
        cols[f"{side}_ppt_bps"] = F.coalesce(_ratio(prem, n) / cap * 10_000, F.lit(0.0))
        cols[f"{side}_accel_ratio"] = F.when(n >= ACCEL_LEAST, F.try_divide(F.col(f"{side}_repeat_2h"), n)).otherwise(0.0)
        cols[f"{side}_accel_score"] = F.greatest(F.lit(-0.5), F.least(F.lit(0.7), cols[f"{side}_accel_ratio"] - BASELINE_2H))
        cols[f"{side}_repeat_count"] = n
    short = cols["dominant_direction"] == "SHORT"
    cols["sweep_share"] = F.when(short, _ratio("bearish_sweep_count", "bearish_count")).otherwise(_ratio("bullish_sweep_count", "bullish_count"))
    cols["multileg_share"] = _ratio("multileg_count", "total_count")
    return a.withColumns(cols)


def weighted_by_key(events: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Per key and side: premium decayed to `now` beside the raw one (both times the direction's confidence), intensity of the raw
    premium over market cap, decayed premium times the delta's magnitude with its intensity, the premium-weighted mean magnitude,
    and the share of the side's decayed premium whose delta came from a vendor.

    events: keys, premium, event_ts, direction, direction_confidence, marketcap, delta_magnitude, delta_source (see
    functions.flow.delta_choice). One aggregate with partial sums; unknown premiums and deltas count as 0."""
    raw, mag = F.coalesce("premium", F.lit(0.0)), F.coalesce("delta_magnitude", F.lit(0.0))
    e = events.withColumn("_p", raw * F.coalesce(X.recency_weight(now), F.lit(1.0)))
    conf = F.coalesce("direction_confidence", F.lit(0.0))
    aggs = [F.max("marketcap").alias("marketcap")]
    for side, way in SIDES:
        on = lambda x, way=way: F.coalesce(F.sum(F.when(F.col("direction") == way, x)), F.lit(0.0))
        aggs += [
            on(F.col("_p") * conf).alias(f"{side}_premium"), on(raw * conf).alias(f"{side}_premium_raw"), on(F.col("_p") * mag * conf).alias(f"{side}_delta_premium"), on(F.col("_p") * mag).alias(f"_{side}_num"),
            on(F.col("_p")).alias(f"_{side}_den"), on(F.when(F.col("delta_source") == "vendor", F.col("_p")).otherwise(0.0)).alias(f"_{side}_vendor"),
        ]
    a, cap = e.groupBy(*keys).agg(*aggs), X.mcap_or_null(F.col("marketcap"))
    cols: dict[str, Column] = {}
    for side, _ in SIDES:
        cols[f"{side}_flow_intensity"] = F.coalesce(F.col(f"{side}_premium_raw") / cap, F.lit(0.0))
        cols[f"{side}_delta_intensity"] = F.coalesce(F.col(f"{side}_delta_premium") / cap, F.lit(0.0))
        cols[f"{side}_avg_delta"] = _ratio(f"_{side}_num", f"_{side}_den")
        cols[f"{side}_delta_source_mix"] = _ratio(f"_{side}_vendor", f"_{side}_den")
    return a.withColumns(cols).drop(*[f"_{s}_{k}" for s, _ in SIDES for k in ("num", "den", "vendor")])


def with_scores(agg: DataFrame) -> DataFrame:
    """Seven weighted components per side, their 0-10 contributions, and the sum."""
    cols: dict[str, Column] = {}
    for side, _ in SIDES:
        units = X.unit_scores(side)
        cols[f"{side}_score"] = X.weighted_score(units)
        cols |= {f"{side}_{k}_contrib": X.FLOW_WEIGHTS[k] * u * 10 for k, u in units.items()}
    return agg.withColumns(cols)


def dominant_bucket(events: DataFrame) -> DataFrame:
    """Per ticker the tracker bucket with the most premium, the first label on ties."""
    by = events.withColumn("bucket", X.bucket(F.col("dte"))).filter("bucket is not null").groupBy("ticker", "bucket").agg(F.round(F.sum("premium"), 4).alias("premium"))
    best = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("premium"), "bucket"))
    return by.withColumn("_r", best).filter("_r = 1").select("ticker", F.col("bucket").alias("dominant_dte_bucket"), "premium")


def premium_by_bucket(events: DataFrame, table: tuple = X.PREMIUM_BUCKETS) -> DataFrame:
    """Premium per ticker, bucket and side as columns, zero where there is none."""
    X.require_columns(events, "ticker", "premium", "dte", "direction")
    sums = [F.coalesce(F.sum(F.when(F.col("dte").between(lo, hi) & (F.col("direction") == way), F.col("premium"))), F.lit(0.0)).alias(f"{label}_{side}_premium") for label, lo, hi in table for side, way in SIDES]
    return events.groupBy("ticker").agg(*sums)


def unusual_share(flagged: DataFrame, tape: DataFrame) -> DataFrame:
    """Flagged directional premium over the whole tape's call or put premium."""
    sums = [F.coalesce(F.sum(F.when(F.col("direction") == way, F.col("premium") * F.col("direction_confidence"))), F.lit(0.0)).alias(side) for side, way in SIDES]
    all_ = tape.groupBy("ticker").agg(F.sum(F.when(F.col("option_type") == "CALL", F.col("premium"))).alias("call"), F.sum(F.when(F.col("option_type") == "PUT", F.col("premium"))).alias("put"))
    return flagged.groupBy("ticker").agg(*sums).join(all_, "ticker", "left").select(
        "ticker", F.try_divide(F.col("bullish"), F.when(F.col("call") > 0, F.col("call"))).alias("bullish_unusual_premium_share"),
        F.try_divide(F.col("bearish"), F.when(F.col("put") > 0, F.col("put"))).alias("bearish_unusual_premium_share"),
    )


def rank_candidates(agg: DataFrame, n: int = 10) -> DataFrame:
    """The n best bullish and bearish tickers, with side and rank."""
    out = None
    for side, _ in SIDES:
        order = [F.desc_nulls_last(f"{side}_{c}") for c in ("score", "premium", "vol_oi", "sweep_premium")]
        top = agg.filter(F.col(f"{side}_premium") > 0).orderBy(*order, "ticker").limit(n)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order, "ticker"))).select("ticker", F.lit(side).alias("side"), "rank", F.col(f"{side}_score").alias("score"), F.col(f"{side}_premium").alias("premium"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def history_baselines(days: DataFrame, floor: float = 1e8) -> DataFrame:
    """Per ticker and date, both sides: premium over market cap, volume over open interest, flagged premium over the
    tape's. days: ticker, date, feed (of rows that share a ticker and a date the greatest counts), marketcap,
    bullish_/bearish_premium and call_/put_ premium, volume and open_interest. Tickers are trimmed and upper-cased;
    those without a market cap of at least `floor` and rows without a date are left out; a ratio over nothing is null."""
    d = days.withColumn("ticker", F.upper(F.trim("ticker"))).filter((F.col("ticker") != "") & F.col("date").isNotNull() & (F.col("marketcap") >= floor))
    values = [c for c in days.columns if c not in ("ticker", "date", "feed")]
    last = d.groupBy("ticker", "date").agg(F.max_by(F.struct(*values), "feed").alias("d")).select("ticker", "date", "d.*")
    over = lambda a, b: F.try_divide(F.col(a).cast("double"), F.when(F.col(b) > 0, F.col(b)))
    out = []
    for side, kind in (("bullish", "call"), ("bearish", "put")):
        out += [(F.col(f"{side}_premium") / F.col("marketcap")).alias(f"{side}_flow_intensity"), over(f"{kind}_volume", f"{kind}_open_interest").alias(f"{side}_vol_oi"), over(f"{side}_premium", f"{kind}_premium").alias(f"{side}_unusual_premium_share")]
    return last.select("ticker", "date", *out)


def event_coverage(events: DataFrame, by: str) -> DataFrame:
    """Per group the share of events with a time, whether it reaches 0.8, and per side the premium-weighted share of
    deltas that the vendor gave (null without premium). events: event_ts, direction, premium, delta_source."""
    share = F.avg(F.col("event_ts").isNotNull().cast("double"))
    mix = []
    for side, way in SIDES:
        on = F.col("direction") == way
        given = F.sum(F.when(on & (F.col("delta_source") == "vendor"), F.col("premium")).when(on, 0.0))
        mix.append(F.try_divide(given, F.sum(F.when(on, F.col("premium")))).alias(f"{side}_vendor_mix"))
    return events.groupBy(by).agg(share.alias("coverage"), (share >= 0.8).alias("coverage_ok"), *mix)
