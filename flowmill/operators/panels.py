"""Panels across tickers: sector heat, insiders, sentiment, persistence, trajectories, rejections, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import growth_label

LEAST_NAMES, TOP_K, ELEVATED = 3, 5, 0.5


def sector_heat(features: DataFrame) -> DataFrame:
    """Per sector and side: 0.6 of the top five's mean score and 0.4 of the share above ELEVATED, times ten.
    features: ticker, sector, bullish_score, bearish_score, bullish_premium, bearish_premium."""
    sides = F.array(*[F.struct(F.lit(way).alias("direction"), F.coalesce(f"{s}_score", F.lit(0.0)).alias("score"), F.coalesce(f"{s}_premium", F.lit(0.0)).alias("premium")) for s, way in (("bullish", "LONG"), ("bearish", "SHORT"))])
    rows = features.filter("sector is not null").select("ticker", "sector", F.inline(sides))
    rank = F.row_number().over(Window.partitionBy("sector", "direction").orderBy(F.desc("score"), "ticker"))
    top = rows.withColumn("_r", rank).filter(F.col("_r") <= TOP_K).groupBy("sector", "direction").agg(F.avg("score").alias("_top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "ticker"))), lambda x: x["ticker"]), ",").alias("top_tickers"))
    a = rows.groupBy("sector", "direction").agg(F.count("*").alias("n_tickers"), F.count_if(F.col("score") >= ELEVATED).alias("n_above"), F.max("score").alias("max_score"), F.sum("premium").alias("premium")).filter(F.col("n_tickers") >= LEAST_NAMES)
    share = F.col("n_above") / F.col("n_tickers")
    return a.join(top, ["sector", "direction"]).withColumn("sector_heat_score", 0.6 * F.col("_top") * 10 + 0.4 * share * 10).withColumnRenamed("_top", "mean_score_topk").withColumn("share_above", share)


def insiders(tx: DataFrame, since: Column, strict: bool = True) -> DataFrame:
    """Buys, sells, notional and net direction per ticker. strict matches whole words; else any type that holds an
    A is a buy and then any that holds a D a sell."""
    t = F.upper(F.trim("transaction_type"))
    buy = t.isin("BUY", "PURCHASE", "A", "P", "ACQUISITION") if strict else t.rlike("BUY|PURCHASE|A|ACQUISITION") | (t == "P")
    sell = ~buy & (t.isin("SELL", "SALE", "D", "S", "DISPOSITION") if strict else t.rlike("SELL|SALE|D|DISPOSITION") | (t == "S"))
    d = tx.filter(F.col("filing_date") >= since).withColumn("_b", buy).withColumn("_s", sell).filter("_b or _s")
    money = lambda c: F.round(F.coalesce(F.sum(F.when(F.col(c), F.abs("value"))), F.lit(0.0)), 2)
    a = d.groupBy("ticker").agg(F.count_if("_b").alias("buy_count"), F.count_if("_s").alias("sell_count"), money("_b").alias("buy_notional"), money("_s").alias("sell_notional"), F.max("filing_date").alias("last_date"))
    way = F.when(F.col("buy_count") > F.col("sell_count"), "buying").when(F.col("sell_count") > F.col("buy_count"), "selling").otherwise("mixed")
    return a.withColumn("net_notional", F.round(F.col("buy_notional") - F.col("sell_notional"), 2)).withColumn("net_direction", way)


def sentiment_trend(daily: DataFrame) -> DataFrame:
    """First against latest mentions, blended sentiment, and a spike where the latest exceed twice the mean."""
    at = lambda c, f: f(c, "snapshot_date")
    a = daily.groupBy("ticker").agg(
        at("st_messages", F.min_by).alias("_s0"), at("st_messages", F.max_by).alias("st_messages"), at("rd_mentions", F.min_by).alias("_r0"), at("rd_mentions", F.max_by).alias("rd_mentions"),
        at("st_sentiment", F.max_by).alias("_st"), at("rd_sentiment", F.max_by).alias("_rd"), F.avg(F.col("st_messages") + F.col("rd_mentions")).alias("_mean"),
    )
    rd = F.when(F.col("_rd") == "bullish", 0.8).when(F.col("_rd") == "bearish", 0.2).otherwise(0.5)
    both = F.round(F.col("_st") * 0.4 + rd * 0.6, 3)
    label = F.when(both >= 0.65, "bullish").when(both <= 0.35, "bearish").otherwise("neutral")
    return a.select("ticker", "st_messages", "rd_mentions", growth_label(F.col("_s0"), F.col("st_messages")).alias("st_mention_trend"), growth_label(F.col("_r0"), F.col("rd_mentions")).alias("rd_mention_trend"),
                    both.alias("combined_sentiment"), label.alias("combined_label"), ((F.col("_mean") > 0) & (F.col("st_messages") + F.col("rd_mentions") > 2 * F.col("_mean"))).alias("mention_spike"))


def persistence(events: DataFrame, lookback: int, least: float, bonus: float = 0.5) -> DataFrame:
    """Distinct active days per ticker and direction over lookback, at most 1, and the bonus it earns."""
    a = events.filter((F.col("premium") >= least) & F.col("direction").isNotNull()).groupBy("ticker", "direction").agg(F.count_distinct("event_date").alias("days"))
    return a.withColumn("persistence", F.least(F.col("days") / F.greatest(F.lit(lookback), F.lit(1)), F.lit(1.0))).withColumn("bonus", bonus * F.col("persistence"))


def trajectory(scans: DataFrame) -> DataFrame:
    """First against last scan per ticker and direction: scans active, premium then and now, growth."""
    a = scans.groupBy("ticker", "direction").agg(F.count("*").alias("scans_active"), F.min_by("premium", "scan").alias("first_premium"), F.max_by("premium", "scan").alias("last_premium"))
    return a.withColumn("growth", F.try_divide(F.col("last_premium") - F.col("first_premium"), F.nullif("first_premium", F.lit(0.0))))


def latest_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key in the given order; the rank is cut before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def column_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank, zero and other values of each column in one pass; suspicious where nothing but blanks and zeros."""
    one = df.agg(F.count("*").alias("_n"), *[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"b_{c}"), F.count_if(F.col(c) == 0).alias(f"z_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("blank"), F.col(f"z_{c}").alias("zero"), (F.col("_n") - F.col(f"b_{c}") - F.col(f"z_{c}")).alias("filled")) for c in columns])
    return one.select(F.inline(rows)).withColumn("suspicious", F.col("filled") == 0)


def rolling_days(daily: DataFrame, days: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Premium and count over the last k calendar days per ticker and direction."""
    day = F.unix_date("date")
    cols = {}
    for k in days:
        w = Window.partitionBy("ticker", "direction").orderBy(day).rangeBetween(-(k - 1), 0)
        cols |= {f"premium_{k}d": F.round(F.sum("premium").over(w), 2), f"count_{k}d": F.sum("trades").over(w)}
    return daily.withColumns(cols)


def rolling_flow(events: DataFrame, days: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """A row per (ticker, direction, date, window): premium, events, mean days to expiry weighted by premium, mean volume over open
    interest, call and put premium and their bias ((calls - puts) over both) of the last k calendar days with the date. Events of a
    day are summed before they meet a window. events: ticker, direction, date, premium, dte, option_type, volume_oi_ratio."""
    prem, ratio = F.coalesce("premium", F.lit(0.0)), F.col("volume_oi_ratio")
    kind = lambda k: F.sum(F.when(F.col("option_type") == k, prem).otherwise(0.0))
    dated = F.col("dte").isNotNull()
    day = events.groupBy("ticker", "direction", "date").agg(
        F.sum(prem).alias("p"), F.count("*").alias("n"), F.sum(F.when(dated, prem * F.col("dte")).otherwise(0.0)).alias("dp"), F.sum(F.when(dated, prem).otherwise(0.0)).alias("dw"), F.coalesce(F.sum(ratio), F.lit(0.0)).alias("v"), F.count(ratio).alias("vn"), kind("CALL").alias("c"), kind("PUT").alias("u"),
    )
    parts = []
    for k in days:
        w = Window.partitionBy("ticker", "direction").orderBy(F.unix_date("date")).rangeBetween(-(k - 1), 0)
        parts.append(F.struct(F.lit(f"{k}D").alias("window"), *[F.sum(c).over(w).alias(c) for c in ("p", "n", "dp", "dw", "v", "vn", "c", "u")]))
    long_ = day.select("ticker", "direction", "date", F.array(*parts).alias("_w")).select("ticker", "direction", "date", F.inline("_w"))
    over = lambda a, b: F.try_divide(F.col(a) if isinstance(a, str) else a, F.nullif(F.col(b) if isinstance(b, str) else b, F.lit(0)))
    return long_.select(
        "ticker", "direction", "date", "window", F.col("p").alias("total_premium"), F.col("n").alias("event_count"), over("dp", "dw").alias("avg_dte_weighted"), over("v", "vn").alias("avg_volume_oi_ratio"), F.col("c").alias("call_premium"), F.col("u").alias("put_premium"),
        over(F.col("c") - F.col("u"), F.col("c") + F.col("u")).alias("flow_bias"),
    )


def streak_trend(history: DataFrame, key: list[str], value: str, order: str, window: int = 5) -> DataFrame:
    """Slope of the last five values over their mean: rising, flat or falling; n/a below three values."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    last = history.withColumn("_r", r).filter(F.col("_r") <= window)
    a = last.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean_flow"), F.regr_slope(F.col(value), -F.col("_r").cast("double")).alias("slope"))
    norm = F.col("slope") / F.greatest(F.abs("mean_flow"), F.lit(1e-6))
    return a.withColumn("flow_trend", F.when(F.col("n") < 3, "n/a").when(norm > 0.05, "rising").when(norm < -0.05, "falling").otherwise("flat"))


def nearest_in_time(rows: DataFrame) -> DataFrame:
    """Rows that ask (ticker, at, tracking_id, asks) with `nearest`: the id of the row of their ticker that does not ask
    and is nearest in time, the least id on ties; null where there is none. Running extremes over time, peers
    included, so no pairs are formed."""
    first, last = Window.unboundedPreceding, Window.currentRow
    at = F.when(~F.col("asks"), F.col("at"))
    rows = rows.withColumn("_before", F.max(F.struct(at.alias("at"), F.when(~F.col("asks"), -F.col("tracking_id")).alias("id"))).over(Window.partitionBy("ticker").orderBy("at").rangeBetween(first, last)))
    late = F.when(~F.col("asks"), F.struct(F.col("at"), F.col("tracking_id").alias("id")))
    rows = rows.withColumn("_after", F.min(late).over(Window.partitionBy("ticker").orderBy(F.desc("at")).rangeBetween(first, last)))
    gap = lambda c, sign: F.when(F.col(f"{c}.at").isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("gap"), (sign * F.col(f"{c}.id")).alias("id")))
    return rows.filter("asks").withColumn("nearest", F.array_min(F.array_compact(F.array(gap("_before", -1), gap("_after", 1))))["id"]).drop("_before", "_after")


def outcome_stamped(history: DataFrame, promoted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(ticker, direction, outcome) of history rows: promoted, rejected:<reason> or not_evaluated. The sides may be
    named LONG / SHORT or BULLISH / BEARISH on either table."""
    d = F.col("direction")
    side = F.when(d.isin("LONG", "BULLISH"), "BULLISH").when(d.isin("SHORT", "BEARISH"), "BEARISH").otherwise(d)
    k = ["ticker", "_side"]
    p = promoted.select("ticker", side.alias("_side"), F.lit(True).alias("_p")).distinct()
    j = rejected.select("ticker", side.alias("_side"), F.col("reject_reason")).groupBy(*k).agg(F.min("reject_reason").alias("_why"))
    stamped = F.when(F.col("_p"), "promoted").otherwise(F.coalesce(F.concat(F.lit("rejected:"), "_why"), F.lit("not_evaluated")))
    return history.withColumn("_side", side).join(p, k, "left").join(j, k, "left").select("ticker", "direction", stamped.alias("outcome"))
