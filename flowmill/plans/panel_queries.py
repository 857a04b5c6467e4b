"""Queries on panels, joins, sets and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import flow as X
from ..functions import scores as C
from ..operators import panels as N
from ..sources.fixtures import FLOW_SQL, PRINTS_SQL, SNAPSHOTS_SQL, flow_events, prints, snapshots, table
from .flow_queries import AGG_SQL, BOTH_SQL, KEY, aggregated, flow, results
from ..operators.panels import nearest_in_time, outcome_stamped
from .registry import query
from .surface_queries import CHAIN_SQL, daily, spot, strikes
from .tracker_queries import TRACK_SQL, board



@query("prj15_screener_derivations", f"""WITH {SNAPSHOTS_SQL}, l AS (SELECT *, lag(call_volume + put_volume) OVER w AS before, avg(call_volume + put_volume) OVER (PARTITION BY ticker ORDER BY snapshot_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a3 FROM snapshots WINDOW w AS (PARTITION BY ticker ORDER BY snapshot_date))
SELECT ticker, snapshot_date, round((call_volume + put_volume - before) / nullif(CAST(before AS DOUBLE), 0) * 100, 4) + 0 AS volume_change_pct, round((call_volume + put_volume) / nullif(a3, 0) + 0.00000001, 4) AS volume_vs_3, round(total_bullish_premium - total_bearish_premium, 2) AS net_premium FROM l""")
def prj15(spark, d):
    w = Window.partitionBy("ticker").orderBy("snapshot_date")
    v = (F.col("call_volume") + F.col("put_volume")).cast("double")
    s = snapshots(spark, d).withColumn("v", v).withColumn("b", F.lag("v").over(w)).withColumn("a3", F.avg("v").over(w.rowsBetween(-3, -1)))
    return s.select("ticker", "snapshot_date", (F.round(F.try_divide(F.col("v") - F.col("b"), F.nullif("b", F.lit(0.0))) * 100, 4) + F.lit(0.0)).alias("volume_change_pct"), F.round(F.try_divide("v", F.nullif("a3", F.lit(0.0))) + 1e-8, 4).alias("volume_vs_3"), "net_premium")


IV_SQL = "CASE WHEN iv IS NULL OR iv <= 5 THEN 0 WHEN iv <= 15 THEN (iv - 5) / 10 WHEN iv <= 45 THEN 1 + (iv - 15) / 30 * 1.5::DOUBLE WHEN iv <= 60 THEN 2.5::DOUBLE - (iv - 45) / 15 WHEN iv <= 75 THEN 1.5::DOUBLE - (iv - 60) / 15 WHEN iv <= 100 THEN 0.5::DOUBLE - (iv - 75) / 25 * 0.5::DOUBLE ELSE 0 END"


@query("prj16_iv_rank_score", f"WITH {SNAPSHOTS_SQL}, v AS (SELECT ticker, snapshot_date, iv_rank AS iv FROM snapshots) SELECT ticker, snapshot_date, round({IV_SQL}, 6) AS iv_score FROM v")
def prj16(spark, d):
    return snapshots(spark, d).select("ticker", "snapshot_date", F.round(C.iv_rank_score(F.col("iv_rank")), 6).alias("iv_score"))


OPT_SQL = f""", ctx0 AS (SELECT ticker, CASE WHEN total_bullish_premium >= total_bearish_premium THEN 'LONG' ELSE 'SHORT' END AS direction, CASE CAST(trades AS INT) % 3 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS regime, snapshot_date,
  sweep_share * 10 AS wall, call_volume AS near_oi, put_volume AS swing_oi, put_call_ratio AS pcr, greatest(total_bullish_premium, total_bearish_premium) / nullif(total_bullish_premium + total_bearish_premium, 0) AS aligned, iv_rank AS iv FROM snapshots),
ctx AS (SELECT *, least(10, CASE regime WHEN 'NEGATIVE' THEN 2.5::DOUBLE WHEN 'NEUTRAL' THEN 1.25::DOUBLE ELSE 0 END + CASE WHEN wall > 5 THEN 2.5::DOUBLE WHEN wall > 2 THEN 1.25::DOUBLE ELSE 0 END + CASE WHEN swing_oi > near_oi AND near_oi > 0 THEN 0.75::DOUBLE ELSE 0 END
  + CASE direction WHEN 'LONG' THEN CASE WHEN pcr < 0.7 THEN 0.75::DOUBLE WHEN pcr < 1 THEN 0.375::DOUBLE ELSE 0 END ELSE CASE WHEN pcr > 1.3 THEN 0.75::DOUBLE WHEN pcr > 1 THEN 0.375::DOUBLE ELSE 0 END END + coalesce(least(1, aligned * 1.5::DOUBLE), 0) + {IV_SQL}) AS options_score FROM ctx0)"""


def _context(spark, d):
    b, s = F.col("total_bullish_premium"), F.col("total_bearish_premium")
    x = snapshots(spark, d).withColumn("direction", F.when(b >= s, "LONG").otherwise("SHORT"))
    k = F.col("trades") % 3
    regime = F.when(k == 0, "NEGATIVE").when(k == 1, "NEUTRAL").otherwise("POSITIVE")
    score = C.options_score(F.col("direction") == "LONG", regime, F.col("sweep_share") * 10, F.col("call_volume"), F.col("put_volume"), F.col("put_call_ratio"), F.try_divide(F.greatest(b, s), F.nullif(b + s, F.lit(0.0))), F.col("iv_rank"))
    return x.withColumn("options_score", score)


@query("prj17_options_score", f"WITH {SNAPSHOTS_SQL}{OPT_SQL} SELECT ticker, snapshot_date, direction, round(options_score, 6) AS options_score FROM ctx")
def prj17(spark, d):
    return _context(spark, d).select("ticker", "snapshot_date", "direction", F.round("options_score", 6).alias("options_score"))


@query("prj18_combined_score", f"WITH {SNAPSHOTS_SQL}{OPT_SQL}, o AS (SELECT *, CASE WHEN wall > 3 THEN options_score END AS o FROM ctx) SELECT ticker, snapshot_date, round(CASE WHEN o IS NOT NULL THEN 0.5::DOUBLE * least(wall, 10) + 0.3::DOUBLE * iv / 10 + 0.2::DOUBLE * o ELSE 0.6::DOUBLE * least(wall, 10) + 0.4::DOUBLE * iv / 10 END, 6) AS final_score FROM o")
def prj18(spark, d):
    c = _context(spark, d)
    wall = F.col("sweep_share") * 10
    return c.select("ticker", "snapshot_date", F.round(C.combined(F.least(wall, F.lit(10)), F.col("iv_rank") / 10, F.when(wall > 3, F.col("options_score"))), 6).alias("final_score"))


REJ_SQL = """rejected AS (SELECT event_id, 'U' || (user_id % 50) AS ticker, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, ts AS scan_ts, value AS flow_score_raw,
  CASE event_type WHEN 'view' THEN 'poor_rr (1.7:1)' WHEN 'click' THEN 'price_over_extended' WHEN 'signup' THEN ' trend_not_aligned ' WHEN 'error' THEN NULL ELSE 'something new' END AS reject_reason, CASE event_type WHEN 'view' THEN 'trend,volume' WHEN 'click' THEN 'volume' ELSE '' END AS checks_failed FROM events),
rej AS (SELECT *, CASE trim(reject_reason) WHEN 'poor_rr (1.7:1)' THEN 'poor_rr' WHEN 'price_over_extended' THEN 'price_over_extended' WHEN 'trend_not_aligned' THEN 'trend_not_aligned' WHEN 'something new' THEN 'other' ELSE 'none' END AS reason FROM rejected)"""


def rejected(spark, d):
    k = F.col("event_type")
    reason = F.when(k == "view", "poor_rr (1.7:1)").when(k == "click", "price_over_extended").when(k == "signup", " trend_not_aligned ").when(k == "error", None).otherwise("something new")
    failed = F.when(k == "view", "trend,volume").when(k == "click", "volume").otherwise("")
    r = table(spark, d, "events").select("event_id", F.concat(F.lit("U"), F.col("user_id") % 50).alias("ticker"), F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.col("ts").alias("scan_ts"), F.col("value").alias("flow_score_raw"), reason.alias("reject_reason"), failed.alias("checks_failed"))
    return r.withColumn("reason", C.reject_reason(F.col("reject_reason")))


@query("prj19_reject_reason", f"WITH {REJ_SQL} SELECT event_id, reason FROM rej")
def prj19(spark, d):
    return rejected(spark, d).select("event_id", "reason")


@query("prj25_premium_mix", f"""WITH {SNAPSHOTS_SQL}, m AS (SELECT ticker, snapshot_date, lottery_bullish_premium + lottery_bearish_premium AS lottery, swing_bullish_premium + swing_bearish_premium AS swing, leap_bullish_premium + leap_bearish_premium AS leap, total_bullish_premium + total_bearish_premium AS total FROM snapshots)
SELECT ticker, snapshot_date, round(lottery / nullif(total, 0), 6) AS lottery_share, round(swing / nullif(total, 0), 6) AS swing_share, round(leap / nullif(total, 0), 6) AS leap_share, CASE WHEN greatest(lottery, swing, leap) <= 0 THEN NULL WHEN swing >= lottery AND swing >= leap THEN 'swing' WHEN lottery >= leap THEN 'lottery' ELSE 'leap' END AS dominant FROM m""")
def prj25(spark, d):
    g = {b: F.col(f"{b}_bullish_premium") + F.col(f"{b}_bearish_premium") for b in ("lottery", "swing", "leap")}
    total = F.nullif(F.col("total_bullish_premium") + F.col("total_bearish_premium"), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(v.alias("g"), F.lit(b).alias("b")) for b, v in g.items()]))
    return snapshots(spark, d).select("ticker", "snapshot_date", *[F.round(F.try_divide(v, total), 6).alias(f"{b}_share") for b, v in g.items()], F.when(best["g"] > 0, best["b"]).alias("dominant"))


TIERS = ((0.0, 6.5, 0.0025), (6.5, 7.5, 0.005), (7.5, 8.5, 0.0075), (8.5, 99.0, 0.01))


@query("prj26_position_size", f"""WITH {BOTH_SQL}, t(lo, hi, pct) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in TIERS)})
SELECT ticker, direction, final_score, pct AS risk_pct, CAST(floor(100000 * pct / 2.5::DOUBLE) AS BIGINT) AS shares FROM results JOIN t ON final_score >= lo AND final_score < hi""")
def prj26(spark, d):
    """Risk share by score band: the tier table is four rows, a broadcast range join."""
    tiers = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(c).alias("pct")) for a, b, c in TIERS])))
    r = results(spark, d)
    j = r.join(F.broadcast(tiers), (r["final_score"] >= tiers["lo"]) & (r["final_score"] < tiers["hi"]))
    return j.select("ticker", "direction", "final_score", F.col("pct").alias("risk_pct"), F.floor(100000 * F.col("pct") / 2.5).alias("shares"))


@query("agg13_sector_heat", f"""WITH {AGG_SQL}, fx AS (SELECT a.*, s.sector FROM agg a JOIN (SELECT DISTINCT ticker, sector FROM flow) s USING (ticker)),
sd AS (SELECT ticker, sector, 'LONG' AS direction, bullish_score AS score, bullish_premium AS premium FROM fx UNION ALL SELECT ticker, sector, 'SHORT', bearish_score, bearish_premium FROM fx),
rk AS (SELECT *, row_number() OVER (PARTITION BY sector, direction ORDER BY score DESC, ticker) AS r FROM sd)
SELECT sector, direction, count(*) AS n_tickers, round(0.6::DOUBLE * avg(score) FILTER (r <= 5) * 10 + 0.4::DOUBLE * CAST(count(*) FILTER (score >= 0.5) AS DOUBLE) / count(*) * 10, 4) AS sector_heat_score, string_agg(ticker, ',' ORDER BY r) FILTER (r <= 5) AS top_tickers FROM rk GROUP BY 1, 2 HAVING count(*) >= 3""")
def agg13(spark, d):
    sectors = flow_events(spark, d).select("ticker", "sector").distinct()
    h = N.sector_heat(aggregated(spark, d).join(sectors, "ticker"))
    return h.select("sector", "direction", "n_tickers", F.round("sector_heat_score", 4).alias("sector_heat_score"), "top_tickers")


TX_SQL = """tx AS (SELECT 'C' || (o_custkey % 40) AS ticker, CASE o_orderstatus WHEN 'O' THEN 'Purchase' WHEN 'F' THEN 'SALE' ELSE 'Grant' END AS transaction_type, CAST(o_orderdate AS DATE) AS filing_date, o_totalprice AS value FROM orders)"""


def _tx(spark, d):
    k = F.col("o_orderstatus")
    return table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("ticker"), F.when(k == "O", "Purchase").when(k == "F", "SALE").otherwise("Grant").alias("transaction_type"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_totalprice").alias("value"))


def _insider_sql(buy: str, sell: str) -> str:
    return f"""WITH {TX_SQL}, f AS (SELECT *, {buy} AS b, NOT ({buy}) AND {sell} AS s FROM tx WHERE filing_date >= DATE '1997-01-01'), a AS (SELECT ticker, count(*) FILTER (b) AS buy_count, count(*) FILTER (s) AS sell_count, round(coalesce(sum(value) FILTER (b), 0), 2) AS buy_notional, round(coalesce(sum(value) FILTER (s), 0), 2) AS sell_notional, max(filing_date) AS last_date FROM f WHERE b OR s GROUP BY 1)
SELECT *, round(buy_notional - sell_notional, 2) AS net_notional, CASE WHEN buy_count > sell_count THEN 'buying' WHEN sell_count > buy_count THEN 'selling' ELSE 'mixed' END AS net_direction FROM a"""


@query("agg14_insiders", _insider_sql("upper(transaction_type) IN ('BUY', 'PURCHASE', 'A', 'P', 'ACQUISITION')", "upper(transaction_type) IN ('SELL', 'SALE', 'D', 'S', 'DISPOSITION')"))
def agg14(spark, d):
    return N.insiders(_tx(spark, d), F.lit("1997-01-01").cast("date"))


@query("agg14_insiders_by_letters", _insider_sql("regexp_matches(upper(transaction_type), 'A')", "regexp_matches(upper(transaction_type), 'SELL|D')"))
def agg14b(spark, d):
    return N.insiders(_tx(spark, d), F.lit("1997-01-01").cast("date"), strict=False)


SENT_SQL = """sent AS (SELECT CAST(ts AS DATE) AS snapshot_date, 'U' || (user_id % 50) AS ticker, count(*) FILTER (event_type IN ('view', 'click')) AS st_messages, count(*) FILTER (event_type = 'signup') AS rd_mentions,
  round(CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) / count(*), 4) AS st_sentiment, CASE WHEN count(*) FILTER (event_type = 'purchase') > count(*) FILTER (event_type = 'error') THEN 'bullish' WHEN count(*) FILTER (event_type = 'purchase') < count(*) FILTER (event_type = 'error') THEN 'bearish' ELSE 'neutral' END AS rd_sentiment FROM events GROUP BY 1, 2)"""


def _sentiment(spark, d):
    n = lambda *k: F.count_if(F.col("event_type").isin(*k))
    up, down = n("purchase"), n("error")
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("snapshot_date"), F.concat(F.lit("U"), F.col("user_id") % 50).alias("ticker")).agg(
        n("view", "click").alias("st_messages"), n("signup").alias("rd_mentions"), F.round(n("click") / F.count("*"), 4).alias("st_sentiment"), F.when(up > down, "bullish").when(up < down, "bearish").otherwise("neutral").alias("rd_sentiment")
    )


def _growth(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 AND {b} > 0 THEN 'new' WHEN {a} = 0 THEN 'stable' WHEN CAST({b} AS DOUBLE) / {a} > 1.5 THEN 'growing' WHEN CAST({b} AS DOUBLE) / {a} < 0.5 THEN 'declining' ELSE 'stable' END"


@query("agg15_sentiment_trend", f"""WITH {SENT_SQL}, a AS (SELECT ticker, arg_min(st_messages, snapshot_date) AS s0, arg_max(st_messages, snapshot_date) AS st_messages, arg_min(rd_mentions, snapshot_date) AS r0, arg_max(rd_mentions, snapshot_date) AS rd_mentions, arg_max(st_sentiment, snapshot_date) AS st, arg_max(rd_sentiment, snapshot_date) AS rd, avg(st_messages + rd_mentions) AS m FROM sent GROUP BY 1),
b AS (SELECT *, round(st * 0.4::DOUBLE + CASE rd WHEN 'bullish' THEN 0.8::DOUBLE WHEN 'bearish' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END * 0.6::DOUBLE, 3) AS combined_sentiment FROM a)
SELECT ticker, st_messages, rd_mentions, {_growth('s0', 'st_messages')} AS st_mention_trend, {_growth('r0', 'rd_mentions')} AS rd_mention_trend, combined_sentiment, CASE WHEN combined_sentiment >= 0.65 THEN 'bullish' WHEN combined_sentiment <= 0.35 THEN 'bearish' ELSE 'neutral' END AS combined_label, m > 0 AND st_messages + rd_mentions > 2 * m AS mention_spike FROM b""")
def agg15(spark, d):
    return N.sentiment_trend(_sentiment(spark, d))


@query("agg16_persistence", f"WITH {FLOW_SQL} SELECT ticker, direction, count(DISTINCT event_date) AS days, round(least(count(DISTINCT event_date) / 250.0::DOUBLE, 1), 6) AS persistence, round(0.5::DOUBLE * least(count(DISTINCT event_date) / 250.0::DOUBLE, 1), 6) AS bonus FROM flow WHERE premium >= 10000 AND direction IS NOT NULL GROUP BY 1, 2")
def agg16(spark, d):
    return N.persistence(flow(spark, d), 250, 10_000).withColumns({c: F.round(c, 6) for c in ("persistence", "bonus")})


SCAN_SQL = FLOW_SQL + ", scans AS (SELECT ticker, direction, date_trunc('month', event_ts) AS scan, round(sum(premium), 2) AS premium FROM flow WHERE direction IS NOT NULL GROUP BY 1, 2, 3)"


@query("agg17_trajectory", f"WITH {SCAN_SQL}, a AS (SELECT ticker, direction, count(*) AS scans_active, arg_min(premium, scan) AS first_premium, arg_max(premium, scan) AS last_premium FROM scans GROUP BY 1, 2) SELECT *, round((last_premium - first_premium) / nullif(first_premium, 0), 6) + 0 AS growth FROM a")
def agg17(spark, d):
    scans = flow(spark, d).filter("direction is not null").groupBy("ticker", "direction", F.date_trunc("month", "event_ts").alias("scan")).agg(F.round(F.sum("premium"), 2).alias("premium"))
    return N.trajectory(scans).withColumn("growth", F.round("growth", 6) + F.lit(0.0))


@query("agg18_market_tide", f"""WITH {FLOW_SQL} SELECT event_date, round(coalesce(sum(premium * direction_confidence) FILTER (direction = 'LONG'), 0) / nullif(sum(premium * direction_confidence), 0), 6) AS bullish_ratio,
  round((coalesce(sum(CASE direction WHEN 'LONG' THEN premium WHEN 'SHORT' THEN -premium END), 0) + sum(premium)) / (2 * sum(premium)), 6) AS tide FROM flow GROUP BY 1""")
def agg18(spark, d):
    p, w, way = F.col("premium"), F.col("premium") * F.col("direction_confidence"), F.col("direction")
    net = F.coalesce(F.sum(F.when(way == "LONG", p).when(way == "SHORT", -p)), F.lit(0.0))
    return flow(spark, d).groupBy("event_date").agg(F.round(F.try_divide(F.coalesce(F.sum(F.when(way == "LONG", w)), F.lit(0.0)), F.nullif(F.sum(w), F.lit(0.0))), 6).alias("bullish_ratio"), F.round((net + F.sum(p)) / (2 * F.sum(p)), 6).alias("tide"))


@query("agg22_rejection_audit", f"WITH {REJ_SQL} SELECT reason, count(*) AS n, count(DISTINCT ticker) AS tickers, round(avg(flow_score_raw), 4) AS mean_score, round(median(flow_score_raw), 4) AS median_score, max(flow_score_raw) AS max_score FROM rej GROUP BY 1")
def agg22(spark, d):
    s = "flow_score_raw"
    return rejected(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), F.round(F.avg(s), 4).alias("mean_score"), F.round(F.median(s), 4).alias("median_score"), F.max(s).alias("max_score"))


@query("agg22_daily_mix", f"WITH {REJ_SQL} SELECT CAST(scan_ts AS DATE) AS date, {', '.join(f'''count(*) FILTER (reason = '{r}') AS {r}''' for r in ('none', 'other', 'poor_rr', 'price_over_extended', 'trend_not_aligned'))} FROM rej GROUP BY 1")
def agg22b(spark, d):
    names = ["none", "other", "poor_rr", "price_over_extended", "trend_not_aligned"]
    return rejected(spark, d).groupBy(F.to_date("scan_ts").alias("date")).pivot("reason", names).count().na.fill(0, names)


@query("agg23_column_audit", f"""WITH {SNAPSHOTS_SQL}, n AS (SELECT {', '.join(f"count(*) FILTER ({c} IS NULL) AS b{i}, count(*) FILTER ({c} = 0) AS z{i}" for i, c in enumerate(('put_call_ratio', 'lottery_bullish_premium', 'trades')))}, count(*) AS n FROM snapshots)
SELECT unnest(['put_call_ratio', 'lottery_bullish_premium', 'trades']) AS "column", unnest([b0, b1, b2]) AS blank, unnest([z0, z1, z2]) AS zero, unnest([n - b0 - z0, n - b1 - z1, n - b2 - z2]) AS filled, unnest([n - b0 - z0 = 0, n - b1 - z1 = 0, n - b2 - z2 = 0]) AS suspicious FROM n""")
def agg23(spark, d):
    return N.column_audit(snapshots(spark, d), ["put_call_ratio", "lottery_bullish_premium", "trades"])


@query("agg24_distribution", f"WITH {AGG_SQL} SELECT {', '.join(f'round(quantile_cont(bullish_flow_intensity * 10000, {p}), 6) AS p{int(p * 100)}' for p in (0.25, 0.5, 0.75, 0.9, 0.99))} FROM agg")
def agg24(spark, d):
    ps = (0.25, 0.5, 0.75, 0.9, 0.99)
    q = aggregated(spark, d).agg(F.percentile(F.col("bullish_flow_intensity") * 10_000, F.array(*map(F.lit, ps))).alias("q"))
    return q.select(*[F.round(F.col("q")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)])


@query("agg30_window_audit", f"""WITH {FLOW_SQL}, m AS (SELECT *, max(event_ts) OVER () AS g, max(event_ts) OVER (PARTITION BY ticker) AS t FROM flow)
SELECT ticker, count(*) FILTER (g - event_ts <= INTERVAL 2 HOUR) AS global_2h, count(*) FILTER (t - event_ts <= INTERVAL 2 HOUR) AS own_2h FROM m GROUP BY 1""")
def agg30(spark, d):
    """The global and the ticker's own last print are aggregates joined back, not an unpartitioned window."""
    f = flow(spark, d).select("ticker", "event_ts")
    own = f.groupBy("ticker").agg(F.max("event_ts").alias("t"))
    every = own.agg(F.max("t").alias("g"))
    two = F.expr("INTERVAL '2' HOUR")
    return f.join(own, "ticker").crossJoin(F.broadcast(every)).groupBy("ticker").agg(F.count_if(F.col("g") - F.col("event_ts") <= two).alias("global_2h"), F.count_if(F.col("t") - F.col("event_ts") <= two).alias("own_2h"))


@query("agg31_failed_checks", f"WITH {REJ_SQL}, c AS (SELECT unnest(string_split(checks_failed, ',')) AS c FROM rej WHERE checks_failed <> '') SELECT c AS \"check\", count(*) AS n FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def agg31(spark, d):
    return rejected(spark, d).filter("checks_failed <> ''").select(F.explode(F.split("checks_failed", ",")).alias("check")).groupBy("check").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check").limit(3)


@query("agg32_history_coverage", f"WITH {SNAPSHOTS_SQL} SELECT ticker, count(DISTINCT snapshot_date) AS days, count(DISTINCT snapshot_date) >= 300 AS warm FROM snapshots GROUP BY 1")
def agg32(spark, d):
    return snapshots(spark, d).groupBy("ticker").agg(F.count_distinct("snapshot_date").alias("days")).withColumn("warm", F.col("days") >= 300)


ROLL_SQL = FLOW_SQL + ", dy AS (SELECT ticker, direction, event_date AS date, sum(premium) AS premium, count(*) AS trades FROM flow WHERE direction IS NOT NULL GROUP BY 1, 2, 3)"


@query("agg33_rolling_days", f"""WITH {ROLL_SQL} SELECT ticker, direction, date, {', '.join(f"round(sum(premium) OVER (PARTITION BY ticker, direction ORDER BY date RANGE BETWEEN INTERVAL {k - 1} DAY PRECEDING AND CURRENT ROW), 2) AS premium_{k}d, CAST(sum(trades) OVER (PARTITION BY ticker, direction ORDER BY date RANGE BETWEEN INTERVAL {k - 1} DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS count_{k}d" for k in (1, 3, 5))} FROM dy""")
def agg33(spark, d):
    dy = flow(spark, d).filter("direction is not null").groupBy("ticker", "direction", F.col("event_date").alias("date")).agg(F.sum("premium").alias("premium"), F.count("*").alias("trades"))
    return N.rolling_days(dy).drop("premium", "trades")


@query("top4_latest_scan", f"WITH {REJ_SQL} SELECT event_id, ticker, direction, reason FROM rej QUALIFY row_number() OVER (PARTITION BY ticker, direction ORDER BY scan_ts DESC, event_id DESC) = 1")
def top4(spark, d):
    return N.latest_per_key(rejected(spark, d), ["ticker", "direction"], F.desc("scan_ts"), F.desc("event_id")).select("event_id", "ticker", "direction", "reason")


@query("top5_missed_trades", f"WITH {REJ_SQL}, l AS (SELECT * FROM rej QUALIFY row_number() OVER (PARTITION BY ticker, direction ORDER BY scan_ts DESC, event_id DESC) = 1) SELECT event_id, ticker, direction, reason, flow_score_raw FROM l WHERE flow_score_raw >= 5 AND reason IN ('poor_rr', 'price_over_extended', 'trend_not_aligned')")
def top5(spark, d):
    last = N.latest_per_key(rejected(spark, d), ["ticker", "direction"], F.desc("scan_ts"), F.desc("event_id"))
    return last.filter((F.col("flow_score_raw") >= 5) & F.col("reason").isin("poor_rr", "price_over_extended", "trend_not_aligned")).select("event_id", "ticker", "direction", "reason", "flow_score_raw")


@query("top9_better_side", f"WITH {AGG_SQL} SELECT ticker, round(greatest(bullish_score, bearish_score), 6) AS best_score, CASE WHEN bullish_score >= bearish_score THEN 'LONG' ELSE 'SHORT' END AS side FROM agg ORDER BY 2 DESC, 1")
def top9(spark, d):
    b, s = F.col("bullish_score"), F.col("bearish_score")
    return aggregated(spark, d).select("ticker", F.round(F.greatest(b, s), 6).alias("best_score"), F.when(b >= s, "LONG").otherwise("SHORT").alias("side")).orderBy(F.desc("best_score"), "ticker")


# ---- joins and sets ----------------------------------------------------------------------------


@query("jon1_left_enrichment", f"""WITH {AGG_SQL}, {CHAIN_SQL.replace(FLOW_SQL + ',', '').lstrip()}, w AS (SELECT cs.ticker, CAST(sum(call_oi) AS BIGINT) AS call_oi FROM cs GROUP BY 1 HAVING sum(call_oi) > 500) SELECT ticker, round(bullish_premium + 0.0001, 1) AS bullish_premium, w.call_oi FROM agg LEFT JOIN w USING (ticker)""")
def jon1(spark, d):
    w = strikes(spark, d).groupBy("ticker").agg(F.sum("call_oi").alias("call_oi")).filter("call_oi > 500")
    return aggregated(spark, d).join(w, "ticker", "left").select("ticker", F.round(F.col("bullish_premium") + 1e-4, 1).alias("bullish_premium"), "call_oi")


@query("jon4_worst_tier", f"WITH {BOTH_SQL} SELECT ticker, direction, CASE WHEN final_score >= 7 THEN 1 WHEN final_score >= 6 THEN 2 ELSE 3 END AS own_tier, max(CASE WHEN final_score >= 7 THEN 1 WHEN final_score >= 6 THEN 2 ELSE 3 END) OVER (PARTITION BY ticker) AS worst_tier FROM results")
def jon4(spark, d):
    tier = F.when(F.col("final_score") >= 7, 1).when(F.col("final_score") >= 6, 2).otherwise(3)
    r = results(spark, d).withColumn("own_tier", tier)
    worst = r.groupBy("ticker").agg(F.max("own_tier").alias("worst_tier"))
    return r.join(worst, "ticker").select("ticker", "direction", "own_tier", "worst_tier")


@query("jon7_outcome_stamp", f"""WITH {BOTH_SQL}, p AS (SELECT ticker, direction FROM results WHERE final_score >= 7), j AS (SELECT ticker, direction, 'poor_rr' AS why FROM results WHERE final_score < 6),
h AS (SELECT ticker, CASE direction WHEN 'LONG' THEN 'BULLISH' ELSE 'BEARISH' END AS direction FROM results)
SELECT r.ticker, r.direction, CASE WHEN p.ticker IS NOT NULL THEN 'promoted' ELSE coalesce('rejected:' || why, 'not_evaluated') END AS outcome FROM h r LEFT JOIN p ON p.ticker = r.ticker AND (p.direction = 'LONG') = (r.direction = 'BULLISH') LEFT JOIN j ON j.ticker = r.ticker AND (j.direction = 'LONG') = (r.direction = 'BULLISH')""")
def jon7(spark, d):
    r = results(spark, d).select("ticker", "direction", "final_score")
    history = r.select("ticker", F.when(F.col("direction") == "LONG", "BULLISH").otherwise("BEARISH").alias("direction"))
    return outcome_stamped(history, r.filter("final_score >= 7"), r.filter("final_score < 6").withColumn("reject_reason", F.lit("poor_rr")))


@query("jon8_not_held", f"WITH {BOTH_SQL} SELECT ticker, direction, final_score FROM results r WHERE NOT EXISTS (SELECT 1 FROM flow h WHERE h.ticker = r.ticker AND h.premium > 104900) ORDER BY final_score DESC, ticker, direction LIMIT 10")
def jon8(spark, d):
    held = flow(spark, d).filter("premium > 104900").select("ticker").distinct()
    return results(spark, d).join(held, "ticker", "left_anti").select("ticker", "direction", "final_score").orderBy(F.desc("final_score"), "ticker", "direction").limit(10)


@query("jon10_nearest_in_time", f"""WITH {PRINTS_SQL}, q AS (SELECT tracking_id, ticker, executed_at, price FROM prints WHERE tracking_id % 10 = 0), g AS (SELECT tracking_id, ticker, executed_at, price FROM prints WHERE tracking_id % 10 <> 0)
SELECT q.tracking_id, arg_min(g.tracking_id, (abs(epoch_us(g.executed_at) - epoch_us(q.executed_at)), g.tracking_id)) AS nearest FROM q JOIN g ON q.ticker = g.ticker GROUP BY 1""")
def jon10(spark, d):
    """The nearest row on either side, the least id among rows of one time: two ordered windows per key carry the last
    and the next candidate, so no pairs are formed."""
    p = prints(spark, d).select("tracking_id", "ticker", F.unix_micros(F.col("executed_at").cast("timestamp")).alias("at"))
    return nearest_in_time(p.withColumn("asks", F.col("tracking_id") % 10 == 0)).select("tracking_id", "nearest")


@query("jon13_sector_precedence", f"WITH {AGG_SQL}, s AS (SELECT DISTINCT ticker, sector FROM flow) SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS INT) % 10 = 0 THEN 'Special basket' WHEN CAST(substr(ticker, 2) AS INT) % 10 = 1 THEN 'Index fund' ELSE sector END AS resolved FROM agg JOIN s USING (ticker)")
def jon13(spark, d):
    k = F.substring("ticker", 2, 9).cast("int") % 10
    base = flow(spark, d).select("ticker", "sector").distinct()
    sub = base.filter(k == 0).select("ticker", F.lit("Special basket").alias("sub"))
    etf = base.filter(k == 1).select("ticker", F.lit("Index fund").alias("etf"))
    out = aggregated(spark, d).select("ticker").join(base, "ticker").join(sub, "ticker", "left").join(etf, "ticker", "left")
    return out.select("ticker", F.coalesce("sub", "etf", F.nullif(F.trim("sector"), F.lit(""))).alias("resolved")).filter("resolved is not null")


@query("jon15_nearest_event", f"""WITH {SNAPSHOTS_SQL}, d AS (SELECT DISTINCT snapshot_date AS day FROM snapshots), e AS (SELECT unnest(generate_series(DATE '1995-01-10', DATE '2002-01-01', INTERVAL 45 DAY))::DATE AS event)
SELECT day, arg_min(event - day, (abs(event - day), event)) AS delta FROM d JOIN e ON event BETWEEN day - 30 AND day + 30 GROUP BY 1""")
def jon15(spark, d):
    """Signed days to the nearest event within thirty: a range join with a calendar of a few rows."""
    days = snapshots(spark, d).select(F.col("snapshot_date").alias("day")).distinct()
    events = spark.range(1).select(F.explode(F.expr("sequence(date'1995-01-10', date'2002-01-01', interval 45 days)")).alias("event"))
    j = days.join(F.broadcast(events), F.col("event").between(F.date_sub("day", 30), F.date_add("day", 30)))
    delta = F.datediff("event", "day")
    return j.groupBy("day").agg(F.min_by(delta, F.struct(F.abs(delta), F.col("event"))).cast("long").alias("delta"))


@query("set1_extra_feed", f"WITH {FLOW_SQL}, a AS (SELECT DISTINCT ticker, 'main' AS feed FROM flow WHERE premium > 104500), b AS (SELECT DISTINCT ticker, 'extra' AS feed FROM flow WHERE premium > 103500) SELECT * FROM a UNION ALL SELECT * FROM b WHERE ticker NOT IN (SELECT ticker FROM a)")
def set1(spark, d):
    f = flow(spark, d)
    a, b = (f.filter(F.col("premium") > p).select("ticker").distinct() for p in (104500, 103500))
    return a.withColumn("feed", F.lit("main")).unionByName(b.join(a, "ticker", "left_anti").withColumn("feed", F.lit("extra")))


@query("set2_keep_last", f"WITH {FLOW_SQL} SELECT ticker, event_date, max(premium) AS premium FROM (SELECT * FROM flow QUALIFY row_number() OVER (PARTITION BY ticker, event_date ORDER BY event_ts DESC, premium DESC) = 1) GROUP BY 1, 2")
def set2(spark, d):
    return N.latest_per_key(flow(spark, d), ["ticker", "event_date"], F.desc("event_ts"), F.desc("premium")).select("ticker", "event_date", "premium")


@query("set3_recent_activity", f"WITH {PRINTS_SQL} SELECT * FROM (SELECT tracking_id, 'entry' AS kind, executed_at FROM prints WHERE price > 60 UNION ALL SELECT tracking_id, 'exit', executed_at FROM prints WHERE price < 0.5) ORDER BY executed_at DESC, tracking_id LIMIT 25")
def set3(spark, d):
    p = prints(spark, d)
    both = p.filter("price > 60").select("tracking_id", F.lit("entry").alias("kind"), "executed_at").unionByName(p.filter("price < 0.5").select("tracking_id", F.lit("exit").alias("kind"), "executed_at"))
    return both.orderBy(F.desc("executed_at"), "tracking_id").limit(25)


@query("set4_recent_tickers", f"WITH {FLOW_SQL} SELECT DISTINCT ticker FROM flow WHERE event_ts >= TIMESTAMP '2001-09-01'")
def set4(spark, d):
    return flow(spark, d).filter(F.col("event_ts") >= F.lit("2001-09-01").cast("timestamp_ntz")).select("ticker").distinct()


@query("snk6_first_seen", f"WITH {FLOW_SQL} SELECT ticker, least(min(event_date), DATE '1995-06-01') AS first_seen FROM flow GROUP BY 1")
def snk6(spark, d):
    """Registry of first dates merged with the known ones by the smaller date."""
    known = flow(spark, d).select("ticker").distinct().withColumn("first_seen", F.lit("1995-06-01").cast("date"))
    new = flow(spark, d).groupBy("ticker").agg(F.min("event_date").alias("first_seen"))
    return known.unionByName(new).groupBy("ticker").agg(F.min("first_seen").alias("first_seen"))


@query("snk5_gap_fill", f"WITH {SNAPSHOTS_SQL}, a AS (SELECT ticker, snapshot_date, 'screener' AS premium_source FROM snapshots WHERE trades >= 3), b AS (SELECT ticker, snapshot_date, 'flow' AS premium_source FROM snapshots WHERE total_bullish_premium > 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.ticker = b.ticker AND a.snapshot_date = b.snapshot_date)")
def snk5(spark, d):
    s = snapshots(spark, d)
    k = ["ticker", "snapshot_date"]
    a, b = s.filter("trades >= 3").select(*k), s.filter("total_bullish_premium > 0").select(*k)
    return a.withColumn("premium_source", F.lit("screener")).unionByName(b.join(a, k, "left_anti").withColumn("premium_source", F.lit("flow")))


@query("win30_momentum_z", f"""WITH {SNAPSHOTS_SQL}, m AS (SELECT *, avg(trades) OVER w AS mu, stddev_samp(trades) OVER w AS sd, count(*) OVER w AS n FROM snapshots WINDOW w AS (PARTITION BY ticker ORDER BY snapshot_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT ticker, snapshot_date, round((trades - mu) / nullif(sd, 0), 6) + 0 AS z3 FROM m WHERE n = 3""")
def win30(spark, d):
    w = Window.partitionBy("ticker").orderBy("snapshot_date").rowsBetween(-3, -1)
    s = snapshots(spark, d).withColumns({"mu": F.avg("trades").over(w), "sd": F.stddev_samp("trades").over(w), "n": F.count("*").over(w)})
    return s.filter("n = 3").select("ticker", "snapshot_date", (F.round(F.try_divide(F.col("trades") - F.col("mu"), F.nullif("sd", F.lit(0.0))), 6) + F.lit(0.0)).alias("z3"))


@query("win31_iv_rank_delta", f"WITH {SNAPSHOTS_SQL}, w AS (SELECT * FROM snapshots WHERE snapshot_date >= DATE '1998-01-05' AND snapshot_date <= DATE '1998-03-02') SELECT ticker, arg_max(iv_rank, snapshot_date) AS current_iv, CASE WHEN count(*) >= 2 THEN round(arg_max(iv_rank, snapshot_date) - arg_min(iv_rank, snapshot_date), 2) + 0 END AS delta, count(*) AS samples FROM w GROUP BY 1")
def win31(spark, d):
    s = snapshots(spark, d).filter(F.col("snapshot_date").between(F.lit("1998-01-05").cast("date"), F.lit("1998-03-02").cast("date")))
    a, b = F.max_by("iv_rank", "snapshot_date"), F.min_by("iv_rank", "snapshot_date")
    return s.groupBy("ticker").agg(a.alias("current_iv"), F.when(F.count("*") >= 2, F.round(a - b, 2) + F.lit(0.0)).alias("delta"), F.count("*").alias("samples"))


@query("win32_streak_trend", f"""WITH {SNAPSHOTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date DESC) AS r FROM snapshots), a AS (SELECT ticker, count(*) AS n, avg(sweep_share) AS mean_flow, regr_slope(sweep_share, -r) AS slope FROM r WHERE r <= 5 GROUP BY 1)
SELECT ticker, n, round(mean_flow, 6) AS mean_flow, CASE WHEN n < 3 THEN 'n/a' WHEN slope / greatest(abs(mean_flow), 1e-6) > 0.05 THEN 'rising' WHEN slope / greatest(abs(mean_flow), 1e-6) < -0.05 THEN 'falling' ELSE 'flat' END AS flow_trend FROM a""")
def win32(spark, d):
    return N.streak_trend(snapshots(spark, d), ["ticker"], "sweep_share", "snapshot_date").select("ticker", "n", F.round("mean_flow", 6).alias("mean_flow"), "flow_trend")


@query("win28_slope_t", f"""WITH {FLOW_SQL}, k AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY event_ts, l_orderkey, l_linenumber, premium) - 1 AS x, CASE direction WHEN 'LONG' THEN premium WHEN 'SHORT' THEN -premium ELSE 0 END AS y FROM flow),
s AS (SELECT ticker, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss FROM k GROUP BY 1) SELECT ticker, n, round(slope, 4) + 0 AS slope, round(slope / sqrt(rss / (n - 2) / sxx), 4) + 0 AS t_stat FROM s""")
def win28(spark, d):
    y = F.when(F.col("direction") == "LONG", F.col("premium")).when(F.col("direction") == "SHORT", -F.col("premium")).otherwise(0.0)
    k = flow(spark, d).select("ticker", (F.row_number().over(Window.partitionBy("ticker").orderBy("event_ts", *KEY, "premium")) - 1).cast("double").alias("x"), y.alias("y"))
    s = k.groupBy("ticker").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    t = F.col("b") / F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return s.select("ticker", "n", (F.round("b", 4) + F.lit(0.0)).alias("slope"), (F.round(t, 4) + F.lit(0.0)).alias("t_stat"))


@query("sta15_repeat_gap", f"WITH {FLOW_SQL}, g AS (SELECT ticker, event_date - lag(event_date) OVER (PARTITION BY ticker ORDER BY event_date) AS gap FROM (SELECT DISTINCT ticker, event_date FROM flow)) SELECT ticker, round(avg(gap), 6) AS mean_gap FROM g GROUP BY 1")
def sta15(spark, d):
    g = flow(spark, d).select("ticker", "event_date").distinct().withColumn("gap", F.datediff("event_date", F.lag("event_date").over(Window.partitionBy("ticker").orderBy("event_date"))))
    return g.groupBy("ticker").agg(F.round(F.avg("gap"), 6).alias("mean_gap"))


@query("sta22_fold_assignment", f"WITH {SNAPSHOTS_SQL}, w AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) - 1 AS k FROM (SELECT DISTINCT snapshot_date FROM snapshots)) SELECT ticker, snapshot_date, k // 20 AS fold, k % 20 >= 15 AS is_test FROM snapshots JOIN w USING (snapshot_date)")
def sta22(spark, d):
    """Walk-forward folds: dates are numbered once, a row per date, and joined back."""
    s = snapshots(spark, d).select("ticker", "snapshot_date")
    k = s.select("snapshot_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("snapshot_date")) - 1)
    return s.join(k, "snapshot_date").select("ticker", "snapshot_date", F.floor(F.col("k") / 20).alias("fold"), (F.col("k") % 20 >= 15).alias("is_test"))


@query("sta23_monotone_grades", f"WITH {TRACK_SQL}, g AS (SELECT grade_rank, avg(accumulation_score) AS m FROM board GROUP BY 1), l AS (SELECT *, lag(m) OVER (ORDER BY grade_rank) AS p FROM g) SELECT bool_and(coalesce(m >= p, true)) AS monotone, count(*) AS grades FROM l")
def sta23(spark, d):
    from ..operators.tracker import GRADE_RANK

    rank = F.create_map(*[x for g, r in GRADE_RANK.items() for x in (F.lit(g), F.lit(r))])
    g = board(spark, d).groupBy(rank[F.col("conviction_grade")].alias("grade_rank")).agg(F.avg("accumulation_score").alias("m"))
    step = F.col("m") >= F.lag("m").over(Window.orderBy("grade_rank"))  # seven grades at most
    return g.withColumn("up", F.coalesce(step, F.lit(True))).agg(F.bool_and("up").alias("monotone"), F.count("*").alias("grades"))


@query("jon2_print_convergence", f"""WITH {SNAPSHOTS_SQL}, f AS (SELECT ticker, CASE WHEN sum(total_bullish_premium) >= sum(total_bearish_premium) THEN 'BULLISH' ELSE 'BEARISH' END AS direction FROM snapshots GROUP BY 1), {PRINTS_SQL}, cl AS (SELECT *, CASE WHEN nbbo_ask > 0 AND price >= nbbo_ask THEN 'buy' WHEN nbbo_bid > 0 AND price <= nbbo_bid THEN 'sell' ELSE 'neutral' END AS side FROM prints WHERE price > 0 AND size > 0),
b AS (SELECT 'S' || substr(ticker, 2) AS ticker, CAST(sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS DOUBLE) / sum(size) AS bias FROM cl GROUP BY 1)
SELECT f.ticker, direction, coalesce((direction = 'BULLISH' AND bias >= 0.2) OR (direction = 'BEARISH' AND bias <= 0.19), false) AS aligned, coalesce((direction = 'BULLISH' AND bias <= 0.19) OR (direction = 'BEARISH' AND bias >= 0.2), false) AS divergent FROM f LEFT JOIN b USING (ticker)""")
def jon2(spark, d):
    f = snapshots(spark, d).groupBy("ticker").agg(F.when(F.sum("total_bullish_premium") >= F.sum("total_bearish_premium"), "BULLISH").otherwise("BEARISH").alias("direction"))
    p = daily(spark, d).groupBy(F.concat(F.lit("S"), F.substring("ticker", 2, 9)).alias("ticker")).agg((F.sum("buy_volume") / F.sum("total_volume")).alias("bias"))
    up, hi, lo = F.col("direction") == "BULLISH", F.col("bias") >= 0.2, F.col("bias") <= 0.19
    no = F.lit(False)
    return f.join(p, "ticker", "left").select("ticker", "direction", F.coalesce((up & hi) | (~up & lo), no).alias("aligned"), F.coalesce((up & lo) | (~up & hi), no).alias("divergent"))
