"""Queries on price-action rules and remaining joins and evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import bars as B
from ..operators import stats as S
from ..sources.fixtures import FLOW_SQL, SNAPSHOTS_SQL, snapshots, table
from ..sources.shared import settled
from .bar_queries import FEAT_SQL, WIN, feat, rows
from .flow_queries import AGG_SQL, BOTH_SQL, aggregated, flow, results
from .registry import query
from .surface_queries import TENOR_SQL, tenors
from .tracker_queries import PLAN_SQL, TRACK_SQL, board, replayed



def _touch(name: str, touch: str, beyond: str) -> str:
    near = "(abs(close - ema20) <= atr14 OR abs(close - ema50) <= atr14)"
    parts = [f"(coalesce(bool_or({touch.format(e=e)} AND atr14 > 0) {rows('4 PRECEDING', 'CURRENT ROW')}, false) AND ({near} OR ({beyond.format(e=e)})))" for e in B.EMAS]
    return f"i >= 4 AND atr14 > 0 AND ({' OR '.join(parts)}) AS {name}"


@query("win11_ema_touch", f"""WITH {FEAT_SQL} SELECT ticker, date, {_touch('pullback_to_ema', 'low <= {e} + 0.3::DOUBLE * atr14 AND close >= {e}', 'close > {e} AND close - {e} <= 3 * atr14')},
  {_touch('rally_to_ema', 'high >= {e} - 0.3::DOUBLE * atr14 AND close <= {e}', 'close < {e} AND {e} - close <= 3 * atr14')} FROM feat""")
def win11(spark, d):
    return feat(spark, d).select("ticker", "date", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in B.ema_touches().items()])


@query("win12_retest_confirm", f"""WITH {FEAT_SQL}, p AS (SELECT *, high - low AS span, lag(low) {WIN} AS pl, lag(high) {WIN} AS ph, lag(close) {WIN} AS pc, lag(atr14) {WIN} AS pa, lag(ema20) {WIN} AS p20, lag(ema50) {WIN} AS p50 FROM feat)
SELECT ticker, date, coalesce(i >= 2 AND atr14 > 0 AND pa > 0 AND span >= 0.5::DOUBLE * atr14 AND close > open AND (close - low) / nullif(span, 0) >= 0.65 AND ((pl <= p20 + 0.3::DOUBLE * pa AND abs(pc - p20) <= 0.75::DOUBLE * pa) OR (pl <= p50 + 0.3::DOUBLE * pa AND abs(pc - p50) <= 0.75::DOUBLE * pa)), false) AS retest_long,
  coalesce(i >= 2 AND atr14 > 0 AND pa > 0 AND span >= 0.5::DOUBLE * atr14 AND close < open AND (high - close) / nullif(span, 0) >= 0.65 AND ((ph >= p20 - 0.3::DOUBLE * pa AND abs(pc - p20) <= 0.75::DOUBLE * pa) OR (ph >= p50 - 0.3::DOUBLE * pa AND abs(pc - p50) <= 0.75::DOUBLE * pa)), false) AS retest_short FROM p""")
def win12(spark, d):
    return feat(spark, d).select("ticker", "date", *[c.alias(k) for k, c in B.retests().items()])


@query("win15_bounce_and_fail", f"""WITH {FEAT_SQL}, r AS (SELECT *, close < open AND atr14 > 0 AND low <= greatest(ema20, ema50) + atr14 AS red, close > open AND atr14 > 0 AND high >= least(ema20, ema50) - atr14 AS green FROM feat)
SELECT ticker, date, coalesce(i >= 5 AND close > open AND count(*) FILTER (red) {rows('5 PRECEDING', '1 PRECEDING')} >= 1, false) AS bounce_long, coalesce(i >= 5 AND close < open AND count(*) FILTER (green) {rows('5 PRECEDING', '1 PRECEDING')} >= 1, false) AS bounce_short FROM r""")
def win15(spark, d):
    return feat(spark, d).select("ticker", "date", *[c.alias(k) for k, c in B.bounces().items()])


LEVEL_SQL = FEAT_SQL + """,
lr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM feat), lz AS (SELECT ticker, date, close, atr14 AS atr FROM lr WHERE k = 1), rc AS (SELECT ticker, date, high, low FROM lr WHERE k BETWEEN 2 AND 21),
pv AS (SELECT *, count(*) OVER w = 7 AND high = max(high) OVER w AS hi, count(*) OVER w = 7 AND low = min(low) OVER w AS lo FROM rc WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
pp AS (SELECT ticker, 'lo' AS side, low AS p FROM pv WHERE lo UNION ALL SELECT ticker, 'hi', high FROM pv WHERE hi),
pn AS (SELECT pp.*, close, CASE WHEN p - lag(p) OVER (PARTITION BY ticker, side ORDER BY p) <= 0.5::DOUBLE * atr THEN 0 ELSE 1 END AS new FROM pp JOIN lz USING (ticker) WHERE atr > 0),
pg AS (SELECT *, sum(new) OVER (PARTITION BY ticker, side ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM pn), cl AS (SELECT ticker, side, g, close, avg(p) AS level, count(*) AS touches FROM pg GROUP BY 1, 2, 3, 4),
bs AS (SELECT ticker, arg_max(level, (touches, -level)) FILTER (side = 'lo' AND level < close) AS s, arg_max(level, (touches, -level)) FILTER (side = 'hi' AND level > close) AS r FROM cl GROUP BY 1)"""


@query("win9_support_resistance", f"WITH {LEVEL_SQL} SELECT lz.ticker, lz.date, round(coalesce(s, mn) + 0.000001, 3) AS support, round(coalesce(r, mx) + 0.000001, 3) AS resistance FROM lz JOIN (SELECT ticker, min(low) AS mn, max(high) AS mx, count(*) AS n FROM rc GROUP BY 1) e ON e.ticker = lz.ticker AND n = 20 LEFT JOIN bs ON bs.ticker = lz.ticker")
def win9(spark, d):
    return B.last_levels(feat(spark, d)).select("ticker", "date", F.round(F.col("support") + 1e-6, 3).alias("support"), F.round(F.col("resistance") + 1e-6, 3).alias("resistance"))


@query("jon3_latest_slice", f"WITH {TRACK_SQL}, l AS (SELECT * FROM board WHERE as_of = (SELECT max(as_of) FROM board)) SELECT r.ticker, r.direction, l.conviction_score FROM (SELECT DISTINCT ticker, direction FROM board) r LEFT JOIN l USING (ticker, direction)")
def jon3(spark, d):
    b = settled(board(spark, d).select("as_of", "ticker", "direction", "conviction_score"))
    last = b.agg(F.max("as_of").alias("as_of"))  # one row
    now = b.join(F.broadcast(last), "as_of").drop("as_of")
    return b.select("ticker", "direction").distinct().join(now, ["ticker", "direction"], "left")


@query("jon6_panel_join", f"WITH {PLAN_SQL}, g AS (SELECT ticker, i, CASE WHEN strength >= 0 THEN 1 ELSE 0 END AS k, round(adx, 4) AS adx FROM (SELECT *, adx AS strength FROM feat)) SELECT r.ticker, r.i, r.direction, g.adx, r.exit_reason FROM replay r JOIN g ON upper(trim(' ' || lower(g.ticker))) = r.ticker AND g.i = r.i")
def jon6(spark, d):
    g = feat(spark, d).select(F.upper(F.trim(F.concat(F.lit(" "), F.lower("ticker")))).alias("ticker"), "i", F.round("adx", 4).alias("adx"))
    return replayed(spark, d).join(g, ["ticker", "i"]).select("ticker", "i", "direction", "adx", "exit_reason")


@query("jon5_side_column", f"WITH {AGG_SQL} SELECT r.ticker, r.direction, round(CASE r.direction WHEN 'LONG' THEN bullish_breadth ELSE bearish_breadth END, 6) AS breadth FROM (SELECT ticker, 'LONG' AS direction FROM agg UNION ALL SELECT ticker, 'SHORT' FROM agg) r JOIN agg USING (ticker)")
def jon5(spark, d):
    a = aggregated(spark, d).select("ticker", "bullish_breadth", "bearish_breadth")
    r = results(spark, d).select("ticker", "direction")
    return r.join(a, "ticker", "left").select("ticker", "direction", F.round(F.when(F.col("direction") == "LONG", F.col("bullish_breadth")).otherwise(F.col("bearish_breadth")), 6).alias("breadth"))


BANDS = ((0.0, 15.0, "calm"), (15.0, 25.0, "normal"), (25.0, 1000.0, "stressed"))


@query("jon14_band_join", f"WITH {FEAT_SQL}, b(lo, hi, tier) AS (VALUES {', '.join(f'({a}::DOUBLE, {z}::DOUBLE, {chr(39)}{t}{chr(39)})' for a, z, t in BANDS)}) SELECT ticker, date, tier FROM feat JOIN b ON adx >= lo AND adx < hi")
def jon14(spark, d):
    bands = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(z).alias("hi"), F.lit(t).alias("tier")) for a, z, t in BANDS])))
    f = feat(spark, d)
    return f.join(F.broadcast(bands), (f["adx"] >= bands["lo"]) & (f["adx"] < bands["hi"])).select("ticker", "date", "tier")


@query("jon16_promote_new", f"WITH {TRACK_SQL}, s AS (SELECT DISTINCT ticker FROM board WHERE as_of = DATE '1998-01-12' AND conviction_score >= 4), n AS (SELECT * FROM board WHERE as_of = DATE '1998-06-15' AND conviction_score >= 3 AND ticker NOT IN (SELECT ticker FROM s)) SELECT ticker, direction, conviction_score FROM n QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY conviction_score DESC) = 1")
def jon16(spark, d):
    b = board(spark, d)
    day = lambda x: F.col("as_of") == F.lit(x).cast("date")
    have = b.filter(day("1998-01-12") & (F.col("conviction_score") >= 4)).select("ticker").distinct()
    new = b.filter(day("1998-06-15") & (F.col("conviction_score") >= 3)).join(have, "ticker", "left_anti")
    r = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("conviction_score")))
    return new.withColumn("_r", r).filter("_r = 1").select("ticker", "direction", "conviction_score")


@query("agg20_exposure", f"WITH {BOTH_SQL} SELECT round(sum(premium) FILTER (direction = 'LONG'), 2) AS long_exposure, round(sum(premium) FILTER (direction = 'SHORT'), 2) AS short_exposure, round(sum(premium), 2) AS gross, round(sum(CASE direction WHEN 'LONG' THEN premium ELSE -premium END), 2) AS net, count(*) FILTER (final_score >= 7) AS healthy FROM results")
def agg20(spark, d):
    p, long_ = F.col("premium"), F.col("direction") == "LONG"
    return results(spark, d).agg(F.round(F.sum(F.when(long_, p)), 2).alias("long_exposure"), F.round(F.sum(F.when(~long_, p)), 2).alias("short_exposure"), F.round(F.sum(p), 2).alias("gross"), F.round(F.sum(F.when(long_, p).otherwise(-p)), 2).alias("net"), F.count_if(F.col("final_score") >= 7).alias("healthy"))


@query("opt6_latest_row", f"WITH {TENOR_SQL} SELECT ticker, arg_max(days, days) AS days, arg_max(volatility, days) AS volatility FROM tn WHERE days <= 100 GROUP BY 1")
def opt6(spark, d):
    return tenors(spark, d).filter("days <= 100").groupBy("ticker").agg(F.max_by(F.struct("days", "volatility"), "days").alias("t")).select("ticker", "t.days", "t.volatility")


@query("opt10_next_and_last", f"WITH {FLOW_SQL} SELECT ticker, min(expiration_date) FILTER (expiration_date >= DATE '1998-01-15') AS next_date, max(expiration_date) FILTER (expiration_date < DATE '1998-01-15') AS last_date FROM flow GROUP BY 1")
def opt10(spark, d):
    e, day = F.col("expiration_date"), F.lit("1998-01-15").cast("date")
    return flow(spark, d).groupBy("ticker").agg(F.min(F.when(e >= day, e)).alias("next_date"), F.max(F.when(e < day, e)).alias("last_date"))


@query("sta13_weight_scheme", f"""WITH {TRACK_SQL}, m AS (SELECT min(prem_mcap_bps) AS lo_b, max(prem_mcap_bps) AS hi_b, min(consistency) AS lo_c, max(consistency) AS hi_c FROM board), s AS (SELECT as_of, ticker, round(0.6::DOUBLE * (prem_mcap_bps - lo_b) / (hi_b - lo_b) + 0.4::DOUBLE * (consistency - lo_c) / (hi_c - lo_c), 8) AS score FROM board, m),
q AS (SELECT quantile_cont(score, 0.75) AS q75, quantile_cont(score, 0.5) AS q50 FROM s) SELECT as_of, ticker, round(score + 0.000000001, 6) AS score, CASE WHEN score >= q75 THEN 'A' WHEN score >= q50 THEN 'B' ELSE 'C' END AS grade FROM s, q""")
def sta13(spark, d):
    b = settled(board(spark, d).select("as_of", "ticker", "prem_mcap_bps", "consistency"))
    m = b.agg(F.min("prem_mcap_bps").alias("b0"), F.max("prem_mcap_bps").alias("b1"), F.min("consistency").alias("c0"), F.max("consistency").alias("c1"))
    s = b.crossJoin(F.broadcast(m)).select("as_of", "ticker", F.round(0.6 * (F.col("prem_mcap_bps") - F.col("b0")) / (F.col("b1") - F.col("b0")) + 0.4 * (F.col("consistency") - F.col("c0")) / (F.col("c1") - F.col("c0")), 8).alias("score"))
    q = S.split_percentiles(s, "score", [0.75, 0.5]).select(F.array("p0", "p1").alias("q"))
    g = F.when(F.col("score") >= F.col("q")[0], "A").when(F.col("score") >= F.col("q")[1], "B").otherwise("C")
    return s.crossJoin(F.broadcast(q)).select("as_of", "ticker", F.round(F.col("score") + 1e-9, 6).alias("score"), g.alias("grade"))


@query("sta17_proxy_features", f"WITH {TRACK_SQL} SELECT as_of, ticker, round(greatest(0, least(1, (ln(1 + prem_mcap_bps) - ln(1.5::DOUBLE)) / (ln(51::DOUBLE) - ln(1.5::DOUBLE)))), 6) AS intensity, round(greatest(0, least(1, (ln(1 + cum_total) - ln(1 + 5e5)) / (ln(1 + 5e7) - ln(1 + 5e5)))), 6) AS mass FROM board")
def sta17(spark, d):
    from ..operators.tracker import log_norm

    return board(spark, d).select("as_of", "ticker", F.round(log_norm(F.col("prem_mcap_bps"), 0.5, 50.0), 6).alias("intensity"), F.round(log_norm(F.col("cum_total"), 5e5, 5e7), 6).alias("mass"))


@query("sta21_matured_labels", f"WITH {FEAT_SQL}, f AS (SELECT ticker, date, close, CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE END AS label, lead(close, 5) {WIN} AS c5 FROM feat) SELECT ticker, date, round(coalesce(label, c5 / close - 1), 6) + 0 AS label FROM f WHERE label IS NOT NULL OR c5 IS NOT NULL")
def sta21(spark, d):
    f = feat(spark, d).select("ticker", "date", "close", F.when(F.col("i") % 2 == 0, 0.5).alias("label"), F.lead("close", 5).over(B.W()).alias("c5"))
    return f.filter("label is not null or c5 is not null").select("ticker", "date", (F.round(F.coalesce("label", F.col("c5") / F.col("close") - 1), 6) + F.lit(0.0)).alias("label"))


@query("sta12_block_bootstrap")
def sta12(spark, d):
    """Mean replay result and its 95 percent interval by resampling tickers, 2000 draws: per draw and ticker a
    Poisson(1) weight from a hash, over per-ticker sums. A draw in which no ticker is taken has no mean and counts as none."""
    per = replayed(spark, d).groupBy("ticker").agg(F.sum("realized_r").alias("s"), F.count("*").alias("n"))
    u = F.pmod(F.xxhash64("draw", "ticker"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cuts = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)
    weight = sum(((u > c).cast("int") for c in cuts[1:]), (u > cuts[0]).cast("int"))
    draws = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(1999)))).withColumn("w", weight).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("mean"))
    return draws.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))


@query("prj32_premium_label", f"WITH {TRACK_SQL} SELECT as_of, ticker, CASE WHEN prem_mcap_bps > 5 THEN 'Outsized' WHEN prem_mcap_bps >= 1 THEN 'Notable' WHEN prem_mcap_bps >= 0.1 THEN 'Normal' ELSE 'Minor' END AS label FROM board")
def prj32(spark, d):
    return board(spark, d).select("as_of", "ticker", C.premium_label(F.col("prem_mcap_bps")).alias("label"))


@query("prj21_vehicle", f"""WITH {SNAPSHOTS_SQL}, v AS (SELECT ticker, snapshot_date, CASE WHEN net_premium > 0 THEN 'LONG' WHEN net_premium < 0 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction, iv_rank AS iv, CAST(trades % 9 AS INT) AS days, marketcap / 10 AS adv FROM snapshots)
SELECT ticker, snapshot_date, CASE WHEN adv < 20000000 OR direction = 'NEUTRAL' THEN 'STOCK' WHEN (days <= 5 AND iv >= 60) OR iv >= 70 THEN 'DEBIT_SPREAD' WHEN iv >= 0 AND iv < 30 THEN CASE direction WHEN 'LONG' THEN 'LONG_CALL' ELSE 'LONG_PUT' END ELSE 'STOCK' END AS vehicle FROM v""")
def prj21(spark, d):
    way = F.when(F.col("net_premium") > 0, "LONG").when(F.col("net_premium") < 0, "SHORT").otherwise("NEUTRAL")
    return snapshots(spark, d).select("ticker", "snapshot_date", C.vehicle(way, F.col("iv_rank"), (F.col("trades") % 9).cast("int"), F.col("marketcap") / 10).alias("vehicle"))


@query("prj28_atr_plan_gate", f"""WITH {FEAT_SQL}, g AS (SELECT *, CASE i % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'a' WHEN 2 THEN 'B' ELSE 'A' END AS grade, 7 + (i % 5) * 0.5::DOUBLE AS score, CASE WHEN (i // 4) % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction FROM feat)
SELECT ticker, date, CASE WHEN upper(grade) NOT IN ('A', 'A+') THEN 'grade_' || upper(grade) || '_not_promotable' WHEN score < 8 THEN 'score_below_floor' WHEN atr14 <= 0 OR close <= 0 THEN 'atr_or_close_invalid' WHEN direction = 'BULLISH' AND close < ema20 THEN 'long_below_ema20_trend_failed' WHEN direction = 'BEARISH' AND close > ema20 THEN 'short_above_ema20_trend_failed' ELSE '' END AS reason,
  round(close + CASE direction WHEN 'BULLISH' THEN -atr14 ELSE atr14 END, 3) AS stop_price, round(close + CASE direction WHEN 'BULLISH' THEN 3 ELSE -3 END * atr14, 3) AS target_2 FROM g WHERE i >= 5""")
def prj28(spark, d):
    i = F.col("i")
    g = F.when(i % 4 == 0, "A+").when(i % 4 == 1, "a").when(i % 4 == 2, "B").otherwise("A")
    way = F.when(F.floor(i / 4) % 2 == 0, "BULLISH").otherwise("BEARISH")
    sign = F.when(way == "BULLISH", 1).otherwise(-1)
    f = feat(spark, d).filter("i >= 5")
    reason = C.promote_reason(g, 7 + (i % 5) * 0.5, way, F.col("close"), F.col("atr14"), F.col("ema20"))
    return f.select("ticker", "date", reason.alias("reason"), F.round(F.col("close") - sign * F.col("atr14"), 3).alias("stop_price"), F.round(F.col("close") + sign * 3 * F.col("atr14"), 3).alias("target_2"))


@query("jon12_blank_fill", f"WITH {TRACK_SQL}, w AS (SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS INT) % 2 = 0 THEN ' ' ELSE 'kept' END AS checks FROM (SELECT DISTINCT ticker FROM board)), r AS (SELECT ticker, conviction_grade AS checks FROM board QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) = 1) SELECT w.ticker, coalesce(nullif(trim(w.checks), ''), r.checks) AS checks FROM w LEFT JOIN r USING (ticker)")
def jon12(spark, d):
    from ..operators.panels import latest_per_key

    b = board(spark, d)
    w = b.select("ticker").distinct().withColumn("own", F.when(F.substring("ticker", 2, 9).cast("int") % 2 == 0, " ").otherwise("kept"))
    r = latest_per_key(b, ["ticker"], F.desc("as_of")).select("ticker", F.col("conviction_grade").alias("last"))
    return w.join(r, "ticker", "left").select("ticker", F.coalesce(F.nullif(F.trim("own"), F.lit("")), "last").alias("checks"))
