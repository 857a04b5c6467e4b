"""Queries on candidates, open positions and market regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import positions as P
from ..operators import stats as S
from ..operators import tracker as T
from ..sources.fixtures import BARS_SQL, FLOW_SQL, INDEX_SQL, SNAPSHOTS_SQL, index_bars, snapshots, table
from .bar_queries import FEAT_SQL, TREND_SQL, WIN, feat, rows
from .flow_queries import flow
from .registry import ORACLES, QUERIES, query
from .surface_queries import DAILY_SQL, daily, z_sql
from .tracker_queries import TRACK_SQL, _log, board


def clamp_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


def half_sql(x: str, k: int) -> str:
    return f"(floor(({x}) * {10**k} + 0.5::DOUBLE) / {10**k})"


# ---- stack score: weekly snapshots stand for the enriched candidates ------------------------------

STACK_SQL = SNAPSHOTS_SQL + f""",
si AS (SELECT ticker, snapshot_date, CASE WHEN total_bullish_premium >= total_bearish_premium THEN 'LONG' ELSE 'SHORT' END AS direction, iv_rank / 10 AS conviction_score, CAST(call_volume AS DOUBLE) / nullif(call_volume + put_volume, 0) AS dp_bias,
  (total_bullish_premium + total_bearish_premium) / marketcap * 10000 AS dp_bps, CASE WHEN trades % 3 <> 0 THEN (iv_rank - 50) / 10 END AS dp_z, CASE WHEN trades % 5 <> 0 THEN trades % 2 = 0 END AS hot_chain, lottery_bullish_premium + swing_bullish_premium AS call_premium, lottery_bearish_premium + swing_bearish_premium AS put_premium,
  CASE CAST(trades % 4 AS INT) WHEN 0 THEN 'buying' WHEN 1 THEN 'selling' WHEN 2 THEN 'neutral' END AS insider, CASE WHEN sweep_share > 0.6::DOUBLE THEN 'STRENGTH' WHEN sweep_share < 0.4::DOUBLE THEN 'WEAKNESS' ELSE 'FLAT' END AS session_tone,
  multileg_share - 0.2::DOUBLE AS rs_5, sweep_share - 0.5::DOUBLE AS rs_20, CASE WHEN trades % 5 <> 1 THEN (iv_rank - 50) / 5 END AS window_return_pct, CASE CAST(trades % 3 AS INT) WHEN 0 THEN 'chase' WHEN 1 THEN 'suppress' ELSE 'neutral' END AS dealer_bias FROM snapshots),
sp AS (SELECT *, {clamp_sql('coalesce(conviction_score, 0)', 0, 10)} / 10 * 50 AS flow_core,
  CASE WHEN dp_bias IS NULL AND dp_bps = 0 AND dp_z IS NULL THEN 0 ELSE {clamp_sql('''(CASE direction WHEN 'LONG' THEN CASE WHEN coalesce(dp_bias, 0.5) >= 0.6 AND dp_bps >= 5 THEN 12 WHEN coalesce(dp_bias, 0.5) >= 0.6 AND dp_bps >= 1 THEN 9 WHEN coalesce(dp_bias, 0.5) >= 0.55 AND dp_bps >= 1 THEN 5 WHEN coalesce(dp_bias, 0.5) <= 0.4 AND dp_bps >= 1 THEN -4 ELSE 0 END
    ELSE CASE WHEN coalesce(dp_bias, 0.5) <= 0.4 AND dp_bps >= 5 THEN 12 WHEN coalesce(dp_bias, 0.5) <= 0.4 AND dp_bps >= 1 THEN 9 WHEN coalesce(dp_bias, 0.5) <= 0.45 AND dp_bps >= 1 THEN 5 WHEN coalesce(dp_bias, 0.5) >= 0.6 AND dp_bps >= 1 THEN -4 ELSE 0 END END
    + CASE WHEN (direction = 'LONG' AND dp_z >= 2) OR (direction = 'SHORT' AND dp_z <= -2) THEN 3 ELSE 0 END)''', 0, 15)} END AS dp_confirm,
  CASE WHEN hot_chain IS NULL THEN 0 WHEN call_premium = 0 AND put_premium = 0 THEN CASE WHEN hot_chain THEN 5 ELSE 2.5::DOUBLE END WHEN (direction = 'LONG' AND call_premium >= put_premium) OR (direction = 'SHORT' AND put_premium >= call_premium) THEN CASE WHEN hot_chain THEN 10 ELSE 5 END ELSE 0 END AS chain_confirm,
  CASE WHEN (direction = 'LONG' AND insider = 'buying') OR (direction = 'SHORT' AND insider = 'selling') THEN 8 ELSE 0 END AS insider_points,
  CASE direction WHEN 'LONG' THEN greatest(CASE session_tone WHEN 'STRENGTH' THEN 8 ELSE 0 END, CASE WHEN rs_5 > 0 AND rs_20 > 0 THEN 10 WHEN rs_20 > 0 THEN 6 ELSE 0 END, CASE WHEN window_return_pct > 0 THEN least(12, 6 + least(window_return_pct, 6)) ELSE 0 END)
    ELSE greatest(CASE session_tone WHEN 'WEAKNESS' THEN 8 ELSE 0 END, CASE WHEN rs_5 < 0 AND rs_20 < 0 THEN 10 WHEN rs_20 < 0 THEN 6 ELSE 0 END, CASE WHEN window_return_pct < 0 THEN least(12, 6 + least(-window_return_pct, 6)) ELSE 0 END) END AS price_confirm,
  CASE dealer_bias WHEN 'chase' THEN 5 WHEN 'suppress' THEN 1.5::DOUBLE ELSE 0 END AS dealer_regime FROM si),
st AS (SELECT *, {clamp_sql('flow_core + dp_confirm + chain_confirm + insider_points + price_confirm + dealer_regime', 0, 100)} AS total FROM sp)"""


def _stack_input(spark, d):
    s, k = snapshots(spark, d), F.col("trades")
    return s.select(
        "ticker", "snapshot_date", F.when(F.col("total_bullish_premium") >= F.col("total_bearish_premium"), "LONG").otherwise("SHORT").alias("direction"), (F.col("iv_rank") / 10).alias("conviction_score"),
        F.try_divide(F.col("call_volume").cast("double"), F.col("call_volume") + F.col("put_volume")).alias("dp_bias"), ((F.col("total_bullish_premium") + F.col("total_bearish_premium")) / F.col("marketcap") * 10000).alias("dp_bps"),
        F.when(k % 3 != 0, (F.col("iv_rank") - 50) / 10).alias("dp_z"), F.when(k % 5 != 0, k % 2 == 0).alias("hot_chain"),
        (F.col("lottery_bullish_premium") + F.col("swing_bullish_premium")).alias("call_premium"), (F.col("lottery_bearish_premium") + F.col("swing_bearish_premium")).alias("put_premium"),
        F.when(k % 4 == 0, "buying").when(k % 4 == 1, "selling").when(k % 4 == 2, "neutral").alias("insider"), F.when(F.col("sweep_share") > 0.6, "STRENGTH").when(F.col("sweep_share") < 0.4, "WEAKNESS").otherwise("FLAT").alias("session_tone"),
        (F.col("multileg_share") - 0.2).alias("rs_5"), (F.col("sweep_share") - 0.5).alias("rs_20"), F.when(k % 5 != 1, (F.col("iv_rank") - 50) / 5).alias("window_return_pct"), F.when(k % 3 == 0, "chase").when(k % 3 == 1, "suppress").otherwise("neutral").alias("dealer_bias"),
    )


_COLUMN = {k: "insider_points" if k == "insider" else k for k in P.STACK}


def _share_sql(test: str, names: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {half_sql(_COLUMN[k], 2)} / {P.STACK[k]}::DOUBLE {test} THEN '{k}' END" for k in names) + ")"


@query("prj23_conviction_stack", f"""WITH {STACK_SQL} SELECT ticker, snapshot_date, direction, {', '.join(f'round(CAST({c} AS DOUBLE) + 0.0000001, 4) AS {k}' for k, c in _COLUMN.items())}, round(total + 0.0000001, 4) AS raw_score, CASE WHEN total >= 80 THEN 'elite' WHEN total >= 65 THEN 'strong' WHEN total >= 50 THEN 'moderate' ELSE 'weak' END AS tier,
  {_share_sql('>= 0.6', list(P.STACK))} AS drivers, {_share_sql('<= 0.2', [k for k in P.STACK if k != 'flow_core'])} AS drags FROM st""")
def prj23(spark, d):
    s = P.conviction_stack(_stack_input(spark, d))
    return s.select("ticker", "snapshot_date", "direction", *[F.round(F.col(f"stack_{k}") + 1e-7, 4).alias(k) for k in P.STACK], F.round(F.col("raw_score") + 1e-7, 4).alias("raw_score"), "tier", F.array_join("drivers", ",").alias("drivers"), F.array_join("drags", ",").alias("drags"))


# ---- ranked reasons of the tracker's grade --------------------------------------------------------

_PARTS = {"persistence": ("persistence_ratio", 2.5), "intensity": (_log("prem_mcap_bps", "1.0::DOUBLE", "30.0::DOUBLE"), 2.0), "consistency": ("consistency", 2.5), "acceleration": ("greatest(0, least(1, (accel_t + 1) / 3))", 2.0), "mass": (_log("cum_total", "5e5", "5e7"), 0.5)}


@query("prj24_ranked_reasons", f"""WITH {TRACK_SQL}, c AS (SELECT as_of, ticker, {', '.join(f'{top}::DOUBLE * ({x}) AS {n}' for n, (x, top) in _PARTS.items())} FROM board),
u AS ({' UNION ALL '.join(f"SELECT as_of, ticker, {k} AS pos, '{n}' AS part, {n} AS points, {n} / {top}::DOUBLE AS share FROM c" for k, (n, (_, top)) in enumerate(_PARTS.items()))}),
r AS (SELECT *, row_number() OVER (PARTITION BY as_of, ticker ORDER BY points DESC, pos) AS k FROM u), w AS (SELECT *, k <= 3 AND points > 0 AS driver FROM r),
g AS (SELECT as_of, ticker, coalesce(string_agg(part, ',' ORDER BY k) FILTER (driver), '') AS drivers, arg_min(part, (share, pos)) FILTER (NOT driver) AS part, min(share) FILTER (NOT driver) AS share FROM w GROUP BY 1, 2)
SELECT as_of, ticker, drivers, CASE WHEN share < 0.2 THEN part END AS drag FROM g""")
def prj24(spark, d):
    unit = {"persistence": F.col("persistence_ratio"), "intensity": T.log_norm(F.col("prem_mcap_bps"), 1.0, 30.0), "consistency": F.col("consistency"), "acceleration": P.clamp((F.col("accel_t") + 1) / 3, 0, 1), "mass": T.log_norm(F.col("cum_total"), 5e5, 5e7)}
    drivers, drag = P.ranked_reasons({n: (top * unit[n], top) for n, (_, top) in _PARTS.items()})
    return board(spark, d).select("as_of", "ticker", F.array_join(drivers, ",").alias("drivers"), drag.alias("drag"))


# ---- open positions: at each bar, one that was opened five bars before ----------------------------

POS_SQL = FEAT_SQL + TREND_SQL + f""",
po0 AS (SELECT *, CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, lag(close, 5) {WIN} AS e, lag(atr14, 5) {WIN} AS ea, lag(high) {WIN} AS h1, lag(high, 2) {WIN} AS h2, lag(low) {WIN} AS l1, lag(low, 2) {WIN} AS l2, max(high) {rows('4 PRECEDING', '1 PRECEDING')} AS mh, min(low) {rows('4 PRECEDING', '1 PRECEDING')} AS ml FROM trended),
po AS (SELECT ticker, date, i, s, s * e AS en, 1.5::DOUBLE * ea AS risk, s * e - 1.5::DOUBLE * ea AS st, s * e + 3 * ea AS t1, s * e + 4.5::DOUBLE * ea AS t2, CASE WHEN s > 0 THEN greatest(mh, high) ELSE greatest(-ml, -low) END AS best, s * close AS cl, s * ema20 AS em, atr14 AS atr, s * coalesce(ema20_slope, 0) AS slope, trend, strength, i % 9 AS days, i % 4 = 0 AS filled,
  CASE CAST(i % 5 AS INT) WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.1::DOUBLE WHEN 2 THEN 2.3::DOUBLE WHEN 3 THEN 2.1::DOUBLE ELSE 2.4::DOUBLE END AS own, CASE CAST(i // 2 % 3 AS INT) WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS regime, CASE WHEN i % 11 <> 3 THEN s * close + (i % 7 - 1) * 0.4::DOUBLE * atr14 END AS wall,
  i // 3 % 7 - i % 7 AS lost, i % 15 - 7 AS heat, CASE CAST(i % 3 AS INT) WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' END AS unusual, CASE WHEN s > 0 THEN high >= h1 AND h1 >= h2 ELSE low <= l1 AND l1 <= l2 END AS rising, (i % 11) / 10.0::DOUBLE AS prem, CASE WHEN i % 4 <> 3 THEN (i % 10) / 9.0::DOUBLE END AS tick, CASE WHEN i % 5 <> 4 THEN (i % 6) / 5.0::DOUBLE END AS prt, CASE WHEN i % 6 <> 5 THEN (i % 7) * 1.1::DOUBLE END AS wall_pct, i % 8 <> 7 AS known FROM po0 WHERE i >= 5),
pp AS (SELECT *, CASE WHEN lost > 0 THEN least(0.5::DOUBLE * lost, 1.5::DOUBLE) ELSE 0 END AS grade_decay, CASE WHEN s * heat <= -2 THEN least(abs(heat) / 5.0::DOUBLE, 1.5::DOUBLE) ELSE 0 END AS heat_reversal, CASE WHEN unusual = CASE WHEN s > 0 THEN 'BEARISH' ELSE 'BULLISH' END THEN 1.0::DOUBLE ELSE 0 END AS flow_flip,
  CASE WHEN risk > 0 THEN (cl - en) / risk ELSE 0 END AS r, CASE regime WHEN 'NEGATIVE' THEN 1.15::DOUBLE WHEN 'POSITIVE' THEN 0.85::DOUBLE ELSE 1 END AS gm, CASE WHEN wall > en AND atr > 0 THEN (wall - cl) / atr END AS gap FROM po),
pk AS (SELECT *, {clamp_sql('1 - (grade_decay + heat_reversal + flow_flip) / 4', 0, 1)} AS keep, CASE WHEN gap > 0 AND gap < 1.5 THEN 1 - gap / 1.5::DOUBLE ELSE 0 END AS blend FROM pp),
pm AS (SELECT *, (own * keep + 2 * (1 - keep)) * gm * (1 - blend) + 2 * gm * blend AS mult FROM pk),
pt AS (SELECT *, greatest(best - mult * atr, st) AS ta, greatest(CASE WHEN days >= 4 AND r < 0.5 THEN en WHEN r < 1 THEN st WHEN r < 2 THEN en ELSE best - 2 * gm * atr END, st) AS th, CASE WHEN filled THEN greatest(t1 - atr, st) END AS tp FROM pm),
ps AS (SELECT *, greatest(ta, em, th, tp) AS active FROM pt),
ph AS (SELECT *, CASE WHEN trend = CASE WHEN s > 0 THEN 'LONG' ELSE 'SHORT' END THEN 2 + least(strength, 1) WHEN trend = 'NEUTRAL' AND slope > 0 THEN 1.5::DOUBLE WHEN trend = 'NEUTRAL' THEN 0.5::DOUBLE ELSE 0 END AS h_trend,
  CASE WHEN cl > st THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN atr > 0 AND (cl - active) / atr > 0.5 THEN 1 ELSE 0 END AS h_structure, CASE WHEN slope > 0 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN rising THEN 1 ELSE 0 END AS h_momentum,
  CASE WHEN t2 - en <= 0 THEN 0.5::DOUBLE ELSE {half_sql(clamp_sql('(cl - en) / (t2 - en)', 0, 1), 3)} END AS h_target, CASE WHEN s > 0 THEN prem ELSE 1 - prem END AS a0, CASE WHEN s > 0 THEN tick ELSE 1 - tick END AS a1, CASE WHEN s > 0 THEN prt ELSE 1 - prt END AS a2,
  CASE WHEN risk > 0 THEN CASE WHEN days > 3 AND (cl - en) / risk < 0.5 THEN 1 ELSE 0 END + CASE WHEN days > 5 AND (cl - en) / risk < 1 THEN 1 ELSE 0 END ELSE 0 END AS h_decay, CASE WHEN atr > 0 AND (cl - active) / atr < 0.5 THEN 2 ELSE 0 END AS h_stop FROM ps),
pa AS (SELECT *, CASE WHEN a1 IS NOT NULL THEN 0.6::DOUBLE * a0 + 0.4::DOUBLE * a1 ELSE a0 END AS b1 FROM ph),
pb AS (SELECT *, CASE WHEN known THEN {half_sql(f"CASE WHEN a2 IS NOT NULL THEN 0.8::DOUBLE * b1 + 0.2::DOUBLE * a2 ELSE b1 END + (CASE WHEN wall_pct IS NULL THEN 0.5::DOUBLE ELSE {clamp_sql('(wall_pct - 1) / 4', 0, 1)} END + CASE WHEN regime = CASE WHEN s > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END THEN 1 WHEN regime <> 'NEUTRAL' THEN 0 ELSE 0.5::DOUBLE END) / 2", 3)} ELSE 1 END AS h_options FROM pa),
pos AS (SELECT *, {half_sql(clamp_sql('h_trend + h_structure + h_momentum + h_target + h_options - h_decay - h_stop - (grade_decay + heat_reversal + flow_flip)', 0, 10), 2)} AS health, {half_sql(clamp_sql('h_trend + h_structure + h_momentum + h_target + h_options - h_decay - h_stop - (grade_decay + heat_reversal + flow_flip)', 0, 10), 6)} AS h6 FROM pb)"""


def _positions(spark, d):
    i = F.col("i")
    grades = F.array(*map(F.lit, P.GRADES))
    grade = lambda n: F.element_at(grades, (n % 7 + 1).cast("int"))
    lag = lambda c, k: F.lag(c, k).over(B.W())
    f = feat(spark, d).withColumns({
        **B.trend(), "direction": F.when(i % 2 == 0, "LONG").otherwise("SHORT"), "entry_price": lag("close", 5), "_ea": lag("atr14", 5), "_top": F.max("high").over(B.rows(-4, -1)), "_bottom": F.min("low").over(B.rows(-4, -1)),
        "_up": (F.col("high") >= lag("high", 1)) & (lag("high", 1) >= lag("high", 2)), "_dn": (F.col("low") <= lag("low", 1)) & (lag("low", 1) <= lag("low", 2)),
    }).filter("i >= 5")
    long_, ea = F.col("direction") == "LONG", F.col("_ea")
    s = F.when(long_, 1.0).otherwise(-1.0)
    k5, k3, u = i % 5, F.floor(i / 2) % 3, i % 3
    return f.withColumns({
        "risk_per_share": 1.5 * ea, "initial_stop": F.col("entry_price") - s * 1.5 * ea, "target_1": F.col("entry_price") + s * 3 * ea, "target_2": F.col("entry_price") + s * 4.5 * ea, "best_price": F.when(long_, F.col("_top")).otherwise(F.col("_bottom")),
        "days_held": i % 9, "partial_filled": i % 4 == 0, "bucket": F.when(k5 == 0, "lottery").when(k5 == 1, "swing").when(k5 == 2, "position").when(k5 == 3, "leap"), "gamma_regime": F.when(k3 == 0, "NEGATIVE").when(k3 == 1, "POSITIVE").otherwise("NEUTRAL"),
        "wall": F.when(i % 11 != 3, F.col("close") + s * (i % 7 - 1) * 0.4 * F.col("atr14")), "entry_grade": grade(F.floor(i / 3)), "current_grade": grade(i), "sector_heat": (i % 15 - 7).cast("double"), "unusual_flow": F.when(u == 0, "BULLISH").when(u == 1, "BEARISH"),
        "rising": F.when(long_, F.col("_up")).otherwise(F.col("_dn")), "premium_share": i % 11 / 10.0, "tick_share": F.when(i % 4 != 3, i % 10 / 9.0), "print_share": F.when(i % 5 != 4, i % 6 / 5.0), "wall_pct": F.when(i % 6 != 5, i % 7 * 1.1), "options_known": i % 8 != 7,
    })


_TRAILS = {"best_price": "best", "trail_atr": "ta", "trail_ema": "em", "trail_hybrid": "th", "trail_post_t1": "tp", "active_stop": "active"}


@query("win37_trailing_stops", f"WITH {POS_SQL} SELECT ticker, date, {', '.join(f'round(s * {c} + 0.000001, 3) AS {n}' for n, c in _TRAILS.items())}, round(r, 4) + 0 AS unrealized_r, round(keep, 4) AS flow_decay_factor FROM pos")
def win37(spark, d):
    t = P.trailing_stops(_positions(spark, d))
    return t.select("ticker", "date", *[F.round(F.col(c) + 1e-6, 3).alias(c) for c in _TRAILS], (F.round("unrealized_r", 4) + F.lit(0.0)).alias("unrealized_r"), F.round("flow_decay_factor", 4).alias("flow_decay_factor"))


_HEALTH = ("h_trend", "h_structure", "h_momentum", "h_target", "h_options", "h_decay", "h_stop")


@query("win36_position_health", f"WITH {POS_SQL} SELECT ticker, date, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _HEALTH)}, grade_decay + heat_reversal + flow_flip AS flow_penalty, health, CASE WHEN h6 >= 7 THEN 'STRONG' WHEN h6 >= 4 THEN 'NEUTRAL' WHEN h6 >= 2 THEN 'WEAK' ELSE 'FAILING' END AS health_state FROM pos")
def win36(spark, d):
    h = P.position_health(P.trailing_stops(_positions(spark, d)))
    return h.select("ticker", "date", *_HEALTH, (F.col("h_grade_decay") + F.col("h_heat_reversal") + F.col("h_flow_flip")).alias("flow_penalty"), "health", "health_state")


# ---- regimes of the benchmark's weeks -------------------------------------------------------------

REGIME_SQL = INDEX_SQL + ", ibars AS (SELECT 'INDEX' AS ticker, * FROM index_bars)" + FEAT_SQL[len(BARS_SQL):].replace("FROM bars", "FROM ibars") + f""",
td AS (SELECT CAST(date_trunc('week', event_ts) AS DATE) AS date, coalesce(sum(premium) FILTER (direction = 'LONG'), 0) / sum(premium) AS tide FROM flow GROUP BY 1),
rg0 AS (SELECT feat.*, CASE WHEN i % 17 <> 16 THEN 10 + adx END AS vix, 10 + avg(adx) {rows('3 PRECEDING', 'CURRENT ROW')} AS vix3m, tide FROM feat LEFT JOIN td USING (date)),
rg1 AS (SELECT *, {half_sql(f"(CASE WHEN close > ema20 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN ema20 > ema50 THEN 1.0::DOUBLE ELSE 0 END + {clamp_sql('(coalesce(ema20_slope, 0) + 2) / 4', 0, 1)}) / 3", 4)} AS alignment, CASE WHEN vix IS NULL THEN 0.5::DOUBLE ELSE {half_sql(clamp_sql('(35 - vix) / 23', 0, 1), 4)} END AS vix_part,
  {half_sql(clamp_sql('(0.025::DOUBLE - atr14 / close) / 0.02::DOUBLE', 0, 1), 4)} AS calm_part, coalesce(tide, 0.5) AS tide_part, CASE WHEN close > ema20 AND ema20 > ema50 THEN 'BULLISH' WHEN close < ema20 AND ema20 < ema50 THEN 'BEARISH' ELSE 'NEUTRAL' END AS market_trend FROM rg0),
rg AS (SELECT *, {half_sql('(alignment + vix_part + calm_part + tide_part) / 4', 4)} AS regime_score, CASE WHEN vix >= 30 THEN 0.5::DOUBLE WHEN vix >= 20 THEN 0.75::DOUBLE ELSE 1 END AS vix_sizing FROM rg1)"""


def _regime(spark, d):
    w = F.to_date(F.date_trunc("week", "event_ts")).alias("date")
    tide = flow(spark, d).groupBy(w).agg((F.coalesce(F.sum(F.when(F.col("direction") == "LONG", F.col("premium"))), F.lit(0.0)) / F.sum("premium")).alias("tide"))
    f = B.features(index_bars(spark, d).withColumn("ticker", F.lit("INDEX")))
    f = f.withColumns({"vix": F.when(F.col("i") % 17 != 16, 10 + F.col("adx")), "vix3m": 10 + F.avg("adx").over(B.rows(-3, 0))})
    return P.market_regime(f.join(tide, "date", "left"))


@query("win38_market_regime", f"WITH {REGIME_SQL} SELECT date, alignment, vix_part, calm_part, round(tide_part, 6) AS tide_part, round(regime_score, 3) AS regime_score, market_trend, vix_sizing FROM rg")
def win38(spark, d):
    return _regime(spark, d).select("date", "alignment", "vix_part", "calm_part", F.round("tide_part", 6).alias("tide_part"), F.round("regime_score", 3).alias("regime_score"), "market_trend", "vix_sizing")


_WARN = {"term": ("vix > 0 AND vix3m > 0 AND vix3m / vix < 1", 0.85), "trend": ("market_trend = 'BEARISH'", 0.9), "rsi": ("rsi14 >= 70 OR rsi14 <= 30", 0.9), "heat": ("heat_pct >= 3", 0.5), "sector": ("same_sector >= 3", 0.75), "direction": ("same_direction >= 6", 0.75)}


@query("win39_risk_regime", f"""WITH {REGIME_SQL}, k AS (SELECT *, CASE WHEN i % 11 <> 10 THEN (i % 13) * 0.45::DOUBLE END AS heat_pct, i % 5 AS same_sector, i % 8 AS same_direction, CASE WHEN i * 7 % 43 < 30 THEN i * 7 % 43 - 4 END AS fomc_days, CASE WHEN i * 5 % 31 < 28 THEN i * 5 % 31 - 2 END AS cpi_days, i * 3 % 23 AS nfp_days FROM rg),
c AS (SELECT *, {', '.join(f'coalesce({t}, false) AS w_{n}' for n, (t, _) in _WARN.items())}, CASE WHEN fomc_days BETWEEN 0 AND 1 THEN 'FOMC' || CASE WHEN fomc_days = 0 THEN ' today' ELSE ' tomorrow' END WHEN cpi_days BETWEEN 0 AND 1 THEN 'CPI' || CASE WHEN cpi_days = 0 THEN ' today' ELSE ' tomorrow' END WHEN nfp_days BETWEEN 0 AND 1 THEN 'NFP' || CASE WHEN nfp_days = 0 THEN ' today' ELSE ' tomorrow' END END AS halt_reason,
  coalesce(fomc_days BETWEEN 0 AND 3, false) OR coalesce(cpi_days BETWEEN 0 AND 3, false) OR nfp_days BETWEEN 0 AND 3 AS w_event, CASE WHEN coalesce(vix, 0) < 18 THEN 1.0::DOUBLE WHEN vix < 24 THEN 0.75::DOUBLE WHEN vix < 35 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS base, CASE WHEN coalesce(vix, 0) < 18 THEN 0 WHEN vix < 24 THEN 1 WHEN vix < 35 THEN 2 ELSE 3 END AS rank FROM k),
m AS (SELECT *, coalesce(heat_pct >= 5, false) OR halt_reason IS NOT NULL AS stopped, greatest(rank, CASE WHEN w_term OR w_heat THEN 1 ELSE 0 END) AS bumped, least(base{''.join(f' * CASE WHEN w_{n} THEN {f}::DOUBLE ELSE 1 END' for n, (_, f) in _WARN.items())}, base) AS m FROM c),
t AS (SELECT *, CASE WHEN stopped THEN 0 ELSE m END AS mult, CASE WHEN stopped OR bumped = 3 THEN 3 WHEN m < 0.4 THEN greatest(bumped, 2) WHEN m < 0.7 THEN greatest(bumped, 1) ELSE bumped END AS worst FROM m)
SELECT date, ['calm', 'elevated', 'panic', 'halt'][worst + 1] AS risk_tier, {half_sql('mult', 3)} AS multiplier, CAST(CASE WHEN worst = 3 THEN 0 ELSE {half_sql('mult * 100', 0)} END AS INT) AS risk_score, halt_reason, concat_ws(',', {', '.join(f"CASE WHEN w_{n} THEN '{n}' END" for n in (*_WARN, 'event'))}) AS warnings FROM t""")
def win39(spark, d):
    i = F.col("i")
    x = _regime(spark, d).withColumns({
        "rsi": F.col("rsi14"), "heat_pct": F.when(i % 11 != 10, i % 13 * 0.45), "same_sector": i % 5, "same_direction": i % 8, "fomc_days": F.when(i * 7 % 43 < 30, i * 7 % 43 - 4), "cpi_days": F.when(i * 5 % 31 < 28, i * 5 % 31 - 2), "nfp_days": i * 3 % 23,
    })
    return P.risk_regime(x).select("date", "risk_tier", "multiplier", "risk_score", "halt_reason", F.array_join("warnings", ",").alias("warnings"))


# ---- bonuses, streaks, prints, exposures ----------------------------------------------------------

_BONUS = ("options_bonus", "ticks_bonus", "prints_bonus", "earnings_penalty", "insider_bonus")


@query("prj29_alignment_bonuses", f"""WITH {STACK_SQL}, v AS (SELECT *, CASE WHEN trades % 7 <> 3 THEN total_bullish_premium END AS bp, CASE WHEN trades % 7 <> 3 THEN total_bearish_premium END AS sp, call_volume / nullif(avg(call_volume) OVER w, 0) AS ca, put_volume / nullif(avg(put_volume) OVER w, 0) AS pa, CASE WHEN trades % 4 <> 1 THEN sweep_share END AS tick, (iv_rank - 50) / 100 AS mo, CAST(trades % 12 AS INT) AS de FROM snapshots WINDOW w AS (PARTITION BY ticker ORDER BY snapshot_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
j AS (SELECT v.*, si.direction, si.insider, si.dp_bias, si.conviction_score AS final_score FROM v JOIN si USING (ticker, snapshot_date)),
b AS (SELECT ticker, snapshot_date, final_score, (CASE WHEN bp + sp > 0 THEN CASE direction WHEN 'LONG' THEN bp ELSE sp END / (bp + sp) ELSE 0.5::DOUBLE END) * 0.06::DOUBLE + coalesce(CASE WHEN CASE direction WHEN 'LONG' THEN ca ELSE pa END IS NULL THEN NULL ELSE least(CASE direction WHEN 'LONG' THEN ca ELSE pa END, 3) / 3 END, 0.5::DOUBLE) * 0.05::DOUBLE AS options_bonus,
  coalesce(0.056::DOUBLE * CASE direction WHEN 'LONG' THEN tick ELSE 1 - tick END + 0.13::DOUBLE * greatest(0, CASE direction WHEN 'LONG' THEN mo ELSE -mo END), 0) AS ticks_bonus, coalesce(0.05::DOUBLE * CASE direction WHEN 'LONG' THEN dp_bias ELSE 1 - dp_bias END, 0) AS prints_bonus, CASE WHEN de <= 5 THEN -0.5::DOUBLE ELSE 0 END AS earnings_penalty,
  CASE WHEN ((direction = 'LONG' AND insider = 'buying') OR (direction = 'SHORT' AND insider = 'selling')) AND bp + sp >= 50000 THEN 0.3::DOUBLE ELSE 0 END AS insider_bonus FROM j)
SELECT ticker, snapshot_date, {', '.join(f'round({c} + 0.000000137, 5) AS {c}' for c in _BONUS)}, round(final_score + options_bonus + ticks_bonus + prints_bonus + earnings_penalty + insider_bonus + 0.000000137, 4) AS aligned_score FROM b""")
def prj29(spark, d):
    w = Window.partitionBy("ticker").orderBy("snapshot_date").rowsBetween(-30, -1)
    k = F.col("trades")
    over = lambda c: F.try_divide(F.col(c), F.nullif(F.avg(c).over(w), F.lit(0.0)))
    v = snapshots(spark, d).select(
        "ticker", "snapshot_date", F.when(k % 7 != 3, F.col("total_bullish_premium")).alias("bullish_premium"), F.when(k % 7 != 3, F.col("total_bearish_premium")).alias("bearish_premium"), over("call_volume").alias("call_vs_avg"), over("put_volume").alias("put_vs_avg"),
        F.when(k % 4 != 1, F.col("sweep_share")).alias("tick_share"), ((F.col("iv_rank") - 50) / 100).alias("momentum"), (k % 12).alias("days_to_earnings"),
    )
    c = _stack_input(spark, d).select("ticker", "snapshot_date", "direction", "insider", F.col("dp_bias").alias("print_share"), F.col("conviction_score").alias("final_score"))
    j = v.join(c, ["ticker", "snapshot_date"]).withColumn("insider_buy_notional", F.col("bullish_premium") + F.col("bearish_premium"))
    a = P.alignment_bonuses(j)
    return a.select("ticker", "snapshot_date", *[F.round(F.col(n) + 1.37e-7, 5).alias(n) for n in _BONUS], F.round(F.col("aligned_score") + 1.37e-7, 4).alias("aligned_score"))


@query("win33_freight_train", f"""WITH w AS ({ORACLES['win32_streak_trend']}), h AS ({ORACLES['agg13_sector_heat']}), s AS (SELECT 'S' || s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT w.*, sector, d.direction FROM w LEFT JOIN s USING (ticker), (VALUES ('LONG'), ('SHORT')) d(direction))
SELECT x.ticker, x.direction, x.sector, n, flow_trend, sector_heat_score AS heat, coalesce(n >= 4 AND mean_flow >= 0.5 AND flow_trend = 'rising' AND (coalesce(sector_heat_score, 0) >= 5 OR coalesce(list_contains(string_split(top_tickers, ','), x.ticker), false)), false) AS freight_train FROM x LEFT JOIN h ON h.sector = x.sector AND h.direction = x.direction""")
def win33(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"))
    s = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), "sector")
    x = QUERIES["win32_streak_trend"](spark, d).join(s, "ticker", "left").withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    return P.freight_train(x, QUERIES["agg13_sector_heat"](spark, d)).select("ticker", "direction", "sector", "n", "flow_trend", "heat", "freight_train")


@query("sta5_print_z_tier", f"""WITH {DAILY_SQL}, h AS (SELECT ticker, date, total_notional AS v FROM dp WHERE date >= (SELECT max(date) FROM dp) - 45),
om AS (SELECT ticker, median(v) AS m, count(*) AS n FROM h GROUP BY 1), own AS (SELECT h.ticker, any_value(m) AS m, median(abs(v - m)) AS d, any_value(n) AS n, arg_max(v, date) AS v FROM h JOIN om USING (ticker) GROUP BY 1),
c AS (SELECT 1 AS k, v FROM h WHERE date = (SELECT max(date) FROM h) UNION ALL SELECT 2, v FROM h), cm AS (SELECT k, median(v) AS m, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 10), cs AS (SELECT k, any_value(m) AS m, median(abs(v - m)) AS d FROM c JOIN cm USING (k) GROUP BY 1),
p AS (SELECT arg_min(m, k) AS pm, arg_min(d, k) AS pd FROM cs), sc AS (SELECT median(abs(v)) AS scale FROM h), j AS (SELECT own.*, pm, pd, scale FROM own, p, sc), t AS (SELECT *, CASE WHEN n >= 20 THEN 1 WHEN n >= 5 AND pd IS NOT NULL THEN 2 WHEN pm IS NOT NULL THEN 3 ELSE 4 END AS tier FROM j)
SELECT ticker, round(v, 2) AS notional, n, tier, round(CASE tier WHEN 1 THEN {z_sql('v', 'm', 'd')} WHEN 2 THEN {z_sql('v', 'm', '((n * d + 10 * pd) / (n + 10))')} WHEN 3 THEN {z_sql('v', 'pm', 'pd')} END, 6) + 0 AS z FROM t""")
def sta5(spark, d):
    z = S.print_z_tier(daily(spark, d).select("ticker", "date", F.col("total_notional").alias("v")))
    return z.select("ticker", F.round("v", 2).alias("notional"), "n", "tier", (F.round("z", 6) + F.lit(0.0)).alias("z"))


EXPOSURE_SQL = FLOW_SQL + ", g AS (SELECT ticker, event_ts, " + ", ".join(f"sum({x}) FILTER (option_type = 'CALL') AS call_{n}, -sum({x}) FILTER (option_type = 'PUT') AS put_{n}" for n, x in (("gamma", "volume"), ("vanna", "open_interest"), ("charm", "premium"))) + " FROM flow GROUP BY 1, 2)"


@query("opt9_latest_exposures", f"""WITH {EXPOSURE_SQL} SELECT ticker, max(event_ts) AS as_of, {', '.join(f"round(arg_max(CASE WHEN call_{n} IS NULL AND put_{n} IS NULL THEN -1e300 ELSE coalesce(call_{n}, 0) + coalesce(put_{n}, 0) END, event_ts), 4) AS {n}_x" for n in ('gamma', 'vanna', 'charm'))} FROM g GROUP BY 1""".replace("SELECT ticker, max", "SELECT * EXCLUDE (gamma_x, vanna_x, charm_x), nullif(gamma_x, -1e300) AS net_gamma, nullif(vanna_x, -1e300) AS net_vanna, nullif(charm_x, -1e300) AS net_charm FROM (SELECT ticker, max") + ")")
def opt9(spark, d):
    return P.latest_exposures(exposures(spark, d)).select("ticker", "as_of", *[F.round(f"net_{n}", 4).alias(f"net_{n}") for n in ("gamma", "vanna", "charm")])


def exposures(spark, d):
    """Call and put greeks per ticker and minute: volume, open interest and premium stand for them, puts negative."""
    put = F.col("option_type") == "PUT"
    cols = {"gamma": F.col("volume").cast("double"), "vanna": F.col("open_interest").cast("double"), "charm": F.col("premium")}
    return flow(spark, d).groupBy("ticker", "event_ts").agg(*[F.sum(F.when(~put, x)).alias(f"call_{n}") for n, x in cols.items()], *[(-F.sum(F.when(put, x))).alias(f"put_{n}") for n, x in cols.items()])
