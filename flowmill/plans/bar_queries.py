"""Queries on price bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources.fixtures import BARS_SQL, INDEX_SQL, bars, flow_events, index_bars
from .registry import query

WIN = "OVER (PARTITION BY ticker ORDER BY date)"


def rows(a: str, b: str) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {a} AND {b})"


SOFAR = rows("UNBOUNDED PRECEDING", "CURRENT ROW")


def ewm_sql(x: str, alpha: str) -> str:
    return f"(pow(1 - {alpha}, i) * (first_value({x}) {SOFAR} + {alpha} * sum(CASE WHEN i = 0 THEN 0 ELSE {x} * pow(1 - {alpha}, -i) END) {SOFAR}))"


def after_sql(x: str) -> str:
    a = "(1::DOUBLE / 14)"
    return f"CASE WHEN i >= 1 THEN pow(1 - {a}, i - 1) * (first_value({x} IGNORE NULLS) {SOFAR} + {a} * coalesce(sum(CASE WHEN i >= 2 THEN {x} * pow(1 - {a}, 1 - i) END) {SOFAR}, 0)) END"


A = "(1::DOUBLE / 14)"
FEAT_SQL = BARS_SQL + f""",
f0 AS (SELECT *, row_number() {WIN} - 1 AS i, lag(close) {WIN} AS prev_close, high - lag(high) {WIN} AS dh, lag(low) {WIN} - low AS dl FROM bars),
f1 AS (SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr, greatest(dh, 0) AS up, greatest(dl, 0) AS down,
  CASE WHEN count(volume) {rows('19 PRECEDING', 'CURRENT ROW')} = 20 THEN avg(volume) {rows('19 PRECEDING', 'CURRENT ROW')} END AS vol_ma20,
  CASE WHEN i > 0 THEN greatest(close - prev_close, 0) END AS gain, CASE WHEN i > 0 THEN greatest(prev_close - close, 0) END AS loss FROM f0),
f2 AS (SELECT *, CASE WHEN i > 0 AND up > down THEN up ELSE 0 END AS plus FROM f1),
f3 AS (SELECT *, CASE WHEN i > 0 AND down > plus THEN down ELSE 0 END AS minus FROM f2),
f4 AS (SELECT *, {ewm_sql('tr', A)} AS atr14, {ewm_sql('close', '(2::DOUBLE / 21)')} AS ema20, {ewm_sql('close', '(2::DOUBLE / 51)')} AS ema50, CAST(volume AS DOUBLE) / nullif(vol_ma20, 0) AS rel_volume,
  {ewm_sql('plus', A)} AS sp, {ewm_sql('minus', A)} AS sm, {after_sql('gain')} AS g, {after_sql('loss')} AS l FROM f3),
f5 AS (SELECT *, 100 * CASE WHEN atr14 <> 0 THEN sp / atr14 END AS pdi, 100 * CASE WHEN atr14 <> 0 THEN sm / atr14 END AS mdi FROM f4),
f6 AS (SELECT *, coalesce(abs(pdi - mdi) / CASE WHEN pdi + mdi = 0 THEN 1e-9 ELSE pdi + mdi END * 100, 0) AS dx FROM f5),
feat AS (SELECT *, {ewm_sql('dx', A)} AS adx, CASE WHEN atr14 <> 0 THEN (ema20 - lag(ema20, 5) {WIN}) / atr14 END AS ema20_slope, CASE WHEN atr14 <> 0 THEN (ema50 - lag(ema50, 5) {WIN}) / atr14 END AS ema50_slope,
  CASE WHEN i >= 14 AND l <> 0 THEN 100 - 100 / (1 + g / l) END AS rsi14 FROM f6)"""


def feat(spark, d):
    return B.features(bars(spark, d))


def _rounded(df, names, k=5):
    return df.select("ticker", "date", *[(F.round(c, k) + F.lit(0.0)).alias(c) for c in names])


def _rsql(names, k=5):
    return "ticker, date, " + ", ".join(f"round({c}, {k}) + 0 AS {c}" for c in names)


for _name, _cols in {
    "win1_ema": ("ema20", "ema50"), "win2_atr": ("tr", "atr14"), "win3_adx": ("adx", "ema20_slope", "ema50_slope"), "win4_relative_volume": ("vol_ma20", "rel_volume"), "win5_rsi": ("rsi14",),
}.items():
    query(_name, f"WITH {FEAT_SQL} SELECT {_rsql(_cols)} FROM feat")(lambda spark, d, c=_cols: _rounded(feat(spark, d), c))


@query("src4_clean_bars", f"""WITH {BARS_SQL}, raw AS (SELECT ticker, date, CAST(open AS VARCHAR) AS open, CASE WHEN volume % 17 = 0 THEN 'n/a' ELSE CAST(high AS VARCHAR) END AS high, low, close, volume FROM bars)
SELECT ticker, date, TRY_CAST(open AS DOUBLE) AS open, TRY_CAST(high AS DOUBLE) AS high, low, close, volume FROM raw WHERE TRY_CAST(high AS DOUBLE) IS NOT NULL""")
def src4(spark, d):
    raw = bars(spark, d).withColumn("open", F.col("open").cast("string")).withColumn("high", F.when(F.col("volume") % 17 == 0, "n/a").otherwise(F.col("high").cast("string")))
    return B.clean(raw).select("ticker", "date", "open", "high", "low", "close", "volume")


TREND_SQL = """, tr0 AS (SELECT *, round(0.6::DOUBLE * greatest(0, least((coalesce(adx, 0) - 15) / 25, 1)) + 0.4::DOUBLE * greatest(0, least(abs(coalesce(ema20_slope, 0)) / 2, 1)), 3) AS st,
  i >= 1 AND close > ema20 AND ema20 > ema50 AS up_, i >= 1 AND close < ema20 AND ema20 < ema50 AS dn_, i >= 1 AND close > ema50 AND coalesce(ema50_slope, 0) > 0 AS ri_, i >= 1 AND close < ema50 AND coalesce(ema50_slope, 0) < 0 AS fa_ FROM feat),
trended AS (SELECT *, CASE WHEN up_ THEN 'LONG' WHEN dn_ THEN 'SHORT' WHEN ri_ THEN 'LONG' WHEN fa_ THEN 'SHORT' ELSE 'NEUTRAL' END AS trend, CASE WHEN up_ OR dn_ THEN st WHEN ri_ OR fa_ THEN floor(st * 700::DOUBLE + 0.5::DOUBLE) / 1000 ELSE 0 END AS strength FROM tr0)"""


@query("win6_trend", f"WITH {FEAT_SQL}{TREND_SQL} SELECT ticker, date, trend, round(strength, 3) AS strength FROM trended")
def win6(spark, d):
    t = feat(spark, d).withColumns(B.trend())
    return t.select("ticker", "date", "trend", F.round("strength", 3).alias("strength"))


@query("win7_pivots", f"""WITH {BARS_SQL}, p AS (SELECT *, count(*) {rows('3 PRECEDING', '3 FOLLOWING')} = 7 AS full_, max(high) {rows('3 PRECEDING', '3 FOLLOWING')} AS hi, min(low) {rows('3 PRECEDING', '3 FOLLOWING')} AS lo FROM bars)
SELECT ticker, date, full_ AND high = hi AS pivot_high, full_ AND low = lo AS pivot_low FROM p""")
def win7(spark, d):
    return bars(spark, d).select("ticker", "date", *[c.alias(k) for k, c in B.pivots().items()])


@query("win13_candles", f"""WITH {BARS_SQL}, c AS (SELECT *, high - low AS span, CASE WHEN close = open THEN 1e-9 ELSE abs(close - open) END AS body, least(open, close) - low AS under, high - greatest(open, close) AS over_ FROM bars)
SELECT ticker, date, span > 0 AND close > open AND coalesce((close - low) / nullif(span, 0) >= 0.75, false) AS bull_strong_close, span > 0 AND close < open AND coalesce((high - close) / nullif(span, 0) >= 0.75, false) AS bear_strong_close,
  span > 0 AND under >= 1.5::DOUBLE * body AND under > over_ AND close > low + span * 0.5::DOUBLE AS bull_wick, span > 0 AND over_ >= 1.5::DOUBLE * body AND over_ > under AND close < low + span * 0.5::DOUBLE AS bear_wick FROM c""")
def win13(spark, d):
    return bars(spark, d).select("ticker", "date", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in B.candles().items()])


@query("win14_volume_rules", f"""WITH {FEAT_SQL} SELECT ticker, date, coalesce(i >= 3 AND avg(rel_volume) {rows('3 PRECEDING', '1 PRECEDING')} <= 1.1, false) AS light_pullback, coalesce(rel_volume >= 1.0, false) AS volume_confirmed FROM feat""")
def win14(spark, d):
    return feat(spark, d).select("ticker", "date", *[c.alias(k) for k, c in B.volume_rules().items()])


@query("win16_flag_break", f"""WITH {FEAT_SQL}, g AS (SELECT *, max(high) {rows('4 PRECEDING', '1 PRECEDING')} AS top, min(low) {rows('4 PRECEDING', '1 PRECEDING')} AS bottom FROM feat)
SELECT ticker, date, coalesce(i >= 4 AND atr14 > 0 AND top - bottom <= 1.5::DOUBLE * atr14 AND rel_volume >= 1 AND close > top, false) AS flag_breakout, coalesce(i >= 4 AND atr14 > 0 AND top - bottom <= 1.5::DOUBLE * atr14 AND rel_volume >= 1 AND close < bottom, false) AS flag_breakdown FROM g""")
def win16(spark, d):
    return feat(spark, d).select("ticker", "date", *[c.alias(k) for k, c in B.flags().items()])


@query("win18_measured_moves", f"""WITH {FEAT_SQL}, g AS (SELECT *, max(high) {rows('9 PRECEDING', '5 PRECEDING')} - min(low) {rows('9 PRECEDING', '5 PRECEDING')} AS pole, max(high) {rows('4 PRECEDING', '1 PRECEDING')} AS top, min(low) {rows('4 PRECEDING', '1 PRECEDING')} AS bottom,
  max(high) {rows('20 PRECEDING', '1 PRECEDING')} AS ceil_, min(low) {rows('20 PRECEDING', '1 PRECEDING')} AS floor_ FROM feat)
SELECT ticker, date, round(top + pole, 4) AS flag_long, round(bottom - pole, 4) AS flag_short, round(close + (ceil_ - floor_), 4) AS range_long, round(close - (ceil_ - floor_), 4) AS range_short FROM g WHERE i >= 20""")
def win18(spark, d):
    f = feat(spark, d)
    pole = F.max("high").over(B.rows(-9, -5)) - F.min("low").over(B.rows(-9, -5))
    span = F.max("high").over(B.rows(-20, -1)) - F.min("low").over(B.rows(-20, -1))
    out = f.select("ticker", "date", "i", F.round(F.max("high").over(B.rows(-4, -1)) + pole, 4).alias("flag_long"), F.round(F.min("low").over(B.rows(-4, -1)) - pole, 4).alias("flag_short"), F.round(F.col("close") + span, 4).alias("range_long"), F.round(F.col("close") - span, 4).alias("range_short"))
    return out.filter("i >= 20").drop("i")


@query("win22_clean_trend", f"""WITH {FEAT_SQL}, c AS (SELECT *, low > lag(low) {WIN} AS hl, high < lag(high) {WIN} AS lh FROM feat),
n AS (SELECT *, i >= 10 AND count(*) FILTER (hl) {rows('9 PRECEDING', 'CURRENT ROW')} >= 6 AS clean_long, i >= 10 AND count(*) FILTER (lh) {rows('9 PRECEDING', 'CURRENT ROW')} >= 6 AS clean_short FROM c)
SELECT ticker, date, clean_long, clean_short, clean_long AND close >= ema20 AND ema20 >= ema50 AS sustained_long, clean_short AND close <= ema20 AND ema20 <= ema50 AS sustained_short FROM n""")
def win22(spark, d):
    names = ("clean_long", "clean_short", "sustained_long", "sustained_short")
    return B.with_clean_trend(feat(spark, d)).select("ticker", "date", *[F.coalesce(c, F.lit(False)).alias(c) for c in names])


@query("win23_relative_strength", f"""WITH {INDEX_SQL}, x AS (SELECT date, close / lag(close, 5) OVER (ORDER BY date) - 1 AS x5, close / lag(close, 20) OVER (ORDER BY date) - 1 AS x20 FROM index_bars),
r AS (SELECT ticker, date, close / lag(close, 5) {WIN} - 1 AS r5, close / lag(close, 20) {WIN} - 1 AS r20 FROM bars)
SELECT ticker, date, round((r5 - x5) * 100, 2) + 0 AS rs_5_pct, round((r20 - x20) * 100, 2) + 0 AS rs_20_pct FROM r LEFT JOIN x USING (date)""")
def win23(spark, d):
    return B.relative_strength(bars(spark, d), index_bars(spark, d)).withColumns({c: F.col(c) + F.lit(0.0) for c in ("rs_5_pct", "rs_20_pct")})


TIER_SQL = "CASE WHEN adv IS NULL OR adv <= 0 THEN 'UNKNOWN' WHEN adv >= 5e8 THEN 'DEEP' WHEN adv >= 1e8 THEN 'HEALTHY' WHEN adv >= 2e7 THEN 'THIN' ELSE 'ILLIQUID' END"


@query("win24_dollar_adv", f"WITH {FEAT_SQL}, a AS (SELECT ticker, date, close * vol_ma20 * 1000 AS adv FROM feat) SELECT ticker, date, round(adv + 0.0001, 1) AS adv_dollar, {TIER_SQL} AS liquidity_tier FROM a")
def win24(spark, d):
    adv = F.col("close") * F.col("vol_ma20") * 1000
    tier = F.when(adv.isNull() | (adv <= 0), "UNKNOWN").when(adv >= 5e8, "DEEP").when(adv >= 1e8, "HEALTHY").when(adv >= 2e7, "THIN").otherwise("ILLIQUID")
    return feat(spark, d).select("ticker", "date", F.round(adv + 0.0001, 1).alias("adv_dollar"), tier.alias("liquidity_tier"))


@query("prj20_session_tone", f"""WITH {FEAT_SQL}, s AS (SELECT ticker, date, (close - prev_close) / prev_close AS p, CASE WHEN open > 0 THEN (close - open) / open ELSE 0 END AS o FROM feat WHERE prev_close > 0 AND close > 0)
SELECT ticker, date, round(p * 100, 2) + 0 AS px_vs_prior_close_pct, round(o * 100, 2) + 0 AS px_vs_open_pct, CASE WHEN p > 0.005 AND o > 0 THEN 'STRENGTH' WHEN p < -0.005 AND o < 0 THEN 'WEAKNESS' ELSE 'FLAT' END AS session_tone FROM s""")
def prj20(spark, d):
    f = feat(spark, d).filter("prev_close > 0 and close > 0")
    p, o = (F.col("close") - F.col("prev_close")) / F.col("prev_close"), F.when(F.col("open") > 0, F.try_divide(F.col("close") - F.col("open"), F.col("open"))).otherwise(0.0)
    tone = F.when((p > 0.005) & (o > 0), "STRENGTH").when((p < -0.005) & (o < 0), "WEAKNESS").otherwise("FLAT")
    return f.select("ticker", "date", (F.round(p * 100, 2) + F.lit(0.0)).alias("px_vs_prior_close_pct"), (F.round(o * 100, 2) + F.lit(0.0)).alias("px_vs_open_pct"), tone.alias("session_tone"))


@query("win25_forward_returns", f"""WITH {BARS_SQL}, f AS (SELECT *, lead(close) {WIN} AS nxt, last_value(close) {rows('CURRENT ROW', 'UNBOUNDED FOLLOWING')} AS fin, {', '.join(f'lead(close, {h}) {WIN} AS l{h}' for h in (1, 3, 5, 10, 20))} FROM bars)
SELECT ticker, date, {', '.join(f'round(CASE WHEN nxt IS NOT NULL THEN coalesce(l{h}, fin) / close - 1 END, 6) + 0 AS forward_return_{h}' for h in (1, 3, 5, 10, 20))} FROM f""")
def win25(spark, d):
    return bars(spark, d).select("ticker", "date", *[(F.round(c, 6) + F.lit(0.0)).alias(k) for k, c in B.forward_returns().items()])


@query("win27_drawdown", f"WITH {BARS_SQL}, p AS (SELECT *, max(close) {SOFAR} AS peak FROM bars), d AS (SELECT ticker, date, (peak - close) / peak AS dd FROM p) SELECT ticker, date, round(dd, 6) + 0 AS drawdown, round(max(dd) {SOFAR}, 6) + 0 AS max_drawdown FROM d")
def win27(spark, d):
    b = bars(spark, d).withColumn("dd", B.drawdown())
    return b.select("ticker", "date", (F.round("dd", 6) + F.lit(0.0)).alias("drawdown"), (F.round(F.max("dd").over(B.rows(Window.unboundedPreceding, 0)), 6) + F.lit(0.0)).alias("max_drawdown"))


@query("win29_vol_regime", f"""WITH {BARS_SQL}, r AS (SELECT ticker, date, close / lag(close) {WIN} - 1 AS r, row_number() {WIN} AS k FROM bars),
s AS (SELECT ticker, date, k, stddev_samp(r) {rows('4 PRECEDING', 'CURRENT ROW')} AS s5, stddev_samp(r) {rows('19 PRECEDING', 'CURRENT ROW')} AS s20 FROM r)
SELECT ticker, date, round(s5 / nullif(s20, 0), 6) AS vol_regime FROM s WHERE k >= 26""")
def win29(spark, d):
    r = bars(spark, d).withColumn("r", F.col("close") / F.lag("close").over(B.W()) - 1).withColumn("k", F.row_number().over(B.W()))
    s = r.select("ticker", "date", "k", F.round(F.try_divide(F.stddev_samp("r").over(B.rows(-4, 0)), F.nullif(F.stddev_samp("r").over(B.rows(-19, 0)), F.lit(0.0))), 6).alias("vol_regime"))
    return s.filter("k >= 26").drop("k")


@query("jon9_bars_as_of", f"""WITH {BARS_SQL}, q AS (SELECT DISTINCT ticker, event_date FROM flow_events)
SELECT q.ticker, q.event_date, b.date, b.close FROM q ASOF JOIN bars b ON q.ticker = b.ticker AND q.event_date >= b.date""")
def jon9(spark, d):
    """Latest bar on or before each date: both sides in one ordered window per ticker, last bar carried forward."""
    asked = flow_events(spark, d).select("ticker", F.col("event_date").alias("at")).distinct().withColumn("bar", F.lit(None).cast("struct<date:date,close:double>"))
    known = bars(spark, d).select("ticker", F.col("date").alias("at"), F.struct("date", "close").alias("bar"))
    w = Window.partitionBy("ticker").orderBy("at", F.col("bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked).withColumn("last", F.last("bar", ignorenulls=True).over(w))
    return both.filter("bar is null and last is not null").select("ticker", F.col("at").alias("event_date"), "last.date", "last.close")


@query("jon11_forward_bar", f"""WITH {INDEX_SQL}, n AS (SELECT ticker, date, close, row_number() {WIN} AS k FROM bars), x AS (SELECT date, close AS ic FROM index_bars)
SELECT a.ticker, a.date, round((b.close / a.close - 1) - (y.ic / x.ic - 1), 6) + 0 AS excess_5 FROM n a JOIN n b ON a.ticker = b.ticker AND b.k = a.k + 5 JOIN x ON x.date = a.date JOIN x y ON y.date = b.date""")
def jon11(spark, d):
    b = bars(spark, d).select("ticker", "date", "close", F.lead(F.struct("date", "close"), 5).over(B.W()).alias("n")).filter("n is not null")
    x = index_bars(spark, d).select(F.col("date").alias("xd"), F.col("close").alias("ic"))
    y = x.select(F.col("xd").alias("yd"), F.col("ic").alias("jc"))
    j = b.join(x, b["date"] == x["xd"]).join(y, F.col("n.date") == y["yd"])
    return j.select("ticker", "date", (F.round((F.col("n.close") / F.col("close") - 1) - (F.col("jc") / F.col("ic") - 1), 6) + F.lit(0.0)).alias("excess_5"))
